"""Encoders, fitted models, tuning and explanations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sparkcast.catalog.forecast_queries import slices
from sparkcast.catalog.readiness_queries import FS, filled
from sparkcast.catalog.registry import query, rnd_sql, rounded
from sparkcast.catalog.views import (
    DAILY,
    DAILY_SQL,
    MONTHLY,
    MONTHLY_SQL,
    ROLES,
    SALES,
    WEEKLY,
    WEEKLY_SQL,
    daily,
    monthly,
    sales,
    table,
    weekly,
    windows,
    windows_sql,
)
from sparkcast.config import MODELS, ForecastConfig
from sparkcast.operators import boosting, encoding, explain, linear, smoothing
from sparkcast.operators.baselines import PREDICTION_COLUMNS, evaluation_slices, series_histories
from sparkcast.operators.features import add_calendar, add_trend, target_copies
from sparkcast.operators.panel import aggregate_panel
from sparkcast.plans.experiment import run_experiment

CALENDAR = ("calendar_year", "calendar_quarter", "calendar_month", "calendar_week", "calendar_month_sin",
            "calendar_month_cos", "periods_since_start", "days_since_start")


def featured(panel, cfg):
    return add_trend(add_calendar(panel, cfg), cfg)


# --- encoders ---------------------------------------------------------------------------------


@query(
    "impute_median",
    f"""WITH {FS}, m AS (SELECT median(spend) AS s, median(units_sold) AS u FROM fs WHERE split = 'train')
    SELECT series, date, coalesce(spend, s) AS spend, coalesce(units_sold, u) AS units_sold FROM fs, m""",
)
def _(spark, sf):
    panel = filled(spark, sf)
    medians = encoding.fit_medians(panel.filter("split = 'train'"), ["spend", "units_sold"])
    return encoding.impute_median(panel, medians, ["spend", "units_sold"]).select("series", "date", "spend", "units_sold")


@query(
    "missing_indicator",
    f"""WITH {FS} SELECT series, date, CAST(spend IS NULL AS INTEGER) AS spend_missing FROM fs""",
)
def _(spark, sf):
    panel = filled(spark, sf)
    out = encoding.missing_indicators(panel, panel.filter("split = 'train'"), ["spend", "weekday"])
    return out.select("series", "date", *[c for c in out.columns if c.endswith("_missing")])


@query(
    "standard_scale",
    f"""WITH {FS}, m AS (SELECT avg(spend) AS a, stddev_pop(spend) AS d FROM fs WHERE split = 'train')
    SELECT series, date, {rnd_sql('(spend - a) / d')} AS spend FROM fs, m""",
)
def _(spark, sf):
    panel = filled(spark, sf)
    scales = encoding.fit_scales(panel.filter("split = 'train'"), ["spend"])
    return rounded(encoding.standard_scale(panel, scales, ["spend"]).select("series", "date", "spend"))


LABELLED_SQL = """lab AS (SELECT event_id, CASE WHEN event_id % 11 = 3 THEN NULL ELSE event_type END AS kind,
  ts < TIMESTAMP '2024-01-20' AS in_train FROM events)"""


def labelled(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        F.when(F.col("event_id") % 11 != 3, F.col("event_type")).alias("kind"),
        (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).alias("in_train"),
    )


@query(
    "impute_mode",
    f"""WITH {LABELLED_SQL}, c AS (SELECT kind, count(*) AS n FROM lab WHERE in_train AND kind IS NOT NULL GROUP BY 1)
    SELECT event_id, coalesce(kind, (SELECT kind FROM c ORDER BY n DESC, kind LIMIT 1)) AS kind FROM lab""",
)
def _(spark, sf):
    rows = labelled(spark, sf)
    return encoding.impute_mode(rows, rows.filter("in_train"), ["kind"]).select("event_id", "kind")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "one_hot",
    "SELECT o_orderkey, "
    + ", ".join(f"""CAST(o_orderpriority = '{p}' AS INTEGER) AS "priority={p}" """ for p in PRIORITIES)
    + " FROM orders",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    return encoding.one_hot(rows, rows, "priority").drop("priority")


@query(
    "one_hot_infrequent",
    """WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS k, count(*) AS n FROM lineitem GROUP BY 1),
    r AS (SELECT k, row_number() OVER (ORDER BY n DESC, k) AS i, count(*) OVER () AS total FROM c)
    SELECT l_orderkey, l_linenumber, l_suppkey, CAST(r.i > CASE WHEN total <= 20 THEN 20 ELSE 19 END AS INTEGER) AS rare
    FROM lineitem JOIN r ON r.k = CAST(l_suppkey AS VARCHAR)""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    coded = encoding.one_hot(rows, rows, "l_suppkey", max_categories=20)
    flag = F.col(f"`l_suppkey={encoding.INFREQUENT}`")
    return coded.select("l_orderkey", "l_linenumber", "l_suppkey", flag.alias("rare"))


@query(
    "ordinal_encode",
    f"""WITH {LABELLED_SQL}, d AS (SELECT kind, CAST(row_number() OVER (ORDER BY kind) - 1 AS INTEGER) AS code FROM
      (SELECT DISTINCT kind FROM lab WHERE in_train AND kind IS NOT NULL AND kind <> 'view'))
    SELECT event_id, coalesce(code, -1) AS kind FROM lab LEFT JOIN d ON lab.kind = d.kind""",
)
def _(spark, sf):
    rows = labelled(spark, sf)
    train = rows.filter("in_train and kind <> 'view'")
    return encoding.ordinal_encode(rows, encoding.fit_ordinals(train, "kind"), "kind").select("event_id", "kind")


@query(
    "covariate_encode",
    f"""WITH {FS}, m AS (SELECT median(spend) AS s FROM fs WHERE split = 'train'),
    d AS (SELECT channel, row_number() OVER (ORDER BY channel) - 1 AS code FROM (SELECT DISTINCT channel FROM fs
          WHERE split = 'train'))
    SELECT series, date, coalesce(spend, s) AS spend, CAST(d.code AS DOUBLE) AS channel FROM fs JOIN d USING (channel), m""",
)
def _(spark, sf):
    panel = filled(spark, sf)
    out = encoding.encode_covariates(panel, panel.filter("split = 'train'"), ["spend"], ["channel"])
    return out.select("series", "date", "spend", "channel")


@query(
    "target_copy_numeric",
    f"""WITH {DAILY_SQL} SELECT 'copy' AS feature_name, bool_and(revenue * 1 IS NOT DISTINCT FROM revenue) AS is_target_copy
    FROM daily UNION ALL SELECT 'spend', bool_and(spend IS NOT DISTINCT FROM revenue) FROM daily
    UNION ALL SELECT 'units_sold', bool_and(units_sold IS NOT DISTINCT FROM revenue) FROM daily""",
)
def _(spark, sf):
    panel = daily(spark, sf).withColumn("copy", F.col("revenue") * 1)
    return target_copies(panel, "revenue", ["copy", "spend", "units_sold"])


# --- fitted models ----------------------------------------------------------------------------

TREND_SQL = f"""{DAILY_SQL}, {windows_sql('daily')},
  t AS (SELECT channel, date, revenue, CAST(date - min(date) OVER (PARTITION BY channel) AS DOUBLE) AS x FROM daily),
  m AS (SELECT w.split, w.fold, w.validation_start, w.validation_end, count(*) AS n, avg(x) AS mx, avg(revenue) AS my,
        stddev_pop(x) AS sx, covar_pop(x, revenue) AS sxy FROM t JOIN win w ON t.date BETWEEN w.train_start AND w.train_end
        GROUP BY ALL)"""


def _trend(spark, sf, model):
    panel = daily(spark, sf)
    spans = linear.collect_windows(panel, windows(panel))
    rows = add_trend(panel, DAILY)
    return linear.forecast_linear(rows, DAILY, spans, ["days_since_start"], [model], categorical=[])


@query(
    "fc_linear_trend",
    f"""WITH {TREND_SQL} SELECT 'linear_regression' AS model, t.channel AS series, m.split, m.fold, t.date,
    {rnd_sql('t.revenue', 4)} AS actual, {rnd_sql('my + sxy / (sx * sx) * (x - mx)', 2)} AS prediction
    FROM t JOIN m ON t.date BETWEEN m.validation_start AND m.validation_end""",
)
def _(spark, sf):
    out = _trend(spark, sf, "linear_regression").drop("h", "residual")
    return rounded(rounded(out, 4, "actual"), 2, "prediction")


@query(
    "fc_ridge_trend",
    f"""WITH {TREND_SQL} SELECT 'ridge_regression' AS model, t.channel AS series, m.split, m.fold, t.date,
    {rnd_sql('t.revenue', 4)} AS actual, {rnd_sql('my + (n * sxy / sx) / (n + 1) * (x - mx) / sx', 2)} AS prediction
    FROM t JOIN m ON t.date BETWEEN m.validation_start AND m.validation_end""",
)
def _(spark, sf):
    out = _trend(spark, sf, "ridge_regression").drop("h", "residual")
    return rounded(rounded(out, 4, "actual"), 2, "prediction")


def _solve_sql(source: str, size: int) -> str:
    """Elimination of the system a_i_j (last column the right side), a row per window: step p clears column p in all other rows."""
    steps, last = [], source
    for p in range(size):
        kept = [
            f"a_{i}_{j}" + ("" if i == p else f" - a_{i}_{p} * a_{p}_{j} / a_{p}_{p} AS a_{i}_{j}")
            for i in range(size) for j in range(p + 1, size + 1)
        ]
        kept += [f"a_{i}_{i}" for i in range(p + 1)]
        steps.append(f"{source}{p} AS (SELECT k, {', '.join(kept)} FROM {last})")
        last = f"{source}{p}"
    return ", ".join(steps) + f", beta AS (SELECT k, [{', '.join(f'a_{i}_{size} / a_{i}_{i}' for i in range(size))}] AS b FROM {last})"


# days since the start are seven times the periods of a weekly panel, so without a penalty one of the two is enough
_PLAIN = ["year(date)", "quarter(date)", "month(date)", "week(date)", "sin(2 * pi() * month(date) / 12)", "cos(2 * pi() * month(date) / 12)",
          "row_number() OVER (PARTITION BY channel ORDER BY date) - 1"]
_DAYS = "date_diff('day', min(date) OVER (PARTITION BY channel), date)"


def _pooled_sql(model: str) -> str:
    """Group effects eliminated, then the slopes by elimination; without a penalty everything is centred within groups."""
    ridge = model == "ridge_regression"
    names = [*_PLAIN, _DAYS] if ridge else _PLAIN
    n = len(names)
    x = [f"x{i}" for i in range(n)]
    sql = f"""WITH {WEEKLY_SQL}, {windows_sql('weekly')},
  ft AS (SELECT channel AS series, date, revenue AS y, {', '.join(f'CAST({e} AS DOUBLE) AS {v}' for v, e in zip(x, names, strict=True))} FROM weekly),
  r AS (SELECT coalesce(w.fold, 0) AS k, w.split, w.fold, ft.*, date <= w.train_end AS train FROM ft JOIN win w ON date BETWEEN w.train_start AND w.validation_end),
  f AS (SELECT k, avg(y) AS m_y, {', '.join(f'avg({v}) AS m_{v}, coalesce(nullif(stddev_pop({v}), 0), 1) AS d_{v}' for v in x)} FROM r WHERE train GROUP BY k),
  z AS (SELECT k, split, fold, series, date, train, y - m_y AS t, m_y, 1e0 AS z0, {', '.join(f'({v} - m_{v}) / d_{v} AS z{i + 1}' for i, v in enumerate(x))} FROM r JOIN f USING (k)),
  g AS (SELECT k, series, sum(t) AS s_t, {', '.join(f'sum(z{i}) AS s{i}' for i in range(n + 1))} FROM z WHERE train GROUP BY ALL)"""
    first, penalty = (0, 1) if ridge else (1, 0)
    z = [f"z{i}" for i in range(first, n + 1)] + ["t"]
    s_ = [f"s{i}" for i in range(first, n + 1)] + ["s_t"]
    cells = [(i, j) for i in range(len(z) - 1) for j in range(len(z))]
    sql += f""",
  c AS (SELECT k, {', '.join(f'sum({z[i]} * {z[j]}) AS c_{i}_{j}' for i, j in cells)} FROM z WHERE train GROUP BY k),
  e AS (SELECT k, {', '.join(f'sum({s_[i]} * {s_[j]} / (s0 + {penalty})) AS e_{i}_{j}' for i, j in cells)} FROM g GROUP BY k),
  a AS (SELECT k, {', '.join(f'c_{i}_{j} - e_{i}_{j}' + (' + 1' if ridge and i == j and i > 0 else '') + f' AS a_{i}_{j}' for i, j in cells)} FROM c JOIN e USING (k)),
  {_solve_sql('a', len(z) - 1)}"""
    line = " + ".join(f"b[{i + 1}] * z{i + first}" for i in range(len(z) - 1))
    rest = " + ".join(f"b[{i + 1}] * s{i + first}" for i in range(len(z) - 1))
    pred = f"m_y + {line} + (s_t - ({rest})) / (s0 + {penalty})"
    return sql + f""" SELECT '{model}' AS model, series, split, fold, date, CAST(row_number() OVER (PARTITION BY series, k ORDER BY date) AS INTEGER) AS h,
    {rnd_sql('t + m_y', 2)} AS actual, {rnd_sql(pred, 2)} AS prediction, {rnd_sql(f'{pred} - t - m_y', 2)} AS residual
    FROM z JOIN beta USING (k) JOIN g USING (k, series) WHERE NOT train"""


def _pooled(spark, sf, model):
    panel = weekly(spark, sf)
    spans = linear.collect_windows(panel, windows(panel, WEEKLY))
    return linear.forecast_linear(featured(panel, WEEKLY), WEEKLY, spans, CALENDAR, [model])


@query("fc_linear", _pooled_sql("linear_regression"))
def _(spark, sf):
    return rounded(_pooled(spark, sf, "linear_regression"), 2)


@query("fc_ridge", _pooled_sql("ridge_regression"))
def _(spark, sf):
    return rounded(_pooled(spark, sf, "ridge_regression"), 2)


@query("fc_ses")
def _(spark, sf):
    return smoothing.forecast_smoothing(slices(spark, sf), ["simple_exponential_smoothing"], 7)


@query("fc_holt")
def _(spark, sf):
    return smoothing.forecast_smoothing(slices(spark, sf), ["holt_linear"], 7)


@query("fc_holt_winters")
def _(spark, sf):
    panel = monthly(spark, sf)
    parts = evaluation_slices(series_histories(panel, MONTHLY), windows(panel, MONTHLY))
    return smoothing.forecast_smoothing(parts, ["holt_winters"], 12)


@query("experiment")
def _(spark, sf):
    """All models on the monthly panel, boosted trees among them, ranked, the winner tested once."""
    panel = featured(monthly(spark, sf), MONTHLY)
    result = run_experiment(panel, MONTHLY, ForecastConfig(models=MODELS, moving_average_windows=(3, 12)), CALENDAR)
    tested = result.test_metrics.select("model", F.col("wape").alias("test_wape"))
    return result.ranking.join(tested, "model", "left")


NUMERIC = ("calendar_month", "calendar_quarter", "calendar_year", "days_since_start")
STUMPS = {"max_iter": 3, "max_depth": 1, "step_size": 0.5}


def _boosted_panel(spark, sf):
    cfg = replace(MONTHLY, group_columns=("channel",))
    panel = aggregate_panel(sales(spark, sf).drop("campaign"), cfg, ROLES)
    return cfg, featured(panel, cfg), linear.collect_windows(panel, windows(panel, cfg))


CHANNEL_SQL = f"""{SALES},
  monthly AS (SELECT channel, CAST(date_trunc('month', date) AS DATE) AS date, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales GROUP BY ALL),
  {windows_sql('monthly')},
  ft AS (SELECT channel, date, revenue AS y, [month(date) * 1e0, quarter(date) * 1e0, year(date) * 1e0,
      date_diff('day', min(date) OVER (PARTITION BY channel), date) * 1e0 LABELS] AS x FROM monthly),
  r0 AS (SELECT coalesce(w.fold, 0) AS k, w.split, w.fold, channel AS series, date, y, x, date <= w.train_end AS train, 0e0 AS pred
    FROM ft JOIN win w ON date BETWEEN w.train_start AND w.validation_end)"""


def _stumps_sql(key: str, labels: str, rounds: int = 3, rate: float = 0.5) -> tuple[str, str]:
    """Boosted stumps as SQL: each round takes the cut of the largest gain; equal gains go to the first feature and the lowest cut."""
    sql = CHANNEL_SQL.replace("LABELS", labels)
    sql += f""",
  p0 AS (SELECT * EXCLUDE (pred), avg(y) FILTER (train) OVER (PARTITION BY {key}) AS pred FROM r0)"""
    for i in range(1, rounds + 1):
        sql += f""",
  v{i} AS (SELECT {key}, f, x[f] AS v, sum(y - pred) AS g, count(*) AS n FROM p{i - 1}, range(1, len(x) + 1) t(f) WHERE train GROUP BY ALL),
  c{i} AS (SELECT *, sum(g) OVER a AS gl, sum(n) OVER a AS nl, sum(g) OVER b AS gt, sum(n) OVER b AS nt FROM v{i}
    WINDOW a AS (PARTITION BY {key}, f ORDER BY v), b AS (PARTITION BY {key}, f)),
  g{i} AS (SELECT *, gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl) - gt * gt / nt AS gain FROM c{i} WHERE nl < nt),
  m{i} AS (SELECT *, gain >= max(gain) OVER (PARTITION BY {key}) * (1 - 1e-9) AS top FROM g{i}),
  s{i} AS (SELECT * FROM m{i} WHERE top QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY f, v) = 1),
  p{i} AS (SELECT p.* REPLACE (p.pred + {rate} * CASE WHEN p.x[s.f] <= s.v THEN s.gl / s.nl ELSE (s.gt - s.gl) / (s.nt - s.nl) END AS pred)
    FROM p{i - 1} p JOIN s{i} s USING ({key}))"""
    out = f"""SELECT 'gradient_boosting' AS model, series, split, fold, date,
    CAST(row_number() OVER (PARTITION BY series, k ORDER BY date) AS INTEGER) AS h, {rnd_sql('y', 2)} AS actual,
    {rnd_sql('pred', 2)} AS prediction, {rnd_sql('pred - y', 2)} AS residual FROM p{rounds} WHERE NOT train"""
    return f"WITH {sql}", out


_CODE = ", CAST(dense_rank() OVER (ORDER BY channel) AS DOUBLE)"
_POOLED_STUMPS, _SERIES_STUMPS = _stumps_sql("k", _CODE), _stumps_sql("k, series", "")


@query("gbt_stumps", " ".join(_POOLED_STUMPS))
def _(spark, sf):
    """Pooled boosting at depth one, where every step has a closed form."""
    cfg, panel, spans = _boosted_panel(spark, sf)
    return rounded(boosting.forecast_boosted(panel, cfg, spans, NUMERIC, params=STUMPS), 2)


@query("gbt_series_stumps", " ".join(_SERIES_STUMPS))
def _(spark, sf):
    """The same, one model per series."""
    cfg, panel, spans = _boosted_panel(spark, sf)
    return rounded(boosting.forecast_boosted(panel, cfg, spans, NUMERIC, params=STUMPS, strategy="per_group"), 2)


@query("gbt_global")
def _(spark, sf):
    cfg, panel, spans = _boosted_panel(spark, sf)
    return boosting.forecast_boosted(panel, cfg, spans, NUMERIC, early_stopping=0.15)


@query("gbt_per_group")
def _(spark, sf):
    cfg, panel, spans = _boosted_panel(spark, sf)
    return boosting.forecast_boosted(panel, cfg, spans, NUMERIC, strategy="per_group")


@query("gbt_tuning")
def _(spark, sf):
    """Nine draws from the whole search space over all folds; two thirds leave at 6 trees, the rest are told apart at 18."""
    cfg, panel, spans = _boosted_panel(spark, sf)
    folds = [s for s in spans if s["split"] == "backtest"]
    return boosting.tune(panel, cfg, folds, NUMERIC, boosting.draw_parameters(9), early_stopping=0.15, rungs=(6, 18))


@query(
    "feature_importance",
    f"""{_POOLED_STUMPS[0]}, a AS (SELECT f, gain FROM s1 WHERE k = 0 UNION ALL SELECT f, gain FROM s2 WHERE k = 0 UNION ALL SELECT f, gain FROM s3 WHERE k = 0)
    SELECT n.feature, {rnd_sql('coalesce(sum(a.gain), 0) / (SELECT sum(gain) FROM a)')} AS importance
    FROM (SELECT unnest(['calendar_month', 'calendar_quarter', 'calendar_year', 'days_since_start', 'channel']) AS feature, unnest(range(1, 6)) AS f) n
    LEFT JOIN a USING (f) GROUP BY ALL""",
)
def _(spark, sf):
    cfg, panel, spans = _boosted_panel(spark, sf)
    encoded = boosting.encode(panel, cfg, spans[:1], NUMERIC, ["channel"])
    model = boosting.fit_pooled(encoded, [boosting.tree_params(STUMPS)])[0, 0]
    return rounded(boosting.feature_importance(encoded, model, panel))


@query(
    "tuning_summary",
    f"""WITH t AS (SELECT l_suppkey AS run_id, l_orderkey * 10 + l_linenumber AS trial,
      CASE WHEN l_partkey % 9 = 2 THEN 'failed' ELSE 'completed' END AS status, CAST(l_partkey AS VARCHAR) AS parameters,
      CASE WHEN l_partkey % 9 = 2 THEN NULL ELSE l_extendedprice END AS metric FROM lineitem)
    SELECT run_id, count(*) FILTER (status = 'completed') AS completed_trials,
    count(*) FILTER (status = 'failed') AS failed_trials, min(metric) AS best_score,
    first(parameters ORDER BY metric, trial) FILTER (status = 'completed') AS best_parameters FROM t GROUP BY run_id""",
)
def _(spark, sf):
    failed = F.col("l_partkey") % 9 == 2
    trials = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("run_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trial"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.col("l_partkey").cast("string").alias("parameters"),
        F.when(~failed, F.col("l_extendedprice")).alias("metric"),
    )
    return boosting.tuning_summary(trials, ["run_id"])


# --- explanations of a fixed linear score over line items -------------------------------------

SLOPES = {"quantity": 1500.0, "discount": -2000.0, "tax": 0.0}
ITEM_SQL = """item AS (SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax,
  l_quantity, l_discount, l_extendedprice) AS BIGINT)
  AS id, l_extendedprice AS y, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem)"""


def measures(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("y"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )


def items(spark, sf):
    """Line items under a number of their own, as no key of the table is unique."""
    from sparkcast.operators.ordered import with_position

    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "tax", "quantity", "discount", "y"]
    return with_position(measures(spark, sf), order, "id").select("id", "y", "quantity", "discount", "tax")


def score(df):
    return df.withColumn("prediction", sum((F.col(f) * s for f, s in SLOPES.items()), F.lit(12000.0)))


SCORE_SQL = "12000.0 + quantity * 1500.0 + discount * -2000.0 + tax * 0.0"


def _unit_sql(*parts: str) -> str:
    return f"CAST(CAST('0x' || substring(sha256({" || ':' || ".join(parts)}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496e0"


_STEPS = ", ".join(
    f"('{f}', {r}, {a}, {b})"
    for (f, r), (a, b) in zip([(f, r) for f in SLOPES for r in range(5)], explain.shuffle_steps(5 * len(SLOPES), 42), strict=True)
)


@query(
    "permutation_importance",
    f"""WITH {ITEM_SQL}, b AS (SELECT -avg(abs(y - ({SCORE_SQL}))) AS base, count(*) AS n FROM item),
    pos AS (SELECT *, row_number() OVER (ORDER BY {_unit_sql('CAST(id AS VARCHAR)', "'row'", "'42'")}) - 1 AS p FROM item),
    runs AS (SELECT * FROM (VALUES {_STEPS}) r(feature, rep, a, b)),
    sh AS (SELECT x.y, r.feature, r.rep, CASE r.feature WHEN 'quantity' THEN d.quantity ELSE x.quantity END AS quantity,
           CASE r.feature WHEN 'discount' THEN d.discount ELSE x.discount END AS discount,
           CASE r.feature WHEN 'tax' THEN d.tax ELSE x.tax END AS tax
           FROM pos x, b, runs r JOIN pos d ON d.p = (CAST(r.a AS BIGINT) * x.p + r.b) % n),
    s AS (SELECT feature, rep, base - (-avg(abs(y - ({SCORE_SQL})))) AS drop_ FROM sh, b GROUP BY feature, rep, base)
    SELECT feature, {rnd_sql('avg(drop_)', 3)} AS mean_decrease, {rnd_sql('stddev_pop(drop_)', 3)} AS std_decrease
    FROM s GROUP BY feature""",
)
def _(spark, sf):
    rows = items(spark, sf)
    return rounded(explain.permutation_importance(rows, "id", "y", list(SLOPES), score, lambda y, p: -F.avg(F.abs(y - p))), 3)


@query(
    "partial_dependence",
    f"""WITH {ITEM_SQL}, e AS (SELECT quantile_cont(quantity, 0.05) AS lo, quantile_cont(quantity, 0.95) AS hi FROM item),
    g AS (SELECT CAST(i AS INTEGER) AS point, lo + (hi - lo) * i / 19 AS v FROM range(20) t(i), e)
    SELECT point, {rnd_sql('v')} AS grid_value,
    {rnd_sql('avg(12000.0 + v * 1500.0 + discount * -2000.0 + tax * 0.0)', 3)} AS mean_prediction
    FROM item, g GROUP BY point, v""",
)
def _(spark, sf):
    out = explain.partial_dependence(measures(spark, sf), "quantity", score)
    return rounded(rounded(out, 6, "grid_value"), 3, "mean_prediction")


@query(
    "counterfactuals",
    f"""WITH {ITEM_SQL}, d AS (SELECT id, CAST(c AS INTEGER) AS candidate, quantity AS q0, discount AS d0, tax,
      {SCORE_SQL} AS baseline,
      quantity * 0.5 + quantity * {_unit_sql('CAST(id AS VARCHAR)', 'CAST(c AS VARCHAR)', "'quantity'", "'7'")} AS q,
      0.1 * {_unit_sql('CAST(id AS VARCHAR)', 'CAST(c AS VARCHAR)', "'discount'", "'7'")} AS dd FROM item, range(5) t(c)),
    h AS (SELECT *, 12000.0 + q * 1500.0 + dd * -2000.0 + tax * 0.0 AS pred FROM d)
    SELECT id, candidate, {rnd_sql('baseline', 3)} AS baseline_prediction, {rnd_sql('pred', 3)} AS counterfactual_prediction,
    {rnd_sql('sqrt((q - q0) * (q - q0) + (dd - d0) * (dd - d0))')} AS distance FROM h WHERE pred BETWEEN 60000 AND 61000""",
)
def _(spark, sf):
    out = explain.counterfactuals(
        items(spark, sf), "id", ["quantity", "discount"], score, (60000.0, 61000.0), {"discount": (0.0, 0.1)}, 5, 7
    )
    out = rounded(out.drop("changes"), 3, "baseline_prediction", "counterfactual_prediction")
    return rounded(out, 6, "distance")


@query(
    "anomaly_top5",
    f"""WITH l AS (SELECT o_orderkey AS id, unnest([
      {{'feature': 'price', 'v': o_totalprice / 1000}}, {{'feature': 'customer', 'v': -o_custkey / 10e0}},
      {{'feature': 'key', 'v': o_orderkey % 100 - 50e0}}, {{'feature': 'day', 'v': CAST(day(o_orderdate) AS DOUBLE)}},
      {{'feature': 'month', 'v': -CAST(month(o_orderdate) AS DOUBLE)}},
      {{'feature': 'year', 'v': year(o_orderdate) - 1990e0}}]) AS s FROM orders),
    r AS (SELECT id, s.feature AS feature, s.v AS v, row_number() OVER (PARTITION BY id ORDER BY abs(s.v) DESC, s.feature)
      AS k FROM l)
    SELECT id, CAST(k AS INTEGER) AS rank, feature, {rnd_sql('v')} AS contribution FROM r WHERE k <= 5""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_totalprice") / 1000).alias("price"),
        (-F.col("o_custkey") / 10.0).alias("customer"),
        (F.col("o_orderkey") % 100 - 50.0).alias("key"),
        F.dayofmonth("o_orderdate").cast("double").alias("day"),
        (-F.month("o_orderdate").cast("double")).alias("month"),
        (F.year("o_orderdate") - 1990.0).alias("year"),
    )
    names = ["price", "customer", "key", "day", "month", "year"]
    return rounded(explain.anomaly_drivers(rows, "id", names))


@query(
    "contribution_summary",
    f"""WITH {ITEM_SQL}, m AS (SELECT avg(quantity) AS q, avg(discount) AS d, avg(tax) AS t FROM item),
    c AS (SELECT 'quantity' AS feature, 1500 * (quantity - q) AS phi FROM item, m UNION ALL
          SELECT 'discount', -2000 * (discount - d) FROM item, m UNION ALL SELECT 'tax', 0 * (tax - t) FROM item, m),
    s AS (SELECT feature, avg(abs(phi)) AS a, avg(phi) AS v FROM c GROUP BY feature)
    SELECT feature, {rnd_sql('a', 3)} AS mean_absolute_contribution, {rnd_sql('v', 3)} AS mean_contribution,
    CAST(row_number() OVER (ORDER BY a DESC, feature) AS INTEGER) AS rank FROM s""",
)
def _(spark, sf):
    rows = measures(spark, sf).withColumn("id", F.col("l_orderkey"))
    out = explain.contribution_summary(explain.linear_contributions(rows, "id", SLOPES))
    return rounded(out.drop("direction"), 3)


