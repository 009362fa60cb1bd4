"""Forecast models, scores, residuals and selection on the daily sales panel."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sparkcast.catalog.registry import query, rnd_sql, rounded
from sparkcast.catalog.views import DAILY, DAILY_SQL, SALES, WEEKLY, WEEKLY_SQL, daily, sales, weekly, windows, windows_sql
from sparkcast.config import BASELINE_MODELS
from sparkcast.operators import baselines, evaluate
from sparkcast.operators.panel import aggregate_panel

SEASON = 7
WINDOWS_SQL = f"{DAILY_SQL}, {windows_sql('daily')}"
FINAL_SQL = f"{DAILY_SQL}, {windows_sql('daily', final_test=True)}"


def slices(spark, sf, final_test=False):
    panel = daily(spark, sf)
    return baselines.evaluation_slices(baselines.series_histories(panel, DAILY), windows(panel, DAILY, final_test))


def predictions(spark, sf, names=BASELINE_MODELS, final_test=False):
    return baselines.forecast_series(slices(spark, sf, final_test), baselines.baseline_models(names, SEASON))


def shown(df):
    return rounded(df.select(*baselines.PREDICTION_COLUMNS), 4)


# Each model as SQL rows (model, series, split, fold, date, h, actual, prediction).
NAIVE = """SELECT 'naive_last' AS model, o.series, o.split, o.fold, o.date, o.h, o.actual, t.y AS prediction
  FROM hold o JOIN hist t ON o.split = t.split AND o.fold IS NOT DISTINCT FROM t.fold AND o.series = t.series
  WHERE t.r = 1 AND t.n >= 2"""
SEASONAL = f"""SELECT 'seasonal_naive' AS model, o.series, o.split, o.fold, o.date, o.h, o.actual, t.y AS prediction
  FROM hold o JOIN hist t ON o.split = t.split AND o.fold IS NOT DISTINCT FROM t.fold AND o.series = t.series
  WHERE t.r = {SEASON} - (o.h - 1) % {SEASON} AND t.n >= {SEASON}"""
AVERAGE = """SELECT 'moving_average_' || k AS model, o.series, o.split, o.fold, o.date, o.h, o.actual,
         CAST(t.total AS DOUBLE) / k AS prediction
  FROM hold o JOIN (SELECT split, fold, series, k, sum(CAST(y AS DECIMAL(18,4))) AS total FROM hist,
                    (VALUES (7), (14), (28)) v(k) WHERE r <= k AND n >= k GROUP BY ALL) t
    ON o.split = t.split AND o.fold IS NOT DISTINCT FROM t.fold AND o.series = t.series"""
DRIFT = """SELECT 'drift' AS model, o.series, o.split, o.fold, o.date, o.h, o.actual,
         t.last + (t.last - t.first) / (t.n - 1) * o.h AS prediction
  FROM hold o JOIN (SELECT split, fold, series, n, max(y) FILTER (r = 1) AS last, max(y) FILTER (i = 1) AS first
                    FROM hist GROUP BY ALL HAVING n >= 2) t
    ON o.split = t.split AND o.fold IS NOT DISTINCT FROM t.fold AND o.series = t.series"""
ALL_MODELS = f"{NAIVE} UNION ALL {SEASONAL} UNION ALL {AVERAGE} UNION ALL {DRIFT}"
SHOWN = f"""model, series, split, fold, date, h, {rnd_sql('actual', 4)} AS actual,
  {rnd_sql('prediction', 4)} AS prediction, {rnd_sql('prediction - actual', 4)} AS residual"""
PRED_SQL = f"{WINDOWS_SQL}, p AS ({ALL_MODELS})"


def _model(name: str, model: str, sql: str) -> None:
    @query(name, f"WITH {WINDOWS_SQL}, p AS ({sql}) SELECT {SHOWN} FROM p")
    def _(spark, sf):
        return shown(predictions(spark, sf, [model]))


_model("fc_naive", "naive_last", NAIVE)
_model("fc_seasonal_naive", "seasonal_naive", SEASONAL)
_model("fc_moving_average", "moving_average", AVERAGE)
_model("fc_drift", "drift", DRIFT)


@query("predictions_table", f"WITH {PRED_SQL} SELECT {SHOWN} FROM p")
def _(spark, sf):
    return shown(predictions(spark, sf))


@query(
    "fc_final_test",
    f"WITH {FINAL_SQL}, p AS ({SEASONAL}) SELECT {SHOWN} FROM p WHERE split = 'test'",
)
def _(spark, sf):
    return shown(predictions(spark, sf, ["seasonal_naive"], final_test=True).filter("split = 'test'"))


@query(
    "prediction_frame",
    f"WITH {WINDOWS_SQL}, p AS ({SEASONAL}) SELECT {SHOWN} FROM p WHERE actual IS NOT NULL AND prediction IS NOT NULL",
)
def _(spark, sf):
    return shown(predictions(spark, sf, ["seasonal_naive"]))


ALPHA, BETA, PHI = 0.3, 0.1, 0.9


@query(
    "fc_ses_fixed",
    f"""WITH {WINDOWS_SQL}, l AS (SELECT split, fold, series, list(y ORDER BY i) AS ys FROM hist GROUP BY ALL),
    s AS (SELECT split, fold, series,
          list_reduce(ys, lambda a, y: a * (1 - CAST({ALPHA} AS DOUBLE)) + y * CAST({ALPHA} AS DOUBLE)) AS level FROM l),
    p AS (SELECT 'ses_fixed' AS model, o.*, s.level AS prediction FROM hold o JOIN s ON o.split = s.split
          AND o.fold IS NOT DISTINCT FROM s.fold AND o.series = s.series)
    SELECT model, series, split, fold, date, h, {rnd_sql('actual', 4)} AS actual, {rnd_sql('prediction', 2)} AS prediction
    FROM p""",
)
def _(spark, sf):
    out = baselines.forecast_series(slices(spark, sf), baselines.fixed_smoothing_models(ses=ALPHA))
    return rounded(rounded(out.drop("residual"), 4, "actual"), 2, "prediction")


@query(
    "fc_holt_fixed",
    f"""WITH RECURSIVE {WEEKLY_SQL}, {windows_sql('weekly')},
    s AS (
      SELECT a.split, a.fold, a.series, CAST(1 AS BIGINT) AS i, a.n, a.y AS level, b.y - a.y AS trend
      FROM hist a JOIN hist b ON a.split = b.split AND a.fold IS NOT DISTINCT FROM b.fold AND a.series = b.series
      WHERE a.i = 1 AND b.i = 2
      UNION ALL
      SELECT split, fold, series, i, n, new_level,
             trend * CAST({PHI} AS DOUBLE) * (1 - CAST({BETA} AS DOUBLE)) + (new_level - level) * CAST({BETA} AS DOUBLE)
      FROM (SELECT s.split, s.fold, s.series, h.i, s.n, s.level, s.trend,
                   (s.level + s.trend * CAST({PHI} AS DOUBLE)) * (1 - CAST({ALPHA} AS DOUBLE))
                     + h.y * CAST({ALPHA} AS DOUBLE) AS new_level
            FROM s JOIN hist h ON s.split = h.split AND s.fold IS NOT DISTINCT FROM h.fold AND s.series = h.series
            AND h.i = s.i + 1)),
    p AS (SELECT 'holt_fixed' AS model, o.*,
                 s.level + s.trend * CAST({PHI} AS DOUBLE) * (1 - pow(CAST({PHI} AS DOUBLE), o.h)) / (1 - CAST({PHI} AS DOUBLE))
                   AS prediction
          FROM hold o JOIN s ON o.split = s.split AND o.fold IS NOT DISTINCT FROM s.fold AND o.series = s.series
          WHERE s.i = s.n)
    SELECT model, series, split, fold, date, h, {rnd_sql('actual', 4)} AS actual, {rnd_sql('prediction', 2)} AS prediction
    FROM p""",
)
def _(spark, sf):
    panel = weekly(spark, sf)
    parts = baselines.evaluation_slices(baselines.series_histories(panel, WEEKLY), windows(panel, WEEKLY))
    out = baselines.forecast_series(parts, baselines.fixed_smoothing_models(holt=(ALPHA, BETA, PHI)))
    return rounded(rounded(out.drop("residual"), 4, "actual"), 2, "prediction")


# Suppliers sell on few days, so many of their series are too short for some models.
THIN = replace(DAILY, group_columns=("supplier",), frequency="quarterly")
THIN_SQL = """sales AS (SELECT CAST(l_suppkey AS VARCHAR) || '-' || l_returnflag || l_linestatus AS channel,
    CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date, CAST(l_extendedprice AS DECIMAL(12,2)) AS revenue
    FROM lineitem),
  thin AS (SELECT channel, date, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales GROUP BY ALL)"""


def thin_slices(spark, sf):
    raw = sales(spark, sf, with_order=True).select(
        F.concat_ws("-", "l_suppkey", F.concat("channel", "campaign")).alias("supplier"), "date", "revenue"
    )
    panel = aggregate_panel(raw, THIN, {"date": "date", "revenue": "revenue"})
    return baselines.evaluation_slices(baselines.series_histories(panel, THIN), windows(panel, THIN))


@query(
    "fc_skipped",
    f"""WITH {THIN_SQL}, {windows_sql('thin')},
    c AS (SELECT o.split, o.fold, o.series, coalesce(max(t.n), 0) AS n FROM hold o LEFT JOIN hist t
          ON o.split = t.split AND o.fold IS NOT DISTINCT FROM t.fold AND o.series = t.series GROUP BY ALL),
    m AS (SELECT * FROM (VALUES ('naive_last', 2, ''), ('seasonal_naive', 7, 'Insufficient seasonal history'),
          ('moving_average_7', 7, 'Insufficient history for moving average 7'),
          ('moving_average_14', 14, 'Insufficient history for moving average 14'),
          ('moving_average_28', 28, 'Insufficient history for moving average 28'), ('drift', 2, '')) v(model, need, why))
    SELECT model, series, split, fold, CAST(n AS INTEGER) AS history,
    CASE WHEN n < 2 THEN 'Insufficient group history' ELSE why END AS reason FROM c, m WHERE n < need""",
)
def _(spark, sf):
    return baselines.skipped_series(thin_slices(spark, sf), baselines.baseline_models(BASELINE_MODELS, SEASON))


# --- scores -----------------------------------------------------------------------------------

BASIC = f"""count(*) AS row_count, {rnd_sql('avg(abs(prediction - actual))', 4)} AS mae,
  {rnd_sql('sqrt(avg((prediction - actual) * (prediction - actual)))', 4)} AS rmse,
  {rnd_sql('avg(prediction - actual)', 4)} AS bias, {rnd_sql('avg(prediction - actual)', 4)} AS mean_error,
  {rnd_sql('median(abs(prediction - actual))', 4)} AS median_absolute_error"""
WAPE = "CASE WHEN sum(abs(actual)) > 1e-8 THEN sum(abs(prediction - actual)) / sum(abs(actual)) END"
SMAPE = """avg(CASE WHEN abs(actual) + abs(prediction) > 1e-8
  THEN 2 * abs(prediction - actual) / (abs(actual) + abs(prediction)) ELSE 0 END)"""
KEYS = ("model", "split", "fold")


def scored(spark, sf, keys=KEYS):
    return evaluate.metrics(predictions(spark, sf), keys)


@query("metrics_basic", f"WITH {PRED_SQL} SELECT model, split, fold, {BASIC} FROM p GROUP BY model, split, fold")
def _(spark, sf):
    out = scored(spark, sf)
    return rounded(out.drop("wape", "smape"), 4)


@query("metrics_wape", f"WITH {PRED_SQL} SELECT model, split, fold, {rnd_sql(WAPE)} AS wape FROM p GROUP BY ALL")
def _(spark, sf):
    return rounded(scored(spark, sf).select(*KEYS, "wape"))


@query("metrics_smape", f"WITH {PRED_SQL} SELECT model, split, fold, {rnd_sql(SMAPE)} AS smape FROM p GROUP BY ALL")
def _(spark, sf):
    return rounded(scored(spark, sf).select(*KEYS, "smape"))


SCALE_SQL = f"""gap AS (SELECT split, fold, series, abs(y - lag(y, CASE WHEN n > {SEASON} THEN {SEASON} ELSE 1 END)
       OVER (PARTITION BY split, fold, series ORDER BY i)) AS g FROM hist),
  own AS (SELECT split, fold, series, avg(g) AS scale, sum(g) AS total, count(g) AS k FROM gap GROUP BY ALL)"""


@query(
    "metrics_mase",
    f"""WITH {PRED_SQL}, {SCALE_SQL}, sc AS (SELECT split, fold, avg(scale) AS scale FROM own GROUP BY ALL),
    a AS (SELECT model, split, fold, avg(abs(prediction - actual)) AS mae FROM p GROUP BY ALL)
    SELECT a.model, a.split, a.fold, {rnd_sql('CASE WHEN scale > 1e-8 THEN mae / scale END')} AS mase
    FROM a LEFT JOIN sc ON a.split = sc.split AND a.fold IS NOT DISTINCT FROM sc.fold""",
)
def _(spark, sf):
    parts = slices(spark, sf)
    p = baselines.forecast_series(parts, baselines.baseline_models(BASELINE_MODELS, SEASON))
    return rounded(evaluate.metrics(p, KEYS, evaluate.naive_scales(parts, SEASON)).select(*KEYS, "mase"))


@query(
    "metrics_mase_pooled",
    f"""WITH {PRED_SQL}, {SCALE_SQL}, sc AS (SELECT split, fold, sum(total) / sum(k) AS scale FROM own GROUP BY ALL),
    a AS (SELECT model, split, fold, avg(abs(prediction - actual)) AS mae FROM p GROUP BY ALL)
    SELECT a.model, a.split, a.fold, {rnd_sql('CASE WHEN scale > 1e-8 THEN mae / scale END')} AS mase
    FROM a LEFT JOIN sc ON a.split = sc.split AND a.fold IS NOT DISTINCT FROM sc.fold""",
)
def _(spark, sf):
    parts = slices(spark, sf)
    p = baselines.forecast_series(parts, baselines.baseline_models(BASELINE_MODELS, SEASON))
    return rounded(evaluate.metrics(p, KEYS, evaluate.pooled_scales(parts, SEASON)).select(*KEYS, "mase"))


@query(
    "metrics_mape_r2",
    f"""WITH {PRED_SQL} SELECT model, split, fold, count(*) AS row_count,
    {rnd_sql('avg(CASE WHEN abs(actual) > 1e-8 THEN abs(prediction - actual) / abs(actual) END)')} AS mape,
    {rnd_sql('1 - sum((prediction - actual) * (prediction - actual)) / (var_pop(actual) * count(*))')} AS r2
    FROM p GROUP BY model, split, fold""",
)
def _(spark, sf):
    out = evaluate.regression_metrics(predictions(spark, sf))
    return rounded(out.select(*KEYS, "row_count", "mape", "r2"))


@query(
    "metrics_by_group",
    f"""WITH {PRED_SQL} SELECT model, split, fold, series, count(*) AS row_count,
    {rnd_sql('avg(abs(prediction - actual))', 4)} AS mae, {rnd_sql(WAPE)} AS wape,
    {rnd_sql('median(abs(prediction - actual))', 4)} AS median_absolute_error
    FROM p WHERE model = 'seasonal_naive' GROUP BY model, split, fold, series""",
)
def _(spark, sf):
    keys = (*KEYS, "series")
    out = evaluate.metrics(predictions(spark, sf, ["seasonal_naive"]), keys)
    return rounded(rounded(out.select(*keys, "row_count", "mae", "wape", "median_absolute_error"), 4, "mae",
                           "median_absolute_error"), 6, "wape")


BACKTEST_SQL = f"""b AS (SELECT model, fold, grouping(fold) AS pooled, count(*) AS row_count,
       avg(abs(prediction - actual)) AS mae, {WAPE} AS wape, {SMAPE} AS smape
       FROM p WHERE split = 'backtest' GROUP BY GROUPING SETS ((model, fold), (model))),
  d AS (SELECT model, stddev_pop(wape) AS deviation FROM b WHERE pooled = 0 GROUP BY model)"""


@query(
    "metrics_backtest",
    f"""WITH {PRED_SQL}, {BACKTEST_SQL} SELECT b.model, fold, row_count, {rnd_sql('mae', 4)} AS mae,
    {rnd_sql('wape')} AS wape, {rnd_sql('CASE WHEN pooled = 1 THEN deviation END')} AS fold_wape_deviation
    FROM b JOIN d ON b.model = d.model""",
)
def _(spark, sf):
    out = evaluate.backtest_metrics(predictions(spark, sf)).select(
        "model", "fold", "row_count", "mae", "wape", "fold_wape_deviation"
    )
    return rounded(rounded(out, 4, "mae"), 6, "wape", "fold_wape_deviation")


@query(
    "residual_summary",
    f"""WITH {PRED_SQL}, e AS (SELECT *, prediction - actual AS r, lag(prediction - actual) OVER
      (PARTITION BY model, split, fold, series ORDER BY date) AS before FROM p),
    s AS (SELECT model, split, fold, count(r) AS row_count, avg(r) AS mean, stddev_pop(r) AS sd, median(r) AS median,
          min(r) AS minimum, max(r) AS maximum, avg(CAST(r > 0 AS INTEGER)) AS positive_ratio,
          corr(before, r) AS ac FROM e GROUP BY ALL),
    g AS (SELECT s.model, s.split, s.fold, count(*) FILTER (sd > 0 AND abs(r) > 3 * sd) AS large_residual_count
          FROM s JOIN e ON s.model = e.model AND s.split = e.split AND s.fold IS NOT DISTINCT FROM e.fold GROUP BY ALL)
    SELECT s.model, s.split, s.fold, row_count, {rnd_sql('mean', 4)} AS mean, {rnd_sql('sd', 4)} AS standard_deviation,
    {rnd_sql('median', 4)} AS median, {rnd_sql('minimum', 4)} AS minimum, {rnd_sql('maximum', 4)} AS maximum,
    {rnd_sql('positive_ratio')} AS positive_ratio, {rnd_sql('ac')} AS autocorrelation_lag_1, large_residual_count
    FROM s JOIN g ON s.model = g.model AND s.split = g.split AND s.fold IS NOT DISTINCT FROM g.fold""",
)
def _(spark, sf):
    out = evaluate.residual_summary(predictions(spark, sf))
    wide = ("mean", "standard_deviation", "median", "minimum", "maximum")
    return rounded(rounded(out, 4, *wide), 6, "positive_ratio", "autocorrelation_lag_1")


DIAG_SQL = """d0 AS (SELECT *, actual - prediction AS r, avg(actual - prediction) OVER
      (PARTITION BY model, split, fold, series) AS m FROM p),
    d1 AS (SELECT *, r - m AS d, lead(r - m) OVER (PARTITION BY model, split, fold, series ORDER BY date) AS nx FROM d0),
    diag AS (SELECT model, series, split, fold, count(*) AS row_count, avg(r) AS mean_residual,
      sqrt(avg(d * d)) AS std_residual, avg(abs(r)) AS mae,
      CASE WHEN avg(d * d) > 0 THEN sum(d * d * d) / (count(*) * pow(sqrt(avg(d * d)), 3)) ELSE 0 END AS skewness,
      CASE WHEN count(*) > 1 AND avg(d * d) > 0 THEN sum(d * nx) / ((count(*) - 1) * avg(d * d)) ELSE 0 END
        AS autocorrelation_lag1 FROM d1 GROUP BY ALL)"""


@query(
    "residual_diagnostics",
    f"""WITH {PRED_SQL}, {DIAG_SQL} SELECT model, series, split, fold, row_count,
    {rnd_sql('mean_residual', 4)} AS mean_residual, {rnd_sql('std_residual', 4)} AS std_residual,
    {rnd_sql('mae', 4)} AS mae, {rnd_sql('skewness')} AS skewness,
    {rnd_sql('autocorrelation_lag1')} AS autocorrelation_lag1,
    CASE WHEN mean_residual < 0 THEN 'over_predicting' WHEN mean_residual > 0 THEN 'under_predicting' ELSE 'neutral' END
      AS bias FROM diag""",
)
def _(spark, sf):
    out = evaluate.residual_diagnostics(predictions(spark, sf))
    return rounded(rounded(out, 4, "mean_residual", "std_residual", "mae"), 6, "skewness", "autocorrelation_lag1")


@query(
    "root_cause_labels",
    f"""WITH {PRED_SQL}, {DIAG_SQL} SELECT model, series, split, fold,
    CASE WHEN mean_residual > 10 AND autocorrelation_lag1 > 0.5 THEN
      ['Significant under-prediction bias detected.',
       'High residual autocorrelation suggests missing lagged features or seasonality.']
    WHEN mean_residual > 10 THEN ['Significant under-prediction bias detected.']
    WHEN autocorrelation_lag1 > 0.5 THEN
      ['High residual autocorrelation suggests missing lagged features or seasonality.']
    ELSE ['No obvious root causes identified in standard residuals.'] END AS suspected_causes,
    CASE WHEN mean_residual > 10 THEN 'high' WHEN autocorrelation_lag1 > 0.5 THEN 'medium' ELSE 'low' END AS severity,
    CAST(CASE WHEN mean_residual > 10 OR autocorrelation_lag1 > 0.5 THEN 0.6 ELSE 0.9 END AS DOUBLE) AS confidence
    FROM diag""",
)
def _(spark, sf):
    out = evaluate.error_causes(evaluate.residual_diagnostics(predictions(spark, sf)))
    return out.select("model", "series", "split", "fold", "suspected_causes", "severity", "confidence")


RANK_SQL = f"""{PRED_SQL}, {BACKTEST_SQL},
  v AS (SELECT model, {WAPE} AS validation_score FROM p WHERE split = 'validation' GROUP BY model),
  rk AS (SELECT b.model, b.wape AS backtest_score, v.validation_score, d.deviation,
         CAST(row_number() OVER (ORDER BY b.wape, v.validation_score, d.deviation, b.model) AS INTEGER) AS rank
         FROM b JOIN d ON b.model = d.model JOIN v ON b.model = v.model WHERE b.pooled = 1)"""


def ranking(spark, sf):
    p = predictions(spark, sf)
    return evaluate.rank_models(evaluate.metrics(p), evaluate.backtest_metrics(p))


@query(
    "model_ranking",
    f"""WITH {RANK_SQL} SELECT model, rank, rank = 1 AS selected, {rnd_sql('backtest_score')} AS backtest_score,
    {rnd_sql('validation_score')} AS validation_score, {rnd_sql('deviation')} AS fold_wape_deviation,
    {rnd_sql('rank + deviation')} AS selection_score FROM rk""",
)
def _(spark, sf):
    return rounded(ranking(spark, sf))


@query(
    "model_comparison",
    f"""WITH {RANK_SQL}, runs AS (SELECT DISTINCT model FROM p UNION ALL SELECT 'not_ranked')
    SELECT runs.model, rank, {rnd_sql('rank + deviation')} AS selection_score, coalesce(rank = 1, false) AS selected,
    CAST(row_number() OVER (ORDER BY rank NULLS LAST, runs.model) AS INTEGER) AS position
    FROM runs LEFT JOIN rk ON runs.model = rk.model""",
)
def _(spark, sf):
    names = predictions(spark, sf).select("model").distinct()
    runs = names.union(names.sparkSession.createDataFrame([("not_ranked",)], "model string"))
    return rounded(evaluate.model_comparison(runs, ranking(spark, sf)))


@query(
    "prediction_join",
    f"""WITH {PRED_SQL} SELECT p.series AS unique_id, p.date AS ds, p.model, {rnd_sql('p.prediction', 4)} AS prediction,
    {rnd_sql('d.revenue', 4)} AS y, {rnd_sql('p.prediction - d.revenue', 4)} AS residual
    FROM p JOIN daily d ON p.series = d.channel AND p.date = d.date WHERE p.split = 'validation'""",
)
def _(spark, sf):
    p = predictions(spark, sf).filter("split = 'validation'")
    forecasts = p.select(F.col("series").alias("unique_id"), F.col("date").alias("ds"), "model", "prediction")
    actuals = daily(spark, sf).select(
        F.col("channel").alias("unique_id"), F.col("date").alias("ds"), F.col("revenue").alias("y")
    )
    return rounded(evaluate.join_actuals(forecasts, actuals), 4)


@query(
    "model_disagreement",
    f"""WITH {PRED_SQL}, j AS (SELECT a.split, a.fold, a.prediction AS a, b.prediction AS b FROM p a JOIN p b
      ON a.series = b.series AND a.split = b.split AND a.fold IS NOT DISTINCT FROM b.fold AND a.date = b.date
      WHERE a.model = 'seasonal_naive' AND b.model = 'drift'),
    s AS (SELECT split, fold, count(*) AS row_count, avg(abs(a - b)) AS d, max(abs(a - b)) AS x,
          coalesce(corr(a, b), 1) AS c FROM j GROUP BY ALL)
    SELECT split, fold, row_count, {rnd_sql('d', 4)} AS mean_absolute_difference, {rnd_sql('x', 4)} AS max_difference,
    {rnd_sql('c')} AS prediction_correlation, {rnd_sql('1 - greatest(0, c)')} AS disagreement_score FROM s""",
)
def _(spark, sf):
    out = evaluate.model_disagreement(predictions(spark, sf), "seasonal_naive", "drift")
    out = rounded(out, 4, "mean_absolute_difference", "max_difference")
    return rounded(out, 6, "prediction_correlation", "disagreement_score")


@query(
    "predictions_page",
    f"""WITH {PRED_SQL}, f AS (SELECT * FROM p WHERE model = 'seasonal_naive' AND split = 'backtest' AND fold = 2)
    SELECT (SELECT count(*) FROM f) AS total, date, series, {rnd_sql('actual', 4)} AS actual,
    {rnd_sql('prediction', 4)} AS prediction FROM f ORDER BY date, series LIMIT 50 OFFSET 50""",
)
def _(spark, sf):
    from sparkcast.sources.tables import page

    p = predictions(spark, sf, ["seasonal_naive"]).filter("split = 'backtest' and fold = 2")
    out = page(p, ["date", "series"], number=2, size=50)
    return rounded(out.select("total", "date", "series", "actual", "prediction"), 4)
