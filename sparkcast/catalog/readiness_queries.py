"""Readiness of the monthly sales panel for sequence models, and the tables such models read."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sparkcast.catalog.registry import query, rnd_sql, rounded
from sparkcast.catalog.views import (
    DAILY,
    DAILY_SQL,
    MONTHLY,
    MONTHLY_SQL,
    ROLES,
    axis_sql,
    daily,
    monthly,
    sales,
    split_daily,
    table,
)
from sparkcast.operators import readiness as ready
from sparkcast.operators.features import feature_catalog
from sparkcast.operators.panel import aggregate_panel, align_panel
from sparkcast.operators.splits import assign_split

SPLIT_SQL = f"""{DAILY_SQL}, {axis_sql('daily')}, sd AS (SELECT daily.*, CASE WHEN date <= train_end THEN 'train'
  WHEN date <= validation_end THEN 'validation' ELSE 'test' END AS split FROM daily, bounds)"""

# Line items as a panel that is not yet regular: a supplier may ship several lines on one day.
SHIP_SQL = "ship AS (SELECT l_suppkey AS series, CAST(l_shipdate AS DATE) AS date, l_quantity AS y FROM lineitem)"


def shipments(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("series"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("y")
    )


@query(
    "panel_duplicates",
    f"""WITH {SHIP_SQL}, c AS (SELECT series, date, count(*) AS n FROM ship GROUP BY ALL)
    SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, count(*) FILTER (n > 1) AS duplicate_keys FROM c""",
)
def _(spark, sf):
    return ready.panel_duplicates(shipments(spark, sf), ["series", "date"])


@query(
    "panel_irregular",
    f"""WITH {SHIP_SQL}, u AS (SELECT DISTINCT series, date FROM ship),
    l AS (SELECT series, coalesce(date - lag(date) OVER (PARTITION BY series ORDER BY date) <> 1, false) AS wrong FROM u),
    s AS (SELECT series, count(*) FILTER (wrong) AS n FROM l GROUP BY 1)
    SELECT count(*) AS series_count, count(*) FILTER (n > 0) AS irregular_series,
    CAST(sum(n) AS BIGINT) AS irregular_steps FROM s""",
)
def _(spark, sf):
    days = shipments(spark, sf).select("series", "date").distinct()
    return ready.irregular_series(days, "series", "date", "daily")


@query(
    "panel_irregular_monthly",
    f"""WITH {SHIP_SQL}, u AS (SELECT DISTINCT series, date FROM ship),
    l AS (SELECT series, coalesce(date_trunc('month', date) = date_trunc('month', lag(date) OVER
      (PARTITION BY series ORDER BY date)), false) AS wrong FROM u),
    s AS (SELECT series, count(*) FILTER (wrong) AS n FROM l GROUP BY 1)
    SELECT count(*) AS series_count, count(*) FILTER (n > 0) AS irregular_series,
    CAST(sum(n) AS BIGINT) AS irregular_steps FROM s""",
)
def _(spark, sf):
    days = shipments(spark, sf).select("series", "date").distinct()
    return ready.irregular_series(days, "series", "date", "monthly")


@query(
    "panel_blockers",
    """WITH t AS (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS kind,
      CASE WHEN event_id % 50 = 3 THEN NULL ELSE CAST(ts AS DATE) END AS date,
      CASE WHEN event_id % 40 = 7 THEN CAST('inf' AS DOUBLE) WHEN event_id % 30 = 2 THEN NULL
           WHEN event_id % 20 = 1 THEN -value ELSE value END AS y FROM events)
    SELECT count(*) AS row_count, count(*) FILTER (kind IS NULL) AS missing_group_ids,
    count(*) FILTER (date IS NULL) AS invalid_times, count(*) FILTER (isinf(y)) AS infinite_targets,
    count(*) FILTER (y IS NULL) AS missing_targets, count(*) FILTER (y < -1) AS below_log1p FROM t""",
)
def _(spark, sf):
    i, v = F.col("event_id"), F.col("value")
    t = table(spark, sf, "events").select(
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"),
        F.when(i % 50 != 3, F.col("ts").cast("date")).alias("date"),
        F.when(i % 40 == 7, float("inf")).when(i % 30 == 2, F.lit(None)).when(i % 20 == 1, -v).otherwise(v).alias("y"),
    )
    return ready.panel_blockers(t, ["kind"], "date", "y")


# Column classes of the sales table, decided from its own data.
CLASS_CFG = replace(DAILY, lag_periods=(1, 7), rolling_windows=(7,), include_holiday_features=True)


def sales_mapping(spark, sf):
    """Column types of the sales table as seen by a scan of it."""
    from sparkcast.operators.profile import physical_types, column_profile

    raw = sales(spark, sf, with_order=True).drop("l_linenumber", "l_partkey", "l_suppkey", "l_tax")
    names = [c for c in raw.columns if c != "l_orderkey"]
    kinds = physical_types(column_profile(raw, names, "l_orderkey")).select("column_index", "column_name", "physical_type")
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return kinds.withColumn("semantic_role", F.element_at(roles, F.col("column_name")))


def catalog(spark, sf):
    return feature_catalog(sales_mapping(spark, sf), CLASS_CFG, ROLES)


KINDS_SQL = """kinds AS (SELECT 'channel' AS name, CASE WHEN count(DISTINCT l_returnflag) <= 50 THEN 'categorical' END AS kind
    FROM lineitem UNION ALL SELECT 'campaign', CASE WHEN count(DISTINCT l_linestatus) <= 50 THEN 'categorical' END
    FROM lineitem UNION ALL SELECT 'date', CASE WHEN count(l_shipdate) > 0 THEN 'date' END FROM lineitem
    UNION ALL SELECT 'revenue', CASE WHEN count(l_extendedprice) > 0 THEN 'float' END FROM lineitem
    UNION ALL SELECT 'spend', CASE WHEN count(l_discount) > 0 THEN 'float' END FROM lineitem
    UNION ALL SELECT 'units_sold', CASE WHEN bool_and(l_quantity = floor(l_quantity)) THEN 'integer' ELSE 'float' END
    FROM lineitem)"""
CATALOG_SQL = KINDS_SQL + """, cat AS (
  SELECT name AS feature_name, CASE WHEN name = 'revenue' THEN 'target' WHEN name = 'date' THEN 'date'
    WHEN kind = 'categorical' THEN 'dimension' ELSE 'raw_numeric' END AS feature_type, kind AS physical_type,
    CASE WHEN name = 'revenue' THEN 'target_derived' ELSE 'unknown' END AS availability_type,
    CASE WHEN name = 'revenue' THEN 'excluded_target' ELSE 'review' END AS leakage_risk, true AS included,
    false AS generated FROM kinds
  UNION ALL SELECT n, 'lag', 'float', 'historical_only', 'none', true, true
    FROM (VALUES ('revenue_lag_1'), ('revenue_lag_7')) v(n)
  UNION ALL SELECT 'revenue_rolling_mean_7', 'rolling', 'float', 'historical_only', 'none', true, true
  UNION ALL SELECT n, 'calendar', 'float', 'known_in_advance', 'none', true, true FROM (VALUES ('calendar_year'),
    ('calendar_quarter'), ('calendar_month'), ('calendar_week'), ('calendar_day_of_week'), ('calendar_is_weekend'),
    ('calendar_month_sin'), ('calendar_month_cos')) v(n)
  UNION ALL SELECT n, 'trend', 'float', 'known_in_advance', 'none', true, true
    FROM (VALUES ('periods_since_start'), ('days_since_start')) v(n)
  UNION ALL SELECT 'is_holiday', 'holiday', 'float', 'known_in_advance', 'none', true, true
  UNION ALL SELECT 'roas', 'derived_metric', 'float', 'target_derived', 'target_derived', false, true)"""


@query("feature_catalog", f"WITH {CATALOG_SQL} SELECT * FROM cat")
def _(spark, sf):
    return catalog(spark, sf).select(
        "feature_name", "feature_type", "physical_type", "availability_type", "leakage_risk", "included", "generated"
    )


@query(
    "catalog_warnings",
    f"""WITH {CATALOG_SQL} SELECT 'TARGET_DERIVED_EXCLUDED' AS code, feature_name ||
    ' was excluded because it uses the same-period target.' AS message FROM cat
    WHERE generated AND leakage_risk = 'target_derived'""",
)
def _(spark, sf):
    from sparkcast.operators.features import catalog_warnings

    return catalog_warnings(catalog(spark, sf))


@query(
    "safe_linear_features",
    f"""WITH {CATALOG_SQL} SELECT feature_name, feature_type, availability_type FROM cat WHERE included
    AND availability_type = 'known_in_advance' AND leakage_risk = 'none' AND feature_name <> 'revenue'""",
)
def _(spark, sf):
    from sparkcast.operators.features import safe_linear_features

    return safe_linear_features(catalog(spark, sf), CLASS_CFG)


@query(
    "safe_gbm_features",
    f"""WITH {CATALOG_SQL} SELECT feature_name, feature_type, availability_type, feature_name = 'channel' OR (included
    AND feature_name <> 'revenue' AND leakage_risk = 'none' AND availability_type IN ('known_in_advance',
    'observed_at_prediction_time') AND feature_type NOT IN ('target', 'date', 'identifier', 'text', 'lag', 'rolling'))
    AS allowed FROM cat""",
)
def _(spark, sf):
    from sparkcast.operators.features import safe_boosted_features

    return safe_boosted_features(catalog(spark, sf), CLASS_CFG)


@query(
    "covariate_classes",
    f"""WITH {CATALOG_SQL}, u AS (SELECT *, feature_name = 'revenue' AS is_target, availability_type = 'target_derived'
      OR regexp_matches(lower(feature_name), 'roas|average_order_value|revenue_per_click|revenue_per_impression|campaign_success|settlement')
      AS derived FROM cat), w AS (SELECT *, is_target OR NOT included OR derived OR leakage_risk NOT IN ('none', 'review')
      OR feature_type IN ('target', 'date', 'identifier', 'text') AS unsafe FROM u)
    SELECT feature_name, CASE WHEN unsafe THEN 'excluded' WHEN availability_type = 'known_in_advance' THEN 'future'
    WHEN availability_type IN ('historical_only', 'observed_at_prediction_time') THEN 'historical'
    WHEN feature_name = 'channel' THEN 'static' ELSE 'historical' END AS category,
    CASE WHEN unsafe AND is_target THEN 'target_column' WHEN unsafe AND derived THEN 'target_derived'
    WHEN unsafe THEN 'excluded_or_unsafe_feature_metadata' END AS exclusion_reason FROM w""",
)
def _(spark, sf):
    return ready.covariate_classes(catalog(spark, sf), CLASS_CFG.group_columns, "revenue")


# Covariates with gaps: a daily panel over channel and campaign, filled with empty periods.
FINE = replace(DAILY, group_columns=("channel", "campaign"), missing_period_policy="insert_null")
FILLED_SQL = """fine AS (SELECT channel, campaign, date, CAST(sum(revenue) AS DOUBLE) AS revenue,
    CAST(sum(spend) AS DOUBLE) AS spend, sum(units_sold) AS units_sold FROM sales GROUP BY ALL),
  span AS (SELECT channel, campaign, min(date) AS lo, max(date) AS hi FROM fine GROUP BY ALL),
  days AS (SELECT channel, campaign, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
  filled AS (SELECT d.channel, d.campaign, d.channel || d.campaign AS series, d.date, f.revenue, f.spend, f.units_sold,
             CAST(isodow(d.date) - 1 AS INTEGER) AS weekday
             FROM days d LEFT JOIN fine f USING (channel, campaign, date)),
  axis AS (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n
           FROM (SELECT DISTINCT date FROM filled)),
  cut AS (SELECT max(date) FILTER (i = greatest(1, CAST(floor(n * CAST(0.70 AS DOUBLE)) AS BIGINT))) AS te,
          max(date) FILTER (i = greatest(1, CAST(floor(n * CAST(0.70 AS DOUBLE)) AS BIGINT))
            + greatest(1, CAST(floor(n * CAST(0.15 AS DOUBLE)) AS BIGINT))) AS ve FROM axis),
  fs AS (SELECT filled.*, CASE WHEN date <= te THEN 'train' WHEN date <= ve THEN 'validation' ELSE 'test' END AS split
         FROM filled, cut)"""


def filled(spark, sf):
    from sparkcast.catalog.views import SALES  # noqa: F401

    panel = align_panel(aggregate_panel(sales(spark, sf), FINE, ROLES), FINE, ROLES)
    panel = panel.withColumns({"series": F.concat("channel", "campaign"), "weekday": F.weekday("date")})
    return assign_split(panel, FINE)


def _filled_sql() -> str:
    from sparkcast.catalog.views import SALES

    return SALES + ", " + FILLED_SQL


FS = _filled_sql()
COVARIATES = ("spend", "units_sold", "weekday", "channel")


def _stat_sql(name: str) -> str:
    return f"""SELECT '{name}' AS feature_name, {rnd_sql(f'count(*) FILTER ({name} IS NULL) / count(*)')} AS missing_rate,
      count(DISTINCT {name}) AS cardinality, count(DISTINCT {name}) + max(CAST({name} IS NULL AS INTEGER)) > 1
      AS varies_over_time, (SELECT max(k) > 1 FROM (SELECT count(DISTINCT {name}) + max(CAST({name} IS NULL AS INTEGER)) AS k
      FROM fs GROUP BY series)) AS varies_in_series FROM fs"""


@query("covariate_stats", f"WITH {FS} " + " UNION ALL ".join(_stat_sql(c) for c in COVARIATES))
def _(spark, sf):
    return rounded(ready.covariate_stats(filled(spark, sf), "series", COVARIATES))


HORIZON = 14


@query(
    "future_coverage",
    f"""WITH {FS}, h AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS k FROM fs
      WHERE split = 'validation'), c AS (SELECT series, count(spend) AS spend, count(weekday) AS weekday FROM h
      WHERE k <= {HORIZON} GROUP BY 1), u AS (SELECT 'spend' AS feature_name, count(*) FILTER (spend < {HORIZON}) AS n FROM c
      UNION ALL SELECT 'weekday', count(*) FILTER (weekday < {HORIZON}) FROM c)
    SELECT feature_name, n AS series_without_coverage, CASE WHEN n = 0 THEN 'complete' ELSE 'missing' END AS status FROM u""",
)
def _(spark, sf):
    return ready.future_coverage(filled(spark, sf), "series", "date", ["spend", "weekday"], HORIZON)


@query(
    "holdout_head",
    f"""WITH {FS}, h AS (SELECT series, date, revenue, CAST(row_number() OVER (PARTITION BY series ORDER BY date) AS INTEGER)
      AS step FROM fs WHERE split = 'validation') SELECT * FROM h WHERE step <= {HORIZON}""",
)
def _(spark, sf):
    return ready.holdout_head(filled(spark, sf), "series", "date", HORIZON).select("series", "date", "revenue", "step")


def _static_sql(name: str) -> str:
    return f"""SELECT '{name}' AS feature_name, count(*) FILTER (k > 1) AS varying_series,
      count(*) FILTER (k > 1) = 0 AS is_static FROM (SELECT count(DISTINCT {name}) + max(CAST({name} IS NULL AS INTEGER)) AS k
      FROM fs GROUP BY series)"""


@query("static_check", f"WITH {FS} " + " UNION ALL ".join(_static_sql(c) for c in ("channel", "campaign", "spend")))
def _(spark, sf):
    return ready.static_check(filled(spark, sf), "series", ["channel", "campaign", "spend"])


SIZE = ready.resolve_input_size(HORIZON)
NEED = ready.minimum_history(HORIZON, SIZE)
READY_SQL = f"""sr AS (SELECT series, count(*) AS observation_count, CAST({NEED} AS INTEGER) AS required_observations,
    min(date) AS start, max(date) AS "end", count(*) FILTER (revenue IS NULL) AS missing_target_count,
    greatest(0, count(*) FILTER (split = 'train') - {SIZE + HORIZON} + 1) AS training_windows,
    greatest(0, count(*) FILTER (split = 'validation') - {HORIZON} + 1) AS validation_windows,
    greatest(0, count(*) FILTER (split = 'test') - {HORIZON} + 1) AS test_windows,
    list_filter([CASE WHEN count(*) FILTER (split = 'train') < {NEED} THEN 'insufficient_training_history' END,
      CASE WHEN count(*) FILTER (revenue IS NULL) > 0 THEN 'missing_targets' END], lambda x: x IS NOT NULL)
      AS failure_reasons FROM fs GROUP BY series)"""


@query("series_readiness", f"WITH {FS}, {READY_SQL} SELECT *, len(failure_reasons) = 0 AS eligible FROM sr")
def _(spark, sf):
    return ready.series_readiness(filled(spark, sf), "series", "date", "revenue", HORIZON)


@query(
    "readiness_status",
    f"""WITH {FS}, {READY_SQL} SELECT count(*) AS series_count, count(*) FILTER (len(failure_reasons) = 0)
    AS eligible_series, CAST(sum(missing_target_count) AS BIGINT) AS missing_targets,
    CAST(sum(training_windows) AS BIGINT) AS training_windows, CAST(sum(validation_windows) AS BIGINT)
    AS validation_windows, CAST(sum(test_windows) AS BIGINT) AS test_windows,
    CASE WHEN count(*) FILTER (len(failure_reasons) = 0) < count(*) THEN 'blocked' ELSE 'ready' END AS status FROM sr""",
)
def _(spark, sf):
    panel = filled(spark, sf)
    report = ready.series_readiness(panel, "series", "date", "revenue", HORIZON)
    return ready.readiness_status(report, ready.panel_blockers(panel, ["channel", "campaign"], "date", "revenue"))


@query(
    "sequence_windows",
    f"""WITH {MONTHLY_SQL}, s AS (SELECT channel || campaign AS series, date AS cutoff, list(revenue) OVER i AS inputs,
      list(revenue) OVER o AS outputs FROM monthly WINDOW
      i AS (PARTITION BY channel, campaign ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
      o AS (PARTITION BY channel, campaign ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
    SELECT * FROM s WHERE len(inputs) = 12 AND len(outputs) = 3""",
)
def _(spark, sf):
    panel = monthly(spark, sf).withColumn("series", F.concat("channel", "campaign"))
    return ready.sequence_windows(panel, "series", "date", "revenue", 12, 3)


@query(
    "panel_ffill",
    f"""WITH {FS}, c AS (SELECT series, date, last_value(revenue IGNORE NULLS) OVER (PARTITION BY series ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM fs WHERE split = 'train')
    SELECT series, date, coalesce(y, median(y) OVER (PARTITION BY series)) AS revenue FROM c""",
)
def _(spark, sf):
    train = filled(spark, sf).filter("split = 'train'").select("series", "date", "revenue")
    return ready.fill_target(train, "series", "date", "revenue")


@query(
    "static_frame",
    f"""WITH {FS} SELECT series, arg_min(channel, date) AS channel, arg_min(campaign, date) AS campaign
    FROM fs GROUP BY series""",
)
def _(spark, sf):
    return ready.static_frame(filled(spark, sf), "series", "date", ["channel", "campaign"])


@query(
    "canonical_panel",
    f"""WITH {DAILY_SQL} SELECT 'series_' || substring(sha256('["' || channel || '"]'), 1, 24) AS unique_id, date AS ds,
    revenue AS y, units_sold FROM daily""",
)
def _(spark, sf):
    return ready.canonical_panel(daily(spark, sf), ["channel"], "date", "revenue", ["units_sold"])


