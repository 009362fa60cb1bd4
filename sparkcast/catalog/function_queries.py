"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcast.catalog.registry import query, rnd_sql, rounded
from sparkcast.catalog.text_views import (
    COLUMNS,
    TEXT_SQL,
    date_prep_sql,
    date_profile_sql,
    date_quality_sql,
    events_text,
    number_prep_sql,
    number_profile_sql,
    number_quality_sql,
)
from sparkcast.catalog.views import DAILY_SQL, daily, table
from sparkcast.functions import dates, numbers, text
from sparkcast.functions.labels import drift_action, drift_severity
from sparkcast.operators.explain import apply_scenario


@query(
    "normalize_names",
    """SELECT p_partkey, lower(regexp_replace(trim(regexp_replace(regexp_replace(p_name || ' CostPer' || p_type,
    '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_'), '_+', '_', 'g')) AS normalized
    FROM part""",
)
def _(spark, sf):
    name = F.concat("p_name", F.lit(" CostPer"), "p_type")
    return table(spark, sf, "part").select("p_partkey", text.normalize_name(name).alias("normalized"))


def _numbers(name: str, parse, sql) -> None:
    columns = ("impressions", "spend", "ctr", "conversions")
    shown = ", ".join(f"{sql(c)} AS {c}" for c in columns)

    @query(name, f"WITH {TEXT_SQL} SELECT row_id, {shown} FROM ev")
    def _(spark, sf):
        return events_text(spark, sf).select("row_id", *[parse(F.col(c)).alias(c) for c in columns])


_numbers("parse_number_profile", numbers.parse_number_profile, number_profile_sql)
_numbers("parse_number_quality", numbers.parse_number_quality, number_quality_sql)
_numbers("parse_number_prep", numbers.parse_number_prep, number_prep_sql)


def _dates(name: str, parse, sql) -> None:
    @query(name, f"WITH {TEXT_SQL} SELECT row_id, {sql('date')} AS parsed FROM ev")
    def _(spark, sf):
        return events_text(spark, sf).select("row_id", parse(F.col("date")).cast("timestamp_ntz").alias("parsed"))


_dates("parse_date_profile", dates.parse_date_profile, date_profile_sql)
_dates("parse_date_quality", dates.parse_date_quality, date_quality_sql)
_dates("parse_date_prep", dates.parse_date_prep, date_prep_sql)


@query(
    "null_tokens",
    f"""WITH {TEXT_SQL} SELECT row_id, lower(trim(channel)) IN ('', 'null', 'none', 'na', 'n/a', 'nan', 'missing')
    AS channel_missing, lower(trim(campaign)) IN ('', 'null', 'none', 'na', 'n/a', 'nan', 'missing') AS campaign_missing
    FROM ev""",
)
def _(spark, sf):
    return events_text(spark, sf).select(
        "row_id",
        text.is_null_token(F.col("channel")).alias("channel_missing"),
        text.is_null_token(F.col("campaign")).alias("campaign_missing"),
    )


@query(
    "period_bucket",
    """SELECT event_id, date_trunc('hour', ts) AS hour, CAST(date_trunc('day', ts) AS DATE) AS day,
    CAST(date_trunc('week', ts) AS DATE) AS week, CAST(date_trunc('month', ts) AS DATE) AS month,
    CAST(date_trunc('quarter', ts) AS DATE) AS quarter FROM events""",
)
def _(spark, sf):
    names = {"day": "daily", "week": "weekly", "month": "monthly", "quarter": "quarterly"}
    return table(spark, sf, "events").select(
        "event_id",
        dates.period_bucket(F.col("ts"), "hourly").cast("timestamp_ntz").alias("hour"),
        *[dates.period_bucket(F.col("ts"), f).alias(n) for n, f in names.items()],
    )


@query(
    "next_period",
    """SELECT o_orderkey, date_trunc('hour', o_orderdate) + INTERVAL 1 HOUR AS next_hour,
    CAST(o_orderdate + INTERVAL 1 DAY AS DATE) AS next_day, CAST(date_trunc('week', o_orderdate) + INTERVAL 7 DAY AS DATE)
    AS next_week, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS next_month,
    CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH AS DATE) AS next_quarter FROM orders""",
)
def _(spark, sf):
    d = F.col("o_orderdate")
    names = {"next_day": "daily", "next_week": "weekly", "next_month": "monthly", "next_quarter": "quarterly"}
    return table(spark, sf, "orders").select(
        "o_orderkey",
        dates.next_period(dates.period_bucket(d, "hourly"), "hourly").cast("timestamp_ntz").alias("next_hour"),
        *[dates.next_period(dates.period_bucket(d, f), f).alias(n) for n, f in names.items()],
    )


@query(
    "safe_ratio",
    f"""SELECT event_id, {rnd_sql('user_id / nullif(event_id % 5, 0)')} AS ratio,
    {rnd_sql("CASE WHEN event_type <> 'error' THEN value END / nullif(user_id, 0)")} AS per_user FROM events""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    amount = F.when(F.col("event_type") != "error", F.col("value"))
    return rounded(
        e.select(
            "event_id",
            numbers.safe_ratio(F.col("user_id").cast("double"), F.col("event_id") % 5).alias("ratio"),
            numbers.safe_ratio(amount, F.col("user_id")).alias("per_user"),
        )
    )


@query(
    "row_fingerprint",
    f"""WITH {TEXT_SQL} SELECT row_id, sha256({" || chr(31) || ".join(f"trim({c})" for c in COLUMNS)}) AS fingerprint
    FROM ev""",
)
def _(spark, sf):
    return events_text(spark, sf).select(
        "row_id", text.row_fingerprint(*[F.col(c) for c in COLUMNS]).alias("fingerprint")
    )


@query(
    "series_id",
    """SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey, 'series_' || substring(sha256('["' || l_returnflag || '","'
    || l_linestatus || '","' || CAST(l_suppkey AS VARCHAR) || '"]'), 1, 24) AS series_id FROM lineitem""",
)
def _(spark, sf):
    groups = ["l_returnflag", "l_linestatus", "l_suppkey"]
    return (
        table(spark, sf, "lineitem")
        .select(*groups)
        .distinct()
        .withColumn("series_id", text.series_id(*[F.col(g) for g in groups]))
    )


@query(
    "group_label",
    """SELECT DISTINCT coalesce(o_orderpriority, '') || ' | ' || coalesce(o_orderstatus, '') AS label, 'all' AS ungrouped
    FROM orders""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        text.group_label(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("label"),
        text.group_label().alias("ungrouped"),
    ).distinct()


@query(
    "mask_text",
    """SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name))
    ELSE repeat('*', length(c_name) - 4) || right(c_name, 4) END AS name,
    CASE WHEN length(c_mktsegment) <= 9 THEN repeat('*', length(c_mktsegment))
    ELSE repeat('*', length(c_mktsegment) - 9) || right(c_mktsegment, 9) END AS segment FROM customer""",
)
def _(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", text.mask(F.col("c_name")).alias("name"), text.mask(F.col("c_mktsegment"), 9).alias("segment")
    )


@query(
    "scenario_apply",
    f"""WITH {DAILY_SQL} SELECT channel, date, revenue, {rnd_sql('spend * 1.1e0', 4)} AS spend,
    units_sold + 5 AS units_sold, CAST(1 AS INTEGER) AS promotion FROM daily""",
)
def _(spark, sf):
    panel = daily(spark, sf).drop("source_rows").withColumn("promotion", F.lit(0))
    changes = {"spend": {"multiply_by": 1.1}, "units_sold": {"add_value": 5.0}, "promotion": {"override_value": 1}}
    return rounded(apply_scenario(panel, changes), 4, "spend")


@query(
    "drift_severity",
    """WITH d AS (SELECT l_suppkey, avg(l_discount) * 0.4e0 AS p_value, stddev_pop(l_quantity) / 20 AS effect
      FROM lineitem GROUP BY l_suppkey),
    s AS (SELECT l_suppkey, CASE WHEN p_value < 0.01 AND effect > 0.5 THEN 'high' WHEN p_value < 0.05 THEN 'medium'
      ELSE 'low' END AS severity FROM d)
    SELECT l_suppkey, severity, CASE WHEN severity = 'high' THEN
     'Consider retraining the model if this feature is highly important globally.' ELSE 'Monitor feature.' END AS action
    FROM s""",
)
def _(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        (F.avg("l_discount") * 0.4).alias("p_value"), (F.stddev_pop("l_quantity") / 20).alias("effect")
    )
    severity = drift_severity(F.col("p_value"), F.col("effect"))
    return d.select("l_suppkey", severity.alias("severity")).withColumn("action", drift_action(F.col("severity")))
