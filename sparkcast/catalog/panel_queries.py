"""Panels, features and splits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sparkcast.catalog.registry import query, rnd, rnd_sql, rounded
from sparkcast.catalog.views import (
    DAILY,
    DAILY_SQL,
    MONTHLY,
    MONTHLY_SQL,
    ROLES,
    ROW_ORDER,
    SALES,
    WEEKLY,
    WEEKLY_SQL,
    axis_sql,
    daily,
    monthly,
    sales,
    split_daily,
    table,
    weekly,
    windows,
    windows_sql,
)
from sparkcast.operators import features, panel, splits
from sparkcast.plans.prepare import prepare_panel, preparation_report

HOLIDAYS = ("1998-12-25", "1999-12-25", "2000-01-01", "2000-12-25")

query("panel_sum", f"WITH {DAILY_SQL} SELECT * FROM daily")(daily)


@query(
    "panel_rules",
    f"""WITH {SALES} SELECT channel, date, CAST(max(revenue) AS DOUBLE) AS revenue,
    {rnd_sql("CAST(sum(spend) AS DOUBLE) / count(*)", 3)} AS spend,
    last(units_sold ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax) AS units_sold,
    count(*) AS source_rows FROM sales GROUP BY channel, date""",
)
def _(spark, sf):
    cfg = replace(DAILY, aggregation_rules={"revenue": "max", "spend": "mean", "units_sold": "last"})
    raw = sales(spark, sf, with_order=True).drop("campaign")
    return rounded(panel.aggregate_panel(raw, cfg, ROLES, ROW_ORDER), 3, "spend")


@query(
    "panel_last_text",
    f"""WITH {SALES} SELECT channel, date,
    last(campaign ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax) AS campaign,
    count(*) AS source_rows FROM sales GROUP BY channel, date""",
)
def _(spark, sf):
    out = panel.aggregate_panel(sales(spark, sf, with_order=True), DAILY, ROLES, ROW_ORDER)
    return out.select("channel", "date", "campaign", "source_rows")


RATIO_ROLES = {**ROLES, "roas": "roas"}


@query(
    "panel_ratios",
    f"""WITH {DAILY_SQL} SELECT channel, date, revenue, spend,
    {rnd_sql("revenue / nullif(spend, 0)")} AS roas FROM daily""",
)
def _(spark, sf):
    raw = sales(spark, sf).withColumn("roas", F.lit(None).cast("double"))
    out = panel.aggregate_panel(raw, DAILY, RATIO_ROLES)
    return out.select("channel", "date", "revenue", "spend", rnd("roas").alias("roas"))


@query(
    "panel_collapsed",
    f"""WITH {DAILY_SQL} SELECT CAST(sum(source_rows - 1) AS BIGINT) AS collapsed_rows,
    count(*) FILTER (source_rows > 1) AS collapsed_periods, count(*) AS periods FROM daily""",
)
def _(spark, sf):
    return panel.collapsed_rows(daily(spark, sf))


FINE = replace(DAILY, group_columns=("channel", "campaign"))
FINE_SQL = SALES + """,
fine AS (SELECT channel, campaign, date, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(spend) AS DOUBLE) AS spend,
                sum(units_sold) AS units_sold, count(*) AS source_rows FROM sales GROUP BY ALL),
span AS (SELECT channel, campaign, min(date) AS lo, max(date) AS hi FROM fine GROUP BY ALL),
days AS (SELECT channel, campaign, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span)"""


def fine(spark, sf):
    return panel.aggregate_panel(sales(spark, sf), FINE, ROLES)


@query(
    "gapfill_null",
    f"""WITH {FINE_SQL} SELECT d.channel, d.campaign, d.date, f.revenue, f.spend, f.units_sold,
    coalesce(f.source_rows, 0) AS source_rows, CAST(f.date IS NULL AS INTEGER) AS is_generated_period
    FROM days d LEFT JOIN fine f USING (channel, campaign, date)""",
)
def _(spark, sf):
    return panel.align_panel(fine(spark, sf), replace(FINE, missing_period_policy="insert_null"), ROLES)


@query(
    "gapfill_zero",
    f"""WITH {FINE_SQL} SELECT d.channel, d.campaign, d.date, f.revenue, coalesce(f.spend, 0) AS spend,
    coalesce(f.units_sold, 0) AS units_sold,
    coalesce(f.source_rows, 0) AS source_rows, CAST(f.date IS NULL AS INTEGER) AS is_generated_period
    FROM days d LEFT JOIN fine f USING (channel, campaign, date)""",
)
def _(spark, sf):
    cfg = replace(FINE, missing_period_policy="insert_zero_for_flow_metrics")
    return panel.align_panel(fine(spark, sf), cfg, ROLES)


@query(
    "gap_report",
    f"""WITH {FINE_SQL} SELECT d.channel, d.campaign, min(d.date) AS first_period, max(d.date) AS last_period,
    count(f.date) AS observed_periods, count(*) - count(f.date) AS missing_periods
    FROM days d LEFT JOIN fine f USING (channel, campaign, date) GROUP BY d.channel, d.campaign""",
)
def _(spark, sf):
    return panel.gap_report(fine(spark, sf), FINE)


HOURLY = replace(DAILY, target_column="revenue", date_column="hour", group_columns=("event_type",), frequency="hourly")


@query(
    "gapfill_hourly",
    """WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour,
      CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS revenue, count(*) AS source_rows FROM events GROUP BY ALL),
    s AS (SELECT event_type, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour
          FROM h GROUP BY event_type)
    SELECT s.event_type, s.hour, h.revenue, coalesce(h.source_rows, 0) AS source_rows,
           CAST(h.hour IS NULL AS INTEGER) AS is_generated_period
    FROM s LEFT JOIN h USING (event_type, hour)""",
)
def _(spark, sf):
    raw = table(spark, sf, "events").select(
        "event_type", F.col("ts").alias("hour"), F.col("value").cast("decimal(12,2)").alias("revenue")
    )
    roles = {"hour": "timestamp", "revenue": "revenue"}
    hourly = panel.aggregate_panel(raw, HOURLY, roles)
    out = panel.align_panel(hourly, replace(HOURLY, missing_period_policy="insert_null"), roles)
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("group_count", f"WITH {FINE_SQL} SELECT count(*) AS group_count FROM span")
def _(spark, sf):
    return panel.group_count(fine(spark, sf), FINE)


@query(
    "drop_missing_target",
    f"""WITH {FINE_SQL} SELECT d.channel, d.campaign, d.date, f.revenue
    FROM days d LEFT JOIN fine f USING (channel, campaign, date) WHERE f.revenue IS NOT NULL""",
)
def _(spark, sf):
    filled = panel.align_panel(fine(spark, sf), replace(FINE, missing_period_policy="insert_null"), ROLES)
    return panel.drop_missing_target(filled, FINE).select("channel", "campaign", "date", "revenue")


# --- features ---------------------------------------------------------------------------------

FEATURES = replace(DAILY, rolling_statistics=("mean", "sum", "min", "max"), holiday_dates=HOLIDAYS)


@query(
    "feat_lags",
    f"""WITH {DAILY_SQL} SELECT channel, date, lag(revenue, 1) OVER w AS revenue_lag_1,
    lag(revenue, 7) OVER w AS revenue_lag_7, lag(revenue, 14) OVER w AS revenue_lag_14,
    lag(revenue, 28) OVER w AS revenue_lag_28
    FROM daily WINDOW w AS (PARTITION BY channel ORDER BY date)""",
)
def _(spark, sf):
    out = features.add_lags(daily(spark, sf), FEATURES)
    return out.select("channel", "date", *[f"revenue_lag_{k}" for k in FEATURES.lag_periods])


def _rolling_sql(size: int) -> str:
    frame = f"(PARTITION BY channel ORDER BY date ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING)"
    exact = "CAST(revenue AS DECIMAL(18,4))"
    return f"""{rnd_sql(f"CAST(sum({exact}) OVER {frame} AS DOUBLE) / count(revenue) OVER {frame}", 3)}
        AS revenue_rolling_mean_{size},
    {rnd_sql(f"CAST(sum({exact}) OVER {frame} AS DOUBLE)", 3)} AS revenue_rolling_sum_{size},
    min(revenue) OVER {frame} AS revenue_rolling_min_{size}, max(revenue) OVER {frame} AS revenue_rolling_max_{size}"""


@query("feat_rolling", f"WITH {DAILY_SQL} SELECT channel, date, {_rolling_sql(7)}, {_rolling_sql(28)} FROM daily")
def _(spark, sf):
    out = features.add_rolling(daily(spark, sf), FEATURES)
    sums = [c for c in out.columns if "rolling_mean" in c or "rolling_sum" in c]
    return rounded(out, 3, *sums).select("channel", "date", *[c for c in out.columns if "rolling" in c])


@query(
    "calendar_features",
    f"""WITH {WEEKLY_SQL} SELECT channel, date, CAST(year(date) AS INTEGER) AS calendar_year,
    CAST(quarter(date) AS INTEGER) AS calendar_quarter, CAST(month(date) AS INTEGER) AS calendar_month,
    CAST(week(date) AS INTEGER) AS calendar_week, CAST(isodow(date) - 1 AS INTEGER) AS calendar_day_of_week,
    CAST(isodow(date) >= 6 AS INTEGER) AS calendar_is_weekend,
    {rnd_sql("sin(2 * pi() * month(date) / 12)")} AS calendar_month_sin,
    {rnd_sql("cos(2 * pi() * month(date) / 12)")} AS calendar_month_cos FROM weekly""",
)
def _(spark, sf):
    out = features.add_calendar(weekly(spark, sf), WEEKLY)
    names = [c for c in out.columns if c.startswith("calendar_")]
    out = out.withColumns({c: rnd(c) for c in ("calendar_month_sin", "calendar_month_cos")})
    return out.select("channel", "date", *names)


@query(
    "feat_trend",
    f"""WITH {DAILY_SQL} SELECT channel, date,
    CAST(row_number() OVER (PARTITION BY channel ORDER BY date) - 1 AS INTEGER) AS periods_since_start,
    CAST(date - min(date) OVER (PARTITION BY channel) AS INTEGER) AS days_since_start FROM daily""",
)
def _(spark, sf):
    out = features.add_trend(daily(spark, sf), FEATURES)
    return out.select("channel", "date", "periods_since_start", "days_since_start")


@query(
    "holiday_flag",
    f"""WITH {DAILY_SQL} SELECT channel, date, CAST(date IN
    ({', '.join(f"DATE '{d}'" for d in HOLIDAYS)}) AS INTEGER) AS is_holiday FROM daily""",
)
def _(spark, sf):
    return features.add_holidays(daily(spark, sf), FEATURES).select("channel", "date", "is_holiday")


FUNNEL_ROLES = {
    "hour": "timestamp",
    "impressions": "impressions",
    "clicks": "clicks",
    "conversions": "conversions",
    "sessions": "sessions",
    "spend": "spend",
    "revenue": "revenue",
}


@query(
    "feat_derived",
    f"""WITH f AS (SELECT CAST(ts AS DATE) AS date, CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS impressions,
       CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS clicks,
       CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS conversions,
       CAST(sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(12,2)) ELSE 0 END) AS DOUBLE) AS spend
       FROM events GROUP BY 1)
    SELECT date, {rnd_sql("clicks / nullif(impressions, 0)")} AS ctr,
    {rnd_sql("conversions / nullif(clicks, 0)")} AS conversion_rate,
    {rnd_sql("spend / nullif(clicks, 0)")} AS cpc, {rnd_sql("spend / nullif(conversions, 0)")} AS cpa FROM f""",
)
def _(spark, sf):
    kind = F.col("event_type")
    amount = F.col("value").cast("decimal(12,2)")
    raw = table(spark, sf, "events").select(
        F.col("ts").cast("date").alias("date"),
        (kind == "view").cast("int").alias("impressions"),
        (kind == "click").cast("int").alias("clicks"),
        (kind == "purchase").cast("int").alias("conversions"),
        F.when(kind == "click", amount).otherwise(0).alias("spend"),
        F.when(kind == "purchase", amount).otherwise(0).alias("revenue"),
    )
    cfg = replace(DAILY, group_columns=())
    roles = {**{k: v for k, v in FUNNEL_ROLES.items() if k in raw.columns}, "date": "date"}
    out = features.add_derived(panel.aggregate_panel(raw, cfg, roles), cfg, roles)
    return rounded(out.select("date", "ctr", "conversion_rate", "cpc", "cpa"))


# --- splits -----------------------------------------------------------------------------------


@query(
    "split_ratio",
    f"""WITH {DAILY_SQL}, {axis_sql('daily')} SELECT channel, date, CASE WHEN date <= train_end THEN 'train'
    WHEN date <= validation_end THEN 'validation' WHEN date <= test_end THEN 'test' ELSE 'unused' END AS split
    FROM daily, bounds""",
)
def _(spark, sf):
    return split_daily(spark, sf).select("channel", "date", "split")


DATED = replace(
    DAILY, train_end_date="1999-06-30", validation_end_date="2000-06-30", test_end_date="2001-06-30"
)


@query(
    "split_dates",
    f"""WITH {DAILY_SQL} SELECT channel, date, CASE WHEN date <= DATE '1999-06-30' THEN 'train'
    WHEN date <= DATE '2000-06-30' THEN 'validation' WHEN date <= DATE '2001-06-30' THEN 'test'
    ELSE 'unused' END AS split FROM daily""",
)
def _(spark, sf):
    return splits.assign_split(daily(spark, sf), DATED).select("channel", "date", "split")


@query(
    "split_manifest",
    f"""WITH {DAILY_SQL}, {axis_sql('daily')}, s AS (SELECT date, revenue, CASE WHEN date <= train_end THEN 'train'
    WHEN date <= validation_end THEN 'validation' ELSE 'test' END AS split FROM daily, bounds)
    SELECT split, min(date) AS start_date, max(date) AS end_date, count(*) AS row_count,
    count(revenue) AS rows_with_target FROM s GROUP BY split""",
)
def _(spark, sf):
    return splits.split_manifest(split_daily(spark, sf), DAILY)


@query(
    "split_order_check",
    f"""WITH {DAILY_SQL}, {axis_sql('daily')} SELECT train_end, validation_start, validation_end, test_start,
    train_end < validation_start AND validation_end < test_start AS chronological FROM bounds""",
)
def _(spark, sf):
    return splits.split_order_check(splits.split_manifest(split_daily(spark, sf), DAILY))


@query(
    "backtest_folds",
    f"""WITH {DAILY_SQL}, {windows_sql('daily', 4)}
    SELECT fold, train_start, train_end, validation_start, validation_end FROM folds""",
)
def _(spark, sf):
    return splits.fold_table(splits.split_bounds(daily(spark, sf), DAILY), 4)


@query(
    "fold_rows",
    f"""WITH {WEEKLY_SQL}, {windows_sql('weekly')}
    SELECT p.channel, p.date, p.revenue, w.split AS window_split, w.fold,
    CASE WHEN p.date <= w.train_end THEN 'train' ELSE 'holdout' END AS part
    FROM weekly p JOIN win w ON p.date BETWEEN w.train_start AND w.validation_end""",
)
def _(spark, sf):
    p = weekly(spark, sf)
    out = splits.fold_rows(p, WEEKLY, windows(p, WEEKLY))
    return out.select("channel", "date", "revenue", "window_split", "fold", "part")


@query(
    "date_slice",
    f"WITH {DAILY_SQL} SELECT * FROM daily WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'",
)
def _(spark, sf):
    return splits.date_slice(daily(spark, sf), "date", "1997-01-01", "1998-12-31")


# --- the whole preparation --------------------------------------------------------------------

PREPARE = replace(MONTHLY, missing_period_policy="insert_null", lag_periods=(1, 12), rolling_windows=(3,))


@query(
    "prepare_panel",
    f"""WITH {MONTHLY_SQL}, span AS (SELECT channel, campaign, min(date) lo, max(date) hi FROM monthly GROUP BY ALL),
    grid AS (SELECT channel, campaign, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS date
             FROM span),
    full_panel AS (SELECT g.channel, g.campaign, g.date, m.revenue, CAST(m.date IS NULL AS INTEGER) AS is_generated_period
             FROM grid g LEFT JOIN monthly m USING (channel, campaign, date)),
    {axis_sql('full_panel')},
    f AS (SELECT *, lag(revenue, 1) OVER w AS revenue_lag_1, lag(revenue, 12) OVER w AS revenue_lag_12,
          {rnd_sql("CAST(sum(CAST(revenue AS DECIMAL(18,4))) OVER p AS DOUBLE) / count(revenue) OVER p", 3)}
            AS revenue_rolling_mean_3,
          CAST(row_number() OVER w - 1 AS INTEGER) AS periods_since_start,
          CAST(month(date) AS INTEGER) AS calendar_month
          FROM full_panel WINDOW w AS (PARTITION BY channel, campaign ORDER BY date),
          p AS (PARTITION BY channel, campaign ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
    SELECT f.*, CASE WHEN date <= train_end THEN 'train' WHEN date <= validation_end THEN 'validation' ELSE 'test' END
      AS split FROM f, bounds WHERE revenue IS NOT NULL""",
)
def _(spark, sf):
    out = prepare_panel(sales(spark, sf), PREPARE, ROLES)
    return rounded(out, 3, "revenue_rolling_mean_3").select(
        "channel", "campaign", "date", "revenue", "is_generated_period", "revenue_lag_1", "revenue_lag_12",
        "revenue_rolling_mean_3", "periods_since_start", "calendar_month", "split",
    )


@query(
    "prep_report",
    f"""WITH {FINE_SQL}, j AS (SELECT f.source_rows, f.revenue, f.date FROM days d
       LEFT JOIN fine f USING (channel, campaign, date))
    SELECT CAST(sum(source_rows - 1) AS BIGINT) AS collapsed_rows, count(*) - count(date) AS generated_rows,
    count(*) - count(revenue) AS dropped_rows, count(revenue) AS row_count FROM j""",
)
def _(spark, sf):
    cfg = replace(FINE, missing_period_policy="insert_null")
    return preparation_report(panel.align_panel(fine(spark, sf), cfg, ROLES), cfg)
