"""Typed views over the shared tables, in Spark and in SQL.

Money is summed as exact decimals, so both engines agree to the last digit.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcast.config import PreparationConfig
from sparkcast.operators.panel import aggregate_panel
from sparkcast.operators.splits import assign_split, evaluation_windows, split_bounds

ROLES = {
    "date": "date",
    "channel": "channel",
    "campaign": "campaign",
    "revenue": "revenue",
    "spend": "spend",
    "units_sold": "units_sold",
}
ROW_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax")

DAILY = PreparationConfig(target_column="revenue", date_column="date", group_columns=("channel",), frequency="daily")
WEEKLY = replace(DAILY, frequency="weekly")
MONTHLY = replace(DAILY, frequency="monthly", group_columns=("channel", "campaign"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str, with_order: bool = False) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    columns = [
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_returnflag").alias("channel"),
        F.col("l_linestatus").alias("campaign"),
        (price * (1 - discount)).alias("revenue"),
        (price * discount).alias("spend"),
        F.col("l_quantity").alias("units_sold"),
    ]
    if with_order:
        columns += [F.col(c) for c in ROW_ORDER]
    return table(spark, sf_dir, "lineitem").select(*columns)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_panel(sales(spark, sf_dir).drop("campaign"), DAILY, ROLES)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_panel(sales(spark, sf_dir).drop("campaign"), WEEKLY, ROLES)


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_panel(sales(spark, sf_dir), MONTHLY, ROLES)


def split_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_split(daily(spark, sf_dir), DAILY)


def windows(panel: DataFrame, cfg: PreparationConfig = DAILY, final_test: bool = False):
    """Evaluation windows of a panel: validation, three folds, and the final test when asked."""
    return evaluation_windows(split_bounds(panel, cfg), cfg.backtest_folds, 5, final_test)


# --- the same views as SQL common table expressions -------------------------------------------

SALES = """sales AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS channel, l_linestatus AS campaign,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS revenue,
         CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS spend,
         l_quantity AS units_sold, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax
  FROM lineitem)"""


def _panel_sql(name: str, bucket: str, groups: str) -> str:
    return f"""{name} AS (
  SELECT {groups}, {bucket} AS date, CAST(sum(revenue) AS DOUBLE) AS revenue,
         CAST(sum(spend) AS DOUBLE) AS spend, sum(units_sold) AS units_sold, count(*) AS source_rows
  FROM sales GROUP BY ALL)"""


DAILY_SQL = SALES + ",\n" + _panel_sql("daily", "date", "channel")
WEEKLY_SQL = SALES + ",\n" + _panel_sql("weekly", "CAST(date_trunc('week', date) AS DATE)", "channel")
MONTHLY_SQL = SALES + ",\n" + _panel_sql("monthly", "CAST(date_trunc('month', date) AS DATE)", "channel, campaign")


def axis_sql(panel: str) -> str:
    """Dates with their position, and the cut points of the ratio split."""
    return f"""axis AS (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n
         FROM (SELECT DISTINCT date FROM {panel})),
cuts AS (SELECT n, a, CASE WHEN a + v >= n THEN n - 1 ELSE a + v END AS b
         FROM (SELECT max(n) AS n, greatest(1, CAST(floor(max(n) * CAST(0.70 AS DOUBLE)) AS BIGINT)) AS a,
                      greatest(1, CAST(floor(max(n) * CAST(0.15 AS DOUBLE)) AS BIGINT)) AS v FROM axis)),
bounds AS (SELECT min(date) AS train_start,
                  max(date) FILTER (i = a) AS train_end, max(date) FILTER (i = a + 1) AS validation_start,
                  max(date) FILTER (i = b) AS validation_end, max(date) FILTER (i = b + 1) AS test_start,
                  max(date) FILTER (i = cuts.n) AS test_end FROM axis, cuts)"""


def windows_sql(panel: str, folds: int = 3, final_test: bool = False) -> str:
    """Evaluation windows as rows."""
    test = (
        "UNION ALL SELECT 'test', NULL, train_start, validation_end, test_start, test_end FROM bounds"
        if final_test
        else ""
    )
    return f"""{axis_sql(panel)},
folds AS (SELECT CAST(f + 1 AS INTEGER) AS fold, (SELECT date FROM axis WHERE i = 1) AS train_start,
                 (SELECT date FROM axis WHERE i = e) AS train_end,
                 (SELECT date FROM axis WHERE i = e + 1) AS validation_start,
                 (SELECT date FROM axis WHERE i = e + v) AS validation_end
          FROM (SELECT f, b - ({folds} - f) * greatest(1, b - a) AS e, greatest(1, b - a) AS v, b
                FROM range({folds}) t(f), cuts) WHERE e >= 2),
win AS (SELECT 'validation' AS split, CAST(NULL AS INTEGER) AS fold, train_start, train_end, validation_start,
               validation_end FROM bounds
        UNION ALL SELECT 'backtest', fold, train_start, train_end, validation_start, validation_end FROM folds {test}),
hist AS (SELECT w.split, w.fold, p.channel AS series, p.date, p.revenue AS y,
                row_number() OVER (PARTITION BY w.split, w.fold, p.channel ORDER BY p.date) AS i,
                row_number() OVER (PARTITION BY w.split, w.fold, p.channel ORDER BY p.date DESC) AS r,
                count(*) OVER (PARTITION BY w.split, w.fold, p.channel) AS n
         FROM {panel} p JOIN win w ON p.date BETWEEN w.train_start AND w.train_end),
hold AS (SELECT w.split, w.fold, p.channel AS series, p.date, p.revenue AS actual,
                CAST(row_number() OVER (PARTITION BY w.split, w.fold, p.channel ORDER BY p.date) AS INTEGER) AS h
         FROM {panel} p JOIN win w ON p.date BETWEEN w.validation_start AND w.validation_end)"""
