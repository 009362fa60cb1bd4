"""Column profiles from a dictionary of distinct values.

Rows are unpivoted to (column, value) and counted at once, so each distinct value is parsed a single
time and a value that fills a third of a column is combined on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcast.functions.dates import has_time_layout, parse_date_profile
from sparkcast.functions.numbers import is_whole, parse_number_profile
from sparkcast.functions.text import cell, is_boolean_token, normalize_name

COLUMN, VALUE = "column_name", "value"


def long_values(df: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """One row per cell: row id, column name, trimmed text ('' when blank or null)."""
    return df.select(row_id, *[cell(F.col(c)).alias(c) for c in columns]).unpivot(
        [row_id], list(columns), COLUMN, VALUE
    )


def value_counts(df: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """Distinct cells of each column with their count and first row."""
    return (
        long_values(df, columns, row_id)
        .groupBy(COLUMN, VALUE)
        .agg(F.count(F.lit(1)).alias("cnt"), F.min(row_id).alias("first_row"))
    )


def _position(columns: Sequence[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in columns]), F.col(COLUMN)) - 1).cast("int")


def column_profile(df: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """One row per column: counts, distinct values, parse rates, numeric, date and length ranges."""
    filled = F.col(VALUE) != ""
    number, moment = F.col("num"), F.col("ts")
    parsed = value_counts(df, columns, row_id).withColumns(
        {
            "num": F.when(filled, parse_number_profile(F.col(VALUE))),
            "ts": F.when(filled, parse_date_profile(F.col(VALUE))),
            "timed": filled & has_time_layout(F.col(VALUE)),
            "size": F.when(filled, F.length(VALUE)),
        }
    )

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("cnt"))), F.lit(0))

    has_number, has_date = number.isNotNull(), moment.isNotNull()
    counted = parsed.groupBy(COLUMN).agg(
        F.sum("cnt").alias("sample_count"),
        rows(~filled).alias("null_count"),
        rows(filled).alias("filled_count"),
        F.count_if(filled).alias("unique_count"),
        rows(has_number).alias("_numbers"),
        rows(has_number & is_whole(number)).alias("_whole"),
        rows(has_number & (number >= 0) & ~F.isnan(number)).alias("_nonnegative"),
        rows(has_date).alias("_dates"),
        rows(has_date & F.col("timed")).alias("_timed"),
        F.coalesce(F.bool_and(F.when(filled, is_boolean_token(F.col(VALUE)))), F.lit(False)).alias("all_boolean"),
        F.min(number).alias("numeric_min"),
        F.max(number).alias("numeric_max"),
        F.try_divide(F.sum(number * F.col("cnt")), rows(has_number)).alias("numeric_mean"),
        F.min(moment).alias("_first"),
        F.max(moment).alias("_last"),
        F.min("size").alias("string_min_length"),
        F.max("size").alias("string_max_length"),
    )
    def rate(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))

    return counted.select(
        _position(columns).alias("column_index"),
        COLUMN,
        normalize_name(F.col(COLUMN)).alias("normalized_name"),
        (F.col("null_count") > 0).alias("nullable"),
        "null_count",
        "sample_count",
        "filled_count",
        "unique_count",
        rate("unique_count", "filled_count").alias("unique_rate"),
        rate("_numbers", "filled_count").alias("numeric_rate"),
        rate("_dates", "filled_count").alias("date_rate"),
        rate("_timed", "_dates").alias("timed_rate"),
        F.greatest(rate("_numbers", "filled_count"), rate("_dates", "filled_count")).alias("parse_success_rate"),
        "all_boolean",
        "numeric_min",
        "numeric_max",
        "numeric_mean",
        F.date_format("_first", "yyyy-MM-dd'T'HH:mm:ss").alias("date_min"),
        F.date_format("_last", "yyyy-MM-dd'T'HH:mm:ss").alias("date_max"),
        "string_min_length",
        "string_max_length",
        rate("_nonnegative", "_numbers").alias("nonnegative_rate"),
        rate("_whole", "_numbers").alias("integer_rate"),
    )


def physical_types(profile: DataFrame) -> DataFrame:
    """Profile with the physical type of each column; the first matching rule wins."""
    c = F.col

    def partly(rate: Column) -> Column:
        return (rate > 0.2) & (rate < 0.8)

    mixed = partly(c("numeric_rate")) | partly(c("date_rate"))
    is_id = F.endswith(c("normalized_name"), F.lit("_id")) | (c("normalized_name") == "id")
    kind = (
        F.when(c("filled_count") == 0, "empty")
        .when(c("all_boolean"), "boolean")
        .when((c("numeric_rate") == 1) & (c("integer_rate") == 1), "integer")
        .when(c("numeric_rate") == 1, "float")
        .when((c("date_rate") >= 0.8) & (c("timed_rate") > 0.5), "datetime")
        .when(c("date_rate") >= 0.8, "date")
        .when(mixed, "mixed")
        .when(is_id & (c("unique_rate") >= 0.8), "identifier")
        .when((c("unique_rate") <= 0.5) | (c("unique_count") <= 50), "categorical")
        .otherwise("text")
    )
    return profile.withColumn("physical_type", kind)


def sample_values(df: DataFrame, columns: Sequence[str], row_id: str, k: int = 10) -> DataFrame:
    """First k distinct non-blank values of each column in row order.

    The rank filter runs before the shuffle, so at most k values per column and task travel.
    """
    order = Window.partitionBy(COLUMN).orderBy("first_row", VALUE)
    head = (
        value_counts(df, columns, row_id)
        .filter(F.col(VALUE) != "")
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= k)
    )
    return head.groupBy(COLUMN).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_n", VALUE))), lambda p: p[VALUE]).alias("sample_values")
    )
