"""Order-dependent work over a whole table without a single global window.

The rows are sorted into files of at most a million rows once. Windows run inside files, whatever the values of
the order are; only one row per file is carried over the borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcast.session import scratch_path, shuffles_dropped

ROWS_PER_BUCKET = 1_000_000


def _sorted_files(df: DataFrame, order: Sequence[str | Column], rows_per_file: int) -> DataFrame:
    """The rows with their file (`_part`, `_piece`) and place in it (`_row`). Files follow the order."""
    path = scratch_path(df.sparkSession, "sorted")
    with shuffles_dropped(df.sparkSession):
        df.orderBy(*order).write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    file = F.col("_metadata.file_name")
    return df.sparkSession.read.schema(df.schema).parquet(path).select(
        "*",
        F.regexp_extract(file, r"part-(\d+)", 1).cast("bigint").alias("_part"),
        F.regexp_extract(file, r"-c(\d+)\.", 1).cast("bigint").alias("_piece"),
        F.col("_metadata.row_index").alias("_row"),
    )


def with_previous(
    df: DataFrame, order: str, columns: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add `previous_<column>`: the value on the row before, in the order of a unique key."""
    tagged = _sorted_files(df, [order], rows_per_bucket)
    inside = Window.partitionBy("_part", "_piece").orderBy("_row")
    lagged = tagged.withColumns({f"_lag_{c}": F.lag(c).over(inside) for c in columns})
    # One row per file of a million rows.
    ends = tagged.groupBy("_part", "_piece").agg(F.max_by(F.struct(*columns), "_row").alias("_last"))
    carried = ends.select("_part", "_piece", F.lag("_last").over(Window.orderBy("_part", "_piece")).alias("_carried"))
    joined = lagged.join(carried, ["_part", "_piece"])
    previous = {
        f"previous_{c}": F.when(F.col("_row") == 0, F.col(f"_carried.{c}")).otherwise(F.col(f"_lag_{c}"))
        for c in columns
    }
    added = joined.withColumns(previous)
    return added.select(*df.columns, *previous)


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in a total order of any columns.

    The rows are sorted into files once. A file knows the index of each of its rows, so only the row
    count of every file is needed to number them all.
    """
    indexed = _sorted_files(df, order, ROWS_PER_BUCKET)
    sizes = indexed.groupBy("_part", "_piece").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_piece", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        indexed.join(offsets, ["_part", "_piece"])
        .withColumn(name, F.col("_offset") + F.col("_row") + 1)
        .drop("_part", "_piece", "_row", "_offset")
    )
