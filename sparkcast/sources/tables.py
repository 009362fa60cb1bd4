"""Table-level reading helpers: previews, pages, scan coverage, digests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcast.functions.text import shorten
from sparkcast.operators.ordered import with_position
from sparkcast.session import materialize


def table_stats(df: DataFrame) -> DataFrame:
    """Row count, column count and column names."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
    )


def preview(df: DataFrame, order: Sequence[str], rows: int = 20, cell_limit: int = 500) -> DataFrame:
    """First rows in row order as text, long cells cut. The limit is pushed into the sort."""
    head = df.orderBy(*order).limit(rows)
    return head.select(*[shorten(F.col(c).cast("string"), cell_limit).alias(c) for c in df.columns])


@dataclass(frozen=True)
class PageIndex:
    """The first key of every page of an ordered table, so that any page is a range of keys.

    Built once by one distributed sort of the key columns alone; it holds one row per page, in the shared folder. A page reads
    the keys at its two ends and the rows between them: page 1,000,000 costs what page 1 costs, and on data that is laid out by
    the leading column the range reaches the scan."""

    rows: DataFrame
    keys: DataFrame
    order: tuple[str, ...]
    size: int
    total: int

    @classmethod
    def build(cls, df: DataFrame, order: Sequence[str], size: int = 50) -> PageIndex:
        """Ascending by columns that together tell any two rows apart; nulls first. Rows
        with equal keys stay together, on the last page that begins with their key."""
        if size < 1:
            raise ValueError("Page number and size must be positive")
        placed = with_position(df.select(*order), list(order), "_position")
        starts = materialize(placed.filter((F.col("_position") - 1) % size == 0).withColumn("_page", F.ceil(F.col("_position") / size)), "pages")
        return cls(df, starts, tuple(order), size, df.count())

    def page(self, number: int) -> DataFrame:
        """The rows of a page in order, with the total row count on every row; none past the end."""
        if number < 1:
            raise ValueError("Page number and size must be positive")
        ends = {r["_page"]: r for r in self.keys.filter(F.col("_page").isin(number, number + 1)).collect()}
        types = dict(self.rows.dtypes)
        key = F.struct(*self.order)

        def value(row: Row) -> Column:
            return F.struct(*[F.lit(row[c]).cast(types[c]).alias(c) for c in self.order])

        if number not in ends:
            hits = self.rows.filter("false")
        else:
            first, last = ends[number], ends.get(number + 1)
            hits = self.rows.filter(key >= value(first))
            lead = self.order[0]
            if first[lead] is not None:
                hits = hits.filter(F.col(lead) >= F.lit(first[lead]).cast(types[lead]))
            if last is not None:
                hits = hits.filter(key < value(last))
                if first[lead] is not None:
                    hits = hits.filter(F.col(lead) <= F.lit(last[lead]).cast(types[lead]))
        return hits.orderBy(*self.order).withColumn("total", F.lit(self.total).cast("long"))


def page(df: DataFrame, order: Sequence[str], number: int = 1, size: int = 50) -> DataFrame:
    """One page of an ordered result. Whoever reads several pages builds the index once."""
    return PageIndex.build(df, order, size).page(number)


def scan_coverage(df: DataFrame, scanned: Column | None = None) -> DataFrame:
    """How much of a table a scan covers. `scanned` tells of each row whether it was used; by default all are."""
    used = F.count(F.lit(1)) if scanned is None else F.count_if(scanned)
    counted = df.agg(F.count(F.lit(1)).alias("total_rows"), used.alias("_used"))
    scanned = F.col("_used")
    return counted.select(
        "total_rows",
        scanned.alias("scanned_rows"),
        F.round(scanned / F.greatest("total_rows", F.lit(1)), 6).alias("coverage_ratio"),
        F.when(scanned < F.col("total_rows"), "bounded").otherwise("full").alias("scan_mode"),
    )


def row_hash(columns: Sequence[str]) -> Column:
    """The leading 60 bits of the SHA-256 of a row, as a number."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(columns)]
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *fields), 256), 1, 15), 16, 10).cast("decimal(20,0)")


def table_digest(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Order-free digest, of the table or of each group: row count and the sum of row hashes.

    Sums combine on the map side and run in decimals, so the digest depends on neither the order of
    rows nor the partitioning.
    """
    summed = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(row_hash(df.columns)), F.lit(0)).cast("string").alias("_sum"),
    )
    digest = F.sha2(F.concat_ws(":", F.col("row_count").cast("string"), "_sum"), 256)
    return summed.select(*by, "row_count", digest.alias("digest"))


def lineage_mismatch(stored: DataFrame, current: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Datasets whose stored digest is missing or differs from the recomputed one."""
    now = current.select(key, F.col("digest").alias("current_digest"))
    return (
        stored.select(key, F.col("digest").alias("stored_digest"))
        .join(now, key, "left")
        .filter(~F.col("stored_digest").eqNullSafe(F.col("current_digest")))
    )


def duplicate_datasets(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Incoming files whose checksum is already registered."""
    return incoming.join(registry.select("checksum"), "checksum", "left_semi")


def coerce(df: DataFrame, dates: Sequence[str] = (), numbers: Sequence[str] = ()) -> DataFrame:
    """Lenient typing of a prepared panel: what cannot be read becomes null."""
    casts = {c: F.to_date(F.col(c).cast("string").try_cast("timestamp")) for c in dates}
    casts |= {c: F.col(c).try_cast("double") for c in numbers}
    return df.withColumns(casts) if casts else df


def typed_projection(df: DataFrame, types: Mapping[str, T.DataType | str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[F.col(c).try_cast(t).alias(c) for c, t in types.items()])
