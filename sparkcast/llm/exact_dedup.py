"""Exact duplicates by content sort.

Rows are dealt by sampled splitters over (leading characters, digest, id) and sorted by the same key, so equal
texts are neighbours and a group of any size spreads over as many ranges as its rows need. Each range is then
scanned once: a text is compared in full with its predecessor. Runs that touch the border of a range are
stitched from one row per border.

Null texts count as empty; empty texts are equal to each other. Null ids sort last. Repeated rows (same id and
text) are copies like any others: one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcast.llm.common import texts
from sparkcast.session import materialize

LEAD_CHARS = 64
_RUN_SCHEMA = "doc_id long, text_sha256 string, range int, run long, lead boolean, run_keep long, run_size long, border string"


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Scan one sorted range. Only ids are held while a run lasts, and a run within a range is bounded by it."""
    part = TaskContext.get().partitionId()
    run, ids, head, out = 0, [], None, []

    def close(last: bool) -> None:
        border = head[0] if run == 0 or last else None
        for i, doc in enumerate(ids):
            out.append((doc, head[1], part, run, i == 0, ids[0], len(ids), border if i == 0 else None))

    columns = ["doc_id", "text_sha256", "range", "run", "lead", "run_keep", "run_size", "border"]
    for batch in batches:
        for doc, text, digest in zip(batch["doc_id"].array, batch["text"].array, batch["digest"].array, strict=True):
            doc = None if pd.isna(doc) else int(doc)
            if head is not None and text != head[0]:
                close(last=False)
                run, ids, head = run + 1, [], None
            if head is None:
                head = (text, digest)
            ids.append(doc)
        if out:
            frame = pd.DataFrame(out, columns=columns)
            out.clear()
            yield frame.astype({"doc_id": "Int64", "run_keep": "Int64"})
    if head is not None:
        close(last=True)
        yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64", "run_keep": "Int64"})


def content_sort_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None, keep: str = "min"
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    `normalise` is an expression over `text`, by default the text itself. `keep` names the row of a group that
    stays: "min" the smallest id, "max" the largest."""
    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    if normalise is not None:
        rows = rows.withColumn("text", F.coalesce(normalise, F.lit("")))
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("lead_chars", F.substring("text", 1, LEAD_CHARS))
    by_id = F.col("doc_id").asc_nulls_last() if keep == "min" else F.col("doc_id").desc_nulls_last()
    order = [F.col("lead_chars"), F.col("digest"), by_id]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    runs = materialize(ordered.select("doc_id", "text", "digest").mapInPandas(_runs, _RUN_SCHEMA), "content-runs")

    # At most two rows for each range: its first and its last run.
    along = Window.orderBy("range", "run")
    borders = runs.filter(F.col("border").isNotNull()).select(
        "range", "run", "run_keep", "run_size", F.coalesce(F.col("border") == F.lag("border").over(along), F.lit(False)).alias("goes_on")
    )
    borders = borders.withColumn("chain", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(along))
    chain = Window.partitionBy("chain")
    best = F.min("run_keep") if keep == "min" else F.max("run_keep")
    borders = borders.select(
        "range", "run", "goes_on", best.over(chain).alias("chain_keep"), F.sum("run_size").over(chain).alias("chain_size")
    )
    joined = runs.drop("border").join(F.broadcast(borders), ["range", "run"], "left")
    return joined.select(
        "doc_id",
        F.coalesce("chain_keep", "run_keep").alias("keep_id"),
        F.coalesce("chain_size", "run_size").alias("group_size"),
        (F.col("lead") & ~F.coalesce("goes_on", F.lit(False))).alias("kept"),
        "text_sha256",
    )
