"""Small helpers shared by the operators: tables, sized broadcasts, links to components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcast.session import materialize

BROADCAST_ROWS = 1_000_000
BATCH_ROWS = "2000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names, so that extra columns never clash.
    A null text counts as empty. Texts are long, so Python workers get fewer rows at once than Spark's default."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    )


def sized(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, hinted for broadcast only when its counted rows are within
    `max_rows`; beyond that the join shuffles, and adaptive execution splits hot keys."""
    return F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z only. `lower` does just that where every character is one byte."""
    c = F.col(c) if isinstance(c, str) else c
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def components(links: DataFrame, label: str) -> DataFrame:
    """Connected components of undirected `links` (a, b): rows (node, root) with the smallest node
    that each node reaches. Every round a node takes the smallest root among its neighbours' roots, then the
    root of that root; both run as joins on written tables, so a hub is an aggregate, never a list."""
    edges = materialize(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), label
    )
    roots = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), label)
    while True:
        # hop: the root of my root
        jump = roots.alias("x").join(roots.alias("y"), F.col("x.root") == F.col("y.node"))
        jump = jump.select(F.col("x.node").alias("node"), F.least("x.root", "y.root").alias("root"))
        near = edges.join(roots, edges.b == roots.node).groupBy(edges.a.alias("node")).agg(F.min("root").alias("near"))
        # hook: my root learns of the smallest root seen next to any of its members
        hook = (
            jump.join(near, "node").groupBy(F.col("root").alias("node")).agg(F.min("near").alias("hook"))
        )
        step = jump.join(near, "node").select("node", F.least("root", "near").alias("root"))
        step = step.join(hook, "node", "left").select("node", F.least("root", F.coalesce("hook", "root")).alias("root"))
        step = materialize(step, label)
        changed = (
            step.alias("n").join(roots.alias("o"), "node").filter(F.col("n.root") != F.col("o.root")).limit(1).count()
        )
        roots = step
        if not changed:
            return roots
