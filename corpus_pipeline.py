"""A corpus pipeline of the training-data operators.

Stages run in order, each on all that its predecessor kept. All but the last keep the columns of documents; rejected
documents go. Null texts count as empty everywhere; empty tables pass through. Of rows that repeat id and text one stays.
A stage other than exact dedup that rejects an id rejects all rows of it, also those with another text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcast.llm.common import sized, table
from sparkcast.llm.decontamination import contamination
from sparkcast.llm.exact_dedup import content_sort_groups
from sparkcast.llm.minhash import near_duplicate_components
from sparkcast.llm.piece_codec import encode_documents
from sparkcast.llm.queries import tokenizer
from sparkcast.llm.toxicity import fit, score
from sparkcast.session import materialize


def _without(docs: DataFrame, rejected: DataFrame, label: str) -> DataFrame:
    """The documents whose id is not among the rejected ones; rows with a null id stay."""
    return docs.join(sized(materialize(rejected.select("doc_id").dropna().distinct(), label), 2_000_000), "doc_id", "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    judged = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return _without(docs, judged.filter("predicted = 1"), "toxic")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays, in one row. Rows are told apart by id and text, so an id that repeats keeps its other texts."""
    marks = content_sort_groups(docs, keep="min").groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"))
    marks = materialize(marks.agg(F.bool_or("kept").alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1"), "copies")
    here = docs.withColumn("_digest", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    same = lambda m: F.col("doc_id").eqNullSafe(m["id"]) & (F.col("_digest") == m["digest"])
    marked, repeated = sized(marks), sized(marks.filter("stays"))
    single = here.join(marked, same(marked), "left_anti")
    return single.union(here.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "_digest"])).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    return _without(docs, near_duplicate_components(docs, percent=80).filter(F.col("doc_id") != F.col("component_id")), "near-copies")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return _without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0"), "leaks")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, as pieces with merge-dropout."""
    return encode_documents(docs, tokenizer("piece_bpe_32k.model"), rate=0.1, seed=7)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", pieces),
]
# A fitted classifier and a keyed dropout have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
