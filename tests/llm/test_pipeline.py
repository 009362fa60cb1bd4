"""Registered SQL on the smallest tables, and the pipeline against its stages done by plain means."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sparkcast.llm.queries import QUERIES, SQL

from .test_operators import brute_components, brute_contamination


def rows(names, records):
    order = sorted(names)
    at = [list(names).index(n) for n in order]
    return sorted(repr([r[i] for i in at]) for r in records)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(SQL[name])
    df = QUERIES[name](spark, sf_dir)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())


def test_registered():
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in entry.queries()


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r.doc_id for r in QUERIES["op3_toxicity"](spark, sf_dir).filter("predicted = 1").collect()}
    left = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id not in toxic]
    seen: set = set()
    left = [(d, t) for d, t in left if not (t in seen or seen.add(t))]
    roots = brute_components([t for _, t in left], 80)
    left = [x for k, (x, (_, root)) in enumerate(zip(left, roots, strict=True)) if root == k]
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    hit = brute_contamination(left, items)
    want = {d for d, _ in left if not hit[d][1]}
    out = corpus_pipeline.run(spark, sf_dir)
    got = out.collect()
    assert {r.doc_id for r in got} == want and all(r.lossless for r in got)


def test_pipeline_on_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0


def test_pipeline_keeps_one_of_repeated_rows(spark, make_docs, sf_dir):
    texts, ids = ["same text", "same text", "same text", "other text", "same text", None, "", "alone"], [5, 5, 9, 9, None, 7, 7, None]
    left = corpus_pipeline.exact_dedup(spark, make_docs(texts, ids), sf_dir)
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "alone"), (5, "same text"), (7, ""), (9, "other text")]
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.decontamination):
        left = stage(spark, left, sf_dir)
    assert left.count() == 4
