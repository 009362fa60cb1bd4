"""Permutation importance in several jobs, and what written tables leave behind."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkcast.operators import explain
from sparkcast.session import materialize


def test_permutation_runs_in_several_jobs_agree(spark, monkeypatch):
    df = spark.createDataFrame(
        [(i, float(i % 13), None if i % 7 == 0 else float(i % 5), float(i * i % 11)) for i in range(97)], "id long, y double, p double, q double"
    )
    score = lambda d: d.withColumn("prediction", F.coalesce(F.col("p"), F.lit(9.0)) * 2 - F.col("q"))
    run = lambda: {
        r["feature"]: (r["mean_decrease"], r["std_decrease"])
        for r in explain.permutation_importance(df, "id", "y", ["p", "q"], score, lambda y, p: -F.avg(F.abs(y - p)), 3).collect()
    }
    rows = sorted(df.withColumn("u", explain.unit_hash(F.col("id"), F.lit("row"), F.lit(42))).collect(), key=lambda r: r["u"])
    loss = lambda p, q: -sum(abs(r["y"] - ((9.0 if a is None else a) * 2 - b)) for r, a, b in zip(rows, p, q, strict=True)) / 97
    p, q, steps = [r["p"] for r in rows], [r["q"] for r in rows], explain.shuffle_steps(6, 42, 97)
    moved = lambda v, a, b: [v[(a * i + b) % 97] for i in range(97)]
    drops = {"p": [loss(p, q) - loss(moved(p, *s), q) for s in steps[:3]], "q": [loss(p, q) - loss(p, moved(q, *s)) for s in steps[3:]]}
    for sent in (explain.SENT_ROWS, 200, 1):
        monkeypatch.setattr(explain, "SENT_ROWS", sent)
        got = run()
        assert {f: got[f][0] for f in drops} == {f: pytest.approx(sum(d) / 3) for f, d in drops.items()}


def test_takers_invert_donors(spark):
    for n in (1, 2, 97, 10**11 - 3):
        places = sorted({1, n, n // 2 + 1, n // 3 + 1})
        for a, b in explain.shuffle_steps(4, 7, n):
            df = spark.createDataFrame([(p, (a * (p - 1) + b) % n + 1) for p in places], "p long, donor long")
            assert all(r["p"] == r["t"] for r in df.select("p", explain._taker(F.col("donor"), a, b, n).alias("t")).collect())


def test_written_tables_leave_no_shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    shuffles = lambda: {p for d in folders for p in Path(d.getPath()).rglob("shuffle_*.data")}
    before = shuffles()
    written = materialize(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count().join(spark.range(100), F.col("k") == F.col("id")), "groups")
    left = shuffles() - before
    assert not left and written.count() == 100
