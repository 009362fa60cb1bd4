"""The paths taken on large data, forced on small data and checked by brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcast.operators import encoding, explain
from sparkcast.operators.ordered import with_position, with_previous
from sparkcast.operators.quantiles import exact_quantiles, from_bits, with_bits


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_are_exact(spark, keys):
    rng = np.random.default_rng(5)
    rows = []
    for k in ("a", "b", "c"):
        # A third of the values are the same one.
        v = np.concatenate([rng.normal(size=4000) * 10, np.full(2000, 3.25)])
        rows += [(k, float(x)) for x in v]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    wanted = {"p05": 0.05, "q1": 0.25, "mid": 0.5, "q3": 0.75, "p99": 0.99}
    out = exact_quantiles(df, keys, "v", wanted).collect()
    groups = {r["k"]: [x for k, x in rows if k == r["k"]] for r in out} if keys else {None: [x for _, x in rows]}
    for r in out:
        values = groups[r["k"] if keys else None]
        for name, p in wanted.items():
            assert r[name] == pytest.approx(np.quantile(values, p), abs=1e-9)


EXTREMES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308,
            1.0, -1.0, 0.1, 3.0, 4.0, np.nextafter(4.0, 0), np.nextafter(4.0, 5), 2.0**52, 2.0**53 - 1, 1e-300, 1e300, 2.0**1023, np.nextafter(2.0**1023, 0)]


def test_bits_keep_the_order_of_numbers(spark):
    rng = np.random.default_rng(8)
    values = EXTREMES + [float(v) for v in rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500)]
    values += [float(2.0**e) for e in range(-1074, 1024, 7)]
    df = with_bits(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", "u")
    rows = df.select("v", "u", from_bits(F.col("u")).alias("w")).collect()
    assert all(r["v"] == r["w"] for r in rows)
    by_value = sorted(rows, key=lambda r: r["v"])
    assert all((a["u"] < b["u"]) == (a["v"] < b["v"]) for a, b in zip(by_value, by_value[1:]))


def test_quantiles_of_many_groups_and_a_hot_value(spark):
    """10,000 groups, null keys, values that are no numbers, and one group of which nearly all is one value between close ones."""
    many = spark.range(60_000).select(
        F.when(F.col("id") % 10_000 != 7, F.col("id") % 10_000).alias("a"), F.lit(None).cast("string").alias("b"),
        F.when(F.col("id") % 3 == 0, F.lit("nan")).otherwise(F.col("id") * 0.5).cast("double").alias("v"),
    )
    close = [1.0 + k * 2.0**-52 for k in range(5)]
    hot = spark.range(200_000).select(F.lit(-1).cast("long"), F.lit("hot"), F.lit(close[2]))
    edges = spark.createDataFrame([(-1, "hot", v) for v in close for _ in range(3)] + [(-1, "hot", float("inf"))], "a long, b string, v double")
    out = exact_quantiles(many.union(hot).union(edges).repartition(7), ["a", "b"], "v", {"low": 0.0, "mid": 0.5, "far": 0.99999, "high": 1.0}).collect()
    got = {(r["a"], r["b"]): (r["low"], r["mid"], r["high"]) for r in out}
    expected = {}
    for i in range(60_000):
        if i % 3:
            expected.setdefault((None if i % 10_000 == 7 else i % 10_000, None), []).append(i * 0.5)
    want = {k: (min(v), float(np.median(v)), max(v)) for k, v in expected.items()}
    assert got.pop((-1, "hot")) == (close[0], close[2], close[4])
    assert got == want
    assert exact_quantiles(many.filter("false"), [], "v", {"mid": 0.5}).count() == 0


def test_previous_row_across_buckets(spark):
    rng = random.Random(4)
    ids = rng.sample(range(100000), 500) + [5_000_000, 2**60]  # far values do not widen any part
    rows = [(i, rng.randrange(50)) for i in ids]
    df = spark.createDataFrame(rows, "id bigint, v int").repartition(6)
    got = {r["id"]: r["previous_v"] for r in with_previous(df, "id", ["v"], rows_per_bucket=20).collect()}
    ordered = sorted(rows)
    expected = {cur[0]: (prev[1] if prev else None) for prev, cur in zip([None, *ordered], ordered)}
    assert got == expected


def test_positions_follow_any_order(spark):
    rng = random.Random(9)
    names = [f"name-{rng.randrange(10**6):06d}" for _ in range(400)]
    df = spark.createDataFrame([(n,) for n in set(names)], "n string").repartition(7)
    got = {r["n"]: r["position"] for r in with_position(df, ["n"]).collect()}
    assert got == {n: i + 1 for i, n in enumerate(sorted(set(names)))}


def test_permutation_of_an_unused_feature_costs_nothing(spark):
    df = spark.range(300).select(
        F.col("id"), (F.col("id") * 2.0).alias("y"), F.col("id").cast("double").alias("used"), F.rand(1).alias("unused")
    )
    score = lambda d: d.withColumn("prediction", F.col("used") * 2.0)
    out = explain.permutation_importance(df, "id", "y", ["used", "unused"], score, lambda y, p: -F.avg(F.abs(y - p)), 3)
    got = {r["feature"]: r["mean_decrease"] for r in out.collect()}
    assert got["unused"] == pytest.approx(0) and got["used"] > 50


def test_one_hot_shares_a_column_for_rare_categories(spark):
    rows = [("a",)] * 5 + [("b",)] * 4 + [("c",)] * 2 + [("d",)]
    df = spark.createDataFrame(rows, "c string")
    unseen = df.union(spark.createDataFrame([("zz",)], "c string"))
    out = encoding.one_hot(unseen, df, "c", max_categories=3)
    assert [c for c in out.columns if "=" in c] == ["c=a", "c=b", "c=infrequent"]
    assert out.agg(F.sum("`c=infrequent`")).first()[0] == 3
    wide = encoding.one_hot(df, df, "c", max_categories=9)
    assert wide.agg(F.sum("`c=infrequent`")).first()[0] == 0
    many = spark.range(150).select(F.col("id").cast("string").alias("c"))
    assert len(encoding.one_hot(many, many, "c").columns) == 151
    assert out.filter("c = 'zz'").select("`c=a`", "`c=b`", "`c=infrequent`").first() == (0, 0, 0)


def test_counterfactuals_repeat(spark):
    df = spark.createDataFrame([(1, 10.0)], "id int, x double")
    score = lambda d: d.withColumn("prediction", F.col("x") * 3)
    run = lambda n: explain.counterfactuals(df.repartition(n), "id", ["x"], score, (20.0, 40.0), draws=50)
    a = sorted(run(1).select("candidate", "distance").collect())
    b = sorted(run(5).select("candidate", "distance").collect())
    assert a == b and a and all(r["distance"] <= 5 for r in a)
