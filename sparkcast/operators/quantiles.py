"""Exact quantiles of any number of groups of any size, by radix descent.

`percentile` and `median` keep every distinct value of a group in one task. Here a number becomes a whole number of 64 bits
in the same order (sign, exponent, fraction), and the wanted ranks descend through it. The first scan counts values by group
and leading 32 bits, the second, only of values that share them with a wanted rank, by the trailing 32; both combine before
the shuffle. Within the counts a rank goes down 16 bits at a time, so a running sum never has more than 65,536 steps,
whatever the spread and number of the values. No group or bracket of values is held or ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcast.functions.numbers import is_finite
from sparkcast.session import materialize

HALF, STEP = 32, 16
_FRACTION = 2.0**52
_SMALLEST_NORMAL = 2.0**-1022


def with_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add a finite double as a long in the same order; both zeros are 0. The exponent comes from the logarithm, and where that
    rounds the fraction falls outside [1, 2) and moves it by one; all else is exact. Steps are columns, so that each is worked out once."""
    kept = [f"`{c}`" for c in df.columns]
    out = df.selectExpr("*", f"least(floor(log2(greatest(abs({value}), {_SMALLEST_NORMAL}D))), 1023L) AS _power")
    out = out.selectExpr("*", f"abs({value}) / pow(2D, _power) AS _part")
    fraction = "CASE WHEN _part < 1 THEN 2 * _part - 2 WHEN _part >= 2 THEN _part / 2 ELSE _part - 1 END"
    # below the smallest normal number: multiples of the smallest number there is
    size = (
        f"CASE WHEN abs({value}) < {_SMALLEST_NORMAL}D THEN cast(abs({value}) * {2.0**537}D * {2.0**537}D AS long) "
        f"ELSE shiftleft(_power + 1023L, 52) + cast({_FRACTION}D * {fraction} AS long) END"
    )
    return out.selectExpr(*kept, f"if({value} < 0, -1L, 1L) * ({size}) AS {name}")


def from_bits(bits: Column) -> Column:
    """The double that `with_bits` was given."""
    size = F.abs(bits)
    exponent, fraction = F.shiftright(size, 52), size.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    value = F.when(exponent == 0, fraction * 2.0**-537 * 2.0**-537).otherwise(
        (fraction / _FRACTION + 1) * F.pow(F.lit(2.0), (exponent - 1023).cast("double"))
    )
    return F.when(bits < 0, -value).otherwise(value)


def _descend(counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """The bin of every rank. `counts`: k, prefix, bin, c; `ranks`: k, n, prefix, t, rest (values below the rank within the prefix).
    Gives k, n, prefix, t, bin and the rest within the bin."""
    top = counts.withColumn("top", F.shiftright("bin", STEP))
    coarse = top.groupBy("k", "prefix", "top").agg(F.sum("c").alias("c"))
    coarse = coarse.withColumn("through", F.sum("c").over(Window.partitionBy("k", "prefix").orderBy("top")))
    picked = coarse.withColumnsRenamed({"k": "k_", "prefix": "prefix_"}).join(
        ranks, (F.col("k") == F.col("k_")) & (F.col("prefix") == F.col("prefix_")) & (F.col("rest") < F.col("through")) & (F.col("rest") >= F.col("through") - F.col("c"))
    )
    picked = picked.select("k", "n", "prefix", "t", "top", (F.col("rest") - F.col("through") + F.col("c")).alias("rest"))
    fine = top.withColumnsRenamed({"k": "k_", "prefix": "prefix_", "top": "top_"}).join(
        picked, (F.col("k") == F.col("k_")) & (F.col("prefix") == F.col("prefix_")) & (F.col("top") == F.col("top_"))
    )
    fine = fine.withColumn("through", F.sum("c").over(Window.partitionBy("k", "t").orderBy("bin")))
    return fine.filter("rest < through and rest >= through - c").select("k", "n", "prefix", "t", "bin", (F.col("rest") - F.col("through") + F.col("c")).alias("rest"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Interpolated quantiles as columns, one row per group that holds a finite number. Groups of null keys are groups too.

    The first scan runs at once; its ranks (two per group and probability) are written, so that their size is known to the join of the second."""
    keys = list(keys)
    v = F.col(f"`{value}`").cast("double")
    group = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    base = with_bits(df.select(group.alias("k"), v.alias("v")).filter(is_finite(F.col("v"))), "v", "u").select("k", "u")

    ends = []
    for i, p in enumerate(probabilities.values()):
        rank = (F.col("n") - 1) * F.lit(float(p))
        ends += [F.struct(F.lit(2 * i + j).alias("t"), f(rank).cast("long").alias("rest")) for j, f in enumerate((F.floor, F.ceil))]
    none = F.lit(0).cast("long")
    counts = base.groupBy("k", none.alias("prefix"), F.shiftright("u", HALF).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    ranks = counts.groupBy("k").agg(F.sum("c").alias("n")).select("k", "n", none.alias("prefix"), F.explode(F.array(*ends)).alias("r")).select("k", "n", "prefix", "r.*")
    first = materialize(_descend(counts, ranks).select("k", "n", F.col("bin").alias("prefix"), "t", "rest"), "radix-ranks")

    kept = first.select(F.col("k").alias("k_"), "prefix").distinct()
    rows = base.join(kept, (F.col("k") == F.col("k_")) & (F.shiftright("u", HALF) == F.col("prefix")))
    counts = rows.groupBy("k", "prefix", F.col("u").bitwiseAND(F.lit((1 << HALF) - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    found = _descend(counts, first).withColumn("u", F.shiftleft("prefix", HALF).bitwiseOR(F.col("bin")))
    wide = found.groupBy("k").agg(
        F.max("n").alias("_n"), *[F.max(F.when(F.col("t") == t, F.col("u"))).alias(f"_{t}") for t in range(len(ends))]
    )

    def interpolated(i: int, name: str, p: float) -> Column:
        rank = (F.col("_n") - 1) * F.lit(float(p))
        low, high = from_bits(F.col(f"_{2 * i}")), from_bits(F.col(f"_{2 * i + 1}"))
        return (low + (high - low) * (rank - F.floor(rank))).alias(name)

    return wide.select(*[F.col("k")[k].alias(k) for k in keys], *[interpolated(i, name, p) for i, (name, p) in enumerate(probabilities.items())])
