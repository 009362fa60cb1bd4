"""Explanations of a scoring function over a DataFrame.

A scorer takes a DataFrame with the feature columns and adds a `prediction` column. It is applied to
whole, distributed DataFrames; grids and repeats are constant arrays that expand the rows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcast.operators.quantiles import exact_quantiles
from sparkcast.session import materialize

Scorer = Callable[[DataFrame], DataFrame]
#: Values that one job of `permutation_importance` sends; a run sends one for each row.
SENT_ROWS = 50_000_000


def apply_scenario(df: DataFrame, assumptions: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Set, multiply or add to features; the first rule given for a feature applies."""
    out: dict[str, Column] = {}
    for feature, change in assumptions.items():
        if "override_value" in change:
            out[feature] = F.lit(change["override_value"])
        elif "multiply_by" in change:
            out[feature] = F.col(feature) * change["multiply_by"]
        elif "add_value" in change:
            out[feature] = F.col(feature) + change["add_value"]
    return df.withColumns(out) if out else df


def unit_hash(*parts: Column) -> Column:
    """A repeatable number in [0, 1) for a key: the same on every attempt and partitioning."""
    digest = F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def _positions(df: DataFrame, groups: Sequence[str], share: str, name: str) -> DataFrame:
    """Position of each row in the order of an evenly spread number, within each group.

    Equal slices of [0, 1) hold equal shares of the rows, so every window stays near a million rows.
    """
    slices = F.greatest(F.ceil(df.agg(F.count(F.lit(1))).scalar() / F.lit(1_000_000)), F.lit(1))
    tagged = df.withColumn("_slices", slices).withColumn("_slice", F.floor(F.col(share) * F.col("_slices"))).drop("_slices")
    inside = Window.partitionBy(*groups, "_slice").orderBy(share)
    sizes = tagged.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        tagged.withColumn("_n", F.row_number().over(inside))
        .join(offsets, [*groups, "_slice"])
        .withColumn(name, F.col("_offset") + F.col("_n"))
        .drop("_slice", "_n", "_offset")
    )


def shuffle_steps(runs: int, seed: int, rows: int | None = None) -> list[tuple[int, int]]:
    """(a, b) for each run: the donor of position p is (a * p + b) mod rows. Each a is a prime that does not divide the number of
    rows, so every position is a donor once; a * p + b stays below 2**63 for up to 10**11 rows."""
    rng = random.Random(seed)
    steps: list[tuple[int, int]] = []
    while len(steps) < runs:
        a, b = rng.randrange(1 << 24, 1 << 26), rng.randrange(1 << 40)
        if all(a % d for d in range(2, math.isqrt(a) + 1)) and not (rows and rows % a == 0):
            steps.append((a, b))
    return steps


def permutation_importance(
    df: DataFrame,
    key: str,
    target: str,
    features: Sequence[str],
    score: Scorer,
    metric: Callable[[Column, Column], Column],
    repeats: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Mean and deviation of the loss of a metric when one feature is shuffled.

    Rows are numbered once, in the order of a hash of the key, and written. Each (feature, repeat) then takes donors by
    arithmetic on the positions, so no run orders anything. Only the one value that a row gives and its place are sent; runs
    share a join and a job as long as they send at most `SENT_ROWS` values, and a job's shuffle files go before the next.
    The metric is higher-is-better: an aggregate of (target, prediction).
    """
    base = score(df).agg(metric(F.col(target), F.col("prediction")).alias("b")).scalar()
    numbered = _positions(df.withColumn("_share", unit_hash(F.col(key), F.lit("row"), F.lit(seed))), [], "_share", "position")
    rows = materialize(numbered.drop("_share"), "permutation")
    n = rows.count()
    steps = shuffle_steps(len(features) * repeats, seed, n)
    runs = [(f, r, *steps[i * repeats + r]) for i, f in enumerate(features) for r in range(repeats)]

    def losses(some: Sequence[tuple[str, int, int, int]]) -> DataFrame:
        given = F.array(
            *[
                F.struct(F.lit(i).alias("_run"), _taker(F.col("position"), a, b, n).alias("_taker"), F.col(f).cast("double").alias("_given"))
                for i, (f, _, a, b) in enumerate(some)
            ]
        )
        # Both sides grow with the data: always a sort-merge join.
        met = rows.hint("merge").join(rows.select(F.inline(given)), F.col("position") == F.col("_taker"))
        mine = {f: [i for i, run in enumerate(some) if run[0] == f] for f in features}
        shuffled = met.withColumns({f: F.when(F.col("_run").isin(mine[f]), F.col("_given")).otherwise(F.col(f).cast("double")) for f in features})
        names = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat")) for f, r, _, _ in some])
        scores = score(shuffled).groupBy("_run").agg(metric(F.col(target), F.col("prediction")).alias("_score"))
        return scores.select(names[F.col("_run")]["feature"].alias("feature"), names[F.col("_run")]["repeat"].alias("repeat"), "_score")

    at_once = max(1, SENT_ROWS // max(n, 1))
    parts = [losses(runs[i : i + at_once]) for i in range(0, len(runs), at_once)]
    scored = parts[0] if len(parts) == 1 else reduce(DataFrame.union, [materialize(part, "permutation-scores") for part in parts])
    return scored.withColumn("drop", base - F.col("_score")).groupBy("feature").agg(
        F.avg("drop").alias("mean_decrease"), F.stddev_pop("drop").alias("std_decrease")
    )


def _taker(position: Column, a: int, b: int, n: int) -> Column:
    """The position whose donor `position` is: (position - b) / a modulo the number of rows, in steps that stay below 2**63 for
    up to 10**11 rows."""
    n = max(n, 1)
    inverse = pow(a, -1, n)
    away = F.pmod(position - F.lit(1 + b % n), F.lit(n))
    high, low = divmod(inverse, 1 << 20)
    return ((away * F.lit(high)) % F.lit(n) * F.lit(1 << 20) + away * F.lit(low)) % F.lit(n) + 1


def partial_dependence(df: DataFrame, feature: str, score: Scorer, points: int = 20) -> DataFrame:
    """Mean prediction with one feature set to each point between its 5th and 95th percentile."""
    ends = exact_quantiles(df, [], feature, {"low": 0.05, "high": 0.95})
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    grid = ends.select(
        F.transform(
            steps,
            lambda i: F.struct(
                i.alias("point"), (F.col("low") + (F.col("high") - F.col("low")) * i / (points - 1)).alias("value")
            ),
        )
    ).scalar()
    expanded = df.withColumn("_g", F.explode(grid)).withColumn(feature, F.col("_g.value"))
    return (
        score(expanded)
        .groupBy(F.col("_g.point").alias("point"))
        .agg(F.max("_g.value").alias("grid_value"), F.avg("prediction").alias("mean_prediction"))
    )


def counterfactuals(
    df: DataFrame,
    key: str,
    controllable: Sequence[str],
    score: Scorer,
    target_range: tuple[float, float],
    bounds: Mapping[str, tuple[float, float]] | None = None,
    draws: int = 100,
    seed: int = 42,
) -> DataFrame:
    """Random changes of controllable features that bring the prediction into a range.

    Without bounds a feature is drawn between half and one and a half of its value. Draws come from
    hashes of the key, so a lost task makes the same ones again.
    """
    bounds = bounds or {}
    scored = score(df).withColumnRenamed("prediction", "baseline_prediction")
    tried = scored.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    olds = {f"_old_{f}": F.col(f).cast("double") for f in controllable}
    drawn: dict[str, Column] = {}
    for f in controllable:
        u = unit_hash(F.col(key), F.col("candidate"), F.lit(f), F.lit(seed))
        low, high = (F.lit(float(b)) for b in bounds[f]) if f in bounds else (F.col(f) * 0.5, F.col(f) * 1.5)
        drawn[f] = low + (high - low) * u
    changed = tried.withColumns(olds).withColumns(drawn)
    square = sum(((F.col(f) - F.col(f"_old_{f}")) * (F.col(f) - F.col(f"_old_{f}")) for f in controllable), F.lit(0.0))
    hits = score(changed).filter(F.col("prediction").between(*target_range))
    changes = F.create_map(
        *[
            x
            for f in controllable
            for x in (F.lit(f), F.struct(F.col(f"_old_{f}").alias("old"), F.col(f).cast("double").alias("new")))
        ]
    )
    return hits.select(
        key,
        "candidate",
        "baseline_prediction",
        F.col("prediction").alias("counterfactual_prediction"),
        changes.alias("changes"),
        F.sqrt(square).alias("distance"),
    )


def anomaly_drivers(df: DataFrame, key: str, contributions: Sequence[str], keep: int = 5) -> DataFrame:
    """The strongest contributions to each row, by size. They sit on the row: nothing is shuffled."""
    pairs = F.array(
        *[
            F.struct((-F.abs(F.col(c))).alias("order"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("contribution"))
            for c in contributions
        ]
    )
    return df.select(key, F.posexplode(F.slice(F.sort_array(pairs), 1, keep)).alias("_i", "_c")).select(
        key, (F.col("_i") + 1).alias("rank"), F.col("_c.feature").alias("feature"),
        F.col("_c.contribution").alias("contribution"),
    )


def linear_contributions(df: DataFrame, key: str, slopes: Mapping[str, float]) -> DataFrame:
    """Exact contributions of a linear model: slope times the distance from the mean, in long form."""
    means = df.agg(F.struct(*[F.avg(f).alias(f) for f in slopes])).scalar()
    parts = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), (F.lit(float(s)) * (F.col(f) - F.col(f"_m.{f}"))).alias("phi"))
            for f, s in slopes.items()
        ]
    )
    return df.withColumn("_m", means).select(key, F.explode(parts).alias("_p")).select(key, "_p.feature", "_p.phi")


def contribution_summary(contributions: DataFrame) -> DataFrame:
    """Mean absolute and mean contribution of each feature with its direction, strongest first."""
    mean = F.col("mean_contribution")
    summary = contributions.groupBy("feature").agg(
        F.avg(F.abs("phi")).alias("mean_absolute_contribution"), F.avg("phi").alias("mean_contribution")
    )
    return summary.withColumns(
        {
            "direction": F.when(mean > 0, "positive").when(mean < 0, "negative").otherwise("neutral"),
            "rank": F.row_number().over(Window.orderBy(F.col("mean_absolute_contribution").desc(), "feature")),
        }
    )
