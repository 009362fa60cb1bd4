"""Imputation, scaling and encoding, always fitted on training rows only.

Fitted values are small tables: one row per column, or one per category. Numeric ones reach the data as
scalar subqueries; category tables are joined, and their size decides how at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcast.operators.ordered import with_position
from sparkcast.operators.quantiles import exact_quantiles

MAX_CATEGORIES = 100
INFREQUENT = "infrequent"


def _long(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    return train.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "name", "value")


def fit_medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact median of each column; one distributed pass for all of them."""
    medians = exact_quantiles(_long(train, columns), ["name"], "value", {"median": 0.5})
    return medians.agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in columns])


def impute_median(df: DataFrame, medians: DataFrame, columns: Sequence[str]) -> DataFrame:
    filled = medians.select(F.struct(*columns)).scalar()
    return (
        df.withColumn("_m", filled)
        .withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m.{c}")) for c in columns})
        .drop("_m")
    )


def missing_indicators(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """0/1 columns for features with gaps in training. Which ones have gaps is one row of flags."""
    gaps = train.agg(*[(F.count(c) < F.count(F.lit(1))).alias(c) for c in columns]).first()
    with_gaps = [c for c in columns if gaps[c]]
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in with_gaps}) if with_gaps else df


def fit_scales(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of means and population deviations; a constant column keeps a deviation of one."""
    return train.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_deviation") for c in columns],
    )


def standard_scale(df: DataFrame, scales: DataFrame, columns: Sequence[str]) -> DataFrame:
    fitted = scales.select(F.struct(*scales.columns)).scalar()
    return (
        df.withColumn("_s", fitted)
        .withColumns({c: (F.col(c) - F.col(f"_s.{c}_mean")) / F.col(f"_s.{c}_deviation") for c in columns})
        .drop("_s")
    )


def category_counts(train: DataFrame, column: str) -> DataFrame:
    return (
        train.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fit_mode(train: DataFrame, column: str) -> Column:
    """Most frequent category; among equals the first by name."""
    counts = category_counts(train, column)
    most = counts.agg(F.max("n")).scalar()
    return counts.withColumn("_most", most).filter(F.col("n") == F.col("_most")).agg(F.min("category")).scalar()


def impute_mode(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), fit_mode(train, c)) for c in columns})


def frequent_categories(train: DataFrame, column: str, limit: int | None = None) -> list[str]:
    """Categories with a column of their own: all, or the most frequent when there are more than `limit`.

    With a limit at most `limit + 1` rows reach the driver; without one, as many as the result has columns.
    """
    if limit is None:
        return sorted(r["category"] for r in category_counts(train, column).select("category").collect())
    top = category_counts(train, column).orderBy(F.col("n").desc(), "category").limit(limit + 1).collect()
    kept = top if len(top) <= limit else top[: limit - 1]
    return sorted(r["category"] for r in kept)


def one_hot(df: DataFrame, train: DataFrame, column: str, max_categories: int | None = None) -> DataFrame:
    """0/1 columns per category; unseen categories have none. With `max_categories` the less frequent ones beyond it
    share one column, which is there even when no category is that rare."""
    counts = category_counts(train, column)
    kept = frequent_categories(train, column, max_categories)
    value = F.col(column).cast("string")
    out = df.withColumns({f"{column}={k}": F.coalesce((value == k).cast("int"), F.lit(0)) for k in kept})
    if max_categories is not None:
        rare = counts.filter(~F.col("category").isin(*kept)).select(
            F.col("category").alias("_rare"), F.lit(1).alias("_hit")
        )
        out = (
            out.join(rare, value == F.col("_rare"), "left")
            .withColumn(f"{column}={INFREQUENT}", F.coalesce("_hit", F.lit(0)))
            .drop("_rare", "_hit")
        )
    return out


def fit_ordinals(train: DataFrame, column: str) -> DataFrame:
    """Position of each category by name, from zero; works for any number of categories."""
    names = category_counts(train, column).select("category")
    return with_position(names, ["category"]).select("category", (F.col("position") - 1).cast("int").alias("code"))


def ordinal_encode(df: DataFrame, ordinals: DataFrame, column: str, unknown: int = -1) -> DataFrame:
    """Replace categories by their position; unseen ones and nulls become `unknown`."""
    codes = ordinals.select(F.col("category").alias("_category"), F.col("code").alias("_code"))
    return (
        df.join(codes, F.col(column).cast("string") == F.col("_category"), "left")
        .withColumn(column, F.coalesce("_code", F.lit(unknown)))
        .drop("_category", "_code")
    )


def encode_covariates(
    df: DataFrame, train: DataFrame, numeric: Sequence[str], labels: Sequence[str]
) -> DataFrame:
    """Covariates of sequence models: labels become sorted positions, gaps the training median."""
    out = df
    for c in labels:
        codes = fit_ordinals(train, c).select(F.col("category").alias("_category"), F.col("code").alias("_code"))
        coded = train.join(codes, F.col(c).cast("string") == F.col("_category")).select(F.col("_code").cast("double").alias(c))
        middle = fit_medians(coded, [c]).select(c).scalar()
        out = (
            out.join(codes, F.col(c).cast("string") == F.col("_category"), "left")
            .withColumn(c, F.coalesce(F.col("_code").cast("double"), middle))
            .drop("_category", "_code")
        )
    return impute_median(out, fit_medians(train, numeric), numeric) if numeric else out
