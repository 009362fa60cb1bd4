"""Whether a prepared panel can feed sequence models, and the tables such models read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcast.functions.text import series_id
from sparkcast.operators.panel import PreparationError
from sparkcast.operators.splits import SPLIT

# Name parts of columns derived from the target, and input sizes.
TARGET_DERIVED_TERMS = ("roas", "average_order_value", "revenue_per_click", "revenue_per_impression",
                        "campaign_success", "settlement")
MIN_INPUT, INPUT_PER_HORIZON, HISTORY_PER_HORIZON = 28, 4, 3
STEP_DAYS = {"daily": 1, "weekly": 7}


def resolve_input_size(horizon: int, configured: int | None = None, most: int | None = None) -> int:
    """Length of the input window: four horizons, at least 28, unless configured; `most` is a limit, off by default."""
    size = configured or max(MIN_INPUT, INPUT_PER_HORIZON * horizon)
    if size < MIN_INPUT or (most is not None and size > most):
        raise PreparationError(f"An input of {size} periods is too short or too long")
    if size < horizon:
        raise PreparationError("The input is shorter than the horizon")
    return size


def minimum_history(horizon: int, input_size: int) -> int:
    return max(input_size + horizon, HISTORY_PER_HORIZON * horizon)


def canonical_panel(panel: DataFrame, groups: Sequence[str], date: str, target: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rename to unique_id, ds, y."""
    return panel.select(
        series_id(*[F.col(g) for g in groups] or [F.lit("all")]).alias("unique_id"),
        F.col(date).alias("ds"),
        F.col(target).cast("double").alias("y"),
        *keep,
    )


def panel_duplicates(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each (series, time)."""
    counted = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
    )


def irregular_series(panel: DataFrame, series: str, date: str, frequency: str) -> DataFrame:
    """Series with a step other than the expected one. Months must be distinct; other steps are fixed."""
    w = Window.partitionBy(series).orderBy(date)
    if frequency in ("monthly", "quarterly"):
        wrong = F.trunc(date, "month") == F.trunc(F.lag(date).over(w), "month")
    elif frequency == "hourly":
        wrong = F.col(date) != F.lag(date).over(w) + F.make_dt_interval(hours=F.lit(1))
    else:
        wrong = F.datediff(date, F.lag(date).over(w)) != STEP_DAYS[frequency]
    flagged = panel.withColumn("_wrong", F.coalesce(wrong, F.lit(False)))
    by_series = flagged.groupBy(series).agg(F.count_if("_wrong").alias("n"))
    return by_series.agg(
        F.count(F.lit(1)).alias("series_count"),
        F.count_if(F.col("n") > 0).alias("irregular_series"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("irregular_steps"),
    )


def panel_blockers(panel: DataFrame, groups: Sequence[str], date: str, target: str) -> DataFrame:
    """Faults that block training, all counted in one pass."""
    y = F.col(target).cast("double")
    no_id = F.lit(False)
    for g in groups:
        no_id = no_id | F.col(g).isNull()
    return panel.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(no_id).alias("missing_group_ids"),
        F.count_if(F.col(date).isNull()).alias("invalid_times"),
        F.count_if(F.abs(y) == float("inf")).alias("infinite_targets"),
        F.count_if(y.isNull() | F.isnan(y)).alias("missing_targets"),
        F.count_if(y < -1).alias("below_log1p"),
    )


def covariate_classes(catalog: DataFrame, groups: Sequence[str], target: str) -> DataFrame:
    """Future, historical, static or excluded, with the reason for an exclusion."""
    name, lower = F.col("feature_name"), F.lower("feature_name")
    derived = F.col("availability_type") == "target_derived"
    for term in TARGET_DERIVED_TERMS:
        derived = derived | F.contains(lower, F.lit(term))
    # generated lags name their shift "periods"; catalogs from elsewhere may say "lag"
    shifts = [F.try_element_at("parameters", F.lit(key)).try_cast("int") for key in ("periods", "lag")]
    lag = F.coalesce(F.least(*shifts), F.lit(0))
    negative = F.contains(lower, F.lit("lag_-")) | (lag < 0)
    centered = F.contains(lower, F.lit("centered")) | F.coalesce(
        F.try_element_at("parameters", F.lit("centered")) == "true", F.lit(False)
    )
    unsafe = (
        (name == target)
        | ~F.col("included")
        | derived
        | ~F.col("leakage_risk").isin("none", "review")
        | negative
        | centered
        | F.col("feature_type").isin("target", "date", "identifier", "text")
    )
    return catalog.select(
        name,
        F.when(unsafe, "excluded")
        .when(F.col("availability_type") == "known_in_advance", "future")
        .when(F.col("availability_type").isin("historical_only", "observed_at_prediction_time"), "historical")
        .when(name.isin(*groups), "static")
        .otherwise("historical")
        .alias("category"),
        F.when(unsafe & (name == target), "target_column")
        .when(unsafe & derived, "target_derived")
        .when(unsafe & negative, "negative_lag")
        .when(unsafe & centered, "centered_rolling")
        .when(unsafe, "excluded_or_unsafe_feature_metadata")
        .alias("exclusion_reason"),
    )


def check_covariates(
    classes: DataFrame, requested: Mapping[str, Sequence[str] | None]
) -> dict[str, list[str]]:
    """Requested covariates by category, or all approved ones; unsafe or repeated names are refused."""
    known: dict[str, set[str]] = {}
    for r in classes.collect():  # one row per feature
        known.setdefault(r["category"], set()).add(r["feature_name"])
    chosen: dict[str, list[str]] = {}
    for category in ("historical", "future", "static"):
        names = requested.get(category)
        available = known.get(category, set())
        if names is None:
            chosen[category] = sorted(available)
            continue
        wrong = sorted(set(names) - available)
        if wrong:
            raise PreparationError(f"Unsafe or incorrectly classified {category} covariates: {', '.join(wrong)}")
        chosen[category] = list(dict.fromkeys(names))
    flat = [n for names in chosen.values() for n in names]
    if len(set(flat)) != len(flat):
        raise PreparationError("Covariate categories overlap")
    return chosen


def covariate_stats(panel: DataFrame, series: str, features: Sequence[str]) -> DataFrame:
    """Missing rate, distinct values, and whether a feature varies over time or inside a series.

    Values are counted by (feature, series, value) first, so no series is held whole in one task.
    """
    long = panel.select(series, *[F.col(f).cast("string").alias(f) for f in features]).unpivot(
        [series], list(features), "feature_name", "value"
    )
    values = long.groupBy("feature_name", series, "value").agg(F.count(F.lit(1)).alias("n"))
    by_series = values.groupBy("feature_name", series).agg(F.count(F.lit(1)).alias("inside"))
    varies = by_series.groupBy("feature_name").agg((F.max("inside") > 1).alias("varies_in_series"))
    overall = values.groupBy("feature_name", "value").agg(F.sum("n").alias("n"))
    stats = overall.groupBy("feature_name").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("_missing"),
        F.sum("n").alias("_rows"),
        F.count("value").alias("cardinality"),
        (F.count(F.lit(1)) > 1).alias("varies_over_time"),
    )
    return stats.join(varies, "feature_name").select(
        "feature_name", (F.col("_missing") / F.col("_rows")).alias("missing_rate"), "cardinality", "varies_over_time",
        "varies_in_series",
    )


def holdout_head(panel: DataFrame, series: str, date: str, horizon: int, split: str = "validation") -> DataFrame:
    """The first rows of each series in a split, numbered; the rank filter runs before the shuffle."""
    w = Window.partitionBy(series).orderBy(date)
    return (
        panel.filter(F.col(SPLIT) == split)
        .withColumn("step", F.row_number().over(w))
        .filter(F.col("step") <= horizon)
    )


def future_coverage(panel: DataFrame, series: str, date: str, features: Sequence[str], horizon: int) -> DataFrame:
    """Series whose validation head does not cover a future feature over the whole horizon."""
    head = holdout_head(panel, series, date, horizon)
    known = head.groupBy(series).agg(*[F.count(f).alias(f) for f in features])
    short = [F.count_if(F.col(f) < horizon).alias(f) for f in features]
    return known.agg(*short).unpivot([], list(features), "feature_name", "series_without_coverage").withColumn(
        "status", F.when(F.col("series_without_coverage") == 0, "complete").otherwise("missing")
    )


def static_check(panel: DataFrame, series: str, features: Sequence[str]) -> DataFrame:
    """Features that must not vary inside a series. Minimum and maximum decide it, nulls apart."""
    by_series = panel.groupBy(series).agg(
        *[
            (
                (F.min(f) != F.max(f)) | ((F.count(f) > 0) & (F.count(f) < F.count(F.lit(1))))
            ).alias(f)
            for f in features
        ]
    )
    counted = by_series.agg(*[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in features])
    return counted.unpivot([], list(features), "feature_name", "varying_series").withColumn(
        "is_static", F.col("varying_series") == 0
    )


def series_readiness(
    panel: DataFrame, series: str, date: str, target: str, horizon: int, input_size: int | None = None,
    allow_missing: bool = False,
) -> DataFrame:
    """One row per series: observations, windows of each split, and why it is not eligible."""
    size = resolve_input_size(horizon, input_size)
    need = minimum_history(horizon, size)
    rows = lambda name: F.count_if(F.col(SPLIT) == name)
    y = F.col(target).cast("double")
    counted = panel.groupBy(series).agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.min(date).alias("start"),
        F.max(date).alias("end"),
        F.count_if(y.isNull() | F.isnan(y)).alias("missing_target_count"),
        rows("train").alias("_train"),
        rows("validation").alias("_validation"),
        rows("test").alias("_test"),
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_train") < need, F.lit("insufficient_training_history")),
            F.when((F.col("missing_target_count") > 0) & F.lit(not allow_missing), F.lit("missing_targets")),
        )
    )
    windows = lambda c, span: F.greatest(F.lit(0), F.col(c) - span + 1)
    return counted.select(
        series,
        "observation_count",
        F.lit(need).alias("required_observations"),
        "start",
        "end",
        "missing_target_count",
        windows("_train", size + horizon).alias("training_windows"),
        windows("_validation", horizon).alias("validation_windows"),
        windows("_test", horizon).alias("test_windows"),
        reasons.alias("failure_reasons"),
        (F.size(reasons) == 0).alias("eligible"),
    )


def readiness_status(series: DataFrame, blockers: DataFrame | None = None) -> DataFrame:
    """Totals over the series report and the overall status."""
    counted = series.agg(
        F.count(F.lit(1)).alias("series_count"),
        F.count_if("eligible").alias("eligible_series"),
        F.sum("missing_target_count").alias("missing_targets"),
        F.sum("training_windows").alias("training_windows"),
        F.sum("validation_windows").alias("validation_windows"),
        F.sum("test_windows").alias("test_windows"),
    )
    blocked = F.col("eligible_series") < F.col("series_count")
    if blockers is not None:
        faults = blockers.agg(
            F.sum(F.col("missing_group_ids") + F.col("invalid_times") + F.col("infinite_targets"))
        ).scalar()
        blocked = blocked | (faults > 0)
    return counted.withColumn("status", F.when(blocked, "blocked").otherwise("ready"))


def sequence_windows(panel: DataFrame, series: str, date: str, target: str, input_size: int, horizon: int) -> DataFrame:
    """Every full (input, output) pair of a series, keyed by the last date of the input."""
    w = Window.partitionBy(series).orderBy(date)
    y = F.coalesce(F.col(target).cast("double"), F.lit(float("nan")))
    both = panel.select(
        series,
        F.col(date).alias("cutoff"),
        F.collect_list(y).over(w.rowsBetween(-(input_size - 1), 0)).alias("inputs"),
        F.collect_list(y).over(w.rowsBetween(1, horizon)).alias("outputs"),
    )
    return both.filter((F.size("inputs") == input_size) & (F.size("outputs") == horizon))


def fill_target(train: DataFrame, series: str, date: str, target: str) -> DataFrame:
    """Carry the last value forward, then use the median of the filled series.

    A series has one row per period, so its median is a bounded aggregate.
    """
    w = Window.partitionBy(series).orderBy(date)
    carried = train.withColumn(target, F.last(F.col(target).cast("double"), ignorenulls=True).over(w))
    return carried.withColumn(
        target, F.coalesce(F.col(target), F.median(target).over(Window.partitionBy(series)))
    )


def static_frame(panel: DataFrame, series: str, date: str, features: Sequence[str]) -> DataFrame:
    """One row per series: the features at its first date."""
    return panel.groupBy(series).agg(*[F.min_by(f, date).alias(f) for f in features])

