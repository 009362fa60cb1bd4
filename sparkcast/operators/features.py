"""Leakage-safe features on a panel, and the catalog that describes them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.config import RATIO_PARTS, PreparationConfig
from sparkcast.functions.dates import calendar_features, holiday_flag
from sparkcast.functions.numbers import safe_ratio
from sparkcast.operators.panel import PreparationError, columns_by_role, series_window

CATALOG_SCHEMA = (
    "feature_name string, source_columns array<string>, feature_type string, semantic_role string, "
    "physical_type string, availability_type string, leakage_risk string, included boolean, "
    "generated boolean, parameters map<string,string>, lineage map<string,string>"
)
UNSAFE_TYPES = ("target", "date", "identifier", "text")


def lag_name(cfg: PreparationConfig, lag: int) -> str:
    return f"{cfg.target_column}_lag_{lag}"


def rolling_name(cfg: PreparationConfig, stat: str, window: int) -> str:
    return f"{cfg.target_column}_rolling_{stat}_{window}"


def derived_ratios(cfg: PreparationConfig, roles: Mapping[str, str]) -> dict[str, tuple[str, str, bool]]:
    """Ratios not yet in the data whose parts are: name -> (numerator, denominator, safe).

    A ratio that uses the target on either side would leak it and is not safe.
    """
    by_role = columns_by_role(roles)
    return {
        ratio: (by_role[num], by_role[den], cfg.target_column not in (by_role[num], by_role[den]))
        for ratio, (num, den) in RATIO_PARTS.items()
        if ratio not in by_role and num in by_role and den in by_role
    }


def add_lags(panel: DataFrame, cfg: PreparationConfig) -> DataFrame:
    """Target values of earlier rows of the same series; lags count rows, not time."""
    w = series_window(cfg)
    return panel.withColumns({lag_name(cfg, k): F.lag(cfg.target_column, k).over(w) for k in cfg.lag_periods})


def add_rolling(panel: DataFrame, cfg: PreparationConfig) -> DataFrame:
    """Statistics over the rows before the current one; nulls are skipped, short windows allowed."""
    w = series_window(cfg)
    stats = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    return panel.withColumns(
        {
            rolling_name(cfg, stat, size): stats[stat](cfg.target_column).over(w.rowsBetween(-size, -1))
            for size in cfg.rolling_windows
            for stat in cfg.rolling_statistics
        }
    )


def add_calendar(panel: DataFrame, cfg: PreparationConfig) -> DataFrame:
    return panel.withColumns(calendar_features(F.col(cfg.date_column)))


def add_trend(panel: DataFrame, cfg: PreparationConfig) -> DataFrame:
    w = series_window(cfg)
    date = F.col(cfg.date_column)
    return panel.withColumns(
        {
            "periods_since_start": F.row_number().over(w) - 1,
            "days_since_start": F.datediff(date, F.first(date).over(w)),
        }
    )


def add_holidays(panel: DataFrame, cfg: PreparationConfig) -> DataFrame:
    return panel.withColumn("is_holiday", holiday_flag(F.col(cfg.date_column), cfg.holiday_dates))


def add_derived(panel: DataFrame, cfg: PreparationConfig, roles: Mapping[str, str]) -> DataFrame:
    fresh = {
        name: safe_ratio(F.col(num), F.col(den))
        for name, (num, den, safe) in derived_ratios(cfg, roles).items()
        if safe
    }
    return panel.withColumns(fresh) if fresh else panel


def add_features(panel: DataFrame, cfg: PreparationConfig, roles: Mapping[str, str] | None = None) -> DataFrame:
    """Every configured feature. All windows share one partitioning and order: one shuffle, one sort."""
    out = panel
    if cfg.lag_periods:
        out = add_lags(out, cfg)
    if cfg.rolling_windows and cfg.rolling_statistics:
        out = add_rolling(out, cfg)
    if cfg.include_trend_features:
        out = add_trend(out, cfg)
    if cfg.include_calendar_features:
        out = add_calendar(out, cfg)
    if cfg.include_holiday_features:
        out = add_holidays(out, cfg)
    if cfg.include_derived_metrics:
        out = add_derived(out, cfg, roles or {})
    return out


def _generated(
    name: str,
    sources: Sequence[str],
    kind: str,
    availability: str,
    parameters: Mapping[str, str] | None = None,
    safe: bool = True,
) -> tuple:
    lineage = {"source_columns": ",".join(sources), "historical_only": str(availability == "historical_only").lower()}
    risk = "none" if safe else "target_derived"
    return (name, list(sources), kind, "unknown", "float", availability, risk, safe, True, dict(parameters or {}), lineage)


def generated_features(cfg: PreparationConfig, roles: Mapping[str, str]) -> list[tuple]:
    """Catalog rows of the features `add_features` makes."""
    rows = [
        _generated(lag_name(cfg, k), [cfg.target_column], "lag", "historical_only", {"periods": str(k)})
        for k in cfg.lag_periods
    ]
    for size in cfg.rolling_windows:
        for stat in cfg.rolling_statistics:
            parameters = {"window": str(size), "shift": "1", "statistic": stat}
            name = rolling_name(cfg, stat, size)
            rows.append(_generated(name, [cfg.target_column], "rolling", "historical_only", parameters))
    kinds: list[tuple[str, Sequence[str], Mapping[str, str]]] = []
    if cfg.include_calendar_features:
        kinds.append(("calendar", list(calendar_features(F.lit(None).cast("date"))), {}))
    if cfg.include_trend_features:
        kinds.append(("trend", ["periods_since_start", "days_since_start"], {}))
    if cfg.include_holiday_features:
        kinds.append(("holiday", ["is_holiday"], {"calendar": "user_provided"}))
    for kind, names, parameters in kinds:
        rows += [_generated(n, [cfg.date_column], kind, "known_in_advance", parameters) for n in names]
    if cfg.include_derived_metrics:
        for name, (num, den, safe) in derived_ratios(cfg, roles).items():
            availability = "observed_at_prediction_time" if safe else "target_derived"
            rows.append(_generated(name, [num, den], "derived_metric", availability, {"safe_division": "true"}, safe))
    return rows


def feature_catalog(mapping: DataFrame, cfg: PreparationConfig, roles: Mapping[str, str]) -> DataFrame:
    """Raw columns as classed by the schema mapping, then the generated features.

    `mapping` has one row per column: column_name, semantic_role, physical_type.
    """
    name = F.col("column_name")
    is_target = name == cfg.target_column
    raw = mapping.select(
        name.alias("feature_name"),
        F.array(name).alias("source_columns"),
        F.when(is_target, "target")
        .when(name == cfg.date_column, "date")
        .when(F.col("physical_type").isin("categorical", "identifier", "text"), "dimension")
        .otherwise("raw_numeric")
        .alias("feature_type"),
        "semantic_role",
        "physical_type",
        F.when(is_target, "target_derived").otherwise("unknown").alias("availability_type"),
        F.when(is_target, "excluded_target").otherwise("review").alias("leakage_risk"),
        (F.col("semantic_role") != "ignored").alias("included"),
        F.lit(False).alias("generated"),
        F.create_map().cast("map<string,string>").alias("parameters"),
        F.create_map(F.lit("source_dataset_column"), name).alias("lineage"),
    )
    generated = mapping.sparkSession.createDataFrame(generated_features(cfg, roles), CATALOG_SCHEMA)
    return raw.unionByName(generated)


def catalog_warnings(catalog: DataFrame) -> DataFrame:
    """Ratios left out because they use the target of the same period."""
    return catalog.filter(F.col("generated") & (F.col("leakage_risk") == "target_derived")).select(
        F.lit("TARGET_DERIVED_EXCLUDED").alias("code"),
        F.concat("feature_name", F.lit(" was excluded because it uses the same-period target.")).alias("message"),
    )


def safe_linear_features(catalog: DataFrame, cfg: PreparationConfig, allowed: Sequence[str] | None = None) -> DataFrame:
    """Features a linear model may use: included, known in advance, without leakage risk."""
    safe = catalog.filter(
        F.col("included")
        & (F.col("availability_type") == "known_in_advance")
        & (F.col("leakage_risk") == "none")
        & (F.col("feature_name") != cfg.target_column)
    ).select("feature_name", "feature_type", "availability_type")
    if allowed is None:
        return safe
    names = {r.feature_name for r in safe.select("feature_name").collect()}  # one row per column
    unknown = sorted(set(allowed) - names)
    if unknown:
        raise PreparationError(f"Features not safe for linear models: {', '.join(unknown)}")
    return safe.filter(F.col("feature_name").isin(*allowed))


def safe_boosted_features(catalog: DataFrame, cfg: PreparationConfig) -> DataFrame:
    """Features a boosted model may use, with the group columns. Target lags are left out: inside a
    holdout of several steps they would show realised targets."""
    name = F.col("feature_name")
    safe = (
        F.col("included")
        & (name != cfg.target_column)
        & (F.col("leakage_risk") == "none")
        & F.col("availability_type").isin("known_in_advance", "observed_at_prediction_time")
        & ~F.col("feature_type").isin(*UNSAFE_TYPES, "lag", "rolling")
    )
    return catalog.select(
        name,
        "feature_type",
        "availability_type",
        (safe | name.isin(*cfg.group_columns)).alias("allowed"),
    )


def target_copies(train: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Numeric features equal to the target on every training row, nulls included: one pass."""
    y = F.col(target).cast("double")
    flags = [F.bool_and(F.col(f).cast("double").eqNullSafe(y)).alias(f) for f in features]
    return (
        train.agg(*flags)
        .unpivot([], list(features), "feature_name", "is_target_copy")
    )
