"""Scores, residual diagnostics and model selection over prediction tables.

Predictions have the columns model, series, split, fold, date, h, actual, prediction, residual.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcast.functions.labels import bias_label, root_cause_severity, root_causes
from sparkcast.functions.numbers import is_finite
from sparkcast.operators.quantiles import exact_quantiles

EPSILON = 1e-8


def finite_pairs(predictions: DataFrame) -> DataFrame:
    return predictions.filter(is_finite(F.col("actual")) & is_finite(F.col("prediction")))


def _error() -> Column:
    return F.col("prediction") - F.col("actual")


def metric_columns(epsilon: float = EPSILON) -> dict[str, Column]:
    """Aggregates that need one pass and combine on the map side."""
    e, a, p = _error(), F.abs("actual"), F.abs("prediction")
    total = F.sum(a)
    return {
        "row_count": F.count(F.lit(1)),
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(F.avg(e * e)),
        "wape": F.when(total > epsilon, F.sum(F.abs(e)) / total),
        "smape": F.avg(F.when(a + p > epsilon, 2 * F.abs(e) / (a + p)).otherwise(0.0)),
        "bias": F.avg(e),
        "mean_error": F.avg(e),
    }


def _join_small(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of two summary tables on null-safe keys."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition, "left").drop(*[f"_r_{k}" for k in keys])


def metrics(
    predictions: DataFrame,
    keys: Sequence[str] = ("model", "split", "fold"),
    scales: DataFrame | None = None,
    epsilon: float = EPSILON,
) -> DataFrame:
    """Scores per group. `scales` (split, fold[, series], scale) adds MASE, null on a zero scale."""
    pairs = finite_pairs(predictions)
    scored = pairs.groupBy(*keys).agg(*[c.alias(n) for n, c in metric_columns(epsilon).items()])
    middle = exact_quantiles(
        pairs.withColumn("_abs", F.abs(_error())), keys, "_abs", {"median_absolute_error": 0.5}
    )
    scored = _join_small(scored, middle, keys)
    if scales is not None:
        shared = [k for k in ("split", "fold", "series") if k in keys and k in scales.columns]
        scored = _join_small(scored, scales, shared)
        scored = scored.withColumn("mase", F.when(F.col("scale") > epsilon, F.col("mae") / F.col("scale"))).drop("scale")
    return scored


def naive_scales(slices: DataFrame, season: int, by_series: bool = False) -> DataFrame:
    """In-sample seasonal-naive error of the training slices: each series on its own, then the mean.

    A history no longer than the season falls back to a lag of one.
    """
    n = F.size("train")
    lag = F.when(n > season, F.lit(season)).otherwise(F.lit(1))
    later = F.slice("train", lag + 1, F.greatest(n - lag, F.lit(0)))
    earlier = F.slice("train", F.lit(1), F.greatest(n - lag, F.lit(0)))
    gaps = F.zip_with(later, earlier, lambda a, b: F.abs(a - b))
    own = F.when(n > lag, F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / (n - lag))
    scaled = slices.select("series", "split", "fold", own.alias("scale"))
    return scaled if by_series else scaled.groupBy("split", "fold").agg(F.avg("scale").alias("scale"))


def pooled_scales(slices: DataFrame, season: int) -> DataFrame:
    """Scale over all training differences of a window taken together."""
    n = F.size("train")
    lag = F.when(n > season, F.lit(season)).otherwise(F.lit(1))
    later = F.slice("train", lag + 1, F.greatest(n - lag, F.lit(0)))
    earlier = F.slice("train", F.lit(1), F.greatest(n - lag, F.lit(0)))
    total = F.aggregate(F.zip_with(later, earlier, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    parts = slices.select("split", "fold", total.alias("t"), F.greatest(n - lag, F.lit(0)).alias("k"))
    return parts.groupBy("split", "fold").agg(F.try_divide(F.sum("t"), F.sum("k")).alias("scale"))


def regression_metrics(
    predictions: DataFrame, keys: Sequence[str] = ("model", "split", "fold"), epsilon: float = EPSILON
) -> DataFrame:
    """MAE, RMSE, MAPE over non-zero actuals, sMAPE, WAPE and R2."""
    e, a = _error(), F.abs("actual")
    base = metric_columns(epsilon)
    spread = F.var_pop("actual") * F.count(F.lit(1))
    return (
        finite_pairs(predictions)
        .groupBy(*keys)
        .agg(
            base["row_count"].alias("row_count"),
            base["mae"].alias("mae"),
            base["rmse"].alias("rmse"),
            F.avg(F.when(a > epsilon, F.abs(e) / a)).alias("mape"),
            base["smape"].alias("smape"),
            base["wape"].alias("wape"),
            F.when(spread > epsilon, 1 - F.sum(e * e) / spread).alias("r2"),
        )
    )


def backtest_metrics(predictions: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Scores of each fold and of all folds together, with the deviation of the fold WAPEs.

    Grouping sets give both levels in one pass; `fold` is null on the pooled rows.
    """
    wanted = metric_columns(epsilon)
    levels = (
        finite_pairs(predictions.filter(F.col("split") == "backtest"))
        .groupingSets([["model", "fold"], ["model"]], "model", "fold")
        .agg(F.grouping("fold").alias("_pooled"), *[c.alias(n) for n, c in wanted.items()])
    )
    by_model = Window.partitionBy("model")
    deviation = F.stddev_pop(F.when(F.col("_pooled") == 0, F.col("wape"))).over(by_model)
    return levels.withColumn(
        "fold_wape_deviation", F.when(F.col("_pooled") == 1, deviation)
    ).drop("_pooled")


def residual_summary(predictions: DataFrame, keys: Sequence[str] = ("model", "split", "fold")) -> DataFrame:
    """Shape of prediction - actual: moments, median, sign share, lag-1 correlation, large residuals.

    The lag runs inside a series and window (bounded by the holdout length), in date order.
    """
    keys = list(keys)
    r = F.col("residual")
    order = Window.partitionBy(*dict.fromkeys([*keys, "model", "series", "split", "fold"])).orderBy("date")
    lagged = predictions.withColumn("_before", F.lag(r).over(order))
    first = lagged.groupBy(*keys).agg(
        F.count(r).alias("row_count"),
        F.avg(r).alias("mean"),
        F.stddev_pop(r).alias("standard_deviation"),
        F.min(r).alias("minimum"),
        F.max(r).alias("maximum"),
        F.avg((r > 0).cast("double")).alias("positive_ratio"),
        F.corr("_before", "residual").alias("autocorrelation_lag_1"),
    )
    middle = exact_quantiles(predictions, keys, "residual", {"median": 0.5})
    summary = _join_small(first, middle, keys)
    limits = summary.select(*keys, (3 * F.col("standard_deviation")).alias("_limit"))
    large = (
        _join_small(predictions, F.broadcast(limits), keys)  # one row per group
        .groupBy(*keys)
        .agg(F.count_if((F.col("_limit") > 0) & (F.abs(r) > F.col("_limit"))).alias("large_residual_count"))
    )
    return _join_small(summary, large, keys).withColumn(
        "autocorrelation_lag_1",
        F.when((F.col("row_count") > 2) & ~F.isnan("autocorrelation_lag_1"), F.col("autocorrelation_lag_1")),
    )


def residual_diagnostics(predictions: DataFrame, keys: Sequence[str] = ("model", "series", "split", "fold")) -> DataFrame:
    """Bias, skewness and lag-1 autocorrelation of actual - prediction.

    The sums follow from raw moments, so one aggregate over the lagged rows is enough.
    """
    keys = list(keys)
    order = Window.partitionBy(*dict.fromkeys([*keys, "model", "series", "split", "fold"])).orderBy("date")
    res = predictions.withColumn("_r", F.col("actual") - F.col("prediction"))
    centred = res.withColumn("_m", F.avg("_r").over(Window.partitionBy(*keys))) if "series" in keys else _join_small(
        res, F.broadcast(res.groupBy(*keys).agg(F.avg("_r").alias("_m"))), keys
    )
    d = centred.withColumn("_d", F.col("_r") - F.col("_m")).withColumn("_next", F.lead("_d").over(order))
    n = F.count("_r")
    sums = d.groupBy(*keys).agg(
        n.alias("row_count"),
        F.avg("_r").alias("mean_residual"),
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("std_residual"),
        F.avg(F.abs("_r")).alias("mae"),
        F.sum(F.col("_d") * F.col("_d") * F.col("_d")).alias("_cubes"),
        F.sum(F.col("_d") * F.col("_next")).alias("_pairs"),
    )
    s, count = F.col("std_residual"), F.col("row_count")
    return sums.select(
        *keys,
        "row_count",
        "mean_residual",
        "std_residual",
        "mae",
        F.when(s > 0, F.col("_cubes") / (count * s * s * s)).otherwise(0.0).alias("skewness"),
        F.when((count > 1) & (s > 0), F.col("_pairs") / ((count - 1) * s * s)).otherwise(0.0).alias("autocorrelation_lag1"),
        bias_label(F.col("mean_residual")).alias("bias"),
    )


def error_causes(diagnostics: DataFrame) -> DataFrame:
    """Suspected causes of forecast errors from residual diagnostics."""
    m, a = F.col("mean_residual"), F.col("autocorrelation_lag1")
    severity = root_cause_severity(m, a)
    return diagnostics.withColumns(
        {
            "suspected_causes": root_causes(m, a),
            "severity": severity,
            "confidence": F.when(severity != "low", 0.6).otherwise(0.9),
        }
    )


def rank_models(validation: DataFrame, backtest: DataFrame, metric: str = "wape") -> DataFrame:
    """Rank models: pooled backtest score, validation score, fold deviation, name; all ascending.

    Models without both scores are not ranked. One row per model reaches the window.
    """
    pooled = backtest.filter(F.col("fold").isNull()).select(
        "model", F.col(metric).alias("backtest_score"), "fold_wape_deviation"
    )
    scored = (
        validation.filter(F.col("split") == "validation")
        .select("model", F.col(metric).alias("validation_score"))
        .join(pooled, "model")
        .filter(F.col("validation_score").isNotNull() & F.col("backtest_score").isNotNull())
    )
    order = Window.orderBy("backtest_score", "validation_score", F.coalesce("fold_wape_deviation", F.lit(0.0)), "model")
    return scored.withColumn("rank", F.row_number().over(order)).withColumns(
        {
            "selection_score": F.col("rank") + F.coalesce("fold_wape_deviation", F.lit(0.0)),
            "selected": F.col("rank") == 1,
        }
    )


def model_comparison(runs: DataFrame, ranking: DataFrame) -> DataFrame:
    """Every run with its rank, unranked runs last."""
    ranked = runs.join(ranking.select("model", "rank", "selection_score", "selected"), "model", "left")
    position = Window.orderBy(F.col("rank").asc_nulls_last(), "model")
    return ranked.withColumns(
        {"position": F.row_number().over(position), "selected": F.coalesce("selected", F.lit(False))}
    )


def join_actuals(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    """Forecasts (unique_id, ds, prediction) with their actuals (unique_id, ds, y)."""
    return forecasts.join(actuals, ["unique_id", "ds"]).withColumn("residual", F.col("prediction") - F.col("y"))


def model_disagreement(predictions: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """How far two models differ on the same periods: one aggregate that pairs them, no self-join."""
    keys = ["series", "split", "fold", "date"]
    paired = (
        predictions.filter(F.col("model").isin(model_a, model_b))
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("model") == model_a, F.col("prediction"))).alias("a"),
            F.max(F.when(F.col("model") == model_b, F.col("prediction"))).alias("b"),
        )
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    )
    stats = paired.groupBy("split", "fold").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_absolute_difference"),
        F.max(F.abs(F.col("a") - F.col("b"))).alias("max_difference"),
        F.corr("a", "b").alias("_c"),
    )
    defined = F.col("_c").isNotNull() & ~F.isnan("_c")
    out = stats.withColumn("prediction_correlation", F.when(defined, F.col("_c")).otherwise(1.0)).drop("_c")
    return out.withColumn("disagreement_score", 1 - F.greatest(F.lit(0.0), F.col("prediction_correlation")))
