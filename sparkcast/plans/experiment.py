"""A forecast experiment: backtest many models, rank them, test the winner once."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.config import (
    BASELINE_MODELS,
    BOOSTED_MODELS,
    LINEAR_MODELS,
    SMOOTHING_MODELS,
    ForecastConfig,
    PreparationConfig,
    seasonal_period,
)
from sparkcast.operators import baselines, evaluate, smoothing
from sparkcast.operators.boosting import SPACE, TRIALS, draw_parameters, forecast_boosted, tune
from sparkcast.operators.evaluate import metric_columns
from sparkcast.operators.features import safe_boosted_features, safe_linear_features, target_copies
from sparkcast.operators.linear import collect_windows, forecast_linear
from sparkcast.operators.splits import evaluation_windows, split_bounds
from sparkcast.session import materialize

# Share of the training dates that decides when boosting stops.
EARLY_STOPPING = 0.15


@dataclass(frozen=True)
class ExperimentResult:
    predictions: DataFrame
    metrics: DataFrame
    backtest: DataFrame
    ranking: DataFrame
    skipped: DataFrame
    test_metrics: DataFrame
    statuses: DataFrame
    trials: DataFrame


def safe_features(
    panel: DataFrame, cfg: PreparationConfig, features: Sequence[str], catalog: DataFrame | None = None
) -> tuple[list[str], list[str]]:
    """Features for linear and for boosted models: those the catalog allows, without exact copies of the target.

    A name that the catalog does not hold safe for linear models is an error, as it was asked for. Copies are
    judged on the training rows alone. Without a catalog only copies are left out.
    """
    linear = boosted = list(features)
    if catalog is not None and features:
        linear = [r["feature_name"] for r in safe_linear_features(catalog, cfg, features).collect()]
        allowed = safe_boosted_features(catalog, cfg).filter("allowed").collect()  # one row per column
        boosted = [f for f in features if f in {r["feature_name"] for r in allowed}]
    text = {name for name, kind in panel.dtypes if kind in ("string", "boolean", "date", "timestamp")}
    numeric = [f for f in features if f not in text]
    if numeric:
        until = split_bounds(panel, cfg).select("train_end").scalar()
        train = panel.withColumn("_until", until).filter(F.col(cfg.date_column).cast("date") <= F.col("_until"))
        found = target_copies(train, cfg.target_column, numeric).filter("is_target_copy").collect()
        copies = {r["feature_name"] for r in found}
        linear, boosted = [f for f in linear if f not in copies], [f for f in boosted if f not in copies]
    return linear, boosted


def forecast_families(
    panel: DataFrame,
    cfg: PreparationConfig,
    forecast: ForecastConfig,
    features: Sequence[str] = (),
    boosted_features: Sequence[str] | None = None,
    final_test: bool = False,
    models: Sequence[str] | None = None,
) -> tuple[list[tuple[list[str], Callable[[Sequence[str]], DataFrame]]], DataFrame]:
    """(models, predictions to be made) of each family that shares a pass, and the slices of all windows.

    With `final_test` the only window is the test, trained on everything before it.
    """
    wanted = list(models or forecast.models)
    season = seasonal_period(cfg.frequency, forecast.seasonal_period)
    windows = evaluation_windows(
        split_bounds(panel, cfg), cfg.backtest_folds, forecast.backtest_folds, only_test=final_test
    )
    slices = baselines.evaluation_slices(baselines.series_histories(panel, cfg), windows)
    spans = lambda: collect_windows(panel, windows)
    linear = forecast.linear_features or features
    boosted = features if boosted_features is None else boosted_features
    makers = (
        (BASELINE_MODELS, lambda own: baselines.forecast_series(
            slices, baselines.baseline_models(own, season, forecast.moving_average_windows))),
        (SMOOTHING_MODELS, lambda own: smoothing.forecast_smoothing(slices, own, season)),
        (LINEAR_MODELS, lambda own: forecast_linear(panel, cfg, spans(), linear, own)),
        (BOOSTED_MODELS, lambda own: forecast_boosted(
            panel, cfg, spans(), boosted, params=forecast.boosted_params, early_stopping=EARLY_STOPPING,
            strategy=forecast.boosted_strategy, seed=forecast.boosted_seed)),
    )
    families = []
    for known, make in makers:
        own = [m for m in wanted if m in known]
        if own:
            families.append((own, make))
    return families, slices


def tuned(
    panel: DataFrame, cfg: PreparationConfig, forecast: ForecastConfig, features: Sequence[str]
) -> tuple[ForecastConfig, DataFrame]:
    """The configuration with the best boosted parameters found on the backtest folds, and the trials. The test is not read."""
    windows = evaluation_windows(split_bounds(panel, cfg), cfg.backtest_folds, forecast.backtest_folds)
    folds = [w for w in collect_windows(panel, windows) if w["split"] == "backtest"]
    metric = forecast.selection_metric if forecast.selection_metric in metric_columns() else "wape"
    drawn = draw_parameters(forecast.boosted_trials, forecast.boosted_seed, forecast.boosted_space or SPACE)
    trials = tune(panel, cfg, folds, features, drawn, metric, EARLY_STOPPING, forecast.boosted_rungs, forecast.boosted_seed)
    best = trials.filter("status = 'completed'").orderBy("metric", "trial").first()
    return replace(forecast, boosted_params=json.loads(best["parameters"]), boosted_trials=0), trials


def _attempt(own: Sequence[str], make: Callable[[Sequence[str]], DataFrame]) -> tuple[list[DataFrame], list[tuple]]:
    """Written predictions and statuses of models that share a pass. Where the pass fails, each model is tried by itself."""
    try:
        return [materialize(make(own), "predictions")], [(m, "completed", None) for m in own]
    except (ValueError, PySparkException) as e:
        if len(own) == 1:
            return [], [(own[0], "failed", str(e).split("\n", 1)[0])]
    tried = [_attempt([m], make) for m in own]
    return [p for parts, _ in tried for p in parts], [s for _, statuses in tried for s in statuses]


def run_experiment(
    panel: DataFrame,
    cfg: PreparationConfig,
    forecast: ForecastConfig,
    features: Sequence[str] = (),
    catalog: DataFrame | None = None,
) -> ExperimentResult:
    """Everything in the order that keeps the test set unseen: the test is scored for the winner only.

    The panel and the predictions are written once to the shared folder, as many steps read them. Models that share a pass
    are written together; where that fails they are tried one by one, and those that fail are marked and the others go on. With
    `boosted_trials` the boosted parameters are searched on the backtest folds first.
    """
    stored = materialize(panel, "panel")
    linear, boosted = safe_features(stored, cfg, features, catalog)
    if forecast.linear_features:
        own, _ = safe_features(stored, cfg, forecast.linear_features, catalog)
        forecast = replace(forecast, linear_features=tuple(own))
    parts, statuses = [], []
    trials = panel.sparkSession.createDataFrame([], TRIALS)
    if forecast.boosted_trials and set(forecast.models) & set(BOOSTED_MODELS):
        try:
            forecast, trials = tuned(stored, cfg, forecast, boosted)
        except (ValueError, PySparkException) as e:
            statuses += [(m, "failed", str(e).split("\n", 1)[0]) for m in BOOSTED_MODELS]
    searched = {m for m, _, _ in statuses}
    families, slices = forecast_families(
        stored, cfg, forecast, linear, boosted, models=[m for m in forecast.models if m not in searched]
    )
    for own, make in families:
        made, noted = _attempt(own, make)
        parts += made
        statuses += noted
    if not parts:
        raise ValueError(f"No model could be fitted: {statuses}")
    predictions = reduce(DataFrame.unionByName, parts)
    season = seasonal_period(cfg.frequency, forecast.seasonal_period)
    scale = evaluate.pooled_scales if forecast.pooled_scale else evaluate.naive_scales
    metrics = evaluate.metrics(predictions, scales=scale(slices, season), epsilon=forecast.epsilon)
    backtest = evaluate.backtest_metrics(predictions, forecast.epsilon)
    ranking = materialize(evaluate.rank_models(metrics, backtest, forecast.selection_metric), "ranking")
    winner = ranking.filter("selected").first()
    if winner is None:
        raise ValueError("No model has valid scores to be ranked by")
    name = winner["model"]
    base = "moving_average" if name.startswith("moving_average_") else name
    last, test_slices = forecast_families(stored, cfg, forecast, linear, boosted, final_test=True, models=[base])
    own, make = last[0]
    test = make(own).filter(F.col("model") == name)
    chosen = baselines.baseline_models(
        [m for m in forecast.models if m in BASELINE_MODELS], season, forecast.moving_average_windows
    )
    smoothed = [(m, smoothing.skip_reason(m, season)) for m in forecast.models if m in SMOOTHING_MODELS]
    return ExperimentResult(
        predictions, metrics, backtest, ranking, baselines.skipped_series(slices, chosen, smoothed),
        evaluate.metrics(test, scales=scale(test_slices, season), epsilon=forecast.epsilon),
        panel.sparkSession.createDataFrame(statuses, "model string, status string, reason string"),
        trials,
    )
