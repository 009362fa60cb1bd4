"""Forecasters, scores and fits against closed forms."""

from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcast.config import ForecastConfig, PreparationConfig
from sparkcast.operators import baselines, boosting, evaluate, linear, smoothing
from sparkcast.operators.features import add_trend, feature_catalog
from sparkcast.operators.panel import PreparationError
from sparkcast.operators.splits import evaluation_windows, split_bounds
from sparkcast.plans.experiment import run_experiment, safe_features

CFG = PreparationConfig("y", "date", ("g",))


def slices(spark, train, steps=2):
    row = [("s", "validation", None, [float(v) for v in train], [(date(2026, 2, 1) + timedelta(days=i), 100.0) for i in range(steps)])]
    return spark.createDataFrame(row, "series string, split string, fold int, train array<double>, holdout array<struct<date:date,y:double>>")


@pytest.mark.parametrize(
    "name,train,expected",
    [("naive_last", [1, 5, 7], [7, 7]), ("seasonal_naive", [9, 1, 2], [1, 2]), ("moving_average", [9, 3, 5], [4, 4]), ("drift", [2, 4, 6], [8, 10])],
)
def test_baselines(spark, name, train, expected):
    out = baselines.forecast_series(slices(spark, train), baselines.baseline_models([name], 2, [2]))
    assert [r["prediction"] for r in out.orderBy("h").collect()] == expected


def test_short_series_are_skipped_with_a_reason(spark):
    models = baselines.baseline_models(["naive_last", "seasonal_naive"], 3)
    got = {r["model"]: r["reason"] for r in baselines.skipped_series(slices(spark, [4.0, 5.0]), models).collect()}
    assert got == {"seasonal_naive": "Insufficient seasonal history"}
    assert baselines.forecast_series(slices(spark, [4.0]), models).count() == 0


def pairs(spark, rows):
    schema = "model string, series string, split string, fold int, date date, h int, actual double, prediction double"
    full = [("m", "s", "validation", None, date(2026, 1, 1) + timedelta(days=i), i + 1, a, p) for i, (a, p) in enumerate(rows)]
    return spark.createDataFrame(full, schema).withColumn("residual", F.col("prediction") - F.col("actual"))


def test_metrics(spark):
    m = evaluate.metrics(pairs(spark, [(1.0, 1.0), (2.0, 3.0), (3.0, 2.0)])).first()
    assert m["mae"] == pytest.approx(2 / 3) and m["rmse"] == pytest.approx((2 / 3) ** 0.5)
    assert m["wape"] == pytest.approx(1 / 3) and m["bias"] == pytest.approx(0) and m["median_absolute_error"] == 1.0
    assert evaluate.regression_metrics(pairs(spark, [(1.0, 1.0), (2.0, 3.0), (3.0, 2.0)])).first()["r2"] == pytest.approx(0)
    zero = evaluate.metrics(pairs(spark, [(0.0, 1.0), (0.0, 2.0)])).first()
    assert zero["wape"] is None and zero["smape"] == pytest.approx(2.0)


def test_residual_summary_matches_numpy(spark):
    rng = np.random.default_rng(3)
    a, p = rng.normal(size=60), rng.normal(size=60)
    p[7] += 25
    s = evaluate.residual_summary(pairs(spark, list(zip(a.tolist(), p.tolist())))).first()
    r = p - a
    assert s["standard_deviation"] == pytest.approx(r.std()) and s["median"] == pytest.approx(np.median(r))
    assert s["autocorrelation_lag_1"] == pytest.approx(np.corrcoef(r[:-1], r[1:])[0, 1])
    assert s["large_residual_count"] == int((abs(r) > 3 * r.std()).sum())


def test_ses_finds_the_best_weight():
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(size=120)) + 50
    weights, state, sse = smoothing.fit_smoothing("simple_exponential_smoothing", y)

    def error(alpha):
        unit, const = np.ones(len(y)), np.zeros(len(y))
        level_c, level_u = 0.0, 1.0
        for t, v in enumerate(y):
            const[t], unit[t] = v - level_c, -level_u
            level_c, level_u = level_c + alpha * (v - level_c), level_u * (1 - alpha)
        start = -(unit @ const) / (unit @ unit)
        return ((const + start * unit) ** 2).sum()

    best = min(error(a) for a in np.linspace(0, 1, 2001))
    assert sse <= best * (1 + 1e-4)


def test_holt_winters_follows_trend_and_season():
    t = np.arange(96)
    y = 100 + 2 * t + 10 * np.sin(2 * np.pi * t / 12)
    weights, state, sse = smoothing.fit_smoothing("holt_winters", y, 12)
    ahead = smoothing.project("holt_winters", weights, state, len(y), 12, 12)
    future = np.arange(96, 108)
    assert np.allclose(ahead, 100 + 2 * future + 10 * np.sin(2 * np.pi * future / 12), rtol=1e-3)


def test_damped_holt_is_finite():
    weights, state, sse = smoothing.fit_smoothing("holt_linear", np.array([1.0, 2.0, 4.0, 7.0, 11.0, 16.0]))
    assert np.isfinite(smoothing.project("holt_linear", weights, state, 6, 5, 1)).all() and 0.8 <= weights[2] <= 0.995


def test_linear_and_ridge_match_closed_forms():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [1, 10, 100] + [5, 0, 2000]
    y = x @ [1.0, -2.0, 0.5] + 7 + rng.normal(size=200)
    full = np.column_stack([np.ones(200), x, y])
    cross = full.T @ full
    intercept, slopes, _ = linear.solve(cross, [True] * 3, 0.0)
    exact = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert np.allclose([intercept, *slopes], exact, rtol=1e-6)
    intercept, slopes, _ = linear.solve(cross, [True] * 3, 1.0)
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(slopes, beta) and intercept == pytest.approx(y.mean() - beta @ x.mean(0))


@pytest.fixture(scope="module")
def two_groups(spark):
    days = spark.range(60).select(F.col("id").cast("int").alias("i"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("g"))
    y = F.when(F.col("g") == "A", 10 + F.col("i") * 2.0).otherwise(500 - F.col("i") * 1.0)
    return days.select((F.lit(date(2026, 1, 1)) + F.col("i")).alias("date"), "g", y.alias("y"))


def test_linear_ignores_holdout_targets(spark, two_groups):
    spans = linear.collect_windows(two_groups, evaluation_windows(split_bounds(two_groups, CFG), 2))
    rows = add_trend(two_groups, CFG)
    hidden = rows.withColumn("y", F.when(F.col("date") > F.lit(spans[0]["train_end"]), 9e9).otherwise(F.col("y")))
    pick = lambda p: linear.forecast_linear(p, CFG, spans[:1], ["days_since_start"]).orderBy("model", "series", "date")
    a = [r["prediction"] for r in pick(rows).collect()]
    b = [r["prediction"] for r in pick(hidden).collect()]
    assert a == pytest.approx(b) and len(a) == 2 * 2 * 9


def test_boosted_needs_enough_rows(spark, two_groups):
    spans = linear.collect_windows(two_groups, evaluation_windows(split_bounds(two_groups, CFG), 2))
    rows = add_trend(two_groups, CFG)
    out = boosting.forecast_boosted(rows, CFG, spans[:1], ["days_since_start"], params={"max_iter": 3, "max_depth": 2})
    assert out.count() == 18 and out.filter("prediction is null").count() == 0
    tiny = rows.filter("g = 'A' or date < '2026-01-05' or date > '2026-02-10'")
    with pytest.raises(boosting.BoostingError):
        boosting.forecast_boosted(tiny, CFG, spans[:1], ["days_since_start"], strategy="per_group")


def test_draws_are_seeded_and_in_range():
    a, b = boosting.draw_parameters(20, 7), boosting.draw_parameters(20, 7)
    assert a == b and all(100 <= p["max_iter"] <= 1500 and 0.01 <= p["step_size"] <= 0.2 for p in a)


def test_experiment_tests_the_winner_once(spark, two_groups):
    result = run_experiment(
        two_groups, replace(CFG, backtest_folds=2), ForecastConfig(models=("naive_last", "drift"), backtest_folds=2)
    )
    ranking = result.ranking.orderBy("rank").collect()
    assert [r["model"] for r in ranking] == ["drift", "naive_last"] and ranking[0]["selected"]
    tests = result.test_metrics.collect()
    assert len(tests) == 1 and tests[0]["wape"] == pytest.approx(0, abs=1e-9)
    assert {r["split"] for r in result.predictions.select("split").distinct().collect()} == {"validation", "backtest"}


def test_experiment_keeps_out_copies_and_unsafe_names(spark, two_groups):
    cfg = replace(CFG, backtest_folds=2)
    rows = add_trend(two_groups, cfg).withColumn("twin", F.col(cfg.target_column) * 1.0)
    assert safe_features(rows, cfg, ["days_since_start", "twin"]) == (["days_since_start"], ["days_since_start"])
    mapping = spark.createDataFrame([(cfg.target_column, "revenue", "float"), ("twin", "revenue", "float")],
                                    "column_name string, semantic_role string, physical_type string")
    catalog = feature_catalog(mapping, cfg, {})
    with pytest.raises(PreparationError):
        run_experiment(rows, cfg, ForecastConfig(models=("linear_regression",)), ["twin"], catalog)


def test_a_failing_family_does_not_end_the_experiment(spark, two_groups, monkeypatch):
    def fails(*args, **kwargs):
        raise ValueError("singular")

    monkeypatch.setattr("sparkcast.plans.experiment.forecast_linear", fails)
    cfg = replace(CFG, backtest_folds=2)
    result = run_experiment(two_groups, cfg, ForecastConfig(models=("drift", "ridge_regression"), backtest_folds=2))
    status = {r["model"]: (r["status"], r["reason"]) for r in result.statuses.collect()}
    assert status == {"drift": ("completed", None), "ridge_regression": ("failed", "singular")}
    assert result.trials.count() == 0
    tested = result.test_metrics.first()
    assert tested["model"] == "drift" and tested["mase"] is not None


def test_one_failing_model_leaves_its_family(spark, two_groups, monkeypatch):
    whole = linear.forecast_linear

    def fails(panel, cfg, windows, features, models, *rest):
        if "ridge_regression" in models:
            raise ValueError("ill-conditioned")
        return whole(panel, cfg, windows, features, models, *rest)

    monkeypatch.setattr("sparkcast.plans.experiment.forecast_linear", fails)
    cfg = replace(CFG, backtest_folds=2)
    wanted = ForecastConfig(models=("linear_regression", "ridge_regression"), backtest_folds=2)
    result = run_experiment(add_trend(two_groups, cfg), cfg, wanted, ["days_since_start"])
    status = {r["model"]: r["status"] for r in result.statuses.collect()}
    assert status == {"linear_regression": "completed", "ridge_regression": "failed"}
    assert [r["model"] for r in result.ranking.collect()] == ["linear_regression"]


def test_experiment_tunes_boosted_models(spark, two_groups):
    """Parameters are searched on the folds; the search, the fits and the ranking never read the test rows."""
    cfg = replace(CFG, backtest_folds=2)
    rows = add_trend(two_groups, cfg)
    wanted = ForecastConfig(models=("naive_last", "gradient_boosting"), backtest_folds=2, boosted_trials=3, boosted_rungs=(2, 4),
                            boosted_space={**boosting.SPACE, "max_iter": (4, 6, 2), "max_depth": (1, 3)})
    last = rows.agg(F.max("date")).first()[0]
    start = evaluate_test_start(rows, cfg)
    results = []
    for frame in (rows, rows.withColumn("y", F.when(F.col("date") >= F.lit(start), -9e9).otherwise(F.col("y")))):
        result = run_experiment(frame, cfg, wanted, ["days_since_start"])
        results.append((result.trials.orderBy("trial").collect(), result.ranking.orderBy("rank").select("model", "selection_score").collect()))
    assert results[0] == results[1] and len(results[0][0]) == 3 and last > start
    assert {r["model"] for r in results[0][1]} == {"naive_last", "gradient_boosting"}


def evaluate_test_start(panel, cfg):
    return split_bounds(panel, cfg).select("test_start").first()[0]
