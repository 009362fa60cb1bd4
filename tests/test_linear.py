"""Pooled linear models with group effects against the full design matrix."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcast.config import PreparationConfig
from sparkcast.operators import linear

CFG = PreparationConfig("y", "date", ("g", "h"))


def brute(x, labels, y, new_x, new_labels, alpha):
    """Centred least squares of least norm, or ridge, with a column per category; unseen categories have none."""
    known = [sorted({r[i] for r in labels if r[i] is not None}) for i in range(len(labels[0]))]
    code = lambda rows: np.array([[float(r[i] == k) for i, ks in enumerate(known) for k in ks] for r in rows])
    unit = np.where(x.std(0) > 0, x.std(0), 1.0) if alpha else np.ones(x.shape[1])
    full = np.column_stack([x / unit, code(labels)])
    mean, centre = full.mean(0), y.mean()
    if alpha:
        slopes = np.linalg.solve((full - mean).T @ (full - mean) + alpha * np.eye(full.shape[1]), (full - mean).T @ (y - centre))
    else:
        slopes = np.linalg.pinv(full - mean, rcond=1e-9) @ (y - centre)
    return (np.column_stack([new_x / unit, code(new_labels)]) - mean) @ slopes + centre


@pytest.mark.parametrize("constant", [False, True])
def test_effects_equal_the_full_design(spark, constant):
    """Unequal groups, one with a single row, null and unseen categories, a far-off feature, gaps; a column constant within groups."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        g = [None, "a", "b", "c", "d"][min(int(rng.integers(0, 12)), 4)] if i != 7 else "single"
        h = "uv"[i % 2]
        day = date(2026, 1, 1) + timedelta(days=i // 4)
        level = {"a": 5.0, "b": -3.0, "single": 90.0}.get(g, 0.0)
        gap = None if i % 11 == 3 else float(rng.normal() + 1e6)
        far = {"a": 1.0, "b": 2.0}.get(g, 7.0) if constant else float(rng.normal() * 50 - 4e4)
        rows.append((day, "new" if i % 31 == 30 and i > 200 else g, h, 3.0 * far + level + (h == "u") * 2 + float(rng.normal()), gap, far))
    frame = spark.createDataFrame(rows, "date date, g string, h string, y double, gap double, far double").repartition(5)
    window = [{"window": 3, "split": "validation", "fold": None, "train_start": date(2026, 1, 1), "train_end": date(2026, 2, 19),
               "validation_start": date(2026, 2, 20), "validation_end": date(2026, 3, 1)}]
    out = linear.forecast_linear(frame, CFG, window, ["gap", "far"]).collect()
    train, held = [r for r in rows if r[0] <= date(2026, 2, 19)], [r for r in rows if r[0] >= date(2026, 2, 20)]
    middle = float(np.median([r[4] for r in train if r[4] is not None]))
    named = [r[1] for r in train if r[1] is not None]
    mode = min(set(named), key=lambda k: (-named.count(k), k))
    cut = lambda part: (np.array([[middle if r[4] is None else r[4], r[5]] for r in part]), [(r[1] or mode, r[2]) for r in part], np.array([r[3] for r in part]))
    for model, alpha in (("linear_regression", 0.0), ("ridge_regression", 1.0)):
        want = brute(*cut(train), *cut(held)[:2], alpha)
        got = sorted((r["actual"], r["prediction"]) for r in out if r["model"] == model)
        assert np.allclose(got, sorted(zip(cut(held)[2], want)), rtol=1e-6, atol=1e-5)


def test_five_thousand_series(spark):
    """A coefficient for every series; medians and means are those of each window."""
    n = 5000
    frame = spark.range(n * 6).select(
        (F.lit(date(2026, 1, 1)) + (F.col("id") % 6).cast("int")).alias("date"), F.concat(F.lit("s"), F.floor(F.col("id") / 6).cast("string")).alias("g"),
        F.lit("x").alias("h"), (F.col("id") % 7).cast("double").alias("x"),
    ).withColumn("y", F.floor(F.substring("g", 2, 9).cast("double") * 7 % 1000) + F.col("x") * 2.5)
    windows = [
        {"window": k, "split": "backtest", "fold": k + 1, "train_start": date(2026, 1, 1), "train_end": date(2026, 1, 4 + k),
         "validation_start": date(2026, 1, 5 + k), "validation_end": date(2026, 1, 5 + k)} for k in range(2)
    ]
    out = linear.forecast_linear(frame, CFG, windows, ["x"]).toPandas()
    assert out.groupby(["model", "fold"]).size().tolist() == [n] * 4
    exact = out[out["model"] == "linear_regression"]
    assert exact["residual"].abs().max() < 1e-6
    rows = frame.toPandas()
    for fold, end in ((1, date(2026, 1, 4)), (2, date(2026, 1, 5))):
        train, held = rows[rows["date"] <= end], rows[rows["date"] == end + timedelta(days=1)]
        x, y = train["x"] / train["x"].std(ddof=0), train["y"]
        sums = train.assign(z=x).groupby("g").agg(n=("y", "size"), z=("z", "sum"), y=("y", "sum"))
        w = sums["n"] + 1.0
        system = np.array([[len(y), x.sum()], [x.sum(), (x * x).sum() + 1.0]]) - np.array([[(sums["n"] ** 2 / w).sum(), (sums["n"] * sums["z"] / w).sum()], [(sums["n"] * sums["z"] / w).sum(), (sums["z"] ** 2 / w).sum()]])
        b, slope = np.linalg.solve(system, [y.sum() - (sums["n"] * sums["y"] / w).sum(), (x * y).sum() - (sums["z"] * sums["y"] / w).sum()])
        effect = (sums["y"] - b * sums["n"] - slope * sums["z"]) / w
        want = held.assign(p=b + slope * held["x"] / train["x"].std(ddof=0) + held["g"].map(effect)).set_index("g")["p"]
        got = out[(out["model"] == "ridge_regression") & (out["fold"] == fold)].copy()
        got["g"] = got["series"].str.split("|").str[0].str.strip()
        assert np.allclose(got.set_index("g")["prediction"].sort_index(), want.sort_index(), rtol=1e-7)


def test_later_rows_change_nothing_earlier(spark):
    """The first fold neither sees categories nor medians of later rows."""
    rows = [(date(2026, 1, 1) + timedelta(days=i), "ab"[i % 2] if i < 30 else "abz"[i % 3], "x", float(i % 5), None if i % 4 == 0 else float(i % 3)) for i in range(40)]
    window = [{"window": 0, "split": "backtest", "fold": 1, "train_start": date(2026, 1, 1), "train_end": date(2026, 1, 20),
               "validation_start": date(2026, 1, 21), "validation_end": date(2026, 1, 25)},
              {"window": 1, "split": "backtest", "fold": 2, "train_start": date(2026, 1, 1), "train_end": date(2026, 2, 4),
               "validation_start": date(2026, 2, 5), "validation_end": date(2026, 2, 9)}]
    schema = "date date, g string, h string, y double, m double"
    both = linear.forecast_linear(spark.createDataFrame(rows, schema), CFG, window, ["m"]).filter("fold = 1").toPandas()
    alone = linear.forecast_linear(spark.createDataFrame(rows[:25], schema), CFG, window[:1], ["m"]).toPandas()
    key = ["model", "date"]
    assert np.allclose(both.sort_values(key)["prediction"], alone.sort_values(key)["prediction"])
