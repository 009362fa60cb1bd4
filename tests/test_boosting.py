"""Boosted trees against brute force, pooled against local fits, and the search."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkcast.config import PreparationConfig
from sparkcast.operators import boosting, linear
from sparkcast.operators.splits import evaluation_windows, split_bounds
from sparkcast.operators.trees import TreeParams, gradient_unit, grow_local, grow_pooled

CFG = PreparationConfig("y", "date", ("g",), backtest_folds=2)


def sample(seed=0, n=300, features=4, bins=12):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, bins, (n, features)).astype(np.uint8)
    y = x[:, 0] * 3.0 - (x[:, 1] > 5) * (x[:, 2] + 2.0) + rng.normal(size=n)
    return x, y


def brute_tree(x, r, depth, rate, l1, l2, floor):
    """The tree by trying every cut of every feature on the rows of every node."""
    shrink = lambda g: np.sign(g) * max(abs(g) - l1, 0.0)
    leaf = rate * shrink(r.sum()) / (len(r) + l2)
    if depth == 0:
        return lambda z: np.full(len(z), leaf)
    score = lambda v: shrink(v.sum()) ** 2 / (len(v) + l2)
    found = []
    for f in range(x.shape[1]):
        for b in range(int(x[:, f].max())):
            left = x[:, f] <= b
            if floor <= left.sum() <= len(r) - floor:
                found.append((score(r[left]) + score(r[~left]) - score(r), -f, -b))
    top = max(found, default=None)
    if top is None or top[0] <= 1e-9:
        return lambda z: np.full(len(z), leaf)
    best = max(((f, b) for g, f, b in found if g >= top[0] * (1 - 1e-9)))
    f, b = -best[0], -best[1]
    here = x[:, f] <= b
    go = [brute_tree(x[m], r[m], depth - 1, rate, l1, l2, floor) for m in (here, ~here)]
    return lambda z: np.where(z[:, f] <= b, go[0](z), go[1](z))


@pytest.mark.parametrize("depth,l1,l2,floor", [(1, 0.0, 0.0, 1), (3, 0.0, 0.0, 1), (4, 2.0, 5.0, 7)])
def test_trees_match_brute_force(depth, l1, l2, floor):
    x, y = sample()
    params = TreeParams(max_iter=6, max_depth=depth, step_size=0.3, l1=l1, l2=l2, min_rows=floor)
    model = grow_local(x, y, np.zeros(len(y), bool), np.arange(len(y)), 12, params, 1)
    ahead = np.full(len(y), y.mean())
    for _ in range(6):
        ahead = ahead + brute_tree(x, y - ahead, depth, 0.3, l1, l2, floor)(x)
    assert np.allclose(model.base + model.predict(x), ahead, atol=1e-6)


def pooled_rows(spark, x, y, held, window):
    pdf = pd.DataFrame({"window": window, "held": held, "key": np.arange(len(y)), "y": y, "bins": [r.tobytes() for r in x]})
    return spark.createDataFrame(pdf, "window int, held boolean, key long, y double, bins binary").repartition(5)


def test_pooled_models_equal_local_ones(spark, monkeypatch):
    """Windows and trials that grow together in Spark are what each gives alone; rows spread over tasks change nothing."""
    monkeypatch.setattr("sparkcast.operators.trees.REFRESH", 3)
    parts = [sample(k, n) for k, n in ((1, 300), (2, 180))]
    held = [np.arange(len(y)) % 5 == 0 for _, y in parts]
    params = [
        TreeParams(max_iter=8, max_depth=3, step_size=0.4, patience=2),
        TreeParams(max_iter=4, max_depth=2, step_size=0.2, subsample=0.7, feature_share=0.5, patience=9),
    ]
    x, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    keys = np.arange(len(y))
    window = np.repeat([0, 1], [300, 180])
    models = grow_pooled(pooled_rows(spark, x, y, np.concatenate(held), window), 4, 12, params, seed=9)
    assert set(models) == {(t, w) for t in (0, 1) for w in (0, 1)}
    for (t, w), model in models.items():
        own = window == w
        # the same draws as the pooled fit, step by step
        alone = brute_pooled(x[own], y[own], held[w], keys[own], params[t], (9, t))
        assert len(model.trees) == len(alone.trees)
        assert np.allclose(model.base + model.predict(x[own]), alone.base + alone.predict(x[own]), atol=1e-6)


def brute_pooled(x, y, held, keys, params, seed):
    from sparkcast.operators import trees

    class Seeded(trees.Growth):
        def __init__(self, model, p, features, own):
            super().__init__(model, p, features, (*seed, own[1]))

    original, trees.Growth = trees.Growth, Seeded
    try:
        return grow_local(x, y, held, keys, 12, params, 0)
    finally:
        trees.Growth = original


def test_held_rows_end_the_growth():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 9, (200, 3)).astype(np.uint8), rng.normal(size=200)
    held = np.arange(200) % 2 == 0
    model = grow_local(x, y, held, np.arange(200), 9, TreeParams(max_iter=60, max_depth=4, step_size=0.5, patience=5), 1)
    assert len(model.errors) < 60 and len(model.trees) == int(np.argmin(model.errors))


def test_rounded_gradients_sum_in_any_order():
    rng = np.random.default_rng(5)
    r = rng.normal(size=5000) * 1e7
    whole = np.rint(r / gradient_unit(np.abs(r).max() * 4, len(r)))
    assert whole.sum() == whole[::-1].sum() == sum(part.sum() for part in np.array_split(rng.permutation(whole), 37))


@pytest.fixture(scope="module")
def panel(spark):
    """Two series with gaps in a number and in a label; a label that training does not hold appears later."""
    rows = []
    for i in range(80):
        for g, shift in (("A", 0.0), ("B", 40.0)):
            kind = None if i % 9 == 4 else ("late" if i >= 60 else "xyz"[i % 3])
            rows.append((date(2026, 1, 1) + timedelta(days=i), g, shift + 10.0 * (i % 3) + i * 0.1, None if i % 5 == 2 else float(i % 3), kind))
    return spark.createDataFrame(rows, "date date, g string, y double, wave double, kind string").repartition(4)


def spans_of(panel):
    return linear.collect_windows(panel, evaluation_windows(split_bounds(panel, CFG), 2, 2))


@pytest.mark.parametrize("strategy", ["global", "per_group"])
def test_gaps_and_unseen_labels(spark, panel, strategy):
    spans = spans_of(panel)
    out = boosting.forecast_boosted(panel, CFG, spans, ["wave"], ["g", "kind"], {"max_iter": 25, "step_size": 0.3}, strategy=strategy).toPandas()
    assert out["prediction"].notna().all() and len(out) == sum(2 * ((s["validation_end"] - s["validation_start"]).days + 1) for s in spans)
    assert (out["residual"] - (out["prediction"] - out["actual"])).abs().max() < 1e-9
    assert out["residual"].abs().mean() < 8.0
    assert sorted(out.groupby(["series", "split"])["h"].min().unique()) == [1]


def test_encoding(spark, panel):
    spans = spans_of(panel)[:1]
    encoded = boosting.encode(panel, CFG, spans, ["wave"], ["kind"])
    assert encoded.names == ["wave", "wave_missing", "kind"]
    rows = encoded.rows.toPandas()
    bins = np.array([list(b) for b in rows["bins"]])
    source = panel.select(F.col("date"), F.col("g").alias("series"), "wave", "kind").toPandas()
    both = rows.assign(b0=bins[:, 0], b1=bins[:, 1], b2=bins[:, 2]).merge(source, on=["date", "series"])
    train = both[both["part"] == "train"]
    middle, mode = train["wave"].median(), train["kind"].mode().min()
    values = sorted(train["wave"].dropna().unique())
    assert (both["b0"] == np.searchsorted(values, both["wave"].fillna(middle))).all()
    assert (both["b1"] == both["wave"].isna()).all()
    code = {k: i + 1 for i, k in enumerate(sorted(train["kind"].dropna().unique()))}
    assert (both["b2"] == both["kind"].fillna(mode).map(code).fillna(0)).all()
    assert (both["kind"] == "late").any()


def test_many_categories_keep_their_order(spark):
    rows = [(date(2026, 1, 1) + timedelta(days=i), f"s{k:04d}", float(k)) for i in range(4) for k in range(500)]
    frame = spark.createDataFrame(rows, "date date, g string, y double")
    window = [{"window": 0, "split": "validation", "fold": None, "train_start": date(2026, 1, 1), "train_end": date(2026, 1, 3),
               "validation_start": date(2026, 1, 4), "validation_end": date(2026, 1, 4)}]
    found = boosting.encode(frame, CFG, window, [], ["g"]).rows.toPandas().sort_values("series")
    codes = np.array([b[0] for b in found["bins"]])
    assert (np.diff(codes) >= 0).all() and set(codes) == set(range(1, boosting.BINS + 1))
    out = boosting.forecast_boosted(frame, CFG, window, [], params={"max_iter": 40, "max_depth": 5, "step_size": 0.5}).toPandas()
    assert out["residual"].abs().mean() < 5


def test_search(spark, panel):
    folds = [s for s in spans_of(panel) if s["split"] == "backtest"]
    small = [{"max_iter": n, "max_depth": d, "step_size": 0.3} for n, d in ((1, 1), (9, 2), (9, 3))]
    whole = boosting.tune(panel, CFG, folds, ["wave"], [*small, {"leaves": 3}]).toPandas()
    assert whole["status"].tolist() == ["completed"] * 3 + ["failed"]
    alone = boosting.tune(panel, CFG, folds, ["wave"], small[1:2]).toPandas()
    assert alone["metric"][0] == pytest.approx(whole["metric"][1])
    assert whole["metric"][0] > whole["metric"][1]
    halved = boosting.tune(panel, CFG, folds, ["wave"], small, rungs=(2, 9)).toPandas()
    short = boosting.tune(panel, CFG, folds, ["wave"], [{**p, "max_iter": min(2, p["max_iter"])} for p in small]).toPandas()
    winner = short["metric"].idxmin()
    for i in range(3):  # the best after two trees goes on, the others keep the score they left with
        assert halved["metric"][i] == pytest.approx((whole if i == winner else short)["metric"][i])
    with pytest.raises(boosting.BoostingError):
        boosting.tune(panel, CFG, folds, ["wave"], [{"leaves": 3}])


def test_short_and_unseen_groups(spark, panel):
    spans = spans_of(panel)[:1]
    short = panel.filter("g = 'A' or date > date_sub(date'%s', 3)" % spans[0]["train_end"])
    for rows in (short, panel.filter("g = 'A' or date > date'%s'" % spans[0]["train_end"])):
        with pytest.raises(boosting.BoostingError):
            boosting.forecast_boosted(rows, CFG, spans, ["wave"], strategy="per_group")
    early = panel.filter("g = 'A' or date < '2026-01-05'")  # too short, but nothing of it is scored
    assert boosting.forecast_boosted(early, CFG, spans, ["wave"], params={"max_iter": 2}, strategy="per_group").filter("series = 'B'").count() == 0
    with pytest.raises(boosting.BoostingError):
        boosting.forecast_boosted(panel, CFG, spans, ["wave"], params={"bogus": 1})
    nothing = [replace_window(spans[0], train_start=date(2020, 1, 1), train_end=date(2020, 2, 1))]
    with pytest.raises(boosting.BoostingError):
        boosting.forecast_boosted(panel, CFG, nothing, ["wave"])


def replace_window(window, **new):
    return {**window, **new}
