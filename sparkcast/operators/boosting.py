"""Gradient-boosted trees: pooled over series or one model per series, early stopping, chronological tuning.

Rows are encoded once for all evaluation windows: gaps of numbers take the median of the window's training rows and a
0/1 feature says where they were, gaps of labels the most frequent label, labels their position by name, and every
feature becomes a bin of one byte. Pooled models then grow together, one aggregate per tree level for all windows (and all
trials of a search). Models per series are fitted where the series is: its rows, one per period, meet in one task, and one
job fits all series and windows.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, fields
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcast.config import PreparationConfig
from sparkcast.functions.numbers import is_finite
from sparkcast.functions.text import group_label
from sparkcast.operators.baselines import PREDICTION_COLUMNS
from sparkcast.operators.evaluate import metric_columns
from sparkcast.operators.quantiles import exact_quantiles
from sparkcast.operators.trees import Model, TreeParams, grow_local, grow_pooled
from sparkcast.session import materialize

# Limits of the search space.
SPACE = {"max_iter": (100, 1500, 50), "max_depth": (3, 10), "step_size": (0.01, 0.20), "subsample": (0.6, 1.0),
         "feature_share": (0.6, 1.0), "l1": (0.0, 10.0), "l2": (0.0, 20.0)}
MIN_GROUP_ROWS = 10
BINS = 64
# Numeric bins end at quantiles of the training rows; the sketch is exact up to this many rows and off by one part in so many beyond.
SKETCH = 10_000


class BoostingError(ValueError):
    """A boosted model cannot be fitted."""


def tree_params(params: Mapping[str, Any] | None) -> TreeParams:
    known = {f.name for f in fields(TreeParams)}
    unknown = set(params or {}) - known
    if unknown:
        raise BoostingError(f"Parameters that no boosted model has: {sorted(unknown)}")
    return TreeParams(**(params or {}))


def _value(column: str) -> Column:
    """A finite number or null."""
    v = F.col(f"`{column}`").cast("double")
    return F.when(is_finite(v), v)


def _windowed(
    panel: DataFrame, cfg: PreparationConfig, windows: Sequence[Mapping[str, Any]], numeric: Sequence[str], labels: Sequence[str],
    early_stopping: float,
) -> DataFrame:
    """Rows of each window under fixed names: window, part (train, stop, hold), series, date, key, y, x0.., c0..

    Training rows need a target; the last share of the training dates stops the growth. One date per period reaches the driver."""
    day = F.col(cfg.date_column).cast("date")
    y = _value(cfg.target_column)
    series = group_label(*[F.col(g) for g in cfg.group_columns])
    base = panel.select(
        series.alias("series"), day.alias("date"), y.alias("y"),
        *[_value(c).alias(f"x{i}") for i, c in enumerate(numeric)],
        *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(labels)],
    )
    dates = sorted(r["date"] for r in base.filter("y is not null").select("date").distinct().collect()) if early_stopping > 0 else []
    day, y = F.col("date"), F.col("y")
    spans = []
    for w in windows:
        own = [d for d in dates if w["train_start"] <= d <= w["train_end"]]
        cut = own[max(math.floor(len(own) * (1 - early_stopping)), 1) - 1] if own else w["train_end"]
        train = day.between(F.lit(w["train_start"]), F.lit(w["train_end"])) & y.isNotNull()
        hold = day.between(F.lit(w["validation_start"]), F.lit(w["validation_end"]))
        role = lambda p, w=w: F.struct(F.lit(w["window"]).cast("int").alias("window"), F.lit(p).alias("part"))
        spans += [F.when(train & (day <= F.lit(cut)), role("train")).when(train, role("stop")), F.when(hold, role("hold"))]
    return base.withColumn("key", F.xxhash64("series", "date")).withColumn("at", F.explode(F.array_compact(F.array(*spans)))).select("at.*", *base.columns, "key")


@dataclass(frozen=True)
class Encoded:
    """Binned rows of every window: window, part, series, date, key, y, bins; and the names of the features in order."""

    rows: DataFrame
    names: list[str]
    width: int


def encode(
    panel: DataFrame, cfg: PreparationConfig, windows: Sequence[Mapping[str, Any]], numeric: Sequence[str], labels: Sequence[str],
    early_stopping: float = 0.0, bins: int = BINS,
) -> Encoded:
    """Bins of all features, fitted on each window's training rows. What is fitted has one value per window, feature and bin."""
    if not 2 <= bins <= 250:
        raise BoostingError("Between 2 and 250 bins")
    numeric, labels = list(numeric), list(labels)
    rows = _windowed(panel, cfg, windows, numeric, labels, early_stopping)
    train = rows.filter("part <> 'hold'")
    grid = [i / bins for i in range(1, bins)] + [1.0]
    x, c = [f"x{i}" for i in range(len(numeric))], [f"c{i}" for i in range(len(labels))]
    fitted = train.groupBy("window").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(v).alias(f"n_{v}") for v in x],
        *[F.percentile_approx(v, grid, SKETCH).alias(f"cuts_{v}") for v in x],
    )
    fitted = {r["window"]: r.asDict() for r in fitted.collect()}
    missing = [w["window"] for w in windows if w["window"] not in fitted]
    if missing:
        raise BoostingError(f"No training rows in windows {missing}")
    gaps = [v for v in x if any(r["n"] > r[f"n_{v}"] for r in fitted.values())]
    middles: dict[tuple[int, str], float] = {}
    if gaps:
        long = train.select("window", *gaps).unpivot(["window"], gaps, "name", "value")
        middles = {(r["window"], r["name"]): r["m"] for r in exact_quantiles(long, ["window", "name"], "value", {"m": 0.5}).collect()}
    cuts = {(w, v): np.unique(np.array(r[f"cuts_{v}"] or [], float)) for w, r in fitted.items() for v in x}

    modes: dict[tuple[int, str], int] = {}
    if labels:
        counts = train.unpivot(["window"], c, "name", "category").filter("category is not null").groupBy("window", "name", "category").count()
        along = Window.partitionBy("window", "name").orderBy("category")
        every = Window.partitionBy("window", "name")
        before = F.sum("count").over(along.rowsBetween(Window.unboundedPreceding, -1))
        rank, share = F.row_number().over(along), F.floor(F.coalesce(before, F.lit(0)) * bins / F.sum("count").over(every)) + 1
        codes = counts.withColumn("code", F.when(F.count("*").over(every) <= bins, rank).otherwise(share).cast("int"))
        codes = materialize(codes, "label-codes")
        top = codes.groupBy("window", "name").agg(F.min_by("code", F.struct(-F.col("count"), F.col("category"))).alias("code"))
        modes = {(r["window"], r["name"]): r["code"] for r in top.collect()}
        for v in c:
            own = codes.filter(F.col("name") == v).select(F.col("window").alias("_w"), F.col("category").alias("_c"), F.col("code").alias(f"code_{v}"))
            rows = rows.join(own, (F.col("window") == F.col("_w")) & (F.col(v) == F.col("_c")), "left").drop("_w", "_c")
        # 0 stands for labels that training does not have
        rows = rows.withColumns({v: F.when(F.col(v).isNotNull(), F.coalesce(f"code_{v}", F.lit(0))) for v in c})

    def to_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for w, part in pdf.groupby("window", sort=False):
                made = []
                for v in x:
                    raw = part[v].to_numpy(float)
                    empty = np.isnan(raw)
                    made.append(np.searchsorted(cuts[w, v], np.where(empty, middles.get((w, v), 0.0), raw)))
                    if v in gaps:
                        made.append(empty)
                for v in c:
                    code = part[v].to_numpy(float)
                    made.append(np.where(np.isnan(code), modes.get((w, v), 0), code))
                table = np.column_stack(made).astype(np.uint8)
                out.append(part[["window", "part", "series", "date", "key", "y"]].assign(bins=[r.tobytes() for r in table]))
            if out:
                yield pd.concat(out)

    names = [n for v, name in zip(x, numeric, strict=True) for n in ([name, f"{name}_missing"] if v in gaps else [name])]
    binned = rows.select("window", "part", "series", "date", "key", "y", *x, *c).mapInPandas(
        to_bins, "window int, part string, series string, date date, key long, y double, bins binary"
    )
    return Encoded(materialize(binned, "boost-bins"), [*names, *labels], bins + 2)


def fit_pooled(encoded: Encoded, params: Sequence[TreeParams], seed: int = 42) -> dict[tuple[int, int], Model]:
    """Models by (trial, window), grown together."""
    rows = encoded.rows.filter("part <> 'hold'").withColumn("held", F.col("part") == "stop")
    return grow_pooled(rows, len(encoded.names), encoded.width, params, seed)


def _scored(encoded: Encoded, models: Mapping[tuple[int, int], Model]) -> DataFrame:
    """Held-out rows with the prediction of every trial."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for w, part in pdf.groupby("window", sort=False):
                table = np.frombuffer(b"".join(part["bins"]), np.uint8).reshape(len(part), -1)
                for (t, own), model in models.items():
                    if own == w:
                        yield part[["window", "series", "date", "y"]].assign(trial=t, prediction=model.base + model.predict(table))

    held = encoded.rows.filter("part = 'hold'").select("window", "series", "date", "y", "bins")
    return held.mapInPandas(run, "trial int, window int, series string, date date, y double, prediction double")


def _local_bins(train: pd.DataFrame, every: pd.DataFrame, x: Sequence[str], c: Sequence[str], bins: int) -> np.ndarray:
    """The encoding of `encode` for one series, fitted on its own training rows."""
    made = []
    for v in x:
        known, raw = train[v].dropna().to_numpy(float), every[v].to_numpy(float)
        ends = np.unique(np.quantile(known, np.arange(1, bins + 1) / bins, method="inverted_cdf")) if len(known) else np.zeros(0)
        made.append(np.searchsorted(ends, np.where(np.isnan(raw), np.median(known) if len(known) else 0.0, raw)))
        made.append(np.isnan(raw))
    for v in c:
        counts = train[v].dropna().value_counts()
        order = sorted(counts.index)
        code = {k: i * bins // max(len(order), bins) + 1 for i, k in enumerate(order)}
        most = min(counts.index, key=lambda k: (-counts[k], k)) if len(counts) else None
        made.append(every[v].fillna(most).map(code).fillna(0) if most is not None else np.zeros(len(every)))
    return np.column_stack(made).astype(np.uint8)


def _per_series(
    panel: DataFrame, cfg: PreparationConfig, windows: Sequence[Mapping[str, Any]], numeric: Sequence[str], labels: Sequence[str],
    params: TreeParams, early_stopping: float, seed: int, bins: int = BINS,
) -> DataFrame:
    """One model per series and window, fitted in the task that holds the series: at most one row per period and window."""
    labels = [v for v in labels if v not in cfg.group_columns]
    rows = _windowed(panel, cfg, windows, numeric, labels, 0.0)
    sizes = rows.groupBy("series", "window").agg(F.count_if(F.col("part") == "train").alias("n"), F.count_if(F.col("part") == "hold").alias("m"))
    least = sizes.filter("m > 0").agg(F.min("n")).first()[0]
    if least is not None and least < MIN_GROUP_ROWS:
        raise BoostingError("A group to be scored has no training rows" if least == 0 else "A group to be scored has too few training rows")
    x, c = [f"x{i}" for i in range(len(numeric))], [f"c{i}" for i in range(len(labels))]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for w, own in pdf.groupby("window"):
            own = own.sort_values("date")
            scored = (own["part"] == "hold").to_numpy()
            if not scored.any():
                continue
            table = _local_bins(own[~scored], own, x, c, bins)
            dates = own.loc[~scored, "date"].to_numpy()
            last = np.unique(dates)
            cut = last[max(math.floor(len(last) * (1 - early_stopping)), 1) - 1]
            held = dates > cut if early_stopping > 0 else np.zeros(len(dates), bool)
            model = grow_local(table[~scored], own.loc[~scored, "y"].to_numpy(float), held, own.loc[~scored, "key"].to_numpy(np.int64), bins + 2, params, seed)
            part = own.loc[scored, ["series", "date", "y"]].assign(trial=0, window=int(w))
            out.append(part.assign(prediction=model.base + model.predict(table[scored])))
        columns = ["trial", "window", "series", "date", "y", "prediction"]
        return pd.concat(out)[columns] if out else pdf.iloc[:0].assign(trial=0, prediction=0.0)[columns]

    return rows.groupBy("series").applyInPandas(fit, "trial int, window int, series string, date date, y double, prediction double")


def _as_predictions(scored: DataFrame, windows: Sequence[Mapping[str, Any]]) -> DataFrame:
    pick = lambda key, kind: F.element_at(F.array(*[F.lit(w[key]).cast(kind) for w in windows]), F.col("at"))
    place = reduce(lambda a, p: a.when(F.col("window") == p[1]["window"], p[0] + 1), enumerate(windows), F)
    order = Window.partitionBy("trial", "series", "window").orderBy("date")
    return (
        scored.withColumn("at", place)
        .withColumns(
            {
                "model": F.lit("gradient_boosting"), "split": pick("split", "string"), "fold": pick("fold", "int"),
                "h": F.row_number().over(order), "actual": F.col("y"), "residual": F.col("prediction") - F.col("y"),
            }
        )
        .filter(F.col("actual").isNotNull())
    )


def _numbered(windows: Sequence[Mapping[str, Any]]) -> list[dict[str, Any]]:
    return [{**w, "window": i} for i, w in enumerate(windows)]


def forecast_boosted(
    panel: DataFrame,
    cfg: PreparationConfig,
    windows: Sequence[Mapping[str, Any]],
    numeric: Sequence[str],
    labels: Sequence[str] | None = None,
    params: Mapping[str, Any] | None = None,
    early_stopping: float = 0.0,
    strategy: str = "global",
    seed: int = 42,
) -> DataFrame:
    """Predictions for each evaluation window. With early stopping the last share of the training dates, never the rows to be
    scored, decides when to stop. The number of jobs depends on neither windows nor groups."""
    if strategy not in ("global", "per_group"):
        raise BoostingError("Strategy must be global or per_group")
    labels = list(cfg.group_columns if labels is None else labels)
    windows, chosen = _numbered(windows), tree_params(params)
    if strategy == "per_group" and cfg.group_columns:
        scored = _per_series(panel, cfg, windows, numeric, labels, chosen, early_stopping, seed)
    else:
        encoded = encode(panel, cfg, windows, numeric, labels, early_stopping)
        scored = _scored(encoded, fit_pooled(encoded, [chosen], seed))
    return _as_predictions(scored, windows).select(*PREDICTION_COLUMNS)


def draw_parameters(trials: int, seed: int = 42, space: Mapping[str, tuple] = SPACE) -> list[dict[str, Any]]:
    """Seeded random draws from the search space; the step size on a log scale."""
    rng = random.Random(seed)
    low, high, step = space["max_iter"]
    return [
        {
            "max_iter": rng.randrange(low, high + 1, step),
            "max_depth": rng.randint(*space["max_depth"]),
            "step_size": math.exp(rng.uniform(*(math.log(v) for v in space["step_size"]))),
            **{k: rng.uniform(*space[k]) for k in ("subsample", "feature_share", "l1", "l2")},
        }
        for _ in range(trials)
    ]


TRIALS = "trial int, status string, parameters string, metric double, failure string"


def _scores(encoded: Encoded, windows: Sequence[Mapping[str, Any]], params: Sequence[TreeParams], metric: str, seed: int) -> dict[int, tuple]:
    """Mean over the windows of the metric, and the number of windows where it is defined, by trial."""
    predicted = _as_predictions(_scored(encoded, fit_pooled(encoded, params, seed)), windows)
    by_window = predicted.groupBy("trial", "window").agg(metric_columns()[metric].alias("m"))
    return {r["trial"]: (r["m"], r["n"]) for r in by_window.groupBy("trial").agg(F.avg("m").alias("m"), F.count("m").alias("n")).collect()}


def tune(
    panel: DataFrame,
    cfg: PreparationConfig,
    folds: Sequence[Mapping[str, Any]],
    numeric: Sequence[str],
    candidates: Sequence[Mapping[str, Any]],
    metric: str = "wape",
    early_stopping: float = 0.0,
    rungs: Sequence[int] = (),
    seed: int = 42,
) -> DataFrame:
    """One row per trial: the mean of the metric over chronological folds. A trial with unknown parameters or an undefined metric is
    kept as failed. The panel is encoded once, and all trials and folds grow in the same jobs.

    `rungs` are numbers of trees at which the worse two thirds of the trials leave (successive halving): those that leave keep the
    score of their last rung, under the parameters they were drawn with. Without rungs every trial grows to its end."""
    windows, labels = _numbered(folds), list(cfg.group_columns)
    parsed: dict[int, TreeParams] = {}
    rows: dict[int, tuple] = {}
    texts = [json.dumps(dict(p), sort_keys=True) for p in candidates]
    for i, params in enumerate(candidates):
        try:
            parsed[i] = tree_params(params)
        except (BoostingError, TypeError) as e:
            rows[i] = (i, "failed", texts[i], None, str(e)[:500])
    if parsed:
        encoded = encode(panel, cfg, windows, numeric, labels, early_stopping)
        running = sorted(parsed)
        for limit in [*rungs, None]:
            if limit is None and rungs:
                break
            given = [parsed[i] if limit is None else _shortened(parsed[i], limit) for i in running]
            found = _scores(encoded, windows, given, metric, seed)
            for place, i in enumerate(running):
                mean, n = found.get(place, (None, 0))
                good = mean is not None and n == len(windows)
                rows[i] = (i, "completed", texts[i], float(mean), None) if good else (i, "failed", texts[i], None, "The metric has no value on some fold")
            alive = sorted((i for i in running if rows[i][1] == "completed"), key=lambda i: (rows[i][3], i))
            running = sorted(alive[: max(1, math.ceil(len(alive) / 3))])
            if not running:
                break
    if all(r[1] == "failed" for r in rows.values()):
        raise BoostingError("No trial of the search gave a score")
    return panel.sparkSession.createDataFrame([rows[i] for i in sorted(rows)], TRIALS)


def _shortened(params: TreeParams, limit: int) -> TreeParams:
    return TreeParams(**{**{f.name: getattr(params, f.name) for f in fields(TreeParams)}, "max_iter": min(limit, params.max_iter)})


def tuning_summary(trials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    done = F.col("status") == "completed"
    return trials.groupBy(*by).agg(
        F.count_if(done).alias("completed_trials"),
        F.count_if(F.col("status") == "failed").alias("failed_trials"),
        F.min("metric").alias("best_score"),
        F.min_by("parameters", F.when(done, F.struct("metric", "trial"))).alias("best_parameters"),
    )


def feature_importance(encoded: Encoded, model: Model, like: DataFrame) -> DataFrame:
    """Share of each feature in the gain of all splits, adding up to one."""
    total = float(model.gain.sum()) or 1.0
    rows = [(name, float(g) / total) for name, g in zip(encoded.names, model.gain, strict=True)]
    return like.sparkSession.createDataFrame(rows, "feature string, importance double")
