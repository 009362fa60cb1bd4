"""Linear and ridge regression pooled over series, fitted for every evaluation window at once.

One categorical column, the one with most categories (usually the series), never becomes columns of the system: its effects are
eliminated exactly. With sums s_g and counts n_g of each category, the system for intercept and slopes is
X'X + aI - sum of s_g s_g' / (n_g + a), and each effect follows from its own sums, so any number of series has a coefficient
of its own. Categories of further columns are columns of the system. Values are shifted by the window's means before they are
multiplied; medians, means and categories come from the window's own training rows. One matrix per window reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcast.config import PreparationConfig
from sparkcast.functions.numbers import is_finite
from sparkcast.functions.text import group_label
from sparkcast.operators.baselines import PREDICTION_COLUMNS
from sparkcast.operators.encoding import frequent_categories
from sparkcast.operators.quantiles import exact_quantiles
from sparkcast.session import materialize

CUTOFF = 1e-11
GRAM = "window int, kind int, bucket int, cross array<double>"


def collect_windows(panel: DataFrame, windows: Column) -> list[dict[str, Any]]:
    """Evaluation windows as plain values: one row per fold and split."""
    rows = panel.sparkSession.range(1).select(windows.alias("w")).first()["w"]
    return [{"window": i, **r.asDict()} for i, r in enumerate(rows)]


def solve(cross: np.ndarray, scaled: Sequence[bool], alpha: float) -> tuple[float, np.ndarray, float]:
    """Intercept and slopes from cross products of [1, x, y]. The intercept is not penalised.

    Without a penalty the solution of least norm is taken, so collinear columns are harmless. With
    one, columns marked `scaled` are measured in standard deviations.
    """
    n = cross[0, 0]
    means = cross[0, 1:-1] / n
    mean_y = cross[0, -1] / n
    xx = cross[1:-1, 1:-1] - n * np.outer(means, means)
    xy = cross[1:-1, -1] - n * means * mean_y
    unit = np.ones(len(means))
    if alpha > 0:
        deviation = np.sqrt(np.clip(np.diag(xx) / n, 0, None))
        unit = np.where(np.array(scaled, dtype=bool) & (deviation > 0), deviation, 1.0)
        system = xx / np.outer(unit, unit) + alpha * np.eye(len(unit))
        slopes = np.linalg.solve(system, xy / unit) / unit
    else:
        slopes = np.linalg.pinv(xx, rcond=CUTOFF, hermitian=True) @ xy
    return float(mean_y - slopes @ means), slopes, float(n)


def solve_with_effects(
    cross: np.ndarray, weighted: np.ndarray, means: np.ndarray, unit: np.ndarray, alpha: float
) -> tuple[float, np.ndarray]:
    """Intercept and slopes beside effects of one categorical column that sum to zero (no penalty) or are penalised like slopes.

    All matrices are over [1, x, y]: `cross` adds up rows, `weighted` adds up s s' / (n + alpha) and `means` adds up
    (s / n)(s / n)' over categories, s being the sums of [1, x, y] over the n rows of one. `unit` measures the slopes."""
    p = len(unit)
    if alpha > 0:
        # effects are e_g = (sum over g of y - b - x slopes) / (n_g + alpha); what is left is a system for b and the slopes
        scale = np.concatenate(([1.0], unit))
        system = (cross - weighted)[:-1, :-1] / np.outer(scale, scale) + alpha * np.diag([0.0] + [1.0] * p)
        found = np.linalg.solve(system, (cross - weighted)[:-1, -1] / scale) / scale
        return float(found[0]), found[1:]
    within = (cross - weighted)[1:, 1:]
    # columns in units of their spread within categories; where that is only noise, of their whole spread
    inner, whole = np.diag(within)[:-1], np.diag(cross)[1:-1]
    size = np.sqrt(np.clip(np.where(inner > CUTOFF * whole, inner, whole), 0, None))
    size = np.where(size > 0, size, 1.0)
    values, vectors = np.linalg.eigh(within[:-1, :-1] / np.outer(size, size))
    kept = values > CUTOFF * max(values.max(initial=0.0), 0.0)
    slopes = vectors[:, kept] @ ((vectors[:, kept].T @ (within[:-1, -1] / size)) / values[kept]) / size
    groups = means[0, 0]
    centre = means[0, 1:] / groups
    spread = means[1:, 1:] - groups * np.outer(centre, centre)
    if (~kept).any():
        # Directions that are constant within categories trade against the effects: take the solution of least norm over both.
        free = vectors[:, ~kept] / size[:, None]
        system = free.T @ free + free.T @ spread[:-1, :-1] @ free
        slopes = slopes + free @ np.linalg.solve(system, free.T @ (spread[:-1, -1] - spread[:-1, :-1] @ slopes - slopes))
    return float(centre[-1] - centre[:-1] @ slopes), slopes


def _rows(
    panel: DataFrame, cfg: PreparationConfig, windows: Sequence[dict[str, Any]], numeric: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """Rows of each window under fixed names: window, split, fold, train, series, date, y, x0.., c0.."""
    day = F.col(cfg.date_column).cast("date")
    y = F.col(f"`{cfg.target_column}`").cast("double")
    spans = []
    for w in windows:
        names = [F.lit(w["window"]).cast("int").alias("window"), F.lit(w["split"]).alias("split"), F.lit(w["fold"]).cast("int").alias("fold")]
        for start, end, train in (("train_start", "train_end", True), ("validation_start", "validation_end", False)):
            inside = day.between(F.lit(w[start]), F.lit(w[end])) & (is_finite(y) if train else F.lit(True))
            spans.append(F.when(inside, F.struct(*names, F.lit(train).alias("train"))))
    value = lambda c: F.when(is_finite(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    return panel.select(
        group_label(*[F.col(g) for g in cfg.group_columns]).alias("series"), day.alias("date"), y.alias("y"),
        *[value(c).alias(f"x{i}") for i, c in enumerate(numeric)],
        *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(categorical)],
        F.explode(F.array_compact(F.array(*spans))).alias("at"),
    ).select("at.*", "series", "date", "y", *[f"x{i}" for i in range(len(numeric))], *[f"c{i}" for i in range(len(categorical))])


def _by_window(values: dict[int, Any], default: Any, kind: str = "double") -> Column:
    """A constant for each window, one row per fold and split."""
    out = F.lit(default).cast(kind)
    for w, v in values.items():
        out = F.when(F.col("window") == w, F.lit(v).cast(kind)).otherwise(out)
    return out


def _filled(rows: DataFrame, x: Sequence[str], c: Sequence[str]) -> DataFrame:
    """Gaps take the median, of categories the most frequent one, of the window's training rows; without gaps this costs one counting pass."""
    if not [*x, *c]:
        return rows
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(v).alias(v) for v in (*x, *c)]).first()
    gaps, holes = ([v for v in names if counts[v] < counts["n"]] for names in (x, c))
    train = rows.filter("train")
    fill: dict[str, dict[int, Any]] = {v: {} for v in (*gaps, *holes)}
    if gaps:
        long = train.select("window", *gaps).unpivot(["window"], gaps, "name", "value")
        for r in exact_quantiles(long, ["window", "name"], "value", {"m": 0.5}).collect():
            fill[r["name"]][r["window"]] = r["m"]
    if holes:
        known = train.select("window", *holes).unpivot(["window"], holes, "name", "category").filter("category is not null")
        most = known.groupBy("window", "name", "category").count().groupBy("window", "name")
        for r in most.agg(F.min_by("category", F.struct(-F.col("count"), F.col("category"))).alias("m")).collect():
            fill[r["name"]][r["window"]] = r["m"]
    # a column without any value in training is constant there
    return rows.withColumns({v: F.coalesce(v, _by_window(fill[v], 0.0 if v in gaps else None, "double" if v in gaps else "string")) for v in fill})


def _grams(rows: DataFrame, columns: Sequence[str], weights: Sequence[Column]) -> DataFrame:
    """Sums of weight * v v' by window and kind of weight, v being the columns; added up per task, then in two steps."""
    size, kinds = len(columns), len(weights)
    given = rows.select("window", *columns, *[w.cast("double").alias(f"w_{k}") for k, w in enumerate(weights)])

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for w, part in pdf.groupby("window", sort=False):
                v = part[list(columns)].to_numpy(float)
                for k in range(kinds):
                    found = v.T @ (v * part[f"w_{k}"].to_numpy(float)[:, None])
                    total[int(w), k] = total[int(w), k] + found if (int(w), k) in total else found
        spread = TaskContext.get().partitionId() % 64  # the same when a lost task runs again
        if total:
            yield pd.DataFrame({"window": [w for w, _ in total], "kind": [k for _, k in total], "bucket": spread, "cross": [m.ravel() for m in total.values()]})

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(bucket=0, cross=[np.sum(np.stack(pdf["cross"].to_list()), axis=0).reshape(size * size)])

    partial = given.mapInPandas(add_up, GRAM)
    return partial.groupBy("window", "kind", "bucket").applyInPandas(combine, GRAM).groupBy("window", "kind").applyInPandas(combine, GRAM)


def _collected(grams: DataFrame, size: int) -> dict[tuple[int, int], np.ndarray]:
    return {(r["window"], r["kind"]): np.array(r["cross"]).reshape(size, size) for r in grams.collect()}


def forecast_linear(
    panel: DataFrame,
    cfg: PreparationConfig,
    windows: Sequence[dict[str, Any]],
    features: Sequence[str],
    models: Sequence[str] = ("linear_regression", "ridge_regression"),
    categorical: Sequence[str] | None = None,
) -> DataFrame:
    """Predictions of the linear models for every holdout row of every window. Categories that training does not hold add nothing."""
    if not models:
        raise ValueError("No linear model was asked for")
    categorical = list(cfg.group_columns if categorical is None else categorical)
    numeric = [f for f in features if f not in categorical]
    if not numeric and not categorical:
        raise ValueError("A linear model needs a feature or a group")
    x, c = [f"x{i}" for i in range(len(numeric))], [f"c{i}" for i in range(len(categorical))]
    rows = _filled(_rows(panel, cfg, windows, numeric, categorical), x, c)
    train = rows.filter("train")
    # the column with most categories is eliminated, those of the others become columns
    sizes = train.agg(*[F.approx_count_distinct(v).alias(v) for v in c]).first().asDict() if c else {}
    widest = max(c, key=lambda v: (sizes[v], v)) if c else None
    terms = [(v, k) for v in c if v != widest for k in frequent_categories(train, v)]
    dummies = {f"t{i}": (F.col(v) == k) for i, (v, k) in enumerate(terms)}
    rows = rows.withColumns({t: F.coalesce(hit.cast("double"), F.lit(0.0)) for t, hit in dummies.items()})
    rows = materialize(rows, "linear-rows")
    train = rows.filter("train")
    known = train.groupBy("window").agg(
        F.count("*").alias("n"), F.avg("y").alias("y"), *[F.avg(v).alias(v) for v in (*x, *dummies)], *[F.stddev_pop(v).alias(f"d_{v}") for v in x]
    )
    facts = {r["window"]: r for r in known.collect() if r["n"] >= 2}
    cols = [*x, *dummies]

    fact = lambda name: _by_window({w: float(r[name]) for w, r in facts.items()}, None)
    shifted = rows.filter(F.col("window").isin(list(facts))).withColumns({v: F.col(v) - fact(v) for v in cols} | {"shifted": F.col("y") - fact("y"), "one": F.lit(1.0)})
    vector = ["one", *cols, "shifted"]
    fitted_on = shifted.filter("train")
    cross = _collected(_grams(fitted_on, vector, [F.lit(1.0)]), len(vector))
    penalties = [1.0 if m == "ridge_regression" else 0.0 for m in models]
    if widest:
        groups = materialize(
            fitted_on.filter(F.col(widest).isNotNull()).groupBy("window", F.col(widest).alias("category")).agg(*[F.sum(v).alias(v) for v in vector]), "linear-groups"
        )
        n = F.col("one")
        kinds = [*[1.0 / (n + a) for a in penalties], 1.0 / (n * n)]
        effects = _collected(_grams(groups, vector, kinds), len(vector))

    out: DataFrame | None = None
    scored = shifted.filter("not train")
    if widest:
        sums = groups.withColumnsRenamed({v: f"s_{v}" for v in vector}).withColumnRenamed("window", "window_")
        scored = scored.join(sums, (F.col("window") == F.col("window_")) & (F.col(widest) == F.col("category")), "left")
    scored = scored.withColumn("h", F.row_number().over(Window.partitionBy("series", "window").orderBy("date")))
    for i, (name, alpha) in enumerate(zip(models, penalties, strict=True)):
        value = F.lit(None).cast("double")
        for w, r in facts.items():
            unit = np.array([float(r[f"d_{v}"]) or 1.0 for v in x] + [1.0] * len(dummies))
            if widest and (w, i) in effects:
                base, slopes = solve_with_effects(cross[w, 0], effects[w, i], effects[w, len(models)], unit, alpha)
            else:
                base, slopes, _ = solve(cross[w, 0], [True] * len(x) + [False] * len(dummies), alpha)
            ahead = F.lit(base) + F.lit(float(r["y"]))
            for v, slope in zip(cols, slopes, strict=True):
                ahead = ahead + F.lit(float(slope)) * F.col(v)
            if widest and (w, i) in effects:
                # the effect from the sums of the category: what the slopes leave, shrunk by the penalty
                rest = F.col("s_shifted") - F.lit(base) * F.col("s_one")
                for v, slope in zip(cols, slopes, strict=True):
                    rest = rest - F.lit(float(slope)) * F.col(f"s_{v}")
                ahead = ahead + F.coalesce(rest / (F.col("s_one") + F.lit(alpha)), F.lit(0.0))
            value = F.when(F.col("window") == w, ahead).otherwise(value)
        part = scored.withColumns({"model": F.lit(name), "actual": F.col("y"), "prediction": value})
        part = part.withColumn("residual", F.col("prediction") - F.col("actual")).select(*PREDICTION_COLUMNS)
        part = part.filter("actual IS NOT NULL AND prediction IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out
