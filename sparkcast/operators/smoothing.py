"""Exponential smoothing with fitted weights.

The error of every model here is linear in its starting state once the weights are given. Each
candidate weight vector therefore has its best starting state in closed form, and only the weights
are searched: a coarse grid, then finer grids around the best point. All candidates of a series run
through its history together as one numpy batch; Spark spreads (series, window) rows over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcast.operators.baselines import TOO_SHORT, expand_predictions

LEVELS, CHUNK, TIE = 4, 256, 1e-10
FIT = "values array<double>, weights array<double>, sse double"


def _states(model: str, season: int) -> int:
    return {"simple_exponential_smoothing": 1, "holt_linear": 2}.get(model, 1 + 1 + season)


def _needed(model: str, season: int) -> int:
    return 2 * season if model == "holt_winters" else 2


def _grid(center: np.ndarray | None, step: np.ndarray, low: np.ndarray, high: np.ndarray, points: int) -> np.ndarray:
    axes = []
    for i in range(len(low)):
        a, b = (low[i], high[i]) if center is None else (max(low[i], center[i] - step[i]), min(high[i], center[i] + step[i]))
        axes.append(np.linspace(a, b, points))
    return np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1).reshape(-1, len(low))


def _run(model: str, y: np.ndarray, w: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray]:
    """Products of the one-step errors and the final state, for a batch of weights.

    Both are kept as affine functions of the starting state: the last axis is the constant part, then
    one column per starting value.
    """
    g, k = len(w), _states(model, season)
    basis = np.zeros((k, 1 + k))
    basis[np.arange(k), 1 + np.arange(k)] = 1.0
    level = np.repeat(basis[None, 0], g, axis=0)
    trend = np.repeat(basis[None, 1], g, axis=0) if k > 1 else np.zeros_like(level)
    cycle = [np.repeat(basis[None, 2 + j], g, axis=0) for j in range(season)] if model == "holt_winters" else []
    alpha = w[:, :1]
    beta = w[:, 1:2] if w.shape[1] > 1 else np.zeros_like(alpha)
    phi = w[:, 2:3] if model == "holt_linear" else np.ones_like(alpha)
    gamma = w[:, 2:3] if model == "holt_winters" else np.zeros_like(alpha)
    unit = np.zeros(1 + k)
    unit[0] = 1.0
    cross = np.zeros((g, 1 + k, 1 + k))
    chunk: list[np.ndarray] = []
    for t, value in enumerate(y):
        carried = phi * trend
        ahead = level + carried
        seasonal = cycle[t % season] if cycle else 0.0
        e = value * unit - ahead - seasonal
        chunk.append(e)
        if len(chunk) == CHUNK:
            cross += _cross(chunk)
            chunk = []
        level = ahead + alpha * e
        trend = carried + alpha * beta * e
        if cycle:
            cycle[t % season] = seasonal + gamma * (1 - alpha) * e
    if chunk:
        cross += _cross(chunk)
    final = np.stack([level, trend, *cycle], axis=1) if k > 1 else level[:, None, :]
    return cross, final


def _cross(errors: list[np.ndarray]) -> np.ndarray:
    """Sums of products of the error terms of some steps, for each candidate."""
    block = np.stack(errors, axis=1)
    return block.transpose(0, 2, 1) @ block


def _best_start(cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best starting state of each candidate by least squares, and the squared error it leaves."""
    gram, right = cross[:, 1:, 1:], -cross[:, 1:, 0]
    k = gram.shape[1]
    # Level and seasonal offsets can trade a constant; a tiny penalty picks the smallest state.
    tie = TIE * np.trace(gram, axis1=1, axis2=2)[:, None, None] / k
    start = np.linalg.solve(gram + tie * np.eye(k)[None], right[:, :, None])[:, :, 0]
    fitted = np.einsum("gi,gij,gj->g", start, gram, start)
    return start, cross[:, 0, 0] + fitted - 2 * np.einsum("gi,gi->g", start, right)


def fit_smoothing(model: str, y: np.ndarray, season: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, final state and squared error of the best fit."""
    low, high = {
        "simple_exponential_smoothing": ([0.0], [1.0]),
        "holt_linear": ([0.0, 0.0, 0.8], [1.0, 1.0, 0.995]),
        "holt_winters": ([0.0, 0.0, 0.0], [1.0, 1.0, 1.0]),
    }[model]
    low_a, high_a = np.array(low), np.array(high)
    points = 21 if len(low) == 1 else 5
    scale = float(np.max(np.abs(y))) or 1.0
    scaled = y / scale
    center, step = None, (high_a - low_a)
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for _ in range(LEVELS):
        w = _grid(center, step, low_a, high_a, points)
        cross, final = _run(model, scaled, w, season)
        start, sse = _best_start(cross)
        i = int(np.argmin(sse))
        if best is None or sse[i] < best[0]:
            state = final[i] @ np.concatenate([[1.0], start[i]])
            best = (float(sse[i]), w[i], state)
        center, step = best[1], step / (points - 1)
    sse, weights, state = best
    return weights, state * scale, max(sse, 0.0) * scale * scale


def project(model: str, weights: np.ndarray, state: np.ndarray, n: int, steps: int, season: int) -> np.ndarray:
    """Forecasts from the final state of a series of n values."""
    ahead = np.arange(1, steps + 1)
    if model == "simple_exponential_smoothing":
        return np.full(steps, state[0])
    if model == "holt_linear":
        damping = np.cumsum(weights[2] ** ahead)
        return state[0] + state[1] * damping
    return state[0] + state[1] * ahead + state[2 + (n + ahead - 1) % season]


def _fitter(model: str, season: int):
    """A column function (history, steps) -> forecasts, weights and squared error."""

    @F.pandas_udf(FIT)
    def fit(train: pd.Series, steps: pd.Series) -> pd.DataFrame:
        rows = []
        for history, h in zip(train, steps):
            y = np.asarray(history, dtype=float)
            if len(y) < _needed(model, season):
                rows.append((None, None, None))
                continue
            weights, state, sse = fit_smoothing(model, y, season)
            rows.append((project(model, weights, state, len(y), int(h), season), weights, sse))
        return pd.DataFrame(rows, columns=["values", "weights", "sse"])

    return fit


def skip_reason(model: str, season: int) -> Column:
    """Why a model cannot be fitted on `train`; null when it can."""
    n = F.size("train")
    return F.when(n < 2, TOO_SHORT).when(
        n < _needed(model, season), "Insufficient history for two seasonal cycles"
    )


def smoothing_fits(slices: DataFrame, models: Sequence[str], season: int) -> DataFrame:
    """Fit every model on every slice: forecasts, weights, squared error, and why a slice was skipped."""
    # Fitting costs far more than moving the slices: give every (series, window) its own place.
    spread = slices.repartition("series", "split", "fold")
    fitted = spread.select(
        "series", "split", "fold", "train", "holdout",
        *[_fitter(m, season)(F.col("train"), F.size("holdout")).alias(m) for m in models],
    )
    runs = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"), F.col(f"{m}.values").alias("values"), F.col(f"{m}.weights").alias("weights"),
                F.col(f"{m}.sse").alias("sse"), skip_reason(m, season).alias("reason"),
            )
            for m in models
        ]
    )
    return fitted.select("series", "split", "fold", "holdout", F.size("train").alias("history"), F.explode(runs).alias("r")).select(
        "r.model", "series", "split", "fold", "holdout", "history", "r.values", "r.weights", "r.sse", "r.reason"
    )


def forecast_smoothing(slices: DataFrame, models: Sequence[str], season: int) -> DataFrame:
    return expand_predictions(smoothing_fits(slices, models, season))
