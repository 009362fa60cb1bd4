"""Univariate forecasting over histories: one row holds one series in time order.

A panel is shuffled by series once. Folds are slices of the history array, and a model is an array
expression over the training slice, so any number of folds and models costs no further shuffle.
Histories hold one value per period; their size is bounded by time, not by the number of raw rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcast.config import PreparationConfig
from sparkcast.functions.numbers import is_finite
from sparkcast.functions.text import group_label

PREDICTION_COLUMNS = ("model", "series", "split", "fold", "date", "h", "actual", "prediction", "residual")
TOO_SHORT = "Insufficient group history"


def series_histories(panel: DataFrame, cfg: PreparationConfig) -> DataFrame:
    """One row per series: its label and its (date, y) pairs in time order."""
    y = F.col(cfg.target_column).cast("double")
    pairs = F.collect_list(F.struct(F.col(cfg.date_column).alias("date"), y.alias("y")))
    return (
        panel.groupBy(*[F.col(g) for g in cfg.group_columns])
        .agg(F.sort_array(pairs).alias("history"))
        .select(group_label(*[F.col(g) for g in cfg.group_columns]).alias("series"), "history")
    )


def evaluation_slices(histories: DataFrame, windows: Column) -> DataFrame:
    """Training values and holdout rows of each series in each evaluation window."""
    at = histories.select("series", "history", F.explode(windows).alias("w"))
    day = lambda p: p["date"].cast("date")
    train = F.filter(
        "history",
        lambda p: (day(p) >= F.col("w.train_start")) & (day(p) <= F.col("w.train_end")) & is_finite(p["y"]),
    )
    holdout = F.filter(
        "history", lambda p: (day(p) >= F.col("w.validation_start")) & (day(p) <= F.col("w.validation_end"))
    )
    return at.select(
        "series",
        F.col("w.split").alias("split"),
        F.col("w.fold").alias("fold"),
        F.transform(train, lambda p: p["y"]).alias("train"),
        holdout.alias("holdout"),
    ).filter(F.size("holdout") > 0)


def _steps() -> Column:
    return F.sequence(F.lit(1), F.size("holdout"))


def naive_last(train: Column, steps: Column) -> Column:
    return F.transform(steps, lambda _: F.element_at(train, -1))


def seasonal_naive(train: Column, steps: Column, season: int) -> Column:
    start = F.size(train) - season + 1
    return F.transform(steps, lambda h: F.element_at(train, (start + (h - 1) % season).cast("int")))


def moving_average(train: Column, steps: Column, window: int) -> Column:
    tail = F.slice(train, F.greatest(F.size(train) - window + 1, F.lit(1)), window)
    mean = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / window
    return F.transform(steps, lambda _: mean)


def drift(train: Column, steps: Column) -> Column:
    last = F.element_at(train, -1)
    slope = (last - F.element_at(train, 1)) / (F.size(train) - 1)
    return F.transform(steps, lambda h: last + slope * h)


def ses_fixed(train: Column, steps: Column, alpha: float) -> Column:
    """Simple exponential smoothing with a given level weight, started at the first value."""
    level = F.aggregate(train, F.element_at(train, 1), lambda l, y: l * (1 - alpha) + y * alpha)
    return F.transform(steps, lambda _: level)


def holt_fixed(train: Column, steps: Column, alpha: float, beta: float, phi: float) -> Column:
    """Damped-trend smoothing with given weights, started at the first value and first difference."""
    first = F.element_at(train, 1)
    start = F.struct(first.alias("level"), (F.element_at(train, 2) - first).alias("trend"))

    def step(s: Column, y: Column) -> Column:
        level = (s["level"] + s["trend"] * phi) * (1 - alpha) + y * alpha
        trend = s["trend"] * phi * (1 - beta) + (level - s["level"]) * beta
        return F.struct(level.alias("level"), trend.alias("trend"))

    def project(s: Column) -> Column:
        total = (lambda h: h.cast("double")) if phi == 1.0 else (lambda h: phi * (1 - F.pow(F.lit(phi), h)) / (1 - phi))
        return F.transform(steps, lambda h: s["level"] + s["trend"] * total(h))

    return F.aggregate(F.slice(train, 2, F.greatest(F.size(train) - 1, F.lit(0))), start, step, project)


class SeriesModel:
    """A named model over histories: the values it needs and the forecast it makes."""

    def __init__(self, name: str, needs: int, forecast: Callable[[Column, Column], Column], reason: str = TOO_SHORT):
        self.name, self.needs, self.forecast, self.reason = name, max(needs, 2), forecast, reason

    def skip_reason(self) -> Column:
        n = F.size("train")
        return F.when(n < 2, TOO_SHORT).when(n < self.needs, self.reason)


def baseline_models(
    names: Sequence[str], season: int, windows: Sequence[int] = (7, 14, 28)
) -> list[SeriesModel]:
    models: list[SeriesModel] = []
    if "naive_last" in names:
        models.append(SeriesModel("naive_last", 2, naive_last))
    if "seasonal_naive" in names:
        models.append(
            SeriesModel(
                "seasonal_naive", season, lambda t, s: seasonal_naive(t, s, season), "Insufficient seasonal history"
            )
        )
    if "moving_average" in names:
        models += [
            SeriesModel(
                f"moving_average_{w}",
                w,
                lambda t, s, w=w: moving_average(t, s, w),
                f"Insufficient history for moving average {w}",
            )
            for w in windows
        ]
    if "drift" in names:
        models.append(SeriesModel("drift", 2, drift))
    return models


def fixed_smoothing_models(
    ses: float | None = None, holt: tuple[float, float, float] | None = None
) -> list[SeriesModel]:
    models = []
    if ses is not None:
        models.append(SeriesModel("ses_fixed", 2, lambda t, s: ses_fixed(t, s, ses)))
    if holt is not None:
        models.append(SeriesModel("holt_fixed", 2, lambda t, s: holt_fixed(t, s, *holt)))
    return models


def expand_predictions(forecasts: DataFrame) -> DataFrame:
    """(model, series, split, fold, holdout, values) -> one row per predicted period.

    Rows without an actual or a prediction are dropped, as scores need both.
    """
    rows = forecasts.filter(F.col("values").isNotNull()).select(
        "model", "series", "split", "fold", F.posexplode(F.arrays_zip("holdout", "values")).alias("_i", "_p")
    )
    return rows.select(
        "model",
        "series",
        "split",
        "fold",
        F.col("_p.holdout.date").cast("date").alias("date"),
        (F.col("_i") + 1).alias("h"),
        F.col("_p.holdout.y").alias("actual"),
        F.col("_p.values").alias("prediction"),
        (F.col("_p.values") - F.col("_p.holdout.y")).alias("residual"),
    ).filter(F.col("actual").isNotNull() & F.col("prediction").isNotNull())


def forecast_series(slices: DataFrame, models: Sequence[SeriesModel]) -> DataFrame:
    """Predictions of every model for every series and window, in one pass over the slices."""
    runs = F.array(
        *[
            F.struct(
                F.lit(m.name).alias("model"),
                F.when(m.skip_reason().isNull(), m.forecast(F.col("train"), _steps())).alias("values"),
            )
            for m in models
        ]
    )
    long = slices.select("series", "split", "fold", "holdout", F.explode(runs).alias("_r"))
    return expand_predictions(
        long.select(F.col("_r.model").alias("model"), "series", "split", "fold", "holdout", F.col("_r.values").alias("values"))
    )


def skipped_series(
    slices: DataFrame, models: Sequence[SeriesModel], others: Sequence[tuple[str, Column]] = ()
) -> DataFrame:
    """Series left out of a model, with the reason. `others` are names of further models with their reason as a column."""
    reasons = [(m.name, m.skip_reason()) for m in models] + list(others)
    runs = F.array(*[F.struct(F.lit(name).alias("model"), reason.alias("reason")) for name, reason in reasons])
    return (
        slices.select(
            "series", "split", "fold", F.size("train").alias("history"),
            F.explode(runs.cast("array<struct<model:string,reason:string>>")).alias("_r"),
        )
        .filter(F.col("_r.reason").isNotNull())
        .select(F.col("_r.model").alias("model"), "series", "split", "fold", "history", F.col("_r.reason").alias("reason"))
    )
