"""Chronological splits and expanding-window folds.

The time axis (sorted distinct dates) is one bounded array. Everything derived from it is a scalar
subquery, so cut points reach the data as constants: nothing is joined and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcast.config import PreparationConfig
from sparkcast.operators.panel import PreparationError

SPLIT = "split"
FOLD_TYPE = (
    "array<struct<split:string,fold:int,train_start:date,train_end:date,validation_start:date,validation_end:date>>"
)


def time_axis(panel: DataFrame, cfg: PreparationConfig) -> DataFrame:
    """One row holding the sorted distinct dates."""
    return panel.agg(F.sort_array(F.collect_set(F.col(cfg.date_column).cast("date"))).alias("dates"))


def _at(position: Column) -> Column:
    return F.try_element_at("dates", position.cast("int"))


def split_bounds(panel: DataFrame, cfg: PreparationConfig) -> DataFrame:
    """One row with the cut points. Too short a history is an error when the query runs."""
    axis = time_axis(panel, cfg)
    n = F.size("dates")
    if cfg.train_end_date and cfg.validation_end_date:
        final = F.to_date(F.lit(cfg.test_end_date)) if cfg.test_end_date else F.element_at("dates", -1)

        def up_to(end: Column) -> Column:
            return F.size(F.filter("dates", lambda d: d <= end))

        train_n = up_to(F.to_date(F.lit(cfg.train_end_date)))
        validation_n = up_to(F.to_date(F.lit(cfg.validation_end_date)))
        test_n = up_to(final)
    else:
        train_n = F.greatest(F.lit(1), F.floor(n * F.lit(float(cfg.train_ratio))))
        wanted = train_n + F.greatest(F.lit(1), F.floor(n * F.lit(float(cfg.validation_ratio))))
        validation_n, test_n = F.when(wanted >= n, n - 1).otherwise(wanted), n
    counts = axis.select(
        "dates",
        n.cast("int").alias("n_dates"),
        train_n.cast("int").alias("train_n"),
        validation_n.cast("int").alias("validation_n"),
        test_n.cast("int").alias("test_n"),
    )
    too_short = F.col("n_dates") < cfg.min_periods
    empty = (F.col("train_n") < 1) | (F.col("validation_n") <= F.col("train_n")) | (F.col("test_n") <= F.col("validation_n"))
    return counts.select(
        "*",
        F.when(too_short, F.raise_error(F.lit("Insufficient temporal history: too few dates to split")).cast("date"))
        .when(empty, F.raise_error(F.lit("Chronological split is too small")).cast("date"))
        .otherwise(_at(F.lit(1)))
        .alias("train_start"),
        _at(F.col("train_n")).alias("train_end"),
        _at(F.col("train_n") + 1).alias("validation_start"),
        _at(F.col("validation_n")).alias("validation_end"),
        _at(F.col("validation_n") + 1).alias("test_start"),
        _at(F.col("test_n")).alias("test_end"),
    )


def _bounds_value(bounds: DataFrame, *names: str) -> Column:
    return bounds.select(F.struct(*names)).scalar()


def assign_split(panel: DataFrame, cfg: PreparationConfig, bounds: DataFrame | None = None) -> DataFrame:
    """Label each row train, validation or test; rows after the last test date are unused."""
    bounds = split_bounds(panel, cfg) if bounds is None else bounds
    cut = _bounds_value(bounds, "train_start", "train_end", "validation_end", "test_end")
    date = F.col(cfg.date_column).cast("date")
    label = (
        F.when(date <= cut["train_end"], "train")
        .when(date <= cut["validation_end"], "validation")
        .when(date <= cut["test_end"], "test")
        .otherwise("unused")
    )
    return panel.withColumn(SPLIT, label)


def split_manifest(split_panel: DataFrame, cfg: PreparationConfig) -> DataFrame:
    """Start, end and rows of each split; rows with a target are counted apart."""
    date = F.col(cfg.date_column).cast("date")
    return split_panel.groupBy(SPLIT).agg(
        F.min(date).alias("start_date"),
        F.max(date).alias("end_date"),
        F.count(F.lit(1)).alias("row_count"),
        F.count(cfg.target_column).alias("rows_with_target"),
    )


def check_split_rows(manifest: DataFrame, cfg: PreparationConfig) -> None:
    """Raise when a split has fewer rows than configured (three rows reach the driver)."""
    rows = {r[SPLIT]: r["row_count"] for r in manifest.collect()}
    needed = dict(zip(("train", "validation", "test"), cfg.min_split_rows))
    if any(rows.get(name, 0) < least for name, least in needed.items()):
        raise PreparationError("A split holds fewer rows than the configuration asks for")


def split_order_check(manifest: DataFrame) -> DataFrame:
    """One row: whether train ends before validation starts, and validation before test."""
    def pick(name: str, c: str) -> Column:
        return F.max(F.when(F.col(SPLIT) == name, F.col(c)))

    return manifest.agg(
        pick("train", "end_date").alias("train_end"),
        pick("validation", "start_date").alias("validation_start"),
        pick("validation", "end_date").alias("validation_end"),
        pick("test", "start_date").alias("test_start"),
    ).withColumn(
        "chronological",
        F.coalesce(
            (F.col("train_end") < F.col("validation_start")) & (F.col("validation_end") < F.col("test_start")),
            F.lit(False),
        ),
    )


def _fold_array(folds: int) -> Column:
    """Expanding folds over the dates before the test span, each as long as the validation span."""
    size = F.greatest(F.lit(1), F.col("validation_n") - F.col("train_n"))

    def fold(i: Column) -> Column:
        cut = F.col("validation_n") - (F.lit(folds) - i) * size
        return F.struct(
            F.lit("backtest").alias("split"),
            (i + 1).cast("int").alias("fold"),
            _at(F.lit(1)).alias("train_start"),
            F.when(cut >= 2, _at(F.greatest(cut, F.lit(1)))).alias("train_end"),
            F.when(cut >= 2, _at(F.greatest(cut, F.lit(1)) + 1)).alias("validation_start"),
            F.when(cut >= 2, _at(F.greatest(cut, F.lit(1)) + size)).alias("validation_end"),
        )

    if folds < 1:
        return F.array().cast(FOLD_TYPE)
    every = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), fold)
    return F.filter(every, lambda f: f["train_end"].isNotNull()).cast(FOLD_TYPE)


def fold_table(bounds: DataFrame, folds: int) -> DataFrame:
    """Backtest folds as rows (at most twelve)."""
    return bounds.select(F.explode(_fold_array(folds)).alias("f")).select(
        "f.fold", "f.train_start", "f.train_end", "f.validation_start", "f.validation_end"
    )


def evaluation_windows(
    bounds: DataFrame, prepared_folds: int, backtest_folds: int = 5, final_test: bool = False, only_test: bool = False
) -> Column:
    """Array of evaluation windows: validation, the latest folds, and the final test when asked, or the test alone."""
    span = lambda split, a, b, c, d: F.struct(
        F.lit(split).alias("split"),
        F.lit(None).cast("int").alias("fold"),
        F.col(a).alias("train_start"),
        F.col(b).alias("train_end"),
        F.col(c).alias("validation_start"),
        F.col(d).alias("validation_end"),
    )
    fixed = [span("validation", "train_start", "train_end", "validation_start", "validation_end")]
    test = span("test", "train_start", "validation_end", "test_start", "test_end")
    if only_test:
        return bounds.select(F.array(test).cast(FOLD_TYPE)).scalar()
    if final_test:
        fixed.append(test)
    folds = _fold_array(prepared_folds)
    keep = F.least(F.size(folds), F.lit(backtest_folds))
    latest = F.slice(folds, F.size(folds) - keep + 1, keep)
    return bounds.select(F.concat(F.array(*fixed).cast(FOLD_TYPE), latest)).scalar()


def fold_rows(panel: DataFrame, cfg: PreparationConfig, windows: Column) -> DataFrame:
    """Rows of the panel in each evaluation window with their part: train or holdout.

    The windows are a constant array, so a row is repeated only for the windows that contain it.
    """
    date = F.col(cfg.date_column).cast("date")
    hit = F.filter("_windows", lambda w: (date >= w["train_start"]) & (date <= w["validation_end"]))
    return (
        panel.withColumn("_windows", windows)
        .withColumn("_window", F.explode(hit))
        .withColumns(
            {
                "window_split": F.col("_window.split"),
                "fold": F.col("_window.fold"),
                "part": F.when(date <= F.col("_window.train_end"), "train").otherwise("holdout"),
            }
        )
        .drop("_window", "_windows")
    )


def date_slice(panel: DataFrame, date_column: str, start: str, end: str) -> DataFrame:
    """Rows between two dates, both included."""
    return panel.filter(F.col(date_column).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
