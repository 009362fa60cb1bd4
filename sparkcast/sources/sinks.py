"""Writers for prepared panels, manifests and predictions, and the readers that go with them."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcast.config import PreparationConfig
from sparkcast.operators.splits import SPLIT
from sparkcast.sources.tables import coerce

PREDICTION_PARTITIONS = ("model", "split", "fold")


def write_panel(panel: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a split panel, one folder per split, so readers prune by split.

    An existing target is refused; the committer publishes all files of a write or none.
    """
    if fmt not in ("parquet", "csv"):
        raise ValueError("Panels are written as parquet or csv")
    writer = panel.write.mode("errorifexists").partitionBy(SPLIT)
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.parquet(path)


def read_panel(spark: SparkSession, path: str, cfg: PreparationConfig, fmt: str = "parquet", numbers=()) -> DataFrame:
    """Read a panel back. Text input is typed leniently: what cannot be read becomes null."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    raw = spark.read.option("header", "true").csv(path)
    return coerce(raw, [cfg.date_column], [cfg.target_column, *numbers])


def write_manifest(
    path: str,
    cfg: PreparationConfig,
    catalog: DataFrame,
    splits: DataFrame,
    folds: DataFrame,
    report: DataFrame,
    lineage: Mapping[str, Any] | None = None,
) -> None:
    """JSON tables beside a panel: configuration with lineage, catalog, splits, folds and report."""
    entry = {"configuration": asdict(cfg), **(lineage or {})}
    spark = catalog.sparkSession
    spark.createDataFrame([(json.dumps(entry, sort_keys=True),)], "value string").write.text(f"{path}/manifest")
    for name, table in (("catalog", catalog), ("splits", splits), ("folds", folds), ("report", report)):
        table.write.json(f"{path}/{name}")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """One table for all models, partitioned by model, split and fold. Rows of a partition are gathered
    first, and spread by series, so that files are neither tiny nor all from one task."""
    predictions.repartition(*PREDICTION_PARTITIONS, F.pmod(F.xxhash64("series"), F.lit(32))).write.partitionBy(
        *PREDICTION_PARTITIONS
    ).parquet(path)


def read_predictions(
    spark: SparkSession, path: str, model: str | None = None, split: str | None = None, fold: int | None = None
) -> DataFrame:
    """Predictions, filtered on partition columns so that only matching folders are read."""
    out = spark.read.parquet(path)
    for name, wanted in (("model", model), ("split", split), ("fold", fold)):
        if wanted is not None:
            out = out.filter(F.col(name) == wanted)
    return out


def write_records(table: DataFrame, path: str) -> None:
    """A registry table (metrics, importances, trials) as JSON lines."""
    table.write.mode("errorifexists").json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file below a path. Files are read whole, one per row: for uploads, not for big tables."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", "length", F.sha2("content", 256).alias("checksum")
    )
