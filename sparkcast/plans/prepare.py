"""Preparation as one lazy plan: aggregate, align, features, split, drop."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.config import PreparationConfig
from sparkcast.operators.features import add_features
from sparkcast.operators.panel import (
    GENERATED,
    ROWS,
    PreparationError,
    aggregate_panel,
    align_panel,
    drop_missing_target,
    group_count,
)
from sparkcast.operators.splits import assign_split, check_split_rows, split_manifest
from sparkcast.session import materialize
from sparkcast.sources.tables import table_digest


def aligned_panel(
    df: DataFrame, cfg: PreparationConfig, roles: Mapping[str, str], row_order: Sequence[str] = ()
) -> DataFrame:
    return align_panel(aggregate_panel(df, cfg, roles, row_order), cfg, roles)


def prepare_panel(
    df: DataFrame, cfg: PreparationConfig, roles: Mapping[str, str], row_order: Sequence[str] = ()
) -> DataFrame:
    """Raw rows to a model-ready panel with features and split labels.

    The raw data is shuffled once, already aggregated by (series, period); gap filling and all
    feature windows share a second, panel-sized shuffle by series.
    """
    aligned = aligned_panel(df, cfg, roles, row_order)
    if cfg.max_groups is not None:
        count = group_count(aligned, cfg).first()["group_count"]
        if count > cfg.max_groups:
            raise PreparationError("The panel has more series than the configuration allows")
    featured = add_features(aligned, cfg, roles)
    return drop_missing_target(assign_split(featured, cfg), cfg)


@dataclass(frozen=True)
class Review:
    """What a table went through before preparation: the state of its mapping, and a quality report with the mapping version and
    table digest it was made for."""

    mapping_status: str
    mapping_version: int
    roles: Mapping[str, str]
    readiness: str | None = None
    report_version: int | None = None
    report_digest: str | None = None


def check_review(df: DataFrame, review: Review, override_reason: str | None = None) -> None:
    """Refuse tables without a confirmed mapping, without a report, with one that is out of date, or with blockers. Tables that are
    not quite ready pass only with a reason. The digest that shows whether the report is up to date reads the table once."""
    if review.mapping_status != "confirmed":
        raise PreparationError("Confirm the mapping of the columns first")
    if review.readiness is None:
        raise PreparationError("Run the quality report first")
    if review.report_version != review.mapping_version or review.report_digest != current_digest(df):
        raise PreparationError("The table or its mapping changed after the quality report")
    if review.readiness == "blocked":
        raise PreparationError("The quality report has findings that block preparation")
    if review.readiness != "quality_ready" and not (override_reason or "").strip():
        raise PreparationError("The table is not quite ready: give a reason to go on")


def current_digest(df: DataFrame) -> str:
    """Digest of the rows of a table, whatever their order."""
    row = table_digest(df).first()
    return ":".join(str(v) for v in row)


def prepare_reviewed(
    df: DataFrame, cfg: PreparationConfig, review: Review, override_reason: str | None = None, row_order: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Panel and split manifest of a reviewed table; splits that are too small are refused. The panel is written once."""
    check_review(df, review, override_reason)
    panel = materialize(prepare_panel(df, cfg, review.roles, row_order), "reviewed-panel")
    manifest = split_manifest(panel, cfg)
    check_split_rows(manifest, cfg)
    return panel, manifest


def preparation_report(aligned: DataFrame, cfg: PreparationConfig) -> DataFrame:
    """What preparation did to the rows: collapsed, generated, dropped, kept."""
    missing = F.col(cfg.target_column).isNull()
    dropped = F.count_if(missing) if cfg.missing_target_policy == "drop_rows_missing_target" else F.lit(0).cast("bigint")
    return aligned.agg(
        F.sum(F.greatest(F.col(ROWS) - 1, F.lit(0))).alias("collapsed_rows"),
        F.sum(F.col(GENERATED).cast("bigint")).alias("generated_rows"),
        dropped.alias("dropped_rows"),
        F.count(F.lit(1)).alias("_all"),
    ).select(
        "collapsed_rows", "generated_rows", "dropped_rows", (F.col("_all") - F.col("dropped_rows")).alias("row_count")
    )
