"""From raw rows to a regular panel: one row for each series and period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcast.config import FLOW_ROLES, RATIO_PARTS, PreparationConfig
from sparkcast.functions.dates import period_bucket, period_step
from sparkcast.functions.numbers import safe_ratio
from sparkcast.functions.text import cell

ROWS = "source_rows"
GENERATED = "is_generated_period"


class PreparationError(ValueError):
    """The data or the configuration cannot be prepared."""


def columns_by_role(roles: Mapping[str, str]) -> dict[str, str]:
    """Role -> column; the first column wins, unknown and ignored columns have no role."""
    found: dict[str, str] = {}
    for column, role in roles.items():
        if role not in ("unknown", "ignored"):
            found.setdefault(role, column)
    return found


def series_window(cfg: PreparationConfig) -> WindowSpec:
    """Time order inside a series. A series holds one row per period, so its size is bounded by time."""
    keys = [F.col(g) for g in cfg.group_columns] or [F.lit("all")]
    return Window.partitionBy(*keys).orderBy(cfg.date_column)


def check_inputs(df: DataFrame, cfg: PreparationConfig, roles: Mapping[str, str]) -> None:
    """Gates that need the schema only; no job runs."""
    missing = [c for c in (cfg.target_column, cfg.date_column, *cfg.group_columns) if c not in df.columns]
    if missing:
        raise PreparationError(f"Columns not found: {', '.join(missing)}")
    if roles.get(cfg.date_column, "date") not in ("date", "timestamp"):
        raise PreparationError("The date column must carry a date or timestamp role")
    if cfg.target_column in cfg.group_columns or cfg.date_column in cfg.group_columns:
        raise PreparationError("Target and date cannot be group columns")
    if not isinstance(df.schema[cfg.target_column].dataType, T.NumericType):
        raise PreparationError("The target column must be numeric")


def _metric(c: Column, rule: str, order: Column) -> Column:
    if rule == "last":
        return F.max_by(c, F.when(c.isNotNull(), order))
    return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[rule](c)


def aggregate_panel(
    df: DataFrame,
    cfg: PreparationConfig,
    roles: Mapping[str, str] | None = None,
    row_order: Sequence[str] = (),
) -> DataFrame:
    """Collapse rows to one per (groups, period).

    Amounts that flow are summed, other numbers averaged, unless a rule says otherwise. Text keeps
    its last non-blank value in row order. Ratios are computed again from their aggregated parts.
    `source_rows` counts the rows behind each period.
    """
    roles = dict(roles or {})
    check_inputs(df, cfg, roles)
    order = F.struct(*row_order) if row_order else F.struct(cfg.date_column)
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("")).alias(g) for g in cfg.group_columns]
    keys.append(period_bucket(F.col(cfg.date_column), cfg.frequency).alias(cfg.date_column))
    taken = {*cfg.group_columns, cfg.date_column, *row_order}
    metrics: list[Column] = []
    for field in df.schema.fields:
        name = field.name
        role = roles.get(name, "unknown")
        if name in taken or role in ("ignored", "date", "timestamp"):
            continue
        c = F.col(name)
        if isinstance(field.dataType, T.NumericType):
            rule = cfg.aggregation_rules.get(name, "sum" if role in FLOW_ROLES else "mean")
            metrics.append(_metric(c, rule, order).cast("double").alias(name))
        elif isinstance(field.dataType, T.StringType):
            metrics.append(F.max_by(c, F.when(cell(c) != "", order)).alias(name))
    panel = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(ROWS), *metrics)
    if cfg.duplicate_period_policy == "reject" and not panel.filter(F.col(ROWS) > 1).isEmpty():
        raise PreparationError("A series has several rows for one period, which the configuration refuses")
    return recompute_ratios(panel, roles)


def recompute_ratios(panel: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    by_role = columns_by_role(roles)
    fresh = {
        by_role[ratio]: safe_ratio(F.col(by_role[num]), F.col(by_role[den]))
        for ratio, (num, den) in RATIO_PARTS.items()
        if {ratio, num, den} <= by_role.keys() and {by_role[ratio], by_role[num], by_role[den]} <= set(panel.columns)
    }
    return panel.withColumns(fresh) if fresh else panel


def collapsed_rows(panel: DataFrame) -> DataFrame:
    """How many source rows were folded into periods, and how many periods had more than one."""
    return panel.agg(
        F.coalesce(F.sum(F.col(ROWS) - 1), F.lit(0)).alias("collapsed_rows"),
        F.count_if(F.col(ROWS) > 1).alias("collapsed_periods"),
        F.count(F.lit(1)).alias("periods"),
    )


def _periods_until_next(cfg: PreparationConfig) -> Column:
    """The period of a row and the empty ones up to the next row of its series."""
    date = F.col(cfg.date_column)
    upcoming = F.lead(date).over(series_window(cfg))
    if cfg.frequency == "hourly":
        last = upcoming - F.make_dt_interval(secs=F.lit(1))
    else:
        last = F.date_sub(upcoming, 1)
    return F.when(upcoming.isNull(), F.array(date)).otherwise(F.sequence(date, last, period_step(cfg.frequency)))


def align_panel(panel: DataFrame, cfg: PreparationConfig, roles: Mapping[str, str] | None = None) -> DataFrame:
    """Fill missing periods between the first and last period of each series.

    Each row is expanded over the empty periods that follow it, so no calendar table and no join
    are needed, and the shuffle by series is the one the feature windows use.
    """
    if cfg.missing_period_policy == "preserve":
        return panel.withColumn(GENERATED, F.lit(0))
    if cfg.missing_period_policy == "reject":
        if not gap_report(panel, cfg).filter("missing_periods > 0").isEmpty():
            raise PreparationError("A series lacks periods between its first and its last")
        return panel.withColumn(GENERATED, F.lit(0))
    by_role = columns_by_role(roles or {})
    zeros = set()
    if cfg.missing_period_policy == "insert_zero_for_flow_metrics":
        zeros = {c for role, c in by_role.items() if role in FLOW_ROLES} - {cfg.target_column}
    expanded = panel.withColumn("_periods", _periods_until_next(cfg)).select(
        "*", F.posexplode("_periods").alias("_step", "_period")
    )
    generated = F.col("_step") > 0
    out = []
    for name in panel.columns:
        if name in cfg.group_columns:
            out.append(F.col(name))
        elif name == cfg.date_column:
            out.append(F.col("_period").alias(name))
        elif name in zeros or name == ROWS:
            out.append(F.when(generated, F.lit(0)).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.when(~generated, F.col(name)).alias(name))
    return expanded.select(*out, generated.cast("int").alias(GENERATED))


def gap_report(panel: DataFrame, cfg: PreparationConfig) -> DataFrame:
    """Missing periods for each series, inside its own first and last period."""
    spans = panel.withColumn("_missing", F.size(_periods_until_next(cfg)) - 1)
    keys = list(cfg.group_columns)
    return spans.groupBy(*keys).agg(
        F.min(cfg.date_column).alias("first_period"),
        F.max(cfg.date_column).alias("last_period"),
        F.count(F.lit(1)).alias("observed_periods"),
        F.sum("_missing").alias("missing_periods"),
    )


def group_count(panel: DataFrame, cfg: PreparationConfig) -> DataFrame:
    if not cfg.group_columns:
        return panel.agg(F.lit(1).cast("bigint").alias("group_count"))
    return panel.select(*cfg.group_columns).distinct().agg(F.count(F.lit(1)).alias("group_count"))


def drop_missing_target(panel: DataFrame, cfg: PreparationConfig) -> DataFrame:
    if cfg.missing_target_policy == "preserve":
        return panel
    return panel.filter(F.col(cfg.target_column).isNotNull())
