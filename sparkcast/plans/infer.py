"""Schema inference: profile, candidates, decisions, relationship evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.config import ProfileConfig
from sparkcast.functions.dates import parse_date_quality
from sparkcast.functions.numbers import parse_number_quality
from sparkcast.functions.text import cell
from sparkcast.operators import profile as profiling
from sparkcast.operators import schema
from sparkcast.operators.panel import columns_by_role
from sparkcast.session import materialize


def profile_table(
    df: DataFrame, columns: Sequence[str], row_id: str, cfg: ProfileConfig = ProfileConfig()
) -> DataFrame:
    return profiling.physical_types(profiling.column_profile(df, columns, row_id))


def infer_roles(
    df: DataFrame, columns: Sequence[str], row_id: str, cfg: ProfileConfig = ProfileConfig()
) -> DataFrame:
    """Column -> role with confidence, status, warnings and alternatives."""
    profile = profile_table(df, columns, row_id, cfg)
    return schema.assign_roles(profile, schema.role_candidates(profile), cfg)


def infer_schema(
    df: DataFrame, columns: Sequence[str], row_id: str, cfg: ProfileConfig = ProfileConfig()
) -> DataFrame:
    """Roles with relationship evidence applied.

    The mapping (one row per column) is written to the shared folder once, since the names of the
    ratio columns decide what the second pass reads.
    """
    mapping = materialize(infer_roles(df, columns, row_id, cfg), "mapping")
    by_role = columns_by_role(schema.roles_dict(mapping))
    return schema.apply_relationships(mapping, schema.relationship_evidence(df, by_role))


def typed_projection(df: DataFrame, mapping: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Read raw text columns by their confirmed roles; the first column of each role wins."""
    first = {r["column_name"] for r in schema.first_by_role(mapping).collect()}  # one row per role
    rows = mapping.select("column_name", "physical_type", "semantic_role", "column_index").collect()
    out = []
    for r in sorted(rows, key=lambda r: r["column_index"]):
        if r["column_name"] not in first:
            continue
        kind = schema.target_type(r["physical_type"], r["semantic_role"])
        text = cell(F.col(r["column_name"]))
        if kind == "double":
            value = parse_number_quality(text)
        elif kind in ("date", "timestamp"):
            value = parse_date_quality(text).cast(kind)
        else:
            value = F.nullif(text, F.lit(""))
        out.append(value.alias(r["semantic_role"]))
    return df.select(*keep, *out)
