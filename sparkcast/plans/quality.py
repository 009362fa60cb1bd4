"""The full quality report: every rule, then the scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from sparkcast.operators import quality as rules
from sparkcast.operators.quality import QualityInput
from sparkcast.session import materialize


def all_findings(q: QualityInput) -> DataFrame:
    """Findings of all rules. The raw table is read once, into a typed copy; the dictionary statistics are written once and
    shared by eight rules."""
    q = rules.typed_rows(q)
    stats = materialize(rules.cell_statistics(q), "cells")
    shared = (
        rules.missing_values, rules.empty_columns, rules.constant_columns, rules.near_constant_columns,
        rules.high_cardinality, rules.invalid_numbers, rules.negative_values, rules.rate_scale,
    )
    alone = (
        rules.schema_rules, rules.outliers, rules.duplicate_rows, rules.duplicate_keys, rules.bad_dates,
        rules.out_of_order_dates, rules.future_dates, rules.duplicate_dates, rules.funnel_inversions, rules.ratio_mismatches, rules.target_copies,
        rules.future_names, rules.derived_targets,
    )
    parts = [rule(q, stats) for rule in shared] + [rule(q) for rule in alone]
    if q.date_column:
        intervals = materialize(rules.interval_summary(q), "interval-summary")
        parts += [rules.temporal_gaps(q, intervals), rules.irregular_time(q, intervals)]
    return reduce(DataFrame.unionByName, parts)


def quality_report(q: QualityInput) -> tuple[DataFrame, DataFrame]:
    """(findings, one-row summary). Findings are few; they are written once and read for the scores."""
    findings = materialize(all_findings(q).coalesce(1), "findings")
    return findings, rules.readiness(findings, q.cfg.blocker_cap)
