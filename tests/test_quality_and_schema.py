"""Rule presence on small tables, roles of marketing columns, determinism of both."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.config import QualityConfig
from sparkcast.operators import quality as dq
from sparkcast.operators import schema
from sparkcast.operators.quality import QualityInput, dimension_scores
from sparkcast.plans.infer import infer_roles, infer_schema
from sparkcast.plans.quality import quality_report


def table(spark, columns, rows):
    data = [(i, *[str(v) for v in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "row_id bigint, " + ", ".join(f"{c} string" for c in columns))


def report(spark, columns, rows, roles=None, **kw):
    roles = roles or {c: c for c in columns}
    q = QualityInput(table(spark, columns, rows), "row_id", roles, cfg=QualityConfig(as_of="2026-12-31"), **kw)
    findings, summary = quality_report(q)
    return {(r["rule_code"], r["affected_column"]): r for r in findings.collect()}, summary.first()


def run(spark, columns, rows, *rules, roles=None, confirmed=True):
    """Findings of some rules only."""
    roles = roles or {c: c for c in columns}
    q = QualityInput(table(spark, columns, rows), "row_id", roles, confirmed, QualityConfig(as_of="2026-12-31"))
    found = reduce(DataFrame.unionByName, [rule(q) for rule in rules])
    return {(r["rule_code"], r["affected_column"]): r for r in found.collect()}


def codes(found):
    return {c for c, _ in found}


def test_missing_and_empty(spark):
    rows = [("2026-01-01", "a", "10"), ("2026-01-02", "", "0"), ("2026-01-03", "n/a", "12"), ("2026-01-04", "b", "")]
    found = run(spark, ["date", "channel", "revenue"], rows, dq.missing_values, dq.empty_columns)
    assert found[("DQ_COMPLETENESS_001", "revenue")]["affected_row_count"] == 1
    assert found[("DQ_COMPLETENESS_001", "channel")]["affected_row_count"] == 2
    assert "DQ_COMPLETENESS_002" not in codes(found)


def test_duplicates_and_types(spark):
    rows = [("2026-01-01", "a", "10"), ("2026-01-01", "a", "10"), ("2026-01-02", "b", "oops")]
    rules = (dq.duplicate_rows, dq.duplicate_keys, dq.invalid_numbers)
    found = run(spark, ["date", "channel", "revenue"], rows, *rules)
    assert found[("DQ_DUPLICATE_001", None)]["affected_row_count"] == 1
    assert found[("DQ_DUPLICATE_001", None)]["sample_row_indices"] == [1]
    assert "DQ_DUPLICATE_002" in codes(found)
    assert found[("DQ_VALIDITY_001", "revenue")]["sample_row_indices"] == [2]


def test_invalid_dates_and_negative_counts(spark):
    rows = [("2026-01-01", "5", "10"), ("bad-date", "-4", "11"), ("2026-01-03", "6", "12")]
    found = run(spark, ["date", "impressions", "revenue"], rows, dq.negative_values, dq.bad_dates)
    assert {"DQ_VALIDITY_002", "DQ_TEMPORAL_001"} <= codes(found)
    assert found[("DQ_TEMPORAL_001", "date")]["blocking"]


def test_outliers(spark):
    rows = [(f"2026-01-0{i + 1}", v) for i, v in enumerate([9, 10, 11, 12, 9, 10, 11, 1000])]
    found = run(spark, ["date", "revenue"], rows, dq.outliers)
    assert found[("DQ_OUTLIER_001", "revenue")]["evidence"]["method"] == "IQR"
    assert found[("DQ_OUTLIER_001", "revenue")]["sample_row_indices"] == [7]


def test_three_distinct_values_are_no_outliers(spark):
    rows = [(f"2026-01-{i + 1:02d}", v) for i, v in enumerate([1, 2, 1, 2, 1, 2, 1, 2, 1, 500])]
    assert not run(spark, ["date", "revenue"], rows, dq.outliers)


def test_gaps_and_disorder(spark):
    rows = [("2026-01-01", 1), ("2026-01-02", 2), ("2026-01-03", 3), ("2026-01-11", 4), ("2026-01-04", 5)]
    found = run(spark, ["date", "revenue"], rows, dq.temporal_gaps, dq.out_of_order_dates)
    assert found[("DQ_TEMPORAL_002", "date")]["evidence"]["expected_frequency"] == "daily"
    assert found[("DQ_TEMPORAL_003", "date")]["affected_row_count"] == 1


def test_irregular_time(spark):
    rows = [("2026-01-01", 1), ("2026-01-02", 2), ("2026-01-05", 3), ("2026-01-11", 4), ("2026-02-01", 5)]
    assert "DQ_TEMPORAL_005" in codes(run(spark, ["date", "revenue"], rows, dq.irregular_time))


def test_relations_and_leakage(spark):
    columns = ["date", "impressions", "clicks", "spend", "revenue", "roas", "actual_revenue"]
    rows = [("2026-01-01", 10, 20, 5, 50, 2, 50), ("2026-01-02", 100, 5, 5, 60, 12, 60), ("2026-01-03", 90, 4, 5, 70, 14, 70)]
    roles = {c: c for c in columns} | {"actual_revenue": "unknown"}
    found, summary = report(spark, columns, rows, roles)
    assert {"DQ_RELATIONSHIP_001", "DQ_RELATIONSHIP_002", "DQ_LEAKAGE_001", "DQ_LEAKAGE_002", "DQ_LEAKAGE_003"} <= codes(found)
    assert summary["readiness"] == "blocked" and summary["overall_score"] <= 49


def test_constant_cardinality_and_rates(spark):
    columns = ["date", "channel", "country", "ctr", "revenue"]
    rows = [("2026-01-01", "a", "x", "0.1", 1), ("2026-01-02", "b", "x", "20", 2), ("2026-01-03", "c", "x", "120", 3), ("2026-01-04", "d", "x", "5", 4)]
    found = run(spark, columns, rows, dq.constant_columns, dq.high_cardinality, dq.rate_scale)
    assert ("DQ_CARDINALITY_001", "country") in found and ("DQ_CARDINALITY_002", "channel") in found
    assert found[("DQ_VALIDITY_003", "ctr")]["severity"] == "error"


def test_missing_roles_block(spark):
    roles = {"notes": "descriptive_text"}
    found = run(spark, ["notes"], [("x",), ("y",)], dq.schema_rules, dq.bad_dates, roles=roles, confirmed=False)
    assert codes(found) == {"DQ_SCHEMA_001", "DQ_SCHEMA_002", "DQ_SCHEMA_003"}


def test_same_input_same_score(spark):
    rows = [("2026-01-01", "10"), ("2026-01-02", "x"), ("2026-01-03", "12")]
    a, sa = report(spark, ["date", "revenue"], rows)
    b, sb = report(spark, ["date", "revenue"], rows)
    assert codes(a) == codes(b) and sa == sb


def test_dimension_scores_do_not_fall_below_zero(spark):
    f = spark.createDataFrame([("validity", "blocker")] * 3 + [("outlier", "info")], "category string, severity string")
    got = {r["dimension"]: r["score"] for r in dimension_scores(f).collect()}
    assert got["validity"] == 0 and got["temporal"] == 100


CANONICAL = ["date", "channel", "campaign", "impressions", "clicks", "spend", "conversions", "revenue"]


def test_canonical_columns_map_to_themselves(spark):
    rows = [(f"2026-01-0{i}", "search", "brand", 100 * i, 10 * i, 5.5 * i, i + 1, 50.5 * i) for i in range(1, 4)]
    roles = infer_roles(table(spark, CANONICAL, rows), CANONICAL, "row_id")
    assert schema.roles_dict(roles) == {c: c for c in CANONICAL}
    assert schema.schema_summary(roles).first()["readiness_status"] == "mapping_ready"
    assert schema.confirm_schema(roles).filter("status <> 'confirmed'").count() == 0


def test_ambiguous_value_column(spark):
    roles = infer_roles(table(spark, ["date", "value", "notes"], [("2026-01-01", 5.5, "a"), ("2026-01-02", 6.5, "b")]), ["date", "value", "notes"], "row_id")
    row = roles.filter("column_name = 'value'").first()
    assert row["semantic_role"] == "unknown" and len(row["alternatives"]) == 3 and row["warnings"] == ["ambiguous_candidates"]
    with pytest.raises(schema.SchemaError):
        schema.confirm_schema(roles)


def test_ratio_evidence_raises_confidence(spark):
    columns = ["date", "impressions", "clicks", "spend", "revenue", "ctr", "roas"]
    rows = [("2026-01-01", 100, 11, 5, 50, 0.11, 10), ("2026-01-02", 200, 30, 5, 60, 0.15, 12), ("2026-01-03", 0, 0, 0, 0, 0, 0)]
    df = table(spark, columns, rows)
    relations = {r["metric"]: r for r in schema.relationship_evidence(df, {c: c for c in columns}).collect()}
    assert relations["ctr"]["observed"] == 2 and relations["roas"]["agreement"] == 1.0
    mapped = {r["column_name"]: r["confidence"] for r in infer_schema(df, columns, "row_id").collect()}
    assert mapped["roas"] == 1.0


def test_overrides_are_audited(spark):
    mapping = infer_roles(table(spark, ["date", "value"], [("2026-01-01", 1), ("2026-01-02", 2)]), ["date", "value"], "row_id")
    with pytest.raises(schema.SchemaError):
        schema.check_overrides({"value": "nonsense"})
    changes = spark.createDataFrame([("value", "revenue")], "column_name string, new_role string")
    out = schema.override_roles(mapping, changes)
    audit = schema.override_audit(out).first()
    assert (audit["old_role"], audit["new_role"]) == ("unknown", "revenue")
    assert out.filter(F.col("column_name") == "value").first()["confidence"] == 1.0


def test_repeats_of_a_hot_row(spark):
    """A row that most of the table repeats, beside small groups and a null key: counts of all, evidence of the first repeats, no row joined back."""
    text = F.when(F.col("row_id") % 10 < 8, "same").when(F.col("row_id") % 10 == 8, F.concat(F.lit("k"), F.floor(F.col("row_id") / 40).cast("string")))
    df = spark.range(20_000).select(F.col("id").alias("row_id")).select(
        "row_id", F.lit("2026-01-01").alias("date"), text.alias("channel"), F.lit("5").alias("revenue")
    ).repartition(7)
    roles = {"date": "date", "channel": "channel", "revenue": "revenue"}
    q = QualityInput(df, "row_id", roles, cfg=QualityConfig(as_of="2026-12-31"))
    rows = df.select("row_id", "channel").collect()
    first, repeated = {}, []
    for r in sorted(rows, key=lambda r: r["row_id"]):
        if r["channel"] in first:
            repeated.append(r["row_id"])
        first.setdefault(r["channel"], r["row_id"])
    for rule in (dq.duplicate_rows, dq.duplicate_keys):
        out = rule(q)
        got = out.first()
        assert got["affected_row_count"] == len(repeated)
        assert got["sample_row_indices"] == repeated[: q.cfg.evidence_rows]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Join" not in plan
