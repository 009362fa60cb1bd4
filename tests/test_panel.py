"""Panels, features, splits and folds on small hand-made data."""

from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from sparkcast.config import PreparationConfig
from sparkcast.operators import features, panel, splits
from sparkcast.operators.panel import PreparationError
from sparkcast.plans.prepare import Review, current_digest, prepare_panel, prepare_reviewed

CFG = PreparationConfig("revenue", "date", ("channel",), lag_periods=(1, 7), rolling_windows=(3,))
ROLES = {"date": "date", "channel": "channel", "revenue": "revenue", "spend": "spend", "roas": "roas"}


@pytest.fixture(scope="module")
def raw(spark):
    start = date(2026, 1, 1)
    rows = [(start + timedelta(days=i), "a", 100.0 * (i + 1) + 100, 50.0, 0.0, i) for i in range(12)]
    rows.append((start, "a", 10.0, 50.0, 0.0, 99))
    return spark.createDataFrame(rows, "date date, channel string, revenue double, spend double, roas double, row int")


def test_aggregate_rules_and_ratios(raw):
    out = panel.aggregate_panel(raw, CFG, ROLES, ["row"]).orderBy("date").collect()
    assert len(out) == 12
    first = out[0]
    assert (first["revenue"], first["spend"], first["source_rows"]) == (210.0, 100.0, 2)
    assert first["roas"] == pytest.approx(2.1)
    last = panel.aggregate_panel(raw, replace(CFG, aggregation_rules={"revenue": "last"}), ROLES, ["row"])
    assert last.orderBy("date").first()["revenue"] == 10.0
    with pytest.raises(panel.PreparationError):
        panel.aggregate_panel(raw, replace(CFG, duplicate_period_policy="reject"), ROLES, ["row"])


def test_gap_fill(spark):
    rows = [(date(2026, 1, 1), "a", 1.0, 5.0), (date(2026, 1, 4), "a", 2.0, 6.0), (date(2026, 1, 2), "b", 3.0, 7.0)]
    p = spark.createDataFrame(rows, "date date, channel string, revenue double, spend double")
    zero = panel.align_panel(p, replace(CFG, missing_period_policy="insert_zero_for_flow_metrics"), ROLES)
    got = [(str(r["date"]), r["revenue"], r["spend"], r["is_generated_period"]) for r in zero.filter("channel='a'").orderBy("date").collect()]
    assert got == [
        ("2026-01-01", 1.0, 5.0, 0), ("2026-01-02", None, 0.0, 1), ("2026-01-03", None, 0.0, 1), ("2026-01-04", 2.0, 6.0, 0)
    ]
    assert zero.filter("channel='b'").count() == 1
    with pytest.raises(panel.PreparationError):
        panel.align_panel(p, replace(CFG, missing_period_policy="reject"), ROLES)


@pytest.mark.parametrize("frequency,days,expected", [("weekly", 21, 4), ("monthly", 92, 4), ("quarterly", 184, 3)])
def test_gap_fill_frequencies(spark, frequency, days, expected):
    start = date(2026, 1, 5) if frequency == "weekly" else date(2026, 1, 1)
    p = spark.createDataFrame([(start, 1.0), (start + timedelta(days=days), 2.0)], "date date, revenue double")
    cfg = replace(CFG, group_columns=(), frequency=frequency, missing_period_policy="insert_null")
    bucketed = p.withColumn("date", F.date_trunc({"weekly": "week", "monthly": "month", "quarterly": "quarter"}[frequency], "date").cast("date"))
    assert panel.align_panel(bucketed, cfg, ROLES).count() == expected


def test_lag_and_rolling_exclude_the_present(raw):
    out = prepare_panel(raw, CFG, ROLES, ["row"]).orderBy("date").collect()
    assert len(out) == 12
    assert out[1]["revenue_lag_1"] == 210.0
    assert out[0]["revenue_rolling_mean_3"] is None
    assert out[3]["revenue_rolling_mean_3"] == pytest.approx((210 + 300 + 400) / 3)
    assert [r["split"] for r in out] == ["train"] * 8 + ["validation"] + ["test"] * 3


def test_future_targets_do_not_change_features(raw):
    changed = raw.withColumn("revenue", F.when(F.col("date") > "2026-01-08", 1e6).otherwise(F.col("revenue")))
    cut = "date <= DATE '2026-01-08'"
    a = prepare_panel(raw, CFG, ROLES, ["row"]).filter(cut).drop("split").orderBy("date").collect()
    b = prepare_panel(changed, CFG, ROLES, ["row"]).filter(cut).drop("split").orderBy("date").collect()
    assert a == b


def test_folds_expand(spark):
    days = spark.range(40).select((F.lit(date(2026, 1, 1)) + F.col("id").cast("int")).alias("date"), F.lit(1.0).alias("revenue"))
    cfg = replace(CFG, group_columns=())
    folds = splits.fold_table(splits.split_bounds(days, cfg), 3).orderBy("fold").collect()
    assert [(str(f["train_end"]), str(f["validation_start"]), str(f["validation_end"])) for f in folds] == [
        ("2026-01-16", "2026-01-17", "2026-01-22"), ("2026-01-22", "2026-01-23", "2026-01-28"),
        ("2026-01-28", "2026-01-29", "2026-02-03"),
    ]
    with pytest.raises(Exception, match="Insufficient temporal history"):
        splits.assign_split(days.limit(5), cfg).collect()


def test_catalog_marks_leaks(spark):
    mapping = spark.createDataFrame(
        [(0, "date", "date", "date"), (1, "channel", "channel", "categorical"), (2, "revenue", "revenue", "float"), (3, "spend", "spend", "float")],
        "column_index int, column_name string, semantic_role string, physical_type string",
    )
    roles = {"date": "date", "channel": "channel", "revenue": "revenue", "spend": "spend"}
    catalog = features.feature_catalog(mapping, CFG, roles)
    safe = {r["feature_name"] for r in features.safe_linear_features(catalog, CFG).collect()}
    assert "calendar_week" in safe and not safe & {"revenue", "roas", "revenue_lag_1"}
    assert features.catalog_warnings(catalog).first()["message"].startswith("roas was excluded")
    with pytest.raises(panel.PreparationError):
        features.safe_linear_features(catalog, CFG, ["revenue_lag_1"])


@pytest.mark.parametrize(
    "change",
    [{"train_ratio": 0.9}, {"lag_periods": (0,)}, {"group_columns": ("a", "a")}, {"frequency": "yearly"}, {"backtest_folds": 13}],
)
def test_bad_configurations(change):
    with pytest.raises(ValueError):
        replace(CFG, **change)


def test_negative_shift_under_either_key_is_excluded(spark):
    from sparkcast.operators.readiness import covariate_classes

    rows = [("a", {"periods": "-2"}), ("b", {"lag": "-1"}), ("c", {"periods": "2"}), ("d", {})]
    catalog = spark.createDataFrame(
        [(n, "lag", "historical_only", "none", True, p) for n, p in rows],
        "feature_name string, feature_type string, availability_type string, leakage_risk string, included boolean, parameters map<string,string>",
    )
    got = {r[0]: r[1] for r in covariate_classes(catalog, [], "y").collect()}
    assert got == {"a": "excluded", "b": "excluded", "c": "historical", "d": "historical"}


def test_only_reviewed_tables_are_prepared(raw):
    digest = current_digest(raw)
    assert digest == current_digest(raw.repartition(3)) != current_digest(raw.filter("row <> 3"))
    good = Review("confirmed", 2, ROLES, "quality_ready", 2, digest)
    cfg = replace(CFG, min_split_rows=(6, 1, 1))
    made, manifest = prepare_reviewed(raw, cfg, good)
    assert made.count() == 12 and {r["split"]: r["row_count"] for r in manifest.collect()} == {"train": 8, "validation": 1, "test": 3}
    refused = [
        replace(good, mapping_status="draft"), replace(good, readiness=None), replace(good, report_version=1),
        replace(good, report_digest="0"), replace(good, readiness="blocked"), replace(good, readiness="needs_attention"),
    ]
    for review in refused:
        with pytest.raises(PreparationError):
            prepare_reviewed(raw, cfg, review, " ")
    assert prepare_reviewed(raw, cfg, refused[-1], "known gap")[0].count() == 12
    with pytest.raises(PreparationError):
        prepare_reviewed(raw, replace(cfg, min_split_rows=(6, 2, 2)), good)


def test_limits_are_optional():
    from sparkcast.operators.readiness import resolve_input_size

    assert replace(CFG, backtest_folds=40, max_folds=None).backtest_folds == 40
    with pytest.raises(ValueError):
        replace(CFG, backtest_folds=40)
    assert resolve_input_size(200) == 800
    with pytest.raises(PreparationError):
        resolve_input_size(200, most=365)
    with pytest.raises(PreparationError):
        resolve_input_size(40, 30)
