"""Scalar functions on hand-made values."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from sparkcast.functions import dates, labels, numbers, text


def values(spark, items, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "name,expected",
    [("AdSpend (USD)", "ad_spend_usd"), ("  Campaign--Name ", "campaign_name"), ("ctr%", "ctr"), ("orderID2Go", "order_id2_go")],
)
def test_normalize_name(spark, name, expected):
    assert values(spark, [name], text.normalize_name) == [expected]


def test_number_parsers_differ_on_purpose(spark):
    raw = ["1,200", "12%", "$5", " 7.5 ", "1_000", "1d", "nan", "1e999", "", "-4", ".5", "5.", "+3e2"]
    quality = values(spark, raw, numbers.parse_number_quality)
    assert quality == [1200.0, 12.0, None, 7.5, 1000.0, None, None, None, None, -4.0, 0.5, 5.0, 300.0]
    prep = values(spark, raw, numbers.parse_number_prep)
    assert prep == [None, None, None, 7.5, 1000.0, None, None, None, None, -4.0, 0.5, 5.0, 300.0]
    profile = values(spark, raw, numbers.parse_number_profile)
    assert profile[0] == 1200.0 and math.isnan(profile[6]) and profile[7] == math.inf and profile[5] is None


def test_dates(spark):
    raw = ["2026-1-5", "05/02/2026", "25/12/2026", "12/25/2026", "2026-01-05T10:00:00+02:00", "2026-02-30", "x", "20260105"]

    def parsed(fn):
        return values(spark, raw, lambda c: F.date_format(fn(c), "yyyy-MM-dd HH:mm"))

    assert parsed(dates.parse_date_quality) == [
        "2026-01-05 00:00", "2026-02-05 00:00", "2026-12-25 00:00", "2026-12-25 00:00", "2026-01-05 10:00", None, None,
        "2026-01-05 00:00",
    ]
    assert parsed(dates.parse_date_prep)[4] == "2026-01-05 08:00"
    assert parsed(dates.parse_date_profile)[4] == "2026-01-05 10:00"


def test_period_bucket_and_next(spark):
    day = spark.sql("SELECT TIMESTAMP '2026-05-14 13:45:00' AS t")
    got = day.select(*[dates.period_bucket(F.col("t"), f).alias(f) for f in dates.FREQUENCIES]).first()
    assert [str(v) for v in got] == ["2026-05-14 13:00:00", "2026-05-14", "2026-05-11", "2026-05-01", "2026-04-01"]
    month_end = spark.sql("SELECT DATE '2025-12-01' AS d").select(
        dates.next_period(F.col("d"), "monthly").alias("m"), dates.next_period(F.col("d"), "quarterly").alias("q")
    ).first()
    assert [str(v) for v in month_end] == ["2026-01-01", "2026-03-01"]
    with pytest.raises(ValueError):
        dates.period_bucket(F.col("t"), "yearly")


def test_series_id_separates_values(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x")], "g string, h string")
    got = [r[0] for r in rows.select(text.series_id(F.col("g"), F.col("h"))).collect()]
    expected = [
        "series_" + hashlib.sha256(json.dumps(v, separators=(",", ":")).encode()).hexdigest()[:24]
        for v in (["a|b", "c"], ["a", "b|c"], [None, "x"])
    ]
    assert got == expected and len(set(got)) == 3


def test_mask(spark):
    assert values(spark, ["secret-key", "abc", "", None, "abcd"], text.mask) == ["******-key", "***", "", "", "****"]


def test_labels(spark):
    rows = spark.createDataFrame([(0.005, 0.6), (0.005, 0.1), (0.2, 0.9)], "p double, e double")
    assert [r[0] for r in rows.select(labels.drift_severity(F.col("p"), F.col("e"))).collect()] == ["high", "medium", "low"]
    causes = spark.createDataFrame([(20.0, 0.9), (0.0, 0.9), (0.0, 0.0)], "m double, a double")
    got = causes.select(
        F.size(labels.root_causes(F.col("m"), F.col("a"))), labels.root_cause_severity(F.col("m"), F.col("a"))
    ).collect()
    assert [tuple(r) for r in got] == [(2, "high"), (1, "medium"), (1, "low")]
