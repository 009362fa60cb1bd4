"""Quality rules over a raw text table, and the scores that follow from their findings.

Each rule returns findings in one common shape. Counting rules share the dictionary of distinct
cells; row numbers shown as evidence come from flagged rows only, ranked before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcast.config import QualityConfig
from sparkcast.functions.dates import frequency_label, parse_date_quality
from sparkcast.functions.numbers import parse_number_quality, relative_gap
from sparkcast.functions.text import cell, has_future_name, is_null_token, normalize_name, row_fingerprint
from sparkcast.operators.ordered import with_previous
from sparkcast.operators.panel import columns_by_role
from sparkcast.operators.profile import COLUMN, VALUE, long_values, value_counts
from sparkcast.operators.quantiles import exact_quantiles
from sparkcast.session import materialize

# Role sets of the quality rules.
NUMERIC_ROLES = ("revenue", "spend", "cost", "price", "profit", "impressions", "clicks", "conversions", "orders",
                 "units_sold", "roas", "ctr", "cpc", "cpa", "conversion_rate", "target")
TARGET_ROLES = ("revenue", "conversions", "orders", "units_sold", "profit", "target")
DIMENSION_ROLES = ("channel", "campaign", "product_category", "country", "region", "city", "device", "source", "medium")
NON_NEGATIVE_ROLES = ("impressions", "clicks", "conversions", "orders", "units_sold", "spend", "price", "roas", "ctr",
                      "cpc", "cpa", "conversion_rate")
RATE_ROLES = ("ctr", "conversion_rate")
DATE_ROLES = ("date", "timestamp")
FUNNEL = (("clicks", "impressions"), ("conversions", "clicks"), ("orders", "conversions"))
RATIOS = {
    "roas": ("revenue", "spend"),
    "ctr": ("clicks", "impressions"),
    "cpc": ("spend", "clicks"),
    "cpa": ("spend", "conversions"),
    "conversion_rate": ("conversions", "clicks"),
}

# Score weights, penalties and the dimension each category counts towards.
WEIGHTS = {"completeness": 0.15, "uniqueness": 0.10, "validity": 0.20, "consistency": 0.15, "temporal": 0.15,
           "integrity": 0.10, "leakage_safety": 0.15}
PENALTIES = {"blocker": 50.0, "error": 20.0, "warning": 7.0, "info": 1.0}
CATEGORY_DIMENSION = {"completeness": "completeness", "uniqueness": "uniqueness", "validity": "validity",
                      "consistency": "consistency", "metric_relationship": "consistency", "temporal": "temporal",
                      "schema": "integrity", "integrity": "integrity", "cardinality": "integrity",
                      "outlier": "validity", "leakage": "leakage_safety"}

# Every rule: category and what to do about it.
RULES = {
    "DQ_SCHEMA_001": ("schema", "Review and confirm the column mapping."),
    "DQ_SCHEMA_002": ("schema", "Map one column to a target metric."),
    "DQ_SCHEMA_003": ("schema", "Map one column to the date or timestamp role."),
    "DQ_COMPLETENESS_001": ("completeness", "Check why the source leaves values out."),
    "DQ_COMPLETENESS_002": ("completeness", "Fix the source or ignore the column."),
    "DQ_CARDINALITY_001": ("cardinality", "Decide whether a constant column is of use."),
    "DQ_CARDINALITY_002": ("cardinality", "Choose a coarser grouping for this dimension."),
    "DQ_CARDINALITY_003": ("cardinality", "Decide whether one dominant value leaves any signal."),
    "DQ_VALIDITY_001": ("validity", "Correct the number format in a derived table."),
    "DQ_VALIDITY_002": ("validity", "Check sign conventions and corrections."),
    "DQ_VALIDITY_003": ("validity", "Bring the rates to one scale in a derived table."),
    "DQ_OUTLIER_001": ("outlier", "Look at the business context before changing values."),
    "DQ_DUPLICATE_001": ("uniqueness", "Find out where repeated rows come from."),
    "DQ_DUPLICATE_002": ("uniqueness", "Confirm the grain of the table."),
    "DQ_TEMPORAL_001": ("temporal", "Correct dates in a derived table."),
    "DQ_TEMPORAL_002": ("temporal", "Review missing periods before preparation."),
    "DQ_TEMPORAL_003": ("temporal", "Sort in a derived table only."),
    "DQ_TEMPORAL_004": ("temporal", "Verify timestamps and when they became known."),
    "DQ_TEMPORAL_005": ("temporal", "Choose an aggregation frequency."),
    "DQ_TEMPORAL_006": ("temporal", "Confirm the grain of the table."),
    "DQ_RELATIONSHIP_001": ("metric_relationship", "Check metric definitions and grain."),
    "DQ_RELATIONSHIP_002": ("metric_relationship", "Check how the ratio is defined and aggregated."),
    "DQ_LEAKAGE_001": ("leakage", "Leave the copy out of the predictors."),
    "DQ_LEAKAGE_002": ("leakage", "Document when this column becomes known."),
    "DQ_LEAKAGE_003": ("leakage", "Establish that this metric is known at prediction time."),
}

FINDING_COLUMNS = (
    "rule_code", "category", "severity", "affected_column", "related_columns", "affected_row_count", "affected_ratio",
    "sample_row_indices", "evidence", "threshold", "recommendation", "blocking", "confidence",
)


FINGERPRINT, MOMENT, NUMBER = "_fingerprint", "_moment", "_number_"


@dataclass(frozen=True)
class QualityInput:
    """A raw table, the column that gives its row order, and the role of each column in order."""

    df: DataFrame
    row_id: str
    roles: Mapping[str, str]
    confirmed: bool = True
    cfg: QualityConfig = QualityConfig()
    typed: bool = False

    @property
    def columns(self) -> list[str]:
        return [c for c, role in self.roles.items() if role != "ignored"]

    @property
    def by_role(self) -> dict[str, str]:
        return columns_by_role(self.roles)

    @property
    def target_role(self) -> str | None:
        return next((r for r in TARGET_ROLES if r in self.by_role), None)

    @property
    def date_column(self) -> str | None:
        return self.by_role.get("date") or self.by_role.get("timestamp")

    def with_role(self, roles: Sequence[str]) -> list[str]:
        return [c for c in self.columns if self.roles[c] in roles]

    def total(self) -> Column:
        return F.greatest(self.df.agg(F.count(F.lit(1))).scalar(), F.lit(1))

    def mapping(self) -> DataFrame:
        rows = [(i, c, r) for i, (c, r) in enumerate(self.roles.items())]
        m = self.df.sparkSession.createDataFrame(rows, "column_index int, column_name string, semantic_role string")
        return m.withColumn("normalized_name", normalize_name(F.col(COLUMN)))


def typed_rows(q: QualityInput) -> QualityInput:
    """The same input on a written copy that also holds what several rules parse: the moment, the numbers and the fingerprint of
    each row. The raw table is read once; a rule then reads only the columns it needs."""
    made = {FINGERPRINT: row_fingerprint(*[F.col(c) for c in q.roles])}
    made |= {f"{NUMBER}{c}": parse_number_quality(cell(F.col(c))) for c in q.with_role(NUMERIC_ROLES)}
    if q.date_column:
        made[MOMENT] = parse_date_quality(cell(F.col(q.date_column)))
    return replace(q, df=materialize(q.df.withColumns(made), "typed-rows"), typed=True)


def finding(
    code: str,
    severity: Column | str,
    *,
    column: Column | None = None,
    related: Column | None = None,
    count: Column | None = None,
    ratio: Column | None = None,
    rows: Column | None = None,
    evidence: Mapping[str, Column] | None = None,
    threshold: Mapping[str, float] | None = None,
    blocking: Column | bool = False,
    confidence: float = 1.0,
) -> list[Column]:
    """The select list that turns a row of rule results into a finding."""
    category, advice = RULES[code]

    def text_map(values: Mapping[str, Column]) -> Column:
        pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
        return F.create_map(*pairs).cast("map<string,string>")

    blocked = F.lit(blocking) if isinstance(blocking, bool) else blocking
    return [
        F.lit(code).alias("rule_code"),
        F.lit(category).alias("category"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        (F.lit(None).cast("string") if column is None else column).alias("affected_column"),
        (F.array().cast("array<string>") if related is None else related).alias("related_columns"),
        (F.lit(None) if count is None else count).cast("bigint").alias("affected_row_count"),
        (F.lit(None) if ratio is None else ratio).cast("double").alias("affected_ratio"),
        (F.array() if rows is None else F.coalesce(rows, F.array())).cast("array<bigint>").alias("sample_row_indices"),
        text_map(evidence or {}).alias("evidence"),
        text_map({k: F.lit(v) for k, v in (threshold or {}).items()}).alias("threshold"),
        F.lit(advice).alias("recommendation"),
        blocked.alias("blocking"),
        F.lit(confidence).alias("confidence"),
    ]


def no_findings(q: QualityInput) -> DataFrame:
    return q.df.sparkSession.range(0).select(*finding("DQ_SCHEMA_001", "info"))


def evidence_rows(flagged: DataFrame, row_id: str, keys: Sequence[str], limit: int) -> DataFrame:
    """The first row ids of each flagged group. The rank filter applies before the shuffle, so a group
    that holds most of the table sends at most `limit` rows per task."""
    order = Window.partitionBy(*keys).orderBy(row_id)
    return (
        flagged.select(*keys, row_id)
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= limit)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.col(row_id).cast("bigint"))).alias("rows"))
    )


def _with_rows(counted: DataFrame, evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    return counted.join(evidence, list(keys), "left")


def _first_rows(flagged: DataFrame, row_id: str, limit: int) -> Column:
    """The first flagged row ids as a constant: a bounded sort, used inside a one-row result."""
    head = flagged.select(F.col(row_id).cast("bigint").alias("r")).orderBy("r").limit(limit)
    return head.agg(F.sort_array(F.collect_list("r"))).scalar()


# --- schema and names -------------------------------------------------------------------------


def schema_rules(q: QualityInput) -> DataFrame:
    """Unconfirmed mapping, no target, no date."""
    role = F.col("semantic_role")
    state = q.mapping().agg(
        F.count_if(role.isin(*TARGET_ROLES)).alias("targets"), F.count_if(role.isin(*DATE_ROLES)).alias("dates")
    )
    parts = [
        state.filter(F.lit(not q.confirmed)).select(*finding("DQ_SCHEMA_001", "warning")),
        state.filter(F.col("targets") == 0).select(*finding("DQ_SCHEMA_002", "blocker", blocking=True)),
        state.filter(F.col("dates") == 0).select(*finding("DQ_SCHEMA_003", "blocker", blocking=True)),
    ]
    return reduce(DataFrame.unionByName, parts)


def future_names(q: QualityInput) -> DataFrame:
    hits = q.mapping().filter(F.col("semantic_role") != "ignored").filter(has_future_name(F.col("normalized_name")))
    return hits.select(*finding("DQ_LEAKAGE_002", "warning", column=F.col(COLUMN), confidence=0.7))


def derived_targets(q: QualityInput) -> DataFrame:
    """Metrics computed from revenue while revenue is the target."""
    if q.target_role != "revenue":
        return no_findings(q)
    target = q.by_role["revenue"]
    names = [q.by_role[r] for r in ("roas", "profit") if r in q.by_role]
    hits = q.mapping().filter(F.col(COLUMN).isin(*names)) if names else q.mapping().filter(F.lit(False))
    return hits.select(
        *finding("DQ_LEAKAGE_003", "warning", column=F.col(COLUMN), related=F.array(F.lit(target)), confidence=0.85)
    )


# --- distinct cells ---------------------------------------------------------------------------


def cell_statistics(q: QualityInput) -> DataFrame:
    """Per column: rows, missing cells, distinct values, the largest count, and number faults.

    Derived from the dictionary of distinct cells, so each distinct text is parsed once.
    """
    roles = F.create_map(*[F.lit(x) for c in q.columns for x in (c, q.roles[c])])
    missing = is_null_token(F.col(VALUE))
    number = parse_number_quality(F.col(VALUE))
    cells = (
        value_counts(q.df, q.columns, q.row_id)
        .withColumns({"missing": missing, "num": number, "role": F.element_at(roles, F.col(COLUMN))})
    )

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("cnt"))), F.lit(0))

    present, num = ~F.col("missing"), F.col("num")
    return cells.groupBy(COLUMN, "role").agg(
        F.sum("cnt").alias("scanned"),
        rows(F.col("missing")).alias("missing_count"),
        rows(present).alias("present"),
        F.count_if(present).alias("unique_count"),
        F.coalesce(F.max(F.when(present, F.col("cnt"))), F.lit(0)).alias("largest"),
        rows(present & num.isNull()).alias("invalid_numbers"),
        rows(num < 0).alias("negative"),
        rows((num < 0) | (num > 100)).alias("out_of_scale"),
        rows(num.isNotNull()).alias("numbers"),
        F.coalesce(F.bool_or((num > 0) & (num <= 1)), F.lit(False)).alias("has_fraction"),
        F.coalesce(F.bool_or(num > 1), F.lit(False)).alias("has_percent"),
    )


def _critical() -> Column:
    return F.col("role").isin(*TARGET_ROLES, *DATE_ROLES)


def missing_values(q: QualityInput, stats: DataFrame | None = None) -> DataFrame:
    s = cell_statistics(q) if stats is None else stats
    ratio = F.col("missing_count") / F.greatest("scanned", F.lit(1))
    severity = (
        F.when((ratio >= q.cfg.missing_blocker) & _critical(), "blocker")
        .when(ratio >= q.cfg.missing_error, "error")
        .when(ratio >= q.cfg.missing_warning, "warning")
        .otherwise("info")
    )
    limits = {"warning": q.cfg.missing_warning, "error": q.cfg.missing_error, "blocker": q.cfg.missing_blocker}
    return s.filter(F.col("missing_count") > 0).select(
        *finding(
            "DQ_COMPLETENESS_001", severity, column=F.col(COLUMN), count=F.col("missing_count"),
            ratio=F.round(ratio, 6), evidence={"observed_count": F.col("missing_count"), "scan_scope": F.col("scanned")},
            threshold=limits, blocking=severity == "blocker",
        )
    )


def empty_columns(q: QualityInput, stats: DataFrame | None = None) -> DataFrame:
    s = cell_statistics(q) if stats is None else stats
    return s.filter(F.col("present") == 0).select(
        *finding(
            "DQ_COMPLETENESS_002", F.when(_critical(), "blocker").otherwise("error"), column=F.col(COLUMN),
            count=F.col("scanned"), ratio=F.lit(1.0), blocking=_critical(),
        )
    )


def constant_columns(q: QualityInput, stats: DataFrame | None = None) -> DataFrame:
    s = cell_statistics(q) if stats is None else stats
    is_target = F.col("role").isin(*TARGET_ROLES)
    return s.filter(F.col("unique_count") == 1).select(
        *finding(
            "DQ_CARDINALITY_001", F.when(is_target, "blocker").otherwise("info"), column=F.col(COLUMN),
            count=F.col("present"), ratio=F.lit(1.0), blocking=is_target,
        )
    )


def near_constant_columns(q: QualityInput, stats: DataFrame | None = None) -> DataFrame:
    s = cell_statistics(q) if stats is None else stats
    share = F.col("largest") / F.greatest("present", F.lit(1))
    return s.filter((F.col("unique_count") > 1) & (share >= q.cfg.near_constant)).select(
        *finding(
            "DQ_CARDINALITY_003", "warning", column=F.col(COLUMN), ratio=share,
            threshold={"dominant_ratio": q.cfg.near_constant},
        )
    )


def high_cardinality(q: QualityInput, stats: DataFrame | None = None) -> DataFrame:
    s = cell_statistics(q) if stats is None else stats
    share = F.col("unique_count") / F.greatest("present", F.lit(1))
    return s.filter(F.col("role").isin(*DIMENSION_ROLES) & (share >= q.cfg.high_cardinality)).select(
        *finding(
            "DQ_CARDINALITY_002", "warning", column=F.col(COLUMN), ratio=F.round(share, 6),
            threshold={"unique_ratio": q.cfg.high_cardinality}, confidence=0.9,
        )
    )


def _numeric_cells(q: QualityInput) -> DataFrame:
    """Cells of numeric roles with their parsed number: (row id, column, value, num)."""
    columns = q.with_role(NUMERIC_ROLES)
    if not columns:
        return q.df.sparkSession.createDataFrame(
            [], f"{q.row_id} bigint, {COLUMN} string, {VALUE} string, num double"
        )
    if q.typed:
        cells = F.array(*[F.struct(F.lit(c).alias(COLUMN), cell(F.col(c)).alias(VALUE), F.col(f"{NUMBER}{c}").alias("num")) for c in columns])
        return q.df.select(q.row_id, F.explode(cells).alias("_cell")).select(q.row_id, "_cell.*")
    cells = long_values(q.df, columns, q.row_id)
    return cells.withColumn("num", parse_number_quality(F.col(VALUE)))


def _cell_evidence(q: QualityInput, flag: Column) -> DataFrame:
    return evidence_rows(_numeric_cells(q).filter(flag), q.row_id, [COLUMN], q.cfg.evidence_rows)


def invalid_numbers(q: QualityInput, stats: DataFrame | None = None) -> DataFrame:
    s = cell_statistics(q) if stats is None else stats
    bad = s.filter(F.col("role").isin(*NUMERIC_ROLES) & (F.col("invalid_numbers") > 0))
    rows = _cell_evidence(q, F.col("num").isNull() & ~is_null_token(F.col(VALUE)))
    return _with_rows(bad, rows, [COLUMN]).select(
        *finding(
            "DQ_VALIDITY_001", "error", column=F.col(COLUMN), count=F.col("invalid_numbers"),
            ratio=F.col("invalid_numbers") / F.greatest("scanned", F.lit(1)), rows=F.col("rows"),
            evidence={"parse_failures": F.col("invalid_numbers"), "scan_scope": F.col("scanned")},
        )
    )


def negative_values(q: QualityInput, stats: DataFrame | None = None) -> DataFrame:
    s = cell_statistics(q) if stats is None else stats
    bad = s.filter(F.col("role").isin(*NON_NEGATIVE_ROLES) & (F.col("negative") > 0))
    return _with_rows(bad, _cell_evidence(q, F.col("num") < 0), [COLUMN]).select(
        *finding(
            "DQ_VALIDITY_002", "error", column=F.col(COLUMN), count=F.col("negative"),
            ratio=F.col("negative") / F.greatest("scanned", F.lit(1)), rows=F.col("rows"),
        )
    )


def rate_scale(q: QualityInput, stats: DataFrame | None = None) -> DataFrame:
    """Rates outside 0..100, or fractions and percentages in one column."""
    s = cell_statistics(q) if stats is None else stats
    mixed, outside = F.col("has_fraction") & F.col("has_percent"), F.col("out_of_scale") > 0
    bad = s.filter(F.col("role").isin(*RATE_ROLES) & (mixed | outside))
    rows = _cell_evidence(q, (F.col("num") < 0) | (F.col("num") > 100))
    return _with_rows(bad, rows, [COLUMN]).select(
        *finding(
            "DQ_VALIDITY_003", F.when(outside, "error").otherwise("warning"), column=F.col(COLUMN),
            count=F.when(outside, F.col("out_of_scale")).otherwise(F.col("numbers")),
            rows=F.when(outside, F.col("rows")),
            evidence={"mixed_scale": mixed, "invalid_count": F.col("out_of_scale")},
        )
    )


def outliers(q: QualityInput) -> DataFrame:
    """Values outside the 1.5 IQR fences; needs eight values, four distinct ones and some spread.

    Limits, quartiles and fences each read the numbers, so the texts are parsed once and the numbers
    written to the shared folder.
    """
    parsed = _numeric_cells(q).select(q.row_id, COLUMN, "num").filter(F.col("num").isNotNull())
    cells = materialize(parsed, "numbers")
    limits = (
        cells.groupBy(COLUMN)
        .agg(F.count(F.lit(1)).alias("numbers"), F.min("num").alias("least"), F.max("num").alias("most"))
        .filter(F.col("numbers") >= 8)
    )
    quartiles = exact_quantiles(cells, [COLUMN], "num", {"q1": 0.25, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fences = limits.join(quartiles, COLUMN).filter(F.col("q3") > F.col("q1")).select(
        COLUMN, "numbers", "least", "most", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high")
    )
    # One row of fences per numeric column.
    placed = cells.join(F.broadcast(fences), COLUMN)
    num = F.col("num")
    beyond = (num < F.col("low")) | (num > F.col("high"))
    # Four distinct values or more: at least two between the least and the most.
    between = F.when((num > F.col("least")) & (num < F.col("most")), num)
    counted = (
        placed.groupBy(COLUMN, "numbers", "low", "high")
        .agg(F.count_if(beyond).alias("outside"), F.min(between).alias("_first"), F.max(between).alias("_last"))
        .filter((F.col("outside") > 0) & (F.col("_first") < F.col("_last")))
    )
    outside = placed.filter(beyond)
    ratio = F.col("outside") / F.col("numbers")
    rows = evidence_rows(outside, q.row_id, [COLUMN], q.cfg.evidence_rows)
    return _with_rows(counted, rows, [COLUMN]).select(
        *finding(
            "DQ_OUTLIER_001", F.when(ratio >= q.cfg.outlier_error, "error").otherwise("warning"), column=F.col(COLUMN),
            count=F.col("outside"), ratio=ratio, rows=F.col("rows"),
            evidence={"method": F.lit("IQR"), "lower_fence": F.col("low"), "upper_fence": F.col("high")},
            threshold={"multiplier": 1.5}, confidence=0.85,
        )
    )


# --- repeats ----------------------------------------------------------------------------------


def _repeats(q: QualityInput, key: Sequence[Column], names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(one row with the number of repeated rows, the repeated rows that can serve as evidence).

    Groups shrink to a count before the shuffle. Of each group the second and the next few rows are kept, as no later one can be
    among the first repeats of the table; the rank filter applies before the shuffle, so of a hot group each task sends a few rows,
    and nothing is joined back.
    """
    keyed = q.df.select(*[k.alias(n) for k, n in zip(key, names)], q.row_id)
    groups = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy(*names).orderBy(q.row_id))
    rows = keyed.withColumn("_nth", nth).filter(F.col("_nth") <= q.cfg.evidence_rows + 1).filter("_nth > 1")
    return groups.agg(F.sum(F.col("n") - 1).alias("repeats"), F.sum("n").alias("scanned")), rows


def duplicate_rows(q: QualityInput) -> DataFrame:
    key = F.col(FINGERPRINT) if q.typed else row_fingerprint(*[F.col(c) for c in q.roles])
    counted, rows = _repeats(q, [key], ["fingerprint"])
    ratio = F.col("repeats") / F.greatest("scanned", F.lit(1))
    return counted.filter(F.col("repeats") > 0).select(
        *finding(
            "DQ_DUPLICATE_001", F.when(ratio >= q.cfg.duplicate_error, "error").otherwise("warning"),
            count=F.col("repeats"), ratio=ratio, rows=_first_rows(rows, q.row_id, q.cfg.evidence_rows),
            evidence={"hash": F.lit("sha256"), "scan_scope": F.col("scanned")},
        )
    )


def duplicate_keys(q: QualityInput) -> DataFrame:
    """Repeats of (date, campaign, channel), when at least two of them are mapped."""
    names = [q.by_role[r] for r in ("date", "campaign", "channel") if r in q.by_role]
    if len(names) < 2:
        return no_findings(q)
    counted, rows = _repeats(q, [cell(F.col(c)) for c in names], names)
    return counted.filter(F.col("repeats") > 0).select(
        *finding(
            "DQ_DUPLICATE_002", "warning", related=F.array(*[F.lit(n) for n in names]), count=F.col("repeats"),
            rows=_first_rows(rows, q.row_id, q.cfg.evidence_rows), confidence=0.7,
        )
    )


# --- time -------------------------------------------------------------------------------------


def _moments(q: QualityInput) -> DataFrame:
    """Row id, date text and parsed moment of every row."""
    text = cell(F.col(q.date_column))
    moment = F.col(MOMENT) if q.typed else parse_date_quality(text)
    return q.df.select(F.col(q.row_id).cast("bigint").alias("row"), text.alias("text"), moment.alias("moment"))


def bad_dates(q: QualityInput) -> DataFrame:
    if not q.date_column:
        return no_findings(q)
    wrong = (F.col("text") != "") & F.col("moment").isNull()
    rows = _moments(q)
    counted = rows.agg(F.count_if(wrong).alias("wrong"), F.count(F.lit(1)).alias("scanned"))
    ratio = F.col("wrong") / F.greatest("scanned", F.lit(1))
    severity = F.when(1 - ratio < q.cfg.date_parse, "blocker").otherwise("error")
    return counted.filter(F.col("wrong") > 0).select(
        *finding(
            "DQ_TEMPORAL_001", severity, column=F.lit(q.date_column), count=F.col("wrong"), ratio=ratio,
            rows=_first_rows(rows.filter(wrong), "row", q.cfg.evidence_rows), blocking=severity == "blocker",
        )
    )


def _backward(q: QualityInput) -> DataFrame:
    dated = _moments(q).filter(F.col("moment").isNotNull()).select("row", "moment")
    return with_previous(dated, "row", ["moment"]).filter(F.col("moment") < F.col("previous_moment"))


def out_of_order_dates(q: QualityInput) -> DataFrame:
    if not q.date_column:
        return no_findings(q)
    back = _backward(q)
    return back.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0).select(
        *finding(
            "DQ_TEMPORAL_003", "warning", column=F.lit(q.date_column), count=F.col("n"),
            rows=_first_rows(back, "row", q.cfg.evidence_rows),
        )
    )


def _as_of(q: QualityInput) -> Column:
    return F.to_date(F.lit(q.cfg.as_of)) if q.cfg.as_of else F.current_date()


def future_dates(q: QualityInput) -> DataFrame:
    if not q.date_column:
        return no_findings(q)
    late = _moments(q).filter(F.col("moment").cast("date") > _as_of(q))
    return late.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0).select(
        *finding(
            "DQ_TEMPORAL_004", "error", column=F.lit(q.date_column), count=F.col("n"),
            rows=_first_rows(late, "row", q.cfg.evidence_rows),
        )
    )


def _intervals(q: QualityInput) -> DataFrame:
    """Seconds between neighbouring distinct moments, computed once and read by each interval rule."""
    distinct = _moments(q).filter(F.col("moment").isNotNull()).select(F.unix_micros("moment").alias("us")).distinct()
    gaps = (
        with_previous(distinct, "us", ["us"])
        .filter(F.col("previous_us").isNotNull())
        .select(((F.col("us") - F.col("previous_us")) / 1_000_000).alias("gap"))
    )
    return materialize(gaps, "intervals")


def interval_summary(q: QualityInput) -> DataFrame:
    """One row: median interval, frequency label, gaps beyond the multiple, spread of intervals."""
    gaps = _intervals(q)
    middle = exact_quantiles(gaps, [], "gap", {"median": 0.5}).select("median").scalar()
    return (
        gaps.withColumn("_median", middle)
        .agg(
            F.count(F.lit(1)).alias("intervals"),
            F.max("_median").alias("median_seconds"),
            F.count_if(F.col("gap") > F.col("_median") * q.cfg.gap_multiplier).alias("gap_count"),
            F.max("gap").alias("largest_gap"),
            F.count_distinct(F.rint("gap")).alias("distinct_intervals"),
        )
        .withColumn("frequency", frequency_label(F.col("median_seconds")))
    )


def temporal_gaps(q: QualityInput, intervals: DataFrame | None = None) -> DataFrame:
    if not q.date_column:
        return no_findings(q)
    return (interval_summary(q) if intervals is None else intervals).filter(F.col("gap_count") > 0).select(
        *finding(
            "DQ_TEMPORAL_002", "warning", column=F.lit(q.date_column), count=F.col("gap_count"),
            evidence={
                "expected_frequency": F.col("frequency"),
                "largest_gap_seconds": F.col("largest_gap"),
                "dominant_interval_seconds": F.col("median_seconds"),
            },
            threshold={"gap_multiplier": q.cfg.gap_multiplier}, confidence=0.85,
        )
    )


def irregular_time(q: QualityInput, intervals: DataFrame | None = None) -> DataFrame:
    if not q.date_column:
        return no_findings(q)
    share = F.try_divide(F.col("distinct_intervals"), F.col("intervals"))
    return (interval_summary(q) if intervals is None else intervals).filter((F.col("intervals") >= 4) & (share > 0.5)).select(
        *finding(
            "DQ_TEMPORAL_005", "warning", column=F.lit(q.date_column), evidence={"interval_variation_ratio": share},
            confidence=0.8,
        )
    )


def duplicate_dates(q: QualityInput) -> DataFrame:
    if not q.date_column:
        return no_findings(q)
    counted = _moments(q).agg((F.count("moment") - F.count_distinct("moment")).alias("n"))
    return counted.filter(F.col("n") > 0).select(
        *finding("DQ_TEMPORAL_006", "info", column=F.lit(q.date_column), count=F.col("n"), confidence=0.7)
    )


def temporal_summary(q: QualityInput) -> DataFrame:
    """One row: frequency, range, gaps, duplicates, disorder and future dates."""
    if not q.date_column:
        return q.df.sparkSession.range(1).select(F.lit(False).alias("available"))
    if not q.typed:
        moment = parse_date_quality(cell(F.col(q.date_column))).alias(MOMENT)
        q = replace(q, df=materialize(q.df.select(q.row_id, q.date_column, moment), "moments"), typed=True)
    moments = _moments(q)
    ranges = moments.agg(
        F.min("moment").alias("date_min"),
        F.max("moment").alias("date_max"),
        (F.count("moment") - F.count_distinct("moment")).alias("duplicate_dates"),
        F.count_if(F.col("moment").cast("date") > _as_of(q)).alias("future_dates"),
    )
    spacing = interval_summary(q).select(F.struct("frequency", "gap_count")).scalar()
    backward = _backward(q).agg(F.count(F.lit(1))).scalar()
    return ranges.select("*", spacing.alias("_spacing"), backward.alias("out_of_order")).select(
        F.lit(True).alias("available"),
        F.lit(q.date_column).alias("column"),
        F.coalesce("_spacing.frequency", F.lit("insufficient")).alias("frequency"),
        F.date_format("date_min", "yyyy-MM-dd'T'HH:mm:ss").alias("date_min"),
        F.date_format("date_max", "yyyy-MM-dd'T'HH:mm:ss").alias("date_max"),
        F.col("_spacing.gap_count").alias("gap_count"),
        "duplicate_dates",
        "out_of_order",
        "future_dates",
    )


# --- relations between metrics ----------------------------------------------------------------


def _row_checks(q: QualityInput, checks: Mapping[str, tuple[Sequence[str], Column]]) -> DataFrame:
    """Count all row predicates in one pass and attach the first flagged rows: (key, related, n, ratio, rows)."""
    schema = "key string, related array<string>, n bigint, ratio double, rows array<bigint>"
    if not checks:
        return q.df.sparkSession.createDataFrame([], schema)
    counted = q.df.agg(
        F.count(F.lit(1)).alias("_scanned"), *[F.count_if(flag).alias(key) for key, (_, flag) in checks.items()]
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(key).alias("key"), F.array(*[F.lit(c) for c in columns]).alias("related"), F.col(key).alias("n"),
                (F.col(key) / F.greatest("_scanned", F.lit(1))).alias("ratio"),
            )
            for key, (columns, _) in checks.items()
        ]
    )
    table = counted.select(F.explode(lines).alias("l")).select("l.*").filter(F.col("n") > 0)
    hits = F.array_compact(F.array(*[F.when(flag, F.lit(key)) for key, (_, flag) in checks.items()]))
    flagged = q.df.select(q.row_id, F.explode(hits).alias("key"))
    return _with_rows(table, evidence_rows(flagged, q.row_id, ["key"], q.cfg.evidence_rows), ["key"])


def _number(q: QualityInput, role: str) -> Column:
    column = q.by_role[role]
    return F.col(f"{NUMBER}{column}") if q.typed and column in q.with_role(NUMERIC_ROLES) else parse_number_quality(cell(F.col(column)))


def funnel_inversions(q: QualityInput) -> DataFrame:
    """Steps of the funnel that exceed the step before them."""
    checks = {
        f"{low}_{high}": ([q.by_role[low], q.by_role[high]], _number(q, low) > _number(q, high))
        for low, high in FUNNEL
        if low in q.by_role and high in q.by_role
    }
    return _row_checks(q, checks).select(
        *finding(
            "DQ_RELATIONSHIP_001", "error", related=F.col("related"), count=F.col("n"), ratio=F.col("ratio"),
            rows=F.col("rows"), confidence=0.9,
        )
    )


def ratio_mismatches(q: QualityInput) -> DataFrame:
    """Stated ratios that differ from their parts by more than the tolerance."""
    checks = {}
    for result, (num, den) in RATIOS.items():
        if not {result, num, den} <= q.by_role.keys():
            continue
        expected = F.try_divide(_number(q, num), F.nullif(_number(q, den), F.lit(0.0)))
        gap = relative_gap(_number(q, result), expected, result in RATE_ROLES)
        columns = [q.by_role[r] for r in (result, num, den)]
        checks[result] = (columns, F.coalesce(gap > q.cfg.relationship_tolerance, F.lit(False)))
    return _row_checks(q, checks).select(
        *finding(
            "DQ_RELATIONSHIP_002", "warning", related=F.col("related"), count=F.col("n"), ratio=F.col("ratio"),
            rows=F.col("rows"), threshold={"relative_tolerance": q.cfg.relationship_tolerance}, confidence=0.8,
        )
    )


def target_copies(q: QualityInput) -> DataFrame:
    """Columns equal to the target on every row where both have text, at least three of them."""
    if q.target_role is None:
        return no_findings(q)
    target = q.by_role[q.target_role]
    names = [c for c in q.columns if c != target and q.roles[c] not in DATE_ROLES]
    if not names:
        return no_findings(q)
    goal = cell(F.col(target))
    sums = []
    for i, name in enumerate(names):
        other = cell(F.col(name))
        both = (goal != "") & (other != "")
        sums += [F.count_if(both).alias(f"n{i}"), F.count_if(both & (goal != other)).alias(f"d{i}")]
    lines = F.array(
        *[
            F.struct(F.lit(n).alias(COLUMN), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("d"))
            for i, n in enumerate(names)
        ]
    )
    compared = q.df.agg(*sums).select(F.explode(lines).alias("l")).select("l.*")
    return compared.filter((F.col("n") >= 3) & (F.col("d") == 0)).select(
        *finding(
            "DQ_LEAKAGE_001", "blocker", column=F.col(COLUMN), related=F.array(F.lit(target)), count=F.col("n"),
            ratio=F.lit(1.0), blocking=True,
        )
    )


# --- scores and views over findings -----------------------------------------------------------


def _dimension() -> Column:
    table = F.create_map(*[F.lit(x) for pair in CATEGORY_DIMENSION.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col("category")), F.lit("integrity"))


def dimension_scores(findings: DataFrame) -> DataFrame:
    """100 less the penalties of each dimension, never below zero; dimensions without findings included."""
    table = F.create_map(*[F.lit(x) for pair in PENALTIES.items() for x in pair])
    lost = findings.agg(
        *[
            F.coalesce(F.sum(F.when(_dimension() == d, F.element_at(table, F.col("severity")))), F.lit(0.0)).alias(d)
            for d in WEIGHTS
        ]
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(d).alias("dimension"), F.lit(w).alias("weight"),
                F.greatest(F.lit(0.0), 100 - F.col(d)).alias("score"),
            )
            for d, w in WEIGHTS.items()
        ]
    )
    return lost.select(F.explode(lines).alias("l")).select("l.*")


def severity_counts(findings: DataFrame) -> DataFrame:
    counted = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in PENALTIES])
    return counted.unpivot([], list(PENALTIES), "severity", "findings")


def readiness(findings: DataFrame, blocker_cap: float = 49.0) -> DataFrame:
    """Overall weighted score and readiness; any blocking finding caps the score."""
    scores = dimension_scores(findings)
    overall = scores.agg(F.round(F.sum(F.col("score") * F.col("weight")), 2)).scalar()
    counted = findings.agg(
        F.count(F.lit(1)).alias("total_findings"),
        F.count_if("blocking").alias("blocking_findings"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    blocked = F.col("blocking_findings") > 0
    score = F.when(blocked, F.least(overall, F.lit(float(blocker_cap)))).otherwise(overall)
    return counted.withColumn("overall_score", score).withColumn(
        "readiness",
        F.when(blocked, "blocked")
        .when(F.col("errors") > 0, "needs_attention")
        .when((F.col("overall_score") >= 90) & (F.col("warnings") <= 2), "quality_ready")
        .otherwise("conditionally_ready"),
    )


def filter_findings(
    findings: DataFrame,
    category: str | None = None,
    severity: str | None = None,
    blocking: bool | None = None,
    column: str | None = None,
) -> DataFrame:
    tests = {"category": category, "severity": severity, "blocking": blocking, "affected_column": column}
    for name, wanted in tests.items():
        if wanted is not None:
            findings = findings.filter(F.col(name) == wanted)
    return findings


def recommendations(findings: DataFrame) -> DataFrame:
    """All pieces of advice, in rule and column order; there are at most a few per column and rule."""
    return findings.orderBy("rule_code", "affected_column", F.array_join("related_columns", ",")).select(
        "rule_code", "affected_column", "recommendation"
    )
