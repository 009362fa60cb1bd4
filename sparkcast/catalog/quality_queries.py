"""Quality rules on the raw text table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sparkcast.catalog.registry import ORACLES, query, rnd, rnd_sql, rounded
from sparkcast.catalog.text_views import (
    COLUMNS,
    MAPPING,
    REPEATED_SQL,
    TEXT_SQL,
    date_quality_sql,
    events_text,
    number_quality_sql,
    repeated,
)
from sparkcast.config import QualityConfig
from sparkcast.operators import quality as dq
from sparkcast.operators.quality import QualityInput
from sparkcast.plans.quality import quality_report
from sparkcast.sources.tables import page

CFG = QualityConfig(as_of="2024-01-25")


def text_input(spark, sf, **changes):
    base = QualityInput(events_text(spark, sf), "row_id", MAPPING, confirmed=False, cfg=CFG)
    return replace(base, **changes) if changes else base


NULLS = "lower(value) IN ('', 'null', 'none', 'na', 'n/a', 'nan', 'missing')"
ROLE_CASE = "CASE column_name " + " ".join(f"WHEN '{c}' THEN '{r}'" for c, r in MAPPING.items()) + " END"
LONG = f"""{TEXT_SQL}, long AS (SELECT row_id, column_name, trim(value) AS value, {ROLE_CASE} AS role FROM
   (UNPIVOT (SELECT row_id, {', '.join(COLUMNS)} FROM ev) ON {', '.join(COLUMNS)} INTO NAME column_name VALUE value)),
 cells AS (SELECT *, {NULLS} AS missing, {number_quality_sql('value')} AS num FROM long)"""


def _in(roles) -> str:
    return "(" + ", ".join(f"'{r}'" for r in roles) + ")"


CRITICAL = f"role IN {_in((*dq.TARGET_ROLES, *dq.DATE_ROLES))}"
NUMERIC = f"role IN {_in(dq.NUMERIC_ROLES)}"


def evidence_sql(source: str, keys: str, where: str = "true") -> str:
    """First ten flagged rows of each group."""
    return f"""ev10 AS (SELECT {keys}, list(row_id ORDER BY row_id) AS sample_row_indices FROM
      (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY row_id) AS nth FROM {source} WHERE {where})
      WHERE nth <= 10 GROUP BY {keys})"""


def short(df, *extra):
    names = ("rule_code", "severity", "affected_column", "affected_row_count", "affected_ratio", "blocking", *extra)
    return df.select(*[rnd(n).alias(n) if n == "affected_ratio" else F.col(n) for n in names])


@query(
    "dq_schema",
    f"""SELECT 'DQ_SCHEMA_001' AS rule_code, 'warning' AS severity, false AS blocking, count(*) > 0 AS has_rows FROM events
    UNION ALL SELECT 'DQ_SCHEMA_002', 'blocker', true, count(*) > 0 FROM events
    UNION ALL SELECT 'DQ_SCHEMA_003', 'blocker', true, count(*) > 0 FROM events""",
)
def _(spark, sf):
    unmapped = {c: ("unknown" if r in (*dq.TARGET_ROLES, *dq.DATE_ROLES) else r) for c, r in MAPPING.items()}
    q = text_input(spark, sf, roles=unmapped)
    has_rows = (q.df.agg(F.count(F.lit(1))).scalar() > 0).alias("has_rows")
    return dq.schema_rules(q).select("rule_code", "severity", "blocking", has_rows)


@query(
    "dq_missing",
    f"""WITH {LONG}, s AS (SELECT column_name, role, count(*) FILTER (missing) AS m, count(*) AS n FROM cells GROUP BY ALL)
    SELECT 'DQ_COMPLETENESS_001' AS rule_code, CASE WHEN m / n >= 0.6 AND {CRITICAL} THEN 'blocker'
    WHEN m / n >= 0.25 THEN 'error' WHEN m / n >= 0.05 THEN 'warning' ELSE 'info' END AS severity,
    column_name AS affected_column, m AS affected_row_count, {rnd_sql('m / n')} AS affected_ratio,
    m / n >= 0.6 AND {CRITICAL} AS blocking FROM s WHERE m > 0""",
)
def _(spark, sf):
    return short(dq.missing_values(text_input(spark, sf)))


@query(
    "dq_empty",
    f"""WITH {LONG} SELECT 'DQ_COMPLETENESS_002' AS rule_code, CASE WHEN {CRITICAL} THEN 'blocker' ELSE 'error' END
    AS severity, column_name AS affected_column, count(*) AS affected_row_count, CAST(1 AS DOUBLE) AS affected_ratio,
    {CRITICAL} AS blocking FROM cells GROUP BY column_name, role HAVING count(*) FILTER (NOT missing) = 0""",
)
def _(spark, sf):
    return short(dq.empty_columns(text_input(spark, sf)))


@query(
    "dq_constant",
    f"""WITH {LONG} SELECT 'DQ_CARDINALITY_001' AS rule_code, 'info' AS severity, column_name AS affected_column,
    count(*) FILTER (NOT missing) AS affected_row_count, CAST(1 AS DOUBLE) AS affected_ratio, false AS blocking FROM cells
    GROUP BY column_name, role HAVING count(DISTINCT value) FILTER (NOT missing) = 1""",
)
def _(spark, sf):
    return short(dq.constant_columns(text_input(spark, sf)))


@query(
    "dq_near_constant",
    f"""WITH {LONG}, v AS (SELECT column_name, value, count(*) AS n FROM cells WHERE NOT missing GROUP BY ALL)
    SELECT 'DQ_CARDINALITY_003' AS rule_code, 'warning' AS severity, column_name AS affected_column,
    CAST(NULL AS BIGINT) AS affected_row_count, {rnd_sql('max(n) / sum(n)')} AS affected_ratio, false AS blocking
    FROM v GROUP BY column_name HAVING count(*) > 1 AND max(n) / sum(n) >= 0.98""",
)
def _(spark, sf):
    return short(dq.near_constant_columns(text_input(spark, sf)))


DIMENSIONED = {**MAPPING, "order_id": "source"}


@query(
    "dq_high_cardinality",
    f"""WITH {LONG}, s AS (SELECT column_name, count(DISTINCT value) / count(*) AS u FROM cells
      WHERE NOT missing AND (role IN {_in(dq.DIMENSION_ROLES)} OR column_name = 'order_id') GROUP BY ALL)
    SELECT 'DQ_CARDINALITY_002' AS rule_code, 'warning' AS severity, column_name AS affected_column,
    CAST(NULL AS BIGINT) AS affected_row_count, {rnd_sql('u')} AS affected_ratio, false AS blocking FROM s WHERE u >= 0.8""",
)
def _(spark, sf):
    return short(dq.high_cardinality(text_input(spark, sf, roles=DIMENSIONED)))


@query(
    "dq_invalid_number",
    f"""WITH {LONG}, {evidence_sql('cells', 'column_name', f'{NUMERIC} AND NOT missing AND num IS NULL')},
    s AS (SELECT column_name, count(*) FILTER (NOT missing AND num IS NULL) AS b, count(*) AS n FROM cells
          WHERE {NUMERIC} GROUP BY ALL)
    SELECT 'DQ_VALIDITY_001' AS rule_code, 'error' AS severity, s.column_name AS affected_column,
    b AS affected_row_count, {rnd_sql('b / n')} AS affected_ratio, false AS blocking, sample_row_indices
    FROM s JOIN ev10 USING (column_name)""",
)
def _(spark, sf):
    return short(dq.invalid_numbers(text_input(spark, sf)), "sample_row_indices")


@query(
    "dq_negative",
    f"""WITH {LONG}, {evidence_sql('cells', 'column_name', f'role IN {_in(dq.NON_NEGATIVE_ROLES)} AND num < 0')},
    s AS (SELECT column_name, count(*) FILTER (num < 0) AS b, count(*) AS n FROM cells GROUP BY ALL)
    SELECT 'DQ_VALIDITY_002' AS rule_code, 'error' AS severity, s.column_name AS affected_column,
    b AS affected_row_count, {rnd_sql('b / n')} AS affected_ratio, false AS blocking, sample_row_indices
    FROM s JOIN ev10 USING (column_name)""",
)
def _(spark, sf):
    return short(dq.negative_values(text_input(spark, sf)), "sample_row_indices")


@query(
    "dq_rate_scale",
    f"""WITH {LONG}, {evidence_sql('cells', 'column_name', 'num < 0 OR num > 100')},
    s AS (SELECT column_name, count(*) FILTER (num < 0 OR num > 100) AS b, count(num) AS n,
          bool_or(num > 0 AND num <= 1) AND bool_or(num > 1) AS mixed FROM cells
          WHERE role IN ('ctr', 'conversion_rate') GROUP BY ALL)
    SELECT 'DQ_VALIDITY_003' AS rule_code, CASE WHEN b > 0 THEN 'error' ELSE 'warning' END AS severity,
    s.column_name AS affected_column, CASE WHEN b > 0 THEN b ELSE n END AS affected_row_count,
    CAST(NULL AS DOUBLE) AS affected_ratio, false AS blocking,
    CASE WHEN b > 0 THEN sample_row_indices ELSE [] END AS sample_row_indices
    FROM s LEFT JOIN ev10 USING (column_name) WHERE b > 0 OR mixed""",
)
def _(spark, sf):
    return short(dq.rate_scale(text_input(spark, sf)), "sample_row_indices")


OUTLIER_SQL = f"""{LONG}, nums AS (SELECT row_id, column_name, num FROM cells WHERE {NUMERIC} AND num IS NOT NULL),
  f AS (SELECT column_name, count(*) AS n, quantile_cont(num, 0.25) AS q1, quantile_cont(num, 0.75) AS q3 FROM nums
        GROUP BY column_name HAVING count(*) >= 8 AND count(DISTINCT num) > 3),
  out AS (SELECT nums.*, f.n, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM nums JOIN f USING (column_name)
          WHERE q3 > q1 AND (num < q1 - 1.5 * (q3 - q1) OR num > q3 + 1.5 * (q3 - q1)))"""


@query(
    "dq_outliers",
    f"""WITH {OUTLIER_SQL}, {evidence_sql('out', 'column_name')},
    s AS (SELECT column_name, n, count(*) AS b, min(lo) AS lo, min(hi) AS hi FROM out GROUP BY column_name, n)
    SELECT 'DQ_OUTLIER_001' AS rule_code, CASE WHEN b / n >= 0.1 THEN 'error' ELSE 'warning' END AS severity,
    column_name AS affected_column, b AS affected_row_count, {rnd_sql('b / n')} AS affected_ratio, false AS blocking,
    sample_row_indices, {rnd_sql('lo')} AS lower_fence, {rnd_sql('hi')} AS upper_fence
    FROM s JOIN ev10 USING (column_name)""",
)
def _(spark, sf):
    out = dq.outliers(text_input(spark, sf))
    fences = [rnd(F.col("evidence")[k].cast("double")).alias(k) for k in ("lower_fence", "upper_fence")]
    return short(out.select("*", *fences), "sample_row_indices", "lower_fence", "upper_fence")


REPEATED_ROLES = {c: MAPPING[c] for c in ("date", "channel", "campaign", "revenue")}


def repeated_input(spark, sf):
    return QualityInput(repeated(spark, sf), "row_id", REPEATED_ROLES, cfg=CFG)


@query(
    "dq_duplicate_rows",
    f"""WITH {REPEATED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY trim(date), trim(channel), trim(campaign),
      trim(revenue) ORDER BY row_id) AS i FROM rep)
    SELECT 'DQ_DUPLICATE_001' AS rule_code, CASE WHEN count(*) FILTER (i > 1) / count(*) >= 0.1 THEN 'error'
    ELSE 'warning' END AS severity, CAST(NULL AS VARCHAR) AS affected_column, count(*) FILTER (i > 1) AS affected_row_count,
    {rnd_sql('count(*) FILTER (i > 1) / count(*)')} AS affected_ratio, false AS blocking,
    (SELECT list(row_id ORDER BY row_id) FROM (SELECT row_id FROM k WHERE i > 1 ORDER BY row_id LIMIT 10))
      AS sample_row_indices FROM k""",
)
def _(spark, sf):
    return short(dq.duplicate_rows(repeated_input(spark, sf)), "sample_row_indices")


@query(
    "dq_duplicate_keys",
    f"""WITH {REPEATED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY trim(date), trim(campaign), trim(channel)
      ORDER BY row_id) AS i FROM rep)
    SELECT 'DQ_DUPLICATE_002' AS rule_code, 'warning' AS severity, ['date', 'campaign', 'channel'] AS related_columns,
    count(*) FILTER (i > 1) AS affected_row_count, (SELECT list(row_id ORDER BY row_id) FROM
      (SELECT row_id FROM k WHERE i > 1 ORDER BY row_id LIMIT 10)) AS sample_row_indices FROM k""",
)
def _(spark, sf):
    return dq.duplicate_keys(repeated_input(spark, sf)).select(
        "rule_code", "severity", "related_columns", "affected_row_count", "sample_row_indices"
    )


MOMENTS = f"""{TEXT_SQL}, mo AS (SELECT row_id, trim(date) AS text, {date_quality_sql('date')} AS moment FROM ev),
  seq AS (SELECT row_id, moment, lag(moment) OVER (ORDER BY row_id) AS before FROM mo WHERE moment IS NOT NULL),
  uniq AS (SELECT DISTINCT moment FROM mo WHERE moment IS NOT NULL),
  gaps AS (SELECT epoch(moment) - epoch(lag(moment) OVER (ORDER BY moment)) AS gap FROM uniq),
  g AS (SELECT gap FROM gaps WHERE gap IS NOT NULL),
  md AS (SELECT median(gap) AS med, count(*) AS n FROM g)"""
FREQ = """CASE WHEN med IS NULL THEN 'insufficient' WHEN med <= 5400 THEN 'hourly' WHEN med <= 129600 THEN 'daily'
  WHEN med <= 864000 THEN 'weekly' WHEN med <= 3888000 THEN 'monthly' WHEN med <= 10368000 THEN 'quarterly'
  ELSE 'irregular' END"""


def _first_ten(source: str, where: str) -> str:
    return f"""(SELECT list(row_id ORDER BY row_id) FROM (SELECT row_id FROM {source} WHERE {where}
      ORDER BY row_id LIMIT 10)) AS sample_row_indices"""


@query(
    "dq_temporal_summary",
    f"""WITH {MOMENTS} SELECT true AS available, 'date' AS "column", {FREQ} AS frequency,
    strftime((SELECT min(moment) FROM mo), '%Y-%m-%dT%H:%M:%S') AS date_min,
    strftime((SELECT max(moment) FROM mo), '%Y-%m-%dT%H:%M:%S') AS date_max,
    (SELECT count(*) FROM g WHERE gap > 2.0 * med) AS gap_count,
    (SELECT count(moment) - count(DISTINCT moment) FROM mo) AS duplicate_dates,
    (SELECT count(*) FROM seq WHERE moment < before) AS out_of_order,
    (SELECT count(*) FROM mo WHERE CAST(moment AS DATE) > DATE '2024-01-25') AS future_dates FROM md""",
)
def _(spark, sf):
    return dq.temporal_summary(text_input(spark, sf))


@query(
    "dq_bad_dates",
    f"""WITH {MOMENTS}, s AS (SELECT count(*) FILTER (text <> '' AND moment IS NULL) AS b, count(*) AS n FROM mo)
    SELECT 'DQ_TEMPORAL_001' AS rule_code, CASE WHEN 1 - b / n < 0.95 THEN 'blocker' ELSE 'error' END AS severity,
    'date' AS affected_column, b AS affected_row_count, {rnd_sql('b / n')} AS affected_ratio, 1 - b / n < 0.95 AS blocking,
    {_first_ten('mo', "text <> '' AND moment IS NULL")} FROM s WHERE b > 0""",
)
def _(spark, sf):
    return short(dq.bad_dates(text_input(spark, sf)), "sample_row_indices")


@query(
    "dq_out_of_order",
    f"""WITH {MOMENTS} SELECT 'DQ_TEMPORAL_003' AS rule_code, 'warning' AS severity, count(*) AS affected_row_count,
    {_first_ten('seq', 'moment < before')} FROM seq WHERE moment < before""",
)
def _(spark, sf):
    return dq.out_of_order_dates(text_input(spark, sf)).select(
        "rule_code", "severity", "affected_row_count", "sample_row_indices"
    )


@query(
    "dq_future_dates",
    f"""WITH {MOMENTS} SELECT 'DQ_TEMPORAL_004' AS rule_code, 'error' AS severity, count(*) AS affected_row_count,
    {_first_ten('mo', "CAST(moment AS DATE) > DATE '2024-01-25'")}
    FROM mo WHERE CAST(moment AS DATE) > DATE '2024-01-25'""",
)
def _(spark, sf):
    return dq.future_dates(text_input(spark, sf)).select(
        "rule_code", "severity", "affected_row_count", "sample_row_indices"
    )


@query(
    "dq_gaps",
    f"""WITH {MOMENTS} SELECT 'DQ_TEMPORAL_002' AS rule_code, count(*) FILTER (gap > 2.0 * med) AS affected_row_count,
    {FREQ} AS expected_frequency, {rnd_sql('max(gap)', 3)} AS largest_gap_seconds, {rnd_sql('med', 3)} AS
    dominant_interval_seconds FROM g, md GROUP BY med HAVING count(*) FILTER (gap > 2.0 * med) > 0""",
)
def _(spark, sf):
    out = dq.temporal_gaps(text_input(spark, sf))
    e = F.col("evidence")
    return out.select(
        "rule_code", "affected_row_count", e["expected_frequency"].alias("expected_frequency"),
        *[rnd(e[k].cast("double"), 3).alias(k) for k in ("largest_gap_seconds", "dominant_interval_seconds")],
    )


@query(
    "dq_irregular",
    f"""WITH {MOMENTS}, s AS (SELECT count(DISTINCT round_even(gap, 0)) / count(*) AS v, count(*) AS n FROM g)
    SELECT 'DQ_TEMPORAL_005' AS rule_code, 'warning' AS severity, {rnd_sql('v')} AS interval_variation_ratio
    FROM s WHERE v > 0.5 AND n >= 4""",
)
def _(spark, sf):
    out = dq.irregular_time(text_input(spark, sf))
    ratio = F.col("evidence")["interval_variation_ratio"].cast("double")
    return out.select("rule_code", "severity", rnd(ratio).alias("interval_variation_ratio"))


@query(
    "dq_dup_dates",
    f"""WITH {MOMENTS} SELECT 'DQ_TEMPORAL_006' AS rule_code, 'info' AS severity,
    count(moment) - count(DISTINCT moment) AS affected_row_count FROM mo""",
)
def _(spark, sf):
    return dq.duplicate_dates(text_input(spark, sf)).select("rule_code", "severity", "affected_row_count")


def _num(c: str) -> str:
    return number_quality_sql(c)


FUNNEL_SQL = f"""{TEXT_SQL}, v AS (SELECT row_id, {_num('impressions')} AS i, {_num('clicks')} AS c,
  {_num('conversions')} AS o, {_num('ctr')} AS ctr, {_num('roas')} AS roas, {_num('revenue')} AS r, {_num('spend')} AS s
  FROM ev)"""


@query(
    "dq_funnel",
    f"""WITH {FUNNEL_SQL}, f AS (SELECT row_id, 'clicks' AS low, 'impressions' AS high FROM v WHERE c > i
      UNION ALL SELECT row_id, 'conversions', 'clicks' FROM v WHERE o > c), {evidence_sql('f', 'low, high')}
    SELECT 'DQ_RELATIONSHIP_001' AS rule_code, 'error' AS severity, [low, high] AS related_columns,
    count(*) AS affected_row_count, {rnd_sql('count(*) / (SELECT count(*) FROM v)')} AS affected_ratio,
    any_value(sample_row_indices) AS sample_row_indices FROM f JOIN ev10 USING (low, high) GROUP BY low, high""",
)
def _(spark, sf):
    out = dq.funnel_inversions(text_input(spark, sf))
    return rounded(out.select("rule_code", "severity", "related_columns", "affected_row_count", "affected_ratio",
                              "sample_row_indices"))


def _gap(actual: str, expected: str) -> str:
    return f"abs({actual} - {expected}) / greatest(abs({expected}), 1e-9)"


@query(
    "dq_ratio",
    f"""WITH {FUNNEL_SQL}, f AS (
      SELECT row_id, 'roas' AS k, ['roas', 'revenue', 'spend'] AS related FROM v WHERE s <> 0 AND {_gap('roas', '(r / s)')} > 0.15
      UNION ALL SELECT row_id, 'ctr', ['ctr', 'clicks', 'impressions'] FROM v
      WHERE i <> 0 AND least({_gap('ctr', '(c / i)')}, {_gap('ctr', '(c / i * 100)')}) > 0.15), {evidence_sql('f', 'k')}
    SELECT 'DQ_RELATIONSHIP_002' AS rule_code, 'warning' AS severity, related AS related_columns,
    count(*) AS affected_row_count, {rnd_sql('count(*) / (SELECT count(*) FROM v)')} AS affected_ratio,
    any_value(sample_row_indices) AS sample_row_indices FROM f JOIN ev10 USING (k) GROUP BY k, related""",
)
def _(spark, sf):
    out = dq.ratio_mismatches(text_input(spark, sf))
    return rounded(out.select("rule_code", "severity", "related_columns", "affected_row_count", "affected_ratio",
                              "sample_row_indices"))


@query(
    "dq_target_copy",
    f"""WITH {LONG}, t AS (SELECT row_id, trim(revenue) AS y FROM ev),
    c AS (SELECT column_name, count(*) AS n, count(*) FILTER (value <> y) AS d FROM long JOIN t USING (row_id)
          WHERE column_name <> 'revenue' AND role NOT IN ('ignored', 'date', 'timestamp') AND value <> '' AND y <> ''
          GROUP BY column_name)
    SELECT 'DQ_LEAKAGE_001' AS rule_code, 'blocker' AS severity, column_name AS affected_column, n AS affected_row_count,
    CAST(1 AS DOUBLE) AS affected_ratio, true AS blocking FROM c WHERE n >= 3 AND d = 0""",
)
def _(spark, sf):
    return short(dq.target_copies(text_input(spark, sf)))


@query(
    "dq_future_name",
    f"""WITH {LONG} SELECT 'DQ_LEAKAGE_002' AS rule_code, 'warning' AS severity, column_name AS affected_column,
    count(*) AS scanned FROM long WHERE regexp_matches(column_name, 'next_|future_|after_|final_|actual_|realized_|post_')
    GROUP BY column_name""",
)
def _(spark, sf):
    q = text_input(spark, sf)
    return dq.future_names(q).select(
        "rule_code", "severity", "affected_column", q.df.agg(F.count(F.lit(1))).scalar().alias("scanned")
    )


@query(
    "dq_derived_target",
    """SELECT 'DQ_LEAKAGE_003' AS rule_code, 'warning' AS severity, 'roas' AS affected_column,
    ['revenue'] AS related_columns, count(*) AS scanned FROM events""",
)
def _(spark, sf):
    q = text_input(spark, sf)
    return dq.derived_targets(q).select(
        "rule_code", "severity", "affected_column", "related_columns",
        q.df.agg(F.count(F.lit(1))).scalar().alias("scanned"),
    )


@query(
    "dq_evidence_rows",
    f"""WITH {LONG}, bad AS (SELECT row_id, column_name FROM cells WHERE missing), {evidence_sql('bad', 'column_name')}
    SELECT column_name, sample_row_indices AS rows FROM ev10""",
)
def _(spark, sf):
    from sparkcast.functions.text import is_null_token
    from sparkcast.operators.profile import COLUMN, VALUE, long_values

    missing = long_values(events_text(spark, sf), COLUMNS, "row_id").filter(is_null_token(F.col(VALUE)))
    return dq.evidence_rows(missing, "row_id", [COLUMN], 10)


# Scores: findings of the dictionary rules and the relation rules, scored on both sides.
SCORED_SQL = f"""{LONG}, {FUNNEL_SQL.split(', v AS', 1)[1].join(['v AS', ''])},
  s AS (SELECT column_name, role, count(*) AS n, count(*) FILTER (missing) AS m, count(*) FILTER (NOT missing) AS p,
        count(DISTINCT value) FILTER (NOT missing) AS u, count(*) FILTER (NOT missing AND num IS NULL) AS inv,
        count(*) FILTER (num < 0) AS neg FROM cells GROUP BY ALL),
  fi AS (
   SELECT 'completeness' AS category, CASE WHEN m / n >= 0.6 AND {CRITICAL} THEN 'blocker' WHEN m / n >= 0.25 THEN 'error'
     WHEN m / n >= 0.05 THEN 'warning' ELSE 'info' END AS severity, m / n >= 0.6 AND {CRITICAL} AS blocking,
     column_name AS affected_column, 'DQ_COMPLETENESS_001' AS rule_code FROM s WHERE m > 0
   UNION ALL SELECT 'completeness', CASE WHEN {CRITICAL} THEN 'blocker' ELSE 'error' END, {CRITICAL}, column_name,
     'DQ_COMPLETENESS_002' FROM s WHERE p = 0
   UNION ALL SELECT 'cardinality', 'info', false, column_name, 'DQ_CARDINALITY_001' FROM s WHERE u = 1
   UNION ALL SELECT 'validity', 'error', false, column_name, 'DQ_VALIDITY_001' FROM s WHERE {NUMERIC} AND inv > 0
   UNION ALL SELECT 'validity', 'error', false, column_name, 'DQ_VALIDITY_002' FROM s
     WHERE role IN {_in(dq.NON_NEGATIVE_ROLES)} AND neg > 0
   UNION ALL SELECT 'metric_relationship', 'error', false, NULL, 'DQ_RELATIONSHIP_001' FROM v HAVING count(*) FILTER (c > i) > 0
   UNION ALL SELECT 'metric_relationship', 'error', false, NULL, 'DQ_RELATIONSHIP_001' FROM v HAVING count(*) FILTER (o > c) > 0
   UNION ALL SELECT 'leakage', 'warning', false, 'actual_revenue', 'DQ_LEAKAGE_002' FROM v HAVING count(*) > 0)"""


def scored_findings(spark, sf):
    q = text_input(spark, sf)
    stats = dq.cell_statistics(q)
    rules = (dq.missing_values, dq.empty_columns, dq.constant_columns, dq.invalid_numbers, dq.negative_values)
    out = dq.funnel_inversions(q).unionByName(dq.future_names(q))
    for rule in rules:
        out = out.unionByName(rule(q, stats))
    return out


DIMENSION_SQL = """dim AS (SELECT d.dimension, d.weight, greatest(0, 100 - coalesce(sum(CASE severity WHEN 'blocker' THEN 50
    WHEN 'error' THEN 20 WHEN 'warning' THEN 7 WHEN 'info' THEN 1 END), 0)) AS score
  FROM (VALUES ('completeness', 0.15), ('uniqueness', 0.10), ('validity', 0.20), ('consistency', 0.15), ('temporal', 0.15),
        ('integrity', 0.10), ('leakage_safety', 0.15)) d(dimension, weight)
  LEFT JOIN (SELECT *, CASE category WHEN 'metric_relationship' THEN 'consistency' WHEN 'cardinality' THEN 'integrity'
             WHEN 'leakage' THEN 'leakage_safety' ELSE category END AS dimension FROM fi) f ON d.dimension = f.dimension
  GROUP BY ALL)"""


@query(
    "dq_dimension_scores",
    f"""WITH {SCORED_SQL}, {DIMENSION_SQL}
    SELECT dimension, CAST(weight AS DOUBLE) AS weight, CAST(score AS DOUBLE) AS score FROM dim""",
)
def _(spark, sf):
    return dq.dimension_scores(scored_findings(spark, sf))


@query(
    "dq_readiness",
    f"""WITH {SCORED_SQL}, {DIMENSION_SQL}, o AS (SELECT round(CAST(sum(weight * score) AS DOUBLE), 2) AS overall FROM dim),
    c AS (SELECT count(*) AS total_findings, count(*) FILTER (blocking) AS blocking_findings,
          count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM fi)
    SELECT c.*, CASE WHEN blocking_findings > 0 THEN least(overall, CAST(49 AS DOUBLE)) ELSE overall END AS overall_score,
    CASE WHEN blocking_findings > 0 THEN 'blocked' WHEN errors > 0 THEN 'needs_attention'
    WHEN overall >= 90 AND warnings <= 2 THEN 'quality_ready' ELSE 'conditionally_ready' END AS readiness FROM c, o""",
)
def _(spark, sf):
    return dq.readiness(scored_findings(spark, sf), CFG.blocker_cap)


@query(
    "dq_severity_counts",
    f"""WITH {SCORED_SQL} SELECT s.severity, count(fi.severity) AS findings
    FROM (VALUES ('blocker'), ('error'), ('warning'), ('info')) s(severity) LEFT JOIN fi USING (severity) GROUP BY 1""",
)
def _(spark, sf):
    return dq.severity_counts(scored_findings(spark, sf))


@query(
    "dq_recommendations",
    f"""WITH {SCORED_SQL} SELECT rule_code, affected_column FROM fi""",
)
def _(spark, sf):
    return dq.recommendations(scored_findings(spark, sf)).select("rule_code", "affected_column")


@query(
    "dq_findings_page",
    f"""WITH {SCORED_SQL}, f AS (SELECT * FROM fi WHERE severity = 'error' AND NOT blocking AND category = 'validity')
    SELECT rule_code, affected_column, (SELECT count(*) FROM f) AS total FROM f ORDER BY rule_code, affected_column LIMIT 2""",
)
def _(spark, sf):
    hits = dq.filter_findings(scored_findings(spark, sf), category="validity", severity="error", blocking=False)
    return page(hits, ["rule_code", "affected_column"], 1, 2).select("rule_code", "affected_column", "total")


def _all_rules_sql() -> str:
    """Rule code, severity and row count of every rule, from the SQL of the single rules."""
    parts = []
    for name in ("dq_missing", "dq_empty", "dq_constant", "dq_near_constant", "dq_invalid_number", "dq_negative",
                 "dq_rate_scale", "dq_outliers", "dq_bad_dates", "dq_out_of_order", "dq_future_dates", "dq_dup_dates",
                 "dq_funnel", "dq_ratio", "dq_target_copy"):
        parts.append(f"SELECT rule_code, severity, affected_row_count FROM ({ORACLES[name]})")
    parts.append(f"SELECT rule_code, 'warning', affected_row_count FROM ({ORACLES['dq_gaps']})")
    for name in ("dq_irregular", "dq_future_name", "dq_derived_target"):
        parts.append(f"SELECT rule_code, severity, CAST(NULL AS BIGINT) FROM ({ORACLES[name]})")
    parts.append("SELECT 'DQ_SCHEMA_001', 'warning', CAST(NULL AS BIGINT) FROM events HAVING count(*) > 0")
    parts.append(
        f"""SELECT 'DQ_DUPLICATE_002', 'warning', n FROM (WITH {TEXT_SQL} SELECT count(*) - count(DISTINCT (trim(date),
        trim(campaign), trim(channel))) AS n FROM ev) WHERE n > 0"""
    )
    return " UNION ALL ".join(parts)


@query("dq_report", _all_rules_sql())
def _(spark, sf):
    """All rules in one report."""
    findings, _ = quality_report(text_input(spark, sf))
    return findings.select("rule_code", "severity", "affected_row_count")
