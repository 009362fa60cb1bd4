"""Profiles, roles and mappings of the raw text table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcast.catalog.registry import query, rnd_sql, rounded
from sparkcast.catalog.text_views import (
    COLUMNS,
    MAPPING,
    TEXT_SQL,
    date_profile_sql,
    date_quality_sql,
    events_text,
    has_time_sql,
    number_profile_sql,
    number_prep_sql,
    number_quality_sql,
)
from sparkcast.operators import profile, schema
from sparkcast.plans.infer import infer_roles, profile_table, typed_projection

ORDER = "CASE column_name " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(COLUMNS)) + " END"
LONG_SQL = f"""{TEXT_SQL},
long AS (SELECT row_id, column_name, trim(value) AS value FROM
         (UNPIVOT (SELECT row_id, {', '.join(COLUMNS)} FROM {{source}}) ON {', '.join(COLUMNS)}
          INTO NAME column_name VALUE value)),
parsed AS (SELECT *, CASE WHEN value <> '' THEN {number_profile_sql('value')} END AS num,
           CASE WHEN value <> '' THEN {date_profile_sql('value')} END AS ts, {has_time_sql('value')} AS timed FROM long)"""
BOOL = "lower(value) IN ('true', 'false', 'yes', 'no', 'y', 'n', '0', '1')"
PROFILE_SQL = """prof AS (SELECT CAST({order} AS INTEGER) AS column_index, column_name, column_name AS normalized_name,
  count(*) FILTER (value = '') > 0 AS nullable, count(*) FILTER (value = '') AS null_count, count(*) AS sample_count,
  count(*) FILTER (value <> '') AS filled_count, {unique} AS unique_count,
  coalesce(count(num) / nullif(count(*) FILTER (value <> ''), 0), 0) AS numeric_rate,
  coalesce(count(ts) / nullif(count(*) FILTER (value <> ''), 0), 0) AS date_rate,
  coalesce(count(ts) FILTER (timed) / nullif(count(ts), 0), 0) AS timed_rate,
  coalesce(bool_and({boolean}) FILTER (value <> ''), false) AS all_boolean,
  min(num) AS numeric_min, max(num) AS numeric_max, sum(num) / nullif(count(num), 0) AS numeric_mean,
  strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS date_min, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS date_max,
  CAST(min(length(value)) FILTER (value <> '') AS INTEGER) AS string_min_length,
  CAST(max(length(value)) FILTER (value <> '') AS INTEGER) AS string_max_length,
  coalesce(count(*) FILTER (num >= 0 AND NOT isnan(num)) / nullif(count(num), 0), 0) AS nonnegative_rate,
  coalesce(count(*) FILTER (num = floor(num) AND NOT isnan(num)) / nullif(count(num), 0), 0) AS integer_rate
  FROM parsed GROUP BY column_name)"""


def profile_sql(source: str = "ev", unique: str = "count(DISTINCT value) FILTER (value <> '')") -> str:
    return LONG_SQL.replace('{source}', source) + ",\n" + PROFILE_SQL.format(order=ORDER, unique=unique, boolean=BOOL)


SHOWN = f"""column_index, column_name, normalized_name, nullable, null_count, sample_count, filled_count, unique_count,
  {rnd_sql('coalesce(unique_count / nullif(filled_count, 0), 0)')} AS unique_rate, {rnd_sql('numeric_rate')} AS numeric_rate,
  {rnd_sql('date_rate')} AS date_rate, {rnd_sql('timed_rate')} AS timed_rate,
  {rnd_sql('greatest(numeric_rate, date_rate)')} AS parse_success_rate, all_boolean, numeric_min, numeric_max,
  {rnd_sql('numeric_mean', 4)} AS numeric_mean, date_min, date_max, string_min_length, string_max_length,
  {rnd_sql('nonnegative_rate')} AS nonnegative_rate, {rnd_sql('integer_rate')} AS integer_rate"""
RATES = ("unique_rate", "numeric_rate", "date_rate", "timed_rate", "parse_success_rate", "nonnegative_rate",
         "integer_rate")


def shown(df):
    return rounded(rounded(df, 6, *RATES), 4, "numeric_mean")


@query("column_profile", f"WITH {profile_sql()} SELECT {SHOWN} FROM prof")
def _(spark, sf):
    return shown(profile.column_profile(events_text(spark, sf), COLUMNS, "row_id"))


TYPED_SQL = """typed AS (SELECT *, coalesce(unique_count / nullif(filled_count, 0), 0) AS unique_rate,
  greatest(numeric_rate, date_rate) AS parse_success_rate, CASE WHEN filled_count = 0 THEN 'empty'
  WHEN all_boolean THEN 'boolean' WHEN numeric_rate = 1 AND integer_rate = 1 THEN 'integer' WHEN numeric_rate = 1 THEN 'float'
  WHEN date_rate >= 0.8 AND timed_rate > 0.5 THEN 'datetime' WHEN date_rate >= 0.8 THEN 'date'
  WHEN (numeric_rate > 0.2 AND numeric_rate < 0.8) OR (date_rate > 0.2 AND date_rate < 0.8) THEN 'mixed'
  WHEN (normalized_name LIKE '%\\_id' ESCAPE '\\' OR normalized_name = 'id')
       AND coalesce(unique_count / nullif(filled_count, 0), 0) >= 0.8 THEN 'identifier'
  WHEN coalesce(unique_count / nullif(filled_count, 0), 0) <= 0.5 OR unique_count <= 50 THEN 'categorical'
  ELSE 'text' END AS physical_type FROM prof)"""


@query("physical_types", f"WITH {profile_sql()}, {TYPED_SQL} SELECT column_name, physical_type FROM typed")
def _(spark, sf):
    return profile_table(events_text(spark, sf), COLUMNS, "row_id").select("column_name", "physical_type")


@query(
    "sample_values",
    f"""WITH {LONG_SQL.replace('{source}', 'ev')}, f AS (SELECT column_name, value, min(row_id) AS first_row FROM long
      WHERE value <> '' GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY first_row, value) AS i FROM f)
    SELECT column_name, list(value ORDER BY i) AS sample_values FROM n WHERE i <= 10 GROUP BY column_name""",
)
def _(spark, sf):
    return profile.sample_values(events_text(spark, sf), COLUMNS, "row_id")


DICTIONARY_SQL = "dict AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', '{schema.role_class(r)}', [{', '.join(repr(s) for s in sorted(names))}], "
    f"{str(r in schema.GENERIC_VALUE_ROLES).lower()})"
    for r, names in schema.ROLE_SYNONYMS.items()
) + ") v(role, role_class, synonyms, generic))"
CANDIDATE_SQL = f"""{DICTIONARY_SQL},
cand AS (SELECT t.*, d.role, d.role_class, CASE WHEN list_contains(synonyms, normalized_name) THEN 'exact synonym'
  WHEN len(list_filter(synonyms, lambda s: list_has_all(string_split(normalized_name, '_'), string_split(s, '_')))) > 0
    THEN 'token synonym'
  WHEN normalized_name = 'value' AND generic THEN 'generic metric name' END AS match,
  CASE WHEN (role_class = 'numeric' AND physical_type IN ('integer', 'float'))
    OR (role_class = 'date' AND physical_type IN ('date', 'datetime'))
    OR (role_class = 'dimension' AND physical_type IN ('categorical', 'identifier', 'text')) OR role_class = 'any'
    THEN CAST(0.25 AS DOUBLE) ELSE CAST(-0.25 AS DOUBLE) END AS type_score,
  CASE WHEN role_class = 'numeric' AND nonnegative_rate >= 0.8 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    AS distribution_score FROM typed t, dict d),
sc AS (SELECT *, CAST(CASE match WHEN 'exact synonym' THEN 0.65 WHEN 'token synonym' THEN 0.45 ELSE 0.35 END AS DOUBLE)
       AS name_score FROM cand WHERE match IS NOT NULL),
scored AS (SELECT *, round(greatest(0, least(1, name_score + type_score + distribution_score)), 4) AS score FROM sc),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY score DESC, role) AS INTEGER) AS rank,
           lead(score) OVER (PARTITION BY column_name ORDER BY score DESC, role) AS second_score FROM scored)"""
ROLES_SQL = f"""{profile_sql()}, {TYPED_SQL}, {CANDIDATE_SQL},
top AS (SELECT * FROM ranked WHERE rank = 1),
mapping AS (SELECT t.column_index, t.column_name, t.physical_type, coalesce(top.score, CAST(0 AS DOUBLE)) AS confidence,
  CASE WHEN top.score >= 0.6 AND NOT coalesce(top.score - top.second_score < 0.1, false) THEN top.role ELSE 'unknown' END
    AS semantic_role,
  list_filter([CASE WHEN coalesce(top.score - top.second_score < CAST(0.1 AS DOUBLE), false) THEN 'ambiguous_candidates' END,
    CASE WHEN top.role IN ('date', 'timestamp') AND t.parse_success_rate < 0.8 THEN 'low_date_parse_rate' END],
    lambda w: w IS NOT NULL) AS warnings FROM typed t LEFT JOIN top USING (column_name)),
mapped AS (SELECT *, CASE WHEN semantic_role = 'unknown' THEN 'unresolved' ELSE 'proposed' END AS status FROM mapping)"""


def candidates(spark, sf):
    return schema.role_candidates(profile_table(events_text(spark, sf), COLUMNS, "row_id"))


@query(
    "role_candidates",
    f"""WITH {profile_sql()}, {TYPED_SQL}, {CANDIDATE_SQL} SELECT column_name, role, match, name_score, type_score,
    distribution_score, score, CAST(CASE WHEN distribution_score > 0 THEN 3 ELSE 2 END AS INTEGER) AS evidence_count
    FROM scored""",
)
def _(spark, sf):
    return candidates(spark, sf).select(
        "column_name", "role", "match", "name_score", "type_score", "distribution_score", "score",
        F.size("evidence").alias("evidence_count"),
    )


@query(
    "role_top3",
    f"""WITH {profile_sql()}, {TYPED_SQL}, {CANDIDATE_SQL}
    SELECT column_name, rank, role, score FROM ranked WHERE rank <= 3""",
)
def _(spark, sf):
    return schema.rank_candidates(candidates(spark, sf)).select("column_name", "rank", "role", "score")


def mapping(spark, sf):
    return infer_roles(events_text(spark, sf), COLUMNS, "row_id")


@query(
    "role_assign",
    f"""WITH {ROLES_SQL} SELECT column_index, column_name, physical_type, semantic_role, confidence, status, warnings
    FROM mapped""",
)
def _(spark, sf):
    return mapping(spark, sf).select(
        "column_index", "column_name", "physical_type", "semantic_role", "confidence", "status", "warnings"
    )


def _relation_sql(metric: str, num: str, den: str) -> str:
    a, n, d = (number_prep_sql(c) for c in (metric, num, den))
    return f"""SELECT '{metric}' AS metric, count(*) AS observed,
      count(*) FILTER (abs(a - n / d) <= greatest(abs(n / d) * 0.25, 0.02)) AS matches
      FROM (SELECT {a} AS a, {n} AS n, {d} AS d FROM ev) WHERE a IS NOT NULL AND n IS NOT NULL AND d <> 0"""


@query(
    "relationship_evidence",
    f"""WITH {TEXT_SQL}, r AS ({_relation_sql('roas', 'revenue', 'spend')}
    UNION ALL {_relation_sql('ctr', 'clicks', 'impressions')})
    SELECT metric, observed, matches, {rnd_sql('matches / observed')} AS agreement,
    CAST(CASE WHEN matches / observed >= 0.7 THEN 0.05 ELSE -0.05 END AS DOUBLE) AS contribution FROM r""",
)
def _(spark, sf):
    by_role = {r: c for c, r in MAPPING.items() if r != "unknown"}
    out = schema.relationship_evidence(events_text(spark, sf), by_role)
    return rounded(out.select("metric", "observed", "matches", "agreement", "contribution"), 6, "agreement")


@query(
    "schema_issues",
    f"""WITH {ROLES_SQL}, s AS (SELECT count(*) FILTER (semantic_role IN ('date', 'timestamp')) AS dates,
      count(*) FILTER (semantic_role IN ('revenue', 'conversions', 'orders', 'units_sold', 'target')) AS targets,
      coalesce(list(column_name ORDER BY column_index) FILTER (semantic_role = 'revenue' AND confidence >= 0.75), [])
        AS revenues, count(*) FILTER (semantic_role = 'spend') AS spends,
      count(*) FILTER (semantic_role = 'revenue') AS any_revenue FROM mapped)
    SELECT 'missing_date' AS code, 'blocking' AS severity, CAST([] AS VARCHAR[]) AS column_names FROM s WHERE dates = 0
    UNION ALL SELECT 'missing_target', 'blocking', [] FROM s WHERE targets = 0
    UNION ALL SELECT 'duplicate_revenue', 'warning', revenues FROM s WHERE len(revenues) > 1
    UNION ALL SELECT 'spend_without_revenue', 'warning', [] FROM s WHERE spends > 0 AND any_revenue = 0""",
)
def _(spark, sf):
    return schema.schema_issues(mapping(spark, sf)).select("code", "severity", "column_names")


def _in(roles) -> str:
    return "(" + ", ".join(f"'{r}'" for r in roles) + ")"


@query(
    "schema_summary",
    f"""WITH {ROLES_SQL} SELECT count(*) AS total_columns,
    count(*) FILTER (semantic_role NOT IN ('unknown', 'ignored')) AS mapped_columns,
    count(*) FILTER (semantic_role = 'unknown') AS unresolved_columns,
    count(*) FILTER (len(warnings) > 0) AS ambiguous_columns, {rnd_sql('avg(confidence)', 4)} AS average_confidence,
    arg_min(column_name, column_index) FILTER (semantic_role IN ('date', 'timestamp')) AS primary_date_candidate,
    arg_min(column_name, column_index) FILTER (semantic_role IN {_in(schema.TARGET_ROLES)}) AS primary_target_candidate,
    coalesce(list(column_name ORDER BY column_index) FILTER (semantic_role IN {_in(schema.MARKETING_DIMENSIONS)}), [])
      AS marketing_dimensions,
    coalesce(list(column_name ORDER BY column_index) FILTER (semantic_role IN {_in(schema.PERFORMANCE_METRICS)}), [])
      AS performance_metrics,
    CASE WHEN count(*) FILTER (semantic_role = 'unknown') > 0 OR count(*) FILTER (len(warnings) > 0) > 0
      OR count(*) FILTER (semantic_role IN ('date', 'timestamp')) = 0
      OR count(*) FILTER (semantic_role IN {_in(schema.TARGET_ROLES)}) = 0
      THEN 'needs_review' ELSE 'mapping_ready' END AS readiness_status FROM mapped""",
)
def _(spark, sf):
    out = schema.schema_summary(mapping(spark, sf))
    return out.select(
        "total_columns", "mapped_columns", "unresolved_columns", "ambiguous_columns", "average_confidence",
        "primary_date_candidate", "primary_target_candidate", "marketing_dimensions", "performance_metrics",
        "readiness_status",
    )


OVERRIDES = {"spend": "spend", "actual_revenue": "ignored", "spare": "ignored", "order_id": "identifier",
             "ctr": "ctr", "device": "device"}
OVERRIDE_SQL = f"""{ROLES_SQL}, o AS (SELECT * FROM (VALUES
  {', '.join(f"('{c}', '{r}')" for c, r in OVERRIDES.items())}) v(column_name, new_role)),
  changed AS (SELECT m.column_index, m.column_name, m.semantic_role AS old_role,
    coalesce(o.new_role, m.semantic_role) AS semantic_role, m.warnings,
    CASE WHEN o.new_role IS NULL THEN m.confidence ELSE CAST(1 AS DOUBLE) END AS confidence,
    CASE WHEN o.new_role IS NULL THEN m.status ELSE 'manually_overridden' END AS status
    FROM mapped m LEFT JOIN o USING (column_name))"""


def overridden(spark, sf):
    schema.check_overrides(OVERRIDES)
    changes = spark.createDataFrame(list(OVERRIDES.items()), "column_name string, new_role string")
    return schema.override_roles(mapping(spark, sf), changes)


@query(
    "mapping_override",
    f"WITH {OVERRIDE_SQL} SELECT column_name, old_role, semantic_role, confidence, status FROM changed",
)
def _(spark, sf):
    return overridden(spark, sf).select("column_name", "old_role", "semantic_role", "confidence", "status")


@query(
    "schema_confirm",
    f"""WITH {OVERRIDE_SQL} SELECT column_name, semantic_role,
    CASE WHEN status = 'proposed' THEN 'confirmed' ELSE status END AS status FROM changed""",
)
def _(spark, sf):
    return schema.confirm_schema(overridden(spark, sf), check=False).select("column_name", "semantic_role", "status")


@query(
    "schema_blockers",
    f"""WITH {ROLES_SQL} SELECT 'Column ' || column_name || ' must be mapped or ignored' AS message FROM mapped
    WHERE semantic_role = 'unknown'""",
)
def _(spark, sf):
    return schema.confirmable(mapping(spark, sf))


@query(
    "typed_projection",
    f"""WITH {TEXT_SQL} SELECT row_id, CAST({date_quality_sql('date')} AS DATE) AS date,
    nullif(trim(channel), '') AS channel, {number_quality_sql('spend')} AS spend,
    {number_quality_sql('revenue')} AS revenue, {number_quality_sql('ctr')} AS ctr, nullif(trim(device), '') AS device
    FROM ev""",
)
def _(spark, sf):
    out = typed_projection(events_text(spark, sf), overridden(spark, sf), keep=["row_id"])
    return out.select("row_id", "date", "channel", "spend", "revenue", "ctr", "device")


LISTING_SQL = "listing AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', '{r.replace('_', ' ').title()}', '{schema.role_class(r)}', "
    f"CAST([{', '.join(repr(s) for s in schema.ROLE_SYNONYMS.get(r, []))}] AS VARCHAR[]))"
    for r in schema.ROLES
) + ") v(role, description, role_class, synonyms))"


@query(
    "role_dictionary",
    f"""WITH {ROLES_SQL}, {LISTING_SQL}, used AS (SELECT semantic_role AS role, list(column_name ORDER BY column_name)
      AS columns FROM mapped GROUP BY 1) SELECT listing.*, used.columns FROM listing LEFT JOIN used USING (role)""",
)
def _(spark, sf):
    """The dictionary with the columns of the raw table that carry each role."""
    used = mapping(spark, sf).groupBy(F.col("semantic_role").alias("role")).agg(
        F.sort_array(F.collect_list("column_name")).alias("columns")
    )
    return schema.role_dictionary(spark).join(used, "role", "left")
