"""Registry analytics over tables derived from customers, orders and line items.

The registry tables are written once as SQL that both engines read the same way.
"""

from __future__ import annotations

from sparkcast.catalog.registry import query, rnd_sql, rounded
from sparkcast.catalog.views import table
from sparkcast.operators import registry as reg

DATASETS = """SELECT c_custkey AS dataset_id, concat(lower(c_name), '.csv') AS filename,
  DATE '2024-01-01' + CAST(c_custkey % 400 AS INT) AS created_at,
  CASE WHEN c_custkey % 7 = 0 THEN 'archived' ELSE 'ready' END AS status FROM {customer}"""
SCHEMAS = """SELECT o_custkey AS dataset_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version,
  CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'needs_review' ELSE 'superseded' END AS status,
  o_orderkey % 5 AS unresolved_columns FROM {orders}"""
REPORTS = """SELECT o_custkey AS dataset_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version,
  CASE WHEN o_orderkey % 9 = 4 THEN 'failed' ELSE 'completed' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'blocked' WHEN '2-HIGH' THEN 'needs_attention'
    WHEN '3-MEDIUM' THEN 'conditionally_ready' ELSE 'quality_ready' END AS readiness,
  CAST(o_orderkey % 100 AS DOUBLE) AS overall_score,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey % 3 + 1 ELSE 0 END AS blocker_count FROM {orders}"""
PREPARATIONS = """SELECT o_orderkey AS preparation_id, o_custkey AS dataset_id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version,
  CASE WHEN o_orderkey % 10 = 3 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN 'needs_review' ELSE 'model_ready' END AS readiness,
  o_orderkey % 40 AS feature_count, o_orderkey % 5000 AS duration_ms FROM {orders}"""
EXPERIMENTS = """SELECT l_orderkey AS experiment_id, l_orderkey AS preparation_id, CAST(min(l_shipdate) AS DATE) AS created_at,
  CASE WHEN l_orderkey % 11 = 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE CAST(sum(CAST(l_quantity AS BIGINT)) % 100 AS DOUBLE) / 100 END AS test_wape
  FROM {lineitem} GROUP BY l_orderkey"""
RUNS = """SELECT experiment_id, model, family, status, wape, tuning_ms, nth = 1 AS selected FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY status, wape, l_linenumber, l_partkey, l_suppkey) AS nth
  FROM (SELECT l_orderkey AS experiment_id, l_linenumber, l_partkey, l_suppkey,
    CASE l_linenumber % 4 WHEN 0 THEN 'gradient_boosting' WHEN 1 THEN 'naive_last' WHEN 2 THEN 'drift'
      ELSE 'ridge_regression' END AS model,
    CASE WHEN l_linenumber % 4 = 0 THEN 'gradient_boosting' ELSE 'statistical' END AS family,
    CASE WHEN l_partkey % 13 = 5 THEN 'failed' ELSE 'completed' END AS status,
    l_discount + 0.01 + CAST(l_suppkey % 10 AS DOUBLE) / 100 AS wape, l_partkey % 700 AS tuning_ms FROM {lineitem}) a) b"""

NAMES = {"customer": "customer", "orders": "orders", "lineitem": "lineitem"}
DS, SC, RP, PR, EX, RN = (
    f"{name} AS ({text.format(**NAMES)})"
    for name, text in (
        ("ds", DATASETS), ("sc", SCHEMAS), ("rp", REPORTS), ("pr", PREPARATIONS), ("ex", EXPERIMENTS), ("rn", RUNS)
    )
)
SUPERSEDED = """rs AS (SELECT rp.* REPLACE (CASE WHEN status = 'completed' AND version < max(version)
    FILTER (status = 'completed') OVER (PARTITION BY dataset_id) THEN 'superseded' ELSE status END AS status) FROM rp)"""


def _read(spark, sf, text):
    used = {t: table(spark, sf, t) for t in NAMES if "{" + t + "}" in text}
    return spark.sql(text, **used)


@query("version_supersede", f"WITH {RP}, {SUPERSEDED} SELECT * FROM rs")
def _(spark, sf):
    return reg.supersede(_read(spark, sf, REPORTS)).select(
        "dataset_id", "version", "status", "readiness", "overall_score", "blocker_count"
    )


@query("version_next", f"WITH {RP} SELECT dataset_id, max(version) + 1 AS next_version FROM rp GROUP BY 1")
def _(spark, sf):
    return reg.next_versions(_read(spark, sf, REPORTS))


@query(
    "latest_version",
    f"""WITH {SC} SELECT dataset_id, CAST(max(version) AS INTEGER) AS version, arg_max(status, version) AS status,
    arg_max(unresolved_columns, version) AS unresolved_columns
    FROM sc WHERE status NOT IN ('superseded', 'failed') GROUP BY dataset_id""",
)
def _(spark, sf):
    return reg.latest_version(_read(spark, sf, SCHEMAS))


@query(
    "version_history",
    f"""WITH {RP} SELECT dataset_id, version, status, row_number() OVER (PARTITION BY dataset_id ORDER BY version DESC)
    AS position FROM rp""",
)
def _(spark, sf):
    return reg.version_history(_read(spark, sf, REPORTS)).select("dataset_id", "version", "status", "position")


@query(
    "dataset_library",
    f"""WITH {DS}, {SC}, {RP}, {SUPERSEDED}, {PR},
    hit AS (SELECT * FROM ds WHERE status = 'ready' AND filename ILIKE '%00%'),
    s AS (SELECT dataset_id, arg_max(status, version) AS status FROM sc WHERE status <> 'superseded' GROUP BY 1),
    q AS (SELECT * FROM rs WHERE status = 'completed'),
    p AS (SELECT dataset_id, arg_max(status, version) AS status, max(version) AS version FROM pr GROUP BY 1)
    SELECT h.dataset_id, h.filename, h.created_at, coalesce(s.status, 'not_analyzed') AS schema_status,
    coalesce(q.readiness, 'not_analyzed') AS quality_status, q.overall_score AS quality_score,
    coalesce(q.blocker_count, 0) AS quality_blockers, coalesce(p.status, 'not_prepared') AS preparation_status,
    p.version AS preparation_version, (SELECT count(*) FROM hit) AS total_items
    FROM hit h LEFT JOIN s USING (dataset_id) LEFT JOIN q USING (dataset_id) LEFT JOIN p USING (dataset_id)
    ORDER BY h.created_at DESC, h.dataset_id LIMIT 25 OFFSET 25""",
)
def _(spark, sf):
    return reg.dataset_library(
        _read(spark, sf, DATASETS), _read(spark, sf, SCHEMAS), reg.supersede(_read(spark, sf, REPORTS)),
        _read(spark, sf, PREPARATIONS), status="ready", search=" 00 ", number=2, size=25,
    )


@query(
    "dataset_stats",
    f"""WITH {DS} SELECT count(*) AS active_datasets, (SELECT filename FROM ds WHERE status = 'ready'
    ORDER BY created_at DESC, dataset_id DESC LIMIT 1) AS latest_filename, max(created_at) AS latest_upload_at
    FROM ds WHERE status = 'ready'""",
)
def _(spark, sf):
    return reg.dataset_stats(_read(spark, sf, DATASETS))


@query(
    "schema_stats",
    f"""WITH {SC} SELECT count(*) FILTER (status = 'needs_review') AS awaiting_review,
    count(*) FILTER (status = 'confirmed') AS confirmed_schemas,
    CAST(coalesce(sum(unresolved_columns) FILTER (status = 'needs_review'), 0) AS BIGINT) AS unresolved_columns FROM sc""",
)
def _(spark, sf):
    return reg.schema_stats(_read(spark, sf, SCHEMAS))


@query(
    "quality_stats",
    f"""WITH {DS}, {RP}, {SUPERSEDED}, a AS (SELECT dataset_id FROM ds WHERE status = 'ready'),
    d AS (SELECT * FROM rs WHERE status = 'completed' AND dataset_id IN (SELECT dataset_id FROM a))
    SELECT count(*) FILTER (readiness = 'blocked') AS blocked_datasets,
    count(*) FILTER (readiness = 'needs_attention') AS needs_attention,
    count(*) FILTER (readiness = 'conditionally_ready') AS conditionally_ready,
    count(*) FILTER (readiness = 'quality_ready') AS quality_ready,
    CAST(sum(blocker_count) AS BIGINT) AS total_blockers, round(avg(overall_score), 2) AS average_quality_score,
    (SELECT count(*) FROM a WHERE dataset_id NOT IN (SELECT dataset_id FROM d)) AS datasets_not_analyzed FROM d""",
)
def _(spark, sf):
    return reg.quality_stats(_read(spark, sf, DATASETS), reg.supersede(_read(spark, sf, REPORTS)))


@query(
    "prep_stats",
    f"""WITH {DS}, {PR}, c AS (SELECT * FROM pr WHERE status IN ('completed', 'superseded'))
    SELECT (SELECT count(*) FROM c) AS total_prepared_datasets,
    (SELECT count(*) FROM c WHERE readiness = 'model_ready') AS model_ready_datasets,
    (SELECT count(*) FROM pr WHERE status = 'failed') AS failed_preparations,
    {rnd_sql('(SELECT avg(feature_count) FROM c)')} AS average_feature_count,
    {rnd_sql('(SELECT avg(duration_ms) FROM c)')} AS average_duration_ms,
    (SELECT count(*) FROM ds WHERE status = 'ready' AND dataset_id NOT IN (SELECT dataset_id FROM c))
      AS datasets_awaiting_preparation""",
)
def _(spark, sf):
    return rounded(reg.preparation_stats(_read(spark, sf, DATASETS), _read(spark, sf, PREPARATIONS)))


@query(
    "forecast_stats",
    f"""WITH {PR}, {EX} SELECT count(*) AS total_experiments, count(*) FILTER (status = 'completed')
    AS completed_experiments, count(*) FILTER (status = 'failed') AS failed_experiments,
    {rnd_sql('avg(test_wape)')} AS average_test_wape,
    (SELECT status FROM ex ORDER BY created_at DESC, experiment_id DESC LIMIT 1) AS latest_experiment_status,
    (SELECT count(*) FROM pr WHERE status = 'completed' AND readiness = 'model_ready' AND preparation_id NOT IN
      (SELECT preparation_id FROM ex WHERE status = 'completed')) AS datasets_awaiting_forecasting FROM ex""",
)
def _(spark, sf):
    return rounded(reg.forecast_stats(_read(spark, sf, EXPERIMENTS), _read(spark, sf, PREPARATIONS)))


@query(
    "winner_distribution",
    f"WITH {RN} SELECT model, count(*) AS wins FROM rn WHERE selected GROUP BY model",
)
def _(spark, sf):
    return reg.winner_distribution(_read(spark, sf, RUNS))


@query(
    "gbm_stats",
    f"""WITH {RN}, b AS (SELECT experiment_id, min(wape) AS best FROM rn WHERE family <> 'gradient_boosting'
      AND status = 'completed' GROUP BY 1), w AS (SELECT experiment_id, wape FROM rn WHERE family = 'gradient_boosting'
      AND selected), g AS (SELECT * FROM rn WHERE family = 'gradient_boosting')
    SELECT (SELECT count(DISTINCT experiment_id) FROM g WHERE status = 'completed') AS completed_experiments,
    (SELECT count(*) FROM w) AS boosted_wins,
    {rnd_sql('(SELECT avg(tuning_ms) FROM g WHERE tuning_ms > 0)')} AS average_tuning_ms,
    {rnd_sql('(SELECT avg((best - wape) / best) FROM b JOIN w USING (experiment_id))')} AS average_improvement,
    (SELECT count(*) FROM g WHERE status = 'failed') AS failed_models""",
)
def _(spark, sf):
    return rounded(reg.boosted_stats(_read(spark, sf, RUNS)))
