"""Files written from the shared tables and read back, previews, digests and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcast.catalog.forecast_queries import PRED_SQL, SHOWN, predictions, shown
from sparkcast.catalog.registry import query
from sparkcast.catalog.text_views import COLUMNS, TEXT_SQL, date_prep_sql, events_text, number_prep_sql
from sparkcast.catalog.views import DAILY, DAILY_SQL, axis_sql, split_daily, table
from sparkcast.session import scratch_path
from sparkcast.sources import csv, sinks, tables


def _write_csv(df, label: str, sep: str = ",") -> str:
    path = scratch_path(df.sparkSession, label)
    options = {"header": "true", "sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}
    df.write.options(**options).csv(path)
    return path


@query(
    "csv_scan",
    f"WITH {TEXT_SQL} SELECT CAST(row_id AS VARCHAR) AS row_id, {', '.join(COLUMNS)} FROM ev",
)
def _(spark, sf):
    path = _write_csv(events_text(spark, sf), "csv")
    return csv.accepted(csv.read_csv(spark, path)).select("row_id", *COLUMNS)


LINES = "concat_ws('{sep}', CAST(event_id AS STRING), event_type, CAST(user_id AS STRING){tail})"


def _lines(spark, sf, sep: str = ";", ragged: bool = False):
    full = LINES.format(sep=sep, tail=", CAST(value AS STRING)")
    short = LINES.format(sep=sep, tail="")
    text = f"CASE WHEN event_id % 50 = 7 THEN {short} ELSE {full} END" if ragged else full
    return table(spark, sf, "events").selectExpr(f"{text} AS value")


@query(
    "csv_delimiter_stats",
    """WITH l AS (SELECT concat_ws(';', CAST(event_id AS VARCHAR), event_type, CAST(user_id AS VARCHAR),
      CAST(value AS VARCHAR)) AS v FROM events),
    d AS (SELECT * FROM (VALUES (0, ','), (1, ';'), (2, chr(9)), (3, '|')) t(preference, delimiter))
    SELECT CAST(preference AS INTEGER) AS preference, delimiter, CAST(min(length(v) - length(replace(v, delimiter, ''))) AS INTEGER)
    AS fewest, CAST(max(length(v) - length(replace(v, delimiter, ''))) AS INTEGER) AS most,
    CAST(avg(length(v) - length(replace(v, delimiter, ''))) AS DOUBLE) AS average, count(*) AS lines
    FROM l, d GROUP BY preference, delimiter""",
)
def _(spark, sf):
    path = scratch_path(spark, "lines")
    _lines(spark, sf).write.text(path)
    return csv.delimiter_stats(spark.read.text(path))


def _ragged(spark, sf):
    """A table file in which one line in fifty lacks its last cell; every part has the header."""
    path = scratch_path(spark, "ragged")
    header = spark.createDataFrame([("event_id,event_type,user_id,value",)], "value string")
    header.coalesce(1).write.text(f"{path}/a")
    _lines(spark, sf, ",", ragged=True).write.text(f"{path}/b")
    return path


@query(
    "csv_rejects",
    """SELECT concat_ws(',', CAST(event_id AS VARCHAR), event_type, CAST(user_id AS VARCHAR)) AS line,
    CAST(event_id AS VARCHAR) AS event_id FROM events WHERE event_id % 50 = 7""",
)
def _(spark, sf):
    path = _ragged(spark, sf)
    schema = f"event_id string, event_type string, user_id string, value string, {csv.REJECT} string"
    raw = spark.read.schema(schema).options(
        header="false", mode="PERMISSIVE", columnNameOfCorruptRecord=csv.REJECT, columnPruning="false"
    ).csv(f"{path}/b")
    return csv.rejects(raw).select(F.col(csv.REJECT).alias("line"), "event_id")


@query(
    "csv_line_numbers",
    f"""WITH {TEXT_SQL} SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS first_row, count(*) - 1 AS last_row,
    count(*) AS distinct_rows FROM ev""",
)
def _(spark, sf):
    path = _write_csv(events_text(spark, sf), "numbered")
    numbered = csv.accepted(csv.with_line_numbers(csv.read_csv(spark, path, ",", "utf-8", multi_line=False)))
    return numbered.agg(
        F.count(F.lit(1)).alias("row_count"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"),
        F.count_distinct("row_id").alias("distinct_rows"),
    )


@query(
    "dataset_stats_basic",
    """SELECT count(*) AS row_count, CAST(6 AS INTEGER) AS column_count,
    ['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'] AS columns FROM orders""",
)
def _(spark, sf):
    return tables.table_stats(table(spark, sf, "orders"))


@query(
    "preview",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 499) || '…' ELSE text END
    AS text, lang, source FROM documents ORDER BY documents.doc_id LIMIT 20""",
)
def _(spark, sf):
    return tables.preview(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), ["doc_id"])


@query(
    "scan_coverage",
    """SELECT count(*) AS total_rows, count(*) FILTER (o_orderstatus <> 'P') AS scanned_rows,
    round(count(*) FILTER (o_orderstatus <> 'P') / greatest(count(*), 1), 6) AS coverage_ratio,
    CASE WHEN count(*) FILTER (o_orderstatus <> 'P') < count(*) THEN 'bounded' ELSE 'full' END AS scan_mode FROM orders""",
)
def _(spark, sf):
    return tables.scan_coverage(table(spark, sf, "orders"), F.col("o_orderstatus") != "P")


def _row_sql(columns) -> str:
    cells = " || chr(31) || ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in sorted(columns))
    return f"CAST(CAST('0x' || substring(sha256({cells}), 1, 15) AS BIGINT) AS DECIMAL(20,0))"


@query(
    "table_digest",
    f"""WITH {TEXT_SQL} SELECT count(*) AS row_count, sha256(CAST(count(*) AS VARCHAR) || ':' ||
    CAST(sum({_row_sql((*COLUMNS, 'row_id'))}) AS VARCHAR)) AS digest FROM ev""",
)
def _(spark, sf):
    return tables.table_digest(events_text(spark, sf))


SUPPLY_SQL = f"""d AS (SELECT l_suppkey, count(*) AS n, sha256(CAST(count(*) AS VARCHAR) || ':' ||
  CAST(sum({_row_sql(('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber'))}) AS VARCHAR)) AS digest
  FROM lineitem GROUP BY l_suppkey)"""


@query(
    "lineage_mismatch",
    f"""WITH {SUPPLY_SQL}, st AS (SELECT s_suppkey AS dataset_id, CASE WHEN s_nationkey = 3 THEN 'stale' ELSE d.digest END
      AS digest FROM supplier LEFT JOIN d ON s_suppkey = l_suppkey)
    SELECT st.dataset_id, st.digest AS stored_digest, d.digest AS current_digest FROM st LEFT JOIN d
    ON st.dataset_id = d.l_suppkey WHERE st.digest IS DISTINCT FROM d.digest""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    current = tables.table_digest(lines, ["l_suppkey"]).withColumnRenamed("l_suppkey", "dataset_id")
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("dataset_id"), "s_nationkey")
    stored = suppliers.join(current, "dataset_id", "left").select(
        "dataset_id", F.when(F.col("s_nationkey") == 3, "stale").otherwise(F.col("digest")).alias("digest")
    )
    return tables.lineage_mismatch(stored, current)


@query(
    "duplicate_datasets",
    """WITH i AS (SELECT c_custkey AS incoming_id, sha256(c_mktsegment || CAST(c_custkey % 97 AS VARCHAR)) AS checksum
      FROM customer), r AS (SELECT sha256(CASE o_orderstatus WHEN 'F' THEN 'BUILDING' ELSE 'MACHINERY' END ||
      CAST(o_custkey % 61 AS VARCHAR)) AS checksum FROM orders)
    SELECT * FROM i WHERE checksum IN (SELECT checksum FROM r)""",
)
def _(spark, sf):
    incoming = table(spark, sf, "customer").selectExpr(
        "c_custkey AS incoming_id", "sha2(concat(c_mktsegment, CAST(c_custkey % 97 AS STRING)), 256) AS checksum"
    )
    registry = table(spark, sf, "orders").selectExpr(
        "sha2(concat(CASE o_orderstatus WHEN 'F' THEN 'BUILDING' ELSE 'MACHINERY' END, "
        "CAST(o_custkey % 61 AS STRING)), 256) AS checksum"
    )
    return tables.duplicate_datasets(incoming, registry)


@query(
    "prepared_roundtrip",
    f"""WITH {DAILY_SQL}, {axis_sql('daily')} SELECT channel, date, revenue, spend, units_sold,
    CASE WHEN date <= train_end THEN 'train' WHEN date <= validation_end THEN 'validation' ELSE 'test' END AS split
    FROM daily, bounds""",
)
def _(spark, sf):
    path = scratch_path(spark, "panel")
    sinks.write_panel(split_daily(spark, sf).drop("source_rows"), path)
    return sinks.read_panel(spark, path, DAILY)


@query(
    "prepared_read_coerce",
    f"""WITH {TEXT_SQL} SELECT row_id, CASE WHEN regexp_matches(trim(date), '^\\d{{4}}-') THEN
      CAST({date_prep_sql('date')} AS DATE) END AS date, {number_prep_sql('impressions')} AS impressions,
      CASE WHEN revenue = '' THEN NULL ELSE CAST(revenue AS DOUBLE) END AS revenue FROM ev""",
)
def _(spark, sf):
    raw = events_text(spark, sf).select("row_id", "date", "impressions", "revenue")
    return tables.coerce(raw, ["date"], ["impressions", "revenue"])


@query("predictions_sink", f"WITH {PRED_SQL} SELECT {SHOWN} FROM p WHERE split = 'backtest' AND fold = 3")
def _(spark, sf):
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(predictions(spark, sf), path)
    return shown(sinks.read_predictions(spark, path, split="backtest", fold=3))

