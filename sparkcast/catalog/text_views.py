"""A raw text table derived from `events`, as it would arrive in a file.

The same SQL text runs on both engines. Every row of `events` is kept; dates, amounts and labels are
written in mixed layouts, with null tokens, stray text, repeats and out-of-range values among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS_TEXT = """
SELECT * FROM (
 SELECT event_id AS row_id,
  CASE WHEN event_id % 97 = 5 THEN 'bad-date' WHEN event_id % 89 = 6 THEN ''
       WHEN event_id % 83 = 7 THEN concat(substring(d, 9, 2), '/', substring(d, 6, 2), '/', substring(d, 1, 4))
       WHEN event_id % 79 = 8 THEN concat(d, 'T', t, 'Z') WHEN event_id % 73 = 9 THEN concat(d, ' ', t)
       WHEN event_id % 71 = 3 THEN concat(d, 'T', t, '+02:00')
       WHEN event_id % 59 = 4 THEN concat(substring(d, 1, 4), substring(d, 6, 2), substring(d, 9, 2))
       WHEN event_id % 53 = 2 THEN concat(' ', d, ' ') ELSE d END AS date,
  CASE WHEN event_id % 61 = 4 THEN 'n/a' WHEN event_id % 67 = 2 THEN '' ELSE event_type END AS channel,
  CASE WHEN event_id % 43 = 1 THEN 'Missing' ELSE concat('c', CAST(user_id % 9 AS STRING)) END AS campaign,
  CASE WHEN event_id % 47 = 3 THEN concat('1,', CAST(100 + imp AS STRING)) ELSE CAST(imp AS STRING) END AS impressions,
  CAST(clk AS STRING) AS clicks,
  CASE WHEN event_id % 41 = 7 THEN '' ELSE CAST(conv AS STRING) END AS conversions,
  CASE WHEN event_id % 101 = 1 THEN 'oops' WHEN event_id % 103 = 2 THEN concat('$', CAST(value AS STRING))
       WHEN event_id % 107 = 3 THEN concat('-', CAST(value AS STRING)) WHEN event_id % 109 = 4 THEN '1_000'
       WHEN event_id % 113 = 6 THEN '1d' WHEN event_id % 127 = 8 THEN 'NaN' WHEN event_id % 131 = 9 THEN '1e2'
       ELSE CAST(value AS STRING) END AS spend,
  CASE WHEN event_id % 37 = 5 THEN '' ELSE CAST(CAST(value * 3 AS DECIMAL(14,2)) AS STRING) END AS revenue,
  CASE WHEN event_id % 29 = 3 THEN concat(CAST(clk % 40 AS STRING), '%')
       WHEN event_id % 31 = 2 THEN '120' WHEN imp = 0 THEN ''
       ELSE CAST(round(clk * 1.0e0 / imp + 3.14159e-6, 4) AS STRING) END AS ctr,
  CASE WHEN event_id % 23 = 3 THEN '9.5' ELSE '3.0' END AS roas,
  'NL' AS country,
  CASE WHEN event_id % 149 = 1 THEN 'tablet' ELSE 'phone' END AS device,
  concat('o-', CAST(event_id AS STRING)) AS order_id,
  CASE WHEN event_id % 37 = 5 THEN '' ELSE CAST(CAST(value * 3 AS DECIMAL(14,2)) AS STRING) END AS actual_revenue,
  '' AS spare
 FROM (SELECT event_id, event_type, user_id, value, substring(CAST(ts AS STRING), 1, 10) AS d,
       substring(CAST(ts AS STRING), 12, 8) AS t, (user_id * 7 + event_id) % 900 + 20 AS imp,
       (event_id * 13) % 60 AS clk, (event_id * 5) % 40 AS conv FROM {events}) e
) base
"""

COLUMNS = (
    "date", "channel", "campaign", "impressions", "clicks", "conversions", "spend", "revenue", "ctr", "roas",
    "country", "device", "order_id", "actual_revenue", "spare",
)
MAPPING = {
    "date": "date", "channel": "channel", "campaign": "campaign", "impressions": "impressions", "clicks": "clicks",
    "conversions": "conversions", "spend": "spend", "revenue": "revenue", "ctr": "ctr", "roas": "roas",
    "country": "country", "device": "device", "order_id": "identifier", "actual_revenue": "unknown",
    "spare": "descriptive_text",
}
TEXT_SQL = f"ev AS ({EVENTS_TEXT.format(events='events')})"

# Repeats: every row that does not carry an order of its own appears once more, later in the file.
REPEATED = """
SELECT row_id, date, channel, campaign, revenue FROM {ev}
UNION ALL
SELECT row_id + 100000000, date, channel, campaign, revenue FROM {ev} WHERE row_id % 7 = 3
"""
REPEATED_SQL = TEXT_SQL + f", rep AS ({REPEATED.format(ev='ev')})"


def events_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENTS_TEXT, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REPEATED, ev=events_text(spark, sf_dir))


# --- the parsers as SQL -----------------------------------------------------------------------

DECIMAL = r"[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?"


def decimal_sql(text: str) -> str:
    return f"CASE WHEN regexp_full_match({text}, '{DECIMAL}') THEN TRY_CAST(replace({text}, '_', '') AS DOUBLE) END"


def number_profile_sql(c: str) -> str:
    text = f"trim(replace({c}, ',', ''))"
    return f"""CASE WHEN lower({text}) IN ('nan', '+nan', '-nan') THEN CAST('nan' AS DOUBLE) ELSE {decimal_sql(text)} END"""


def number_quality_sql(c: str) -> str:
    text = f"replace(trim({c}), ',', '')"
    bare = f"trim(rtrim({text}, '%'))"
    return f"""CASE WHEN lower({text}) IN ('', 'null', 'none', 'na', 'n/a', 'nan', 'missing')
      OR regexp_matches({text}, '^[$₹€£]') THEN NULL ELSE {decimal_sql(bare)} END"""


def number_prep_sql(c: str) -> str:
    return decimal_sql(f"trim({c})")


def date_profile_sql(c: str) -> str:
    t = f"trim({c})"
    return f"""coalesce(try_strptime({t}, '%Y-%m-%dT%H:%M:%S'), try_strptime({t}, '%Y-%m-%d %H:%M:%S'),
      try_strptime(CASE WHEN regexp_matches({t}, 'T.*(Z|[+-]\\d{{2}}:?\\d{{2}})$')
        THEN regexp_replace({t}, '(Z|[+-]\\d{{2}}:?\\d{{2}})$', '') END, '%Y-%m-%dT%H:%M:%S'),
      try_strptime({t}, '%Y-%m-%d'), try_strptime({t}, '%Y/%m/%d'), try_strptime({t}, '%d-%m-%Y'),
      try_strptime({t}, '%d/%m/%Y'), try_strptime({t}, '%m/%d/%Y'), try_strptime({t}, '%d-%b-%Y'))"""


def has_time_sql(c: str) -> str:
    t = f"trim({c})"
    return f"""(try_strptime({t}, '%Y-%m-%dT%H:%M:%S') IS NOT NULL OR try_strptime({t}, '%Y-%m-%d %H:%M:%S') IS NOT NULL
      OR try_strptime(CASE WHEN regexp_matches({t}, 'T.*(Z|[+-]\\d{{2}}:?\\d{{2}})$')
        THEN regexp_replace({t}, '(Z|[+-]\\d{{2}}:?\\d{{2}})$', '') END, '%Y-%m-%dT%H:%M:%S') IS NOT NULL)"""


def date_quality_sql(c: str) -> str:
    t = f"trim({c})"
    bare = f"regexp_replace({t}, '(Z|[+-]\\d{{2}}:\\d{{2}})$', '')"
    return f"""coalesce(try_strptime({t}, '%Y-%m-%d'), try_strptime({t}, '%Y-%m-%d %H:%M:%S'),
      try_strptime({t}, '%Y-%m-%dT%H:%M:%S'), try_strptime({t}, '%d/%m/%Y'), try_strptime({t}, '%m/%d/%Y'),
      try_strptime({t}, '%d-%m-%Y'), try_strptime({bare}, '%Y-%m-%dT%H:%M:%S'),
      CASE WHEN regexp_full_match({t}, '\\d{{8}}') THEN try_strptime({t}, '%Y%m%d') END)"""


def date_prep_sql(c: str) -> str:
    t = f"trim({c})"
    bare = f"regexp_replace({t}, '(Z|[+-]\\d{{2}}:\\d{{2}})$', '')"
    shift = f"""CASE WHEN regexp_matches({t}, '[+-]\\d{{2}}:\\d{{2}}$') AND regexp_matches({t}, 'T')
      THEN INTERVAL 1 MINUTE * CAST((CASE WHEN {t}[-6] = '-' THEN -1 ELSE 1 END)
        * (CAST({t}[-5:-4] AS INTEGER) * 60 + CAST({t}[-2:] AS INTEGER)) AS INTEGER) ELSE INTERVAL 0 MINUTE END"""
    return f"""coalesce(try_strptime({t}, '%Y-%m-%d'), try_strptime({t}, '%Y-%m-%d %H:%M:%S'),
      try_strptime({bare}, '%Y-%m-%dT%H:%M:%S') - {shift},
      CASE WHEN regexp_full_match({t}, '\\d{{8}}') THEN try_strptime({t}, '%Y%m%d') END,
      try_strptime({t}, '%d/%m/%Y'), try_strptime({t}, '%m/%d/%Y'))"""
