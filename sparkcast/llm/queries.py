"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcast.llm.common import table
from sparkcast.llm.decontamination import contamination
from sparkcast.llm.exact_dedup import content_sort_groups
from sparkcast.llm.fill_in_middle import fill_in_middle, restored
from sparkcast.llm.filter_audit import filter_audit
from sparkcast.llm.minhash import near_duplicate_components
from sparkcast.llm.passages import mark_passages
from sparkcast.llm.piece_codec import encode_documents
from sparkcast.llm.secrets import find_secrets, joined_spans
from sparkcast.llm.sharding import uniform_shards
from sparkcast.llm.substring_dedup import remove_repeats
from sparkcast.llm.token_counts import count_tokens
from sparkcast.llm.toxicity import fit, score
from sparkcast.llm.url_filter import filter_urls

Query = Callable[[SparkSession, str], DataFrame]
# The rules that the URL query is asked for.
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), rate=0.1, seed=7)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["label"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined_spans("base"), 256).alias("base_sha256"), joined_spans("spans").alias("spans"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_passages(table(spark, sf_dir, "documents"), least=50, percent=80)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort_groups(table(spark, sf_dir, "documents"), keep="max")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), span=100).drop("kept")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_components(table(spark, sf_dir, "documents"), percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law")
    )
    return uniform_shards(rows, shards=24, seed=11).withColumn("grown_shard", F.lit(None).cast("int"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), seed=42)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored("output", "form"), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_pieces, op3_toxicity, op4_secrets, op5_token_counts, op6_passages, op7_exact_dedup, op8_suffix_dedup,
        op9_minhash, op10_url_filter, op11_filter_audit, op12_sharding, op13_fill_in_middle,
    )
}
SQL: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
SQL["op1_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
w AS (SELECT item_id, least(len(words), 10) AS width, unnest(range(len(words) - least(len(words), 10) + 1)) AS s, words FROM b WHERE len(words) > 0),
v AS (SELECT DISTINCT item_id, width, words[s + 1 : s + width] AS terms FROM w),
widths AS (SELECT DISTINCT width FROM v),
p AS (SELECT doc_id, width, unnest(range(len(words) - width + 1)) AS s, words FROM d, widths WHERE len(words) >= width),
q AS (SELECT doc_id, width, s, words[s + 1 : s + width] AS terms FROM p),
h AS (SELECT doc_id, item_id, s, q.width FROM q JOIN v USING (terms)),
c AS (SELECT doc_id, count(DISTINCT s + i) AS n_hit FROM (SELECT doc_id, s, unnest(range(width)) AS i FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""

SQL["op7_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

SQL["op9_minhash"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i + 1 : i + 5], ' ') AS sh FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - 4, 1))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT x AS node, x AS seen FROM l UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.seen),
c AS (SELECT node AS doc_id, min(seen) AS root FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

SQL["op10_url_filter"] = r"""
WITH r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) t(verdict, h, p)),
u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k
  FROM v JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM v LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (page_id)
"""

SQL["op11_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  concat(CASE WHEN len(words) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN g USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS here, substr(filter_order, 1, step::INT - 1) AS past FROM o, range(1, 6) r(step)),
m AS (SELECT part, filter_order, step, here, n, n_good, n_toxic, fails,
  contains(fails, here) AS hit, regexp_matches(fails, '[' || past || '-]') AS gone FROM c, s),
t AS (SELECT part, filter_order, step, here,
  coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = here), 0)::BIGINT AS unique_fails,
  coalesce(sum(n_good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM m GROUP BY 1, 2, 3, 4)
SELECT * EXCLUDE (here), (sum(removed) OVER (PARTITION BY part, here))::BIGINT AS shapley FROM t
"""

SQL["op13_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS toks FROM d),
u AS (SELECT *, len(toks) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS k FROM t),
c AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= 50 THEN 'plain'
    WHEN k[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(toks[1 : a], '') AS pre, array_to_string(toks[a + 1 : b], '') AS mid, array_to_string(toks[b + 1 : n], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
