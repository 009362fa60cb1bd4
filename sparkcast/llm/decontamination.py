"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

Terms of the benchmark are counted in the corpus first. The posting lists (term, document, position) of the rarest
terms of every window are stored; other lists are never opened, so they are not written. Lists are then intersected
with positions adjusted by the term's place in its item: postings that belong to one occurrence meet on the same
(document, item, offset). Places where enough of the rarest terms meet are compared word by word.

Words are runs of letters, digits and characters beyond ASCII, after A-Z is lower-cased. A window is `size`
consecutive words of an item; a shorter item is one window, an item without words none. Null and empty texts have no
words. Repeated document rows are judged one by one if their ids differ; rows with one id share their hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcast.llm.common import ascii_lower, sized, texts
from sparkcast.session import materialize

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAREST = 2


def words_of(text: Column | str) -> Column:
    return F.array_remove(F.split(ascii_lower(text), _BREAK), "")


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Items with words: item_id, words, n, width (words in a window)."""
    rows = texts(items, id_col, text_col).select(F.col("doc_id").alias("item_id"), words_of("text").alias("words")).distinct()
    return rows.withColumn("n", F.size("words")).filter("n > 0")


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """One row per window: item_id, start, width, terms."""
    width = F.least("n", F.lit(size))
    rows = items.select("item_id", "words", width.alias("width"), F.explode(F.sequence(F.lit(0), F.col("n") - width)).alias("start"))
    return rows.select("item_id", "start", "width", F.slice("words", F.col("start") + 1, F.col("width")).alias("terms"))


def anchors_of(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The rarest terms of every window by corpus count: term, item_id, at (place in the item), need (how many of
    them an occurrence must show). Windows with a term that the corpus lacks cannot occur and have none."""
    vocabulary = sized(materialize(windows.select(F.explode("terms").alias("term")).distinct(), "terms"))
    seen = docs.select(F.explode("words").alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("freq"))
    seen = materialize(seen, "term-counts")
    places = windows.select("item_id", "start", "width", F.posexplode("terms").alias("offset", "term"))
    ranked = places.join(seen, "term", "left").withColumn(
        "rank", F.row_number().over(Window.partitionBy("item_id", "start").orderBy(F.col("freq").asc_nulls_first(), "term", "offset"))
    )
    ranked = ranked.withColumn("absent", F.max(F.col("freq").isNull()).over(Window.partitionBy("item_id", "start")))
    kept = ranked.filter(~F.col("absent") & (F.col("rank") <= _RAREST))
    return kept.groupBy("term", "item_id", (F.col("start") + F.col("offset")).alias("at")).agg(
        F.min(F.least("width", F.lit(_RAREST))).alias("need")
    )


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (term, doc_id, position) of the given terms: one scan, written by the tasks that read the
    documents, without a shuffle."""
    postings = docs.select("doc_id", F.posexplode("words").alias("position", "term"))
    return materialize(postings.join(sized(terms.select("term").distinct()), "term"), "postings")


def intersect(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Places where an item's rarest terms meet: doc_id, item_id, shift (document position of the item's word 0).
    Lists of several terms meet on the adjusted position alone, whatever the order in which they are read."""
    met = postings.join(sized(anchors), "term").select(
        "doc_id", "item_id", (F.col("position") - F.col("at")).alias("shift"), "at", "need"
    )
    met = met.groupBy("doc_id", "item_id", "shift").agg(F.count_distinct("at").alias("met"), F.min("need").alias("need"))
    return met.filter("met >= need").select("doc_id", "item_id", "shift")


def phrase_hits(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Exact occurrences, joined where they overlap on one shift: doc_id, item_id, start, stop (word positions)."""
    words = texts(docs).select("doc_id", words_of("text").alias("words"))
    entries = materialize(item_words(items), "items")
    anchors = materialize(anchors_of(words, windows_of(entries, size)), "anchors")
    found = materialize(intersect(build_index(words, anchors), anchors), "meetings")
    in_doc = words.join(sized(found), "doc_id")
    pair = in_doc.join(sized(entries.withColumnRenamed("words", "item")), "item_id")
    # places of the item whose word is the document's there
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.col("n"), F.size("words") - F.col("shift")) - 1
    pair = pair.filter(first <= last).select(
        "doc_id", "item_id", "shift", "n", F.least("n", F.lit(size)).alias("width"), first.alias("first"),
        F.zip_with(
            F.slice("words", F.col("shift") + first + 1, last - first + 1), F.slice("item", first + 1, last - first + 1), lambda a, b: a == b
        ).alias("same"),
    )
    # lengths of the runs of equal words, cut at the places that differ
    broken = F.filter(F.transform("same", lambda x, i: F.when(~x, i)), lambda i: i.isNotNull())
    ends = F.concat(F.array(F.lit(-1)), broken, F.array(F.size("same")))
    runs = F.filter(
        F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda i: F.struct((F.get("ends", i - 1) + 1).alias("a"), F.get("ends", i).alias("b"))),
        lambda r: r["b"] - r["a"] >= F.col("width"),
    )
    hits = pair.withColumn("ends", ends).select("doc_id", "item_id", (F.col("shift") + F.col("first")).alias("base"), F.explode(runs).alias("run"))
    return hits.select("doc_id", "item_id", (F.col("base") + F.col("run.a")).alias("start"), (F.col("base") + F.col("run.b")).alias("stop"))


def near_hits(docs: DataFrame, items: DataFrame, size: int = 10, reach: int = 15) -> DataFrame:
    """Proximity matches: doc_id, item_id for documents where all distinct words of some window lie, in any order,
    within `reach` consecutive words. Every place of the window's rarest term is looked at."""
    words = texts(docs).select("doc_id", words_of("text").alias("words"))
    windows = materialize(windows_of(item_words(items), size), "windows")
    vocabulary = sized(materialize(windows.select(F.explode("terms").alias("term")).distinct(), "terms"))
    freq = words.select(F.explode("words").alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("freq"))
    ranked = windows.select("item_id", "start", F.array_distinct("terms").alias("terms"), F.explode("terms").alias("term")).join(freq, "term", "left")
    best = ranked.groupBy("item_id", "start", "terms").agg(
        F.min(F.struct("freq", "term")).alias("rare"), F.max(F.col("freq").isNull()).alias("absent")
    ).filter("not absent").select("item_id", F.col("rare.term").alias("term"), "terms").distinct()
    best = materialize(best, "rarest")
    places = build_index(words, best).join(sized(best), "term")
    local = words.join(sized(places), "doc_id").withColumn("low", F.greatest(F.lit(0), F.col("position") - reach + 1))
    part = local.select("doc_id", "item_id", "terms", F.slice("words", F.col("low") + 1, 2 * reach - 1).alias("part"), (F.col("position") - F.col("low")).alias("at"))
    close = F.exists(
        F.sequence(F.lit(0), F.col("at")),
        lambda i: (F.size(F.array_intersect(F.slice("part", i + 1, reach), "terms")) == F.size("terms")) & (F.col("at") < i + reach),
    )
    return part.filter(close).select("doc_id", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurrence), item_ids (sorted as strings).

    Rows are told apart by id and 96 bits of hashes of the text, so rows with a null id and rows that share an id each get what their
    own text holds. Postings carry this key, so it is short."""
    hashes = F.xxhash64("text").alias("hash"), F.crc32(F.col("text").cast("binary")).alias("check")
    keyed = texts(docs).withColumn("key", F.struct("doc_id", *hashes))
    hits = materialize(phrase_hits(keyed.select(F.col("key").alias("doc_id"), "text"), items, size).distinct(), "hits")
    along = Window.partitionBy("doc_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("doc_id", "start", "stop").distinct().withColumn("before", F.max("stop").over(along))
    covered = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("before", F.lit(0))))
    per_doc = spans.groupBy("doc_id").agg(F.sum(covered).cast("long").alias("n_hit"))
    ids = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    counts = keyed.select("doc_id", "key", F.size(words_of("text")).cast("long").alias("n_words"))
    found = materialize(per_doc.join(ids, "doc_id").withColumnRenamed("doc_id", "key"), "contaminated")
    return counts.join(sized(found), "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )
