"""Secret scan: known forms, and a battery of randomness tests for strings without one. DataFrame functions only.

Known forms are found leftmost and without overlap for each kind: assign, access, hex. Every other run of at least 20
characters of an encoding is tested: as a whole, without its separators (so that a UUID is one number), and in each part of
20 characters or more between separators (so that a key in a path is found). The narrowest encoding that holds the string is
inferred (digits, hex, letters and base36 in either case, base32, base62, base64). Three tests take "uniformly random over this
encoding" as their hypothesis: chi-squared on the counts of the alphabet, runs above and below its middle, and lag-one serial
correlation; Fisher's method combines them, and a weighted step-up procedure rejects strings with a pattern.

What is left may still be written language by chance, so a second hypothesis is tested: the string was drawn letter pair by
letter pair like the table's own short words. The likelihood ratio of this model to the uniform one is a valid p-value (Markov's
inequality), and it falls with every further character. Strings that a weighted step-up procedure rejects are reported as
`random`, so the expected share of written language among the reported ones is at most `ALPHA`. Of a run and its parts those with more evidence stand.

Null texts are empty and have no spans. Positions are code points, ends exclusive. Rows that repeat an id are scanned each for
itself. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcast.llm.common import texts
from sparkcast.session import materialize

# The known forms (kind, pattern, group that must be long enough, its least length).
KINDS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
_KEYWORDS = r"(?i:password|passwd|secret|token|api_?key)"
_CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
_SEPARATORS = "[+/_=-]"
_PART = r"[A-Za-z0-9]{20,}"
_ALPHABETS = [
    ("digits", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("upper hex", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "+/-_0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
]
ALPHA = 0.05
#: Level of the step-up procedure that rejects patterned strings: about the share of random strings that it loses.
PATTERN = 0.01
#: Share of the uniform law in the letter-pair model, so that one odd pair is little evidence.
ODD = 0.1
_SYMBOLS = 67
_TESTED = "array<struct<start:int,stop:int,whole:boolean,value:string>>"


def _spans(text: Column, pattern: str, group: int, least: int, order: int, label: str) -> Column:
    """Spans of the matches whose group is long enough: the pieces between matches give the positions."""
    lit = F.lit(pattern)
    gaps, found, part = F.split(text, pattern, -1), F.regexp_extract_all(text, lit, F.lit(0)), F.regexp_extract_all(text, lit, F.lit(group))
    steps = F.zip_with(found, part, lambda m, g: F.struct(F.length(m).alias("size"), F.length(g).alias("part")))
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), steps, lambda g, s: F.struct(F.length(g).alias("gap"), s["size"].alias("size"), s["part"].alias("part")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,stop:int,label:string>>").alias("spans"))
    walked = F.aggregate(
        steps,
        empty,
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["size"]).alias("at"),
            F.when(
                s["part"] >= least,
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + s["gap"]).alias("start"), F.lit(order).alias("kind"), (acc["at"] + s["gap"] + s["size"]).alias("stop"), F.lit(label).alias("label"))),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return walked["spans"]


_SPANS = "array<struct<start:int,kind:int,stop:int,label:string>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _tail(z: Column) -> Column:
    """Upper tail of the normal law for z >= 0 (rational approximation, error under 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.lit(1e-12), F.exp(-z * z / 2) / 2.5066282746310002 * poly)


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _tail(F.abs(z)))


def battery(strings: DataFrame) -> DataFrame:
    """Add encoding, p_uniform, p_runs, p_serial and p (combined) to rows with a column `value`."""
    bare = F.rtrim(F.col("value"), F.lit("="))
    kind = F.coalesce(*[F.when(bare.rlike(f"^[{a.replace('-', chr(92) + '-')}]+$"), F.lit(i)) for i, (_, a) in enumerate(_ALPHABETS)], F.lit(len(_ALPHABETS) - 1))
    alphabet = F.element_at(F.array(*[F.lit(a) for _, a in _ALPHABETS]), F.col("kind") + 1)
    rows = strings.withColumn("kind", kind).withColumn("alphabet", alphabet).withColumn("k", F.length("alphabet"))
    rows = rows.withColumn("codes", F.filter(F.transform(F.split(bare, ""), lambda c: F.instr(F.col("alphabet"), c) - 1), lambda x: x >= 0))
    rows = rows.withColumn("n", F.size("codes").cast("double"))
    squares = F.aggregate(F.transform(F.array_distinct("codes"), lambda a: F.pow(F.size(F.filter("codes", lambda x: x == a)).cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    chi = squares * F.col("k") / F.col("n") - F.col("n")
    z_chi = (chi - (F.col("k") - 1)) / F.sqrt(2.0 * (F.col("k") - 1) * (F.col("n") - 1) / F.col("n"))
    rows = rows.withColumn("p_uniform", F.when(z_chi >= 0, _tail(F.abs(z_chi))).otherwise(1 - _tail(F.abs(z_chi))))
    high = F.transform("codes", lambda x: (x >= F.col("k") / 2).cast("int"))
    rows = rows.withColumn("high", high).withColumn("n1", F.aggregate("high", F.lit(0), lambda s, x: s + x).cast("double")).withColumn("n0", F.col("n") - F.col("n1"))
    shifted = F.slice("high", 2, F.greatest(F.size("high") - 1, F.lit(0)))
    changes = F.aggregate(F.zip_with(F.slice("high", 1, F.greatest(F.size("high") - 1, F.lit(0))), shifted, lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)
    mean = 2 * F.col("n1") * F.col("n0") / F.col("n") + 1
    var = (mean - 1) * (mean - 2) / (F.col("n") - 1)
    rows = rows.withColumn("p_runs", F.when(var > 0, _two_sided(F.try_divide(changes + 1 - mean, F.sqrt(var)))).otherwise(F.lit(1e-12)))
    rows = rows.withColumn("mu", F.aggregate("codes", F.lit(0.0), lambda s, x: s + x) / F.col("n"))
    spread = F.aggregate("codes", F.lit(0.0), lambda s, x: s + (x - F.col("mu")) * (x - F.col("mu")))
    ahead = F.slice("codes", 2, F.greatest(F.size("codes") - 1, F.lit(0)))
    cross = F.aggregate(F.zip_with(F.slice("codes", 1, F.greatest(F.size("codes") - 1, F.lit(0))), ahead, lambda a, b: (a - F.col("mu")) * (b - F.col("mu"))), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("p_serial", F.when(spread > 0, _two_sided((F.try_divide(cross, spread) + 1 / F.col("n")) * F.sqrt("n"))).otherwise(F.lit(1e-12)))
    half = -(F.log("p_uniform") + F.log("p_runs") + F.log("p_serial"))
    rows = rows.withColumn("half", half).withColumn("p", F.exp(-F.col("half")) * (1 + F.col("half") + F.col("half") * F.col("half") / 2))
    encoding = F.element_at(F.array(*[F.lit(n) for n, _ in _ALPHABETS]), F.col("kind") + 1)
    return rows.withColumn("encoding", encoding).drop("kind", "alphabet", "k", "codes", "high", "n1", "n0", "mu", "half")


def _step_up(tested: DataFrame, log_p: Column, alpha: float) -> int | None:
    """Cut of the weighted step-up procedure, in hundredths of log10(p), or None where it rejects nothing. Weights are the
    lengths over their mean; p-values are binned, rounded up, so the ranks come from a table of fixed size."""
    counts = tested.groupBy(_bin(tested, log_p).alias("bin")).count()
    total = F.sum("count").over(Window.partitionBy())
    up_to = F.sum("count").over(Window.orderBy("bin"))
    passed = counts.select("bin", total.alias("m"), up_to.alias("rank")).filter(F.pow(F.lit(10.0), F.col("bin") / 100) * F.col("m") <= alpha * F.col("rank"))
    return passed.agg(F.max("bin")).first()[0]


def _bin(tested: DataFrame, log_p: Column) -> Column:
    mean = tested.agg(F.avg("n")).first()[0] or 1.0
    return F.ceil(F.greatest(F.lit(-300.0), log_p + F.log10(F.lit(mean) / F.col("n"))) * 100).cast("int")


def random_strings(tested: DataFrame, alpha: float = PATTERN) -> DataFrame:
    """The rows of a battery that the step-up procedure does not reject as patterned."""
    log_p = F.log10(F.greatest(F.lit(1e-30), F.col("p")))
    cut = _step_up(tested, log_p, alpha)
    return tested if cut is None else tested.filter(_bin(tested, log_p) > cut)


def unlike_words(tested: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Of all tested strings, those without a pattern whose likelihood as written language (`log_word`) is rejected."""
    log_p = F.when(F.col("patternless"), F.least(F.lit(0.0), F.col("log_word"))).otherwise(F.lit(0.0))
    cut = _step_up(tested, log_p, alpha)
    return tested.filter("patternless and log_word < 0").filter(F.lit(False) if cut is None else _bin(tested, log_p) <= cut)


def _pairs(value: Column) -> Column:
    """Neighbouring letters of a string; the first letter follows the empty string."""
    return F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.struct(F.when(i > 1, F.substring(value, i - 1, 1)).otherwise("").alias("one"), F.substring(value, i, 1).alias("two")))


def letter_pairs(docs: DataFrame) -> DataFrame:
    """Letter pairs of all words of the table that are too short to be tested: one, two, log_chance (base 10). Equal words are
    counted before they are taken apart. At most 67 x 68 rows."""
    words = docs.select(F.explode(F.split("text", "[^A-Za-z0-9+/_=-]+")).alias("word")).filter(F.length("word").between(1, 19))
    counts = words.groupBy("word").agg(F.count("*").alias("times"))
    pairs = counts.select("times", F.inline(_pairs(F.col("word")))).groupBy("one", "two").agg(F.sum("times").alias("times"))
    share = F.col("times") / F.sum("times").over(Window.partitionBy("one"))
    return pairs.select("one", "two", F.log10((1 - ODD) * share + ODD / _SYMBOLS).alias("log_chance"))


def word_likelihood(strings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add log_word: log10 of the likelihood of `value` under the letter pairs over that under its encoding; `test` is a key."""
    letters = strings.select("test", F.inline(_pairs(F.rtrim("value", F.lit("=")))))
    unseen = F.log10(F.lit(ODD / _SYMBOLS))
    sums = letters.join(F.broadcast(pairs), ["one", "two"], "left").groupBy("test").agg(F.sum(F.coalesce("log_chance", unseen)).alias("log_chance"))
    size = F.element_at(F.create_map(*[F.lit(x) for name, a in _ALPHABETS for x in (name, float(len(a)))]), F.col("encoding"))
    return strings.join(sums, "test").withColumn("log_word", F.col("log_chance") + F.length(F.rtrim("value", F.lit("="))) * F.log10(size)).drop("log_chance")


def _tested(run: Column) -> Column:
    """The strings of one run: parts of 20 characters or more, and where it has separators the whole with and without them."""
    value = run["value"]
    parts = F.transform(
        _spans(value, _PART, 0, 20, len(KINDS), "random"),
        lambda s: F.struct((run["start"] + s["start"]).alias("start"), (run["start"] + s["stop"]).alias("stop"), F.lit(False).alias("whole"), F.substring(value, s["start"] + 1, s["stop"] - s["start"]).alias("value")),
    )
    bare = F.regexp_replace(value, _SEPARATORS, "")
    whole = F.transform(F.array(value, bare), lambda v: F.struct(run["start"].alias("start"), run["stop"].alias("stop"), F.lit(True).alias("whole"), v.alias("value")))
    whole = F.filter(whole, lambda w: F.length(F.rtrim(w["value"], F.lit("="))) >= 20)
    return F.concat(parts.cast(_TESTED), F.when(value.rlike(_SEPARATORS), whole.cast(_TESTED)).otherwise(F.array().cast(_TESTED)))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base (array of spans of the known kinds), spans (with the random strings); a span is
    (start, kind, stop, label), ordered by start and kind."""
    rows = texts(docs, id_col, text_col)
    hints = {"assign": F.col("text").rlike(_KEYWORDS), "access": F.contains("text", F.lit("AKIA")), "hex": F.col("text").rlike("[0-9a-f]{32}")}
    base = [F.when(hints[name], _spans(F.col("text"), p, g, least, i, name)).otherwise(_none()) for i, (name, p, g, least) in enumerate(KINDS)]
    other = F.when(F.col("text").rlike(_CANDIDATE), _spans(F.col("text"), _CANDIDATE, 0, 20, len(KINDS), "random")).otherwise(_none())
    found = rows.select("doc_id", "text", F.array_sort(F.concat(*base)).alias("base"), other.alias("other"))
    runs = F.transform("other", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.substring(F.col("text"), s["start"] + 1, s["stop"] - s["start"]).alias("value")))
    runs = F.transform(runs, lambda r: F.struct(r["start"].alias("run"), F.filter(_tested(r), lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))).alias("strings")))
    scanned = materialize(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", F.filter(runs, lambda r: F.size(r["strings"]) > 0).alias("runs")), "secret-scan")
    strings = scanned.select("row", F.inline("runs")).select("row", "run", F.inline("strings"))
    strings = battery(strings.withColumn("test", F.struct("row", "start", "stop", F.length("value").alias("size"))).distinct())
    judged = materialize(word_likelihood(strings, materialize(letter_pairs(rows), "letter-pairs")).select("test", "row", "run", "start", "stop", "whole", "n", "p", "log_word"), "secret-tests")
    calm = random_strings(judged).select("test", F.lit(True).alias("patternless"))
    judged = materialize(judged.join(calm, "test", "left").withColumn("patternless", F.coalesce("patternless", F.lit(False))), "secret-judged")
    span = F.struct("start", F.lit(len(KINDS)).alias("kind"), "stop", F.lit("random").alias("label"))
    per_run = unlike_words(judged).groupBy("row", "run").agg(
        F.min(F.when(F.col("whole"), F.col("log_word"))).alias("whole_p"), F.min(F.when(~F.col("whole"), F.col("log_word"))).alias("part_p"),
        F.collect_set(F.when(F.col("whole"), span)).alias("whole"), F.collect_set(F.when(~F.col("whole"), span)).alias("parts"),
    )
    chosen = F.when(F.col("part_p").isNull() | (F.col("whole_p") <= F.col("part_p") + 1e-9), F.col("whole")).otherwise(F.col("parts"))
    added = per_run.select("row", F.explode(chosen).alias("span")).groupBy("row").agg(F.collect_list("span").alias("added"))
    joined = scanned.join(added, "row", "left")
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce(F.col("added").cast(_SPANS), _none()))).alias("spans"))


def joined_spans(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
