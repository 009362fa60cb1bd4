"""Delimited text: detection, strict and lenient reading, rejects and line numbers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Delimiters tried in order.
DELIMITERS = (",", ";", "\t", "|")
REJECT = "_corrupt_record"

# Bytes cp1252 leaves undefined, and what it has in place of the other control codes.
CP1252_UNDEFINED = "\x81\x8d\x8f\x90\x9d"
CP1252_UNDEFINED_HEX = "81|8D|8F|90|9D"
CP1252_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if chr(b) not in CP1252_UNDEFINED)
CP1252_TEXT = "".join(bytes([ord(c)]).decode("cp1252") for c in CP1252_BYTES)


class CsvError(ValueError):
    """A file cannot be read as a table."""


def delimiter_stats(lines: DataFrame, column: str = "value") -> DataFrame:
    """How often each delimiter stands on a line, outside quotes."""
    bare = F.regexp_replace(F.col(column), '"[^"]*"', "")
    counts = [(d, F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))) for d in DELIMITERS]
    measured = lines.select(*[c.alias(f"d{i}") for i, (_, c) in enumerate(counts)]).agg(
        *[
            F.struct(
                F.lit(i).alias("preference"),
                F.lit(d).alias("delimiter"),
                F.min(f"d{i}").alias("fewest"),
                F.max(f"d{i}").alias("most"),
                F.avg(f"d{i}").alias("average"),
                F.count(F.lit(1)).alias("lines"),
            ).alias(f"s{i}")
            for i, (d, _) in enumerate(counts)
        ]
    )
    rows = F.array(*[F.col(f"s{i}") for i in range(len(DELIMITERS))])
    return measured.select(F.explode(rows).alias("s")).select("s.*")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter with a constant positive count per line, else the most frequent one; comma when none.
    All lines count, in one distributed pass."""
    rows = delimiter_stats(spark.read.text(path).filter("value <> ''")).collect()  # four rows
    steady = [r for r in rows if r["fewest"] and r["fewest"] == r["most"]]
    candidates = steady or [r for r in rows if r["average"]]
    if not candidates:
        return ","
    return max(candidates, key=lambda r: (r["average"], -r["preference"]))["delimiter"]


def detect_encoding(spark: SparkSession, path: str) -> str:
    """utf-8, cp1252 or latin-1: the first that decodes every byte. One distributed pass.

    A byte order mark needs no encoding of its own: the readers drop it.
    """
    # The text reader hands on the bytes of a line as they are.
    octets = F.hex(F.col("value").cast("binary"))
    found = spark.read.text(path).agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(octets.rlike(f"^(..)*({CP1252_UNDEFINED_HEX})")).alias("undefined"),
    ).first()
    if found["utf8"] is None or found["utf8"]:
        return "utf-8"
    return "latin-1" if found["undefined"] else "cp1252"


def _java_name(encoding: str) -> str:
    return {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1252": "ISO-8859-1", "latin-1": "ISO-8859-1"}.get(
        encoding.lower(), encoding
    )


def check_header(names: Sequence[str], max_columns: int | None = None) -> list[str]:
    """Clean column names: no mark or blanks around them, none empty, none repeated, not too many."""
    clean = [n.replace("﻿", "").replace("ï»¿", "").strip() for n in names]
    if not clean or not any(clean):
        raise CsvError("The header row is missing")
    if any(not n for n in clean):
        raise CsvError("Column names must not be blank")
    if len(set(clean)) != len(clean):
        raise CsvError("Column names must be unique")
    if max_columns is not None and len(clean) > max_columns:
        raise CsvError(f"The file has more than {max_columns} columns")
    return clean


def _header(spark: SparkSession, path: str | list[str], delimiter: str, encoding: str) -> list[str]:
    first = (
        spark.read.option("sep", delimiter).option("quote", '"').option("escape", '"')
        .option("encoding", _java_name(encoding)).option("header", "false").csv(path).first()
    )
    if first is None:
        raise CsvError("The file is empty")
    return ["" if v is None else v for v in first]


def _by_header(spark: SparkSession, path: str) -> list[str | list[str]]:
    """`path` itself when its files share their first line, else the files of each first line."""
    lines = spark.read.text(path)
    if len(lines.inputFiles()) < 2:
        return [path]
    placed = lines.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    firsts = placed.groupBy("file").agg(F.min_by("value", F.struct("block", "at")).alias("line"))
    alike = firsts.groupBy("line").agg(F.collect_list("file").alias("files"))
    if alike.limit(2).count() < 2:
        return [path]
    return [r["files"] for r in alike.orderBy(F.array_min("files")).collect()]  # file names only


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    encoding: str | None = None,
    multi_line: bool = True,
    max_columns: int | None = None,
) -> DataFrame:
    """Text columns plus `_corrupt_record` (rows with too few or too many cells) and the row's place.

    Columns of several files are matched by name. Files that name other columns are an error.

    Files are split whatever their cells hold. With `multi_line` a pass over the lines finds out whether any opens a quote that it
    does not close; if one does, records are put together from lines (`quoted_records`), else lines are records.
    """
    encoding = encoding or detect_encoding(spark, path)
    delimiter = delimiter or sniff_delimiter(spark, path)
    parts, names = [], []
    for files in _by_header(spark, path):
        own = check_header(_header(spark, files, delimiter, encoding), max_columns)
        names = names or own
        if set(own) != set(names):
            raise CsvError(f"The files differ in their columns: {', '.join(sorted(set(own) ^ set(names)))}")
        if multi_line and len(delimiter) == 1 and _java_name(encoding) in ("UTF-8", "ISO-8859-1"):
            lines = _lines(spark, files, delimiter, encoding)
            if lines.filter("opened").limit(1).count():
                parts.append(_parsed_records(quoted_records(lines), own, delimiter, encoding))
                continue
            parts.append(_read_files(spark, files, own, delimiter, encoding, False))
            continue
        parts.append(_read_files(spark, files, own, delimiter, encoding, multi_line))
    return reduce(DataFrame.unionByName, parts)


def _read_files(
    spark: SparkSession, path: str | list[str], names: list[str], delimiter: str, encoding: str, multi_line: bool
) -> DataFrame:
    raw = spark.read.schema(_schema(names)).options(**_options(delimiter, encoding, multi_line)).csv(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return _cells(raw.withColumn("_at", F.monotonically_increasing_id()), names, encoding)


def _schema(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, REJECT])


def _options(delimiter: str, encoding: str, multi_line: bool) -> dict[str, str]:
    return dict(
        header="true", sep=delimiter, quote='"', escape='"', mode="PERMISSIVE", enforceSchema="true",
        encoding=_java_name(encoding), columnNameOfCorruptRecord=REJECT, multiLine=str(multi_line).lower(),
        columnPruning="false", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", nullValue="",
    )


def _cells(raw: DataFrame, names: list[str], encoding: str) -> DataFrame:
    fix: Column
    cells = []
    for n in names:
        fix = F.coalesce(F.col(f"`{n}`"), F.lit(""))
        cells.append((F.translate(fix, CP1252_BYTES, CP1252_TEXT) if encoding == "cp1252" else fix).alias(n))
    # Spark refuses plans that read nothing but the reject column, so it is tied to the first cell;
    # the second argument is always null.
    first = F.col(f"`{names[0]}`")
    return raw.select(
        *cells,
        F.coalesce(F.col(REJECT), F.nullif(first, first)).alias(REJECT),
        "_file", "_block", "_at",
    )


def _lines(spark: SparkSession, path: str | list[str], delimiter: str, encoding: str) -> DataFrame:
    """Lines with their place, and the state after each: `opened` if it starts outside quotes and ends inside, `stays` if it
    starts inside and ends inside. A quote opens only at the start of a cell, as the parser has it."""
    d = "\\" + delimiter
    inside = '[^"]*+(?:""[^"]*+)*+'
    cells = f'(?:(?:"{inside}"[^{d}]*+|[^"{d}][^{d}]*+)?+{d})*+'
    raw = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    if _java_name(encoding) == "UTF-8":
        value = F.when(F.col("_block") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    else:
        value = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    return raw.withColumn("value", value).withColumns({
        "opened": F.col("value").rlike(f'^{cells}"{inside}\\z'),
        "crlf": F.col("value").endswith("\r"),
        "stays": F.col("value").rlike(f'^{inside}(?:\\z|"[^{d}]*+{d}{cells}"{inside}\\z)'),
    })


def quoted_records(lines: DataFrame) -> DataFrame:
    """Records of split files, without the header of each: raw (as it stands in the file), record (line breaks as the parser
    takes them), _file, _block (where it starts), _at (its number there). A quote that is never closed makes the rest one record.

    A line maps the state before it (inside or outside quotes) to the state after it: it keeps, flips or sets the state. Such maps
    compose, so each block is summed up by itself, for either state it may start in; one short row per block then tells
    the state in which each block starts. Lines are sorted once, by block; only lines of records with line breaks are grouped.
    """
    flips, sets = F.col("opened") & ~F.col("stays"), F.col("opened") == F.col("stays")
    upto = Window.partitionBy("_file", "_block").orderBy("_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("_file", "_block").orderBy("_line").rowsBetween(Window.unboundedPreceding, -1)
    turned = lines.withColumn("turns", F.sum(flips.cast("long")).over(upto))
    fixed = F.when(sets, F.struct("_line", "opened", "turns"))
    states = turned.withColumn("set", F.max(fixed).over(before)).withColumn("odd", F.col("turns") - flips.cast("long"))
    # the state before each line, should its block start outside (0) or inside (1)
    known = (F.col("set.opened").cast("long") + F.col("odd") - F.col("set.turns")) % 2 == 1
    for start in (0, 1):
        states = states.withColumn(f"in{start}", F.coalesce(known, (F.col("odd") + start) % 2 == 1))
    solid = F.rtrim("value", F.lit("\r")) != ""  # an empty line outside quotes is no record
    for start in (0, 1):
        states = states.withColumn(f"nth{start}", F.sum((~F.col(f"in{start}") & solid).cast("long")).over(upto))
    last = F.max(F.struct("_line", "in0", "in1", "opened", "stays", "nth0", "nth1")).alias("l")
    blocks = states.groupBy("_file", "_block").agg(last, F.min(F.struct("_line", "crlf")).alias("first")).select(
        "_file", "_block", "first.crlf", *[F.when(F.col(f"l.in{x}"), F.col("l.stays")).otherwise(F.col("l.opened")).alias(f"out{x}") for x in (0, 1)],
        F.col("l.nth0").alias("n0"), F.col("l.nth1").alias("n1"),
    )
    # the same composition over the blocks of a file
    file_upto = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    file_before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    flip = (F.col("out0") & ~F.col("out1")).cast("long")
    blocks = blocks.withColumn("turns", F.sum(flip).over(file_upto))
    blocks = blocks.withColumn("set", F.max(F.when(F.col("out0") == F.col("out1"), F.struct("_block", "out0", "turns"))).over(file_before))
    odd = F.col("turns") - flip
    blocks = blocks.withColumn("inside", F.coalesce((F.col("set.out0").cast("long") + odd - F.col("set.turns")) % 2 == 1, odd % 2 == 1))
    blocks = blocks.withColumn("n", F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0")))
    blocks = blocks.withColumn("open", F.max(F.when(F.col("n") > 0, F.struct("_block", "n"))).over(file_before))
    # as in a read of the whole file, its first line end is the one that counts, inside cells too
    blocks = blocks.select("_file", "_block", "inside", "open", F.first("crlf").over(file_upto).alias("crlf"))
    placed = states.drop("crlf").join(blocks, ["_file", "_block"])
    nth, within = (F.when(F.col("inside"), F.col(f"{x}1")).otherwise(F.col(f"{x}0")) for x in ("nth", "in"))
    placed = placed.select("_file", "_block", "_line", "value", "opened", "open", "crlf", nth.alias("nth"), within.alias("within")).filter(F.col("within") | solid)
    # lines before the first start of a block belong to the record that an earlier block left open
    home = F.when(F.col("nth") > 0, F.struct("_block", F.col("nth").alias("n"))).otherwise(F.col("open"))
    placed = placed.withColumn("home", home).withColumn("header", F.col("open").isNull() & (F.col("nth") == 1))
    placed = placed.select("_file", "home", "_block", "_line", "value", "header", "crlf", (~F.col("within") & ~F.col("opened")).alias("alone"))
    single = placed.filter("alone and not header").select("value", "crlf", "_file", F.col("home._block").alias("_block"), F.col("home.n").alias("_at"))
    parts = placed.filter("not alone").groupBy("_file", "home").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_line", "value"))).alias("parts"), F.bool_or("header").alias("header"), F.first("crlf").alias("crlf")
    )
    parts = parts.filter("not header").select(F.array_join("parts.value", "\n").alias("value"), "crlf", "_file", F.col("home._block").alias("_block"), F.col("home.n").alias("_at"))
    records = single.union(parts).withColumn("raw", F.regexp_replace("value", "\r\\z", ""))
    record = F.when(F.col("crlf"), F.replace("raw", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("raw"))
    return records.select("raw", record.alias("record"), "_file", "_block", "_at")


def _parsed_records(records: DataFrame, names: list[str], delimiter: str, encoding: str) -> DataFrame:
    options = {**_options(delimiter, encoding, True), "header": "false", "lineSep": "\n"}
    parsed = records.select(F.from_csv("record", _schema(names), options).alias("r"), "raw", "_file", "_block", "_at")
    reject = F.when(F.col(f"r.{REJECT}").isNotNull(), F.col("raw")).alias(REJECT)
    return _cells(parsed.select(*[F.col("r").getField(n).alias(n) for n in names], reject, "_file", "_block", "_at"), names, encoding)


def rejects(df: DataFrame) -> DataFrame:
    """Rows that do not have as many cells as the header, in full."""
    return df.filter(F.col(REJECT).isNotNull())


def accepted(df: DataFrame, strict: bool = False) -> DataFrame:
    """Well-formed rows. With `strict`, a single malformed row is an error."""
    if strict:
        bad = with_line_numbers(df).filter(F.col(REJECT).isNotNull()).orderBy("line_number").select("line_number").first()
        if bad is not None:
            raise CsvError(f"Row {bad['line_number']} does not match the header")
    return df.filter(F.col(REJECT).isNull()).drop(REJECT)


def with_line_numbers(df: DataFrame) -> DataFrame:
    """Add `row_id` (0-based) and `line_number` (the header is line 1) in file order.

    Call it on all rows, before rejects are dropped. Rows of a file block are read in order by one
    task, so counting rows per block is enough: no row is moved, and one line per block is joined back.
    """
    blocks = df.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    placed = df.join(offsets, ["_file", "_block"])
    return (
        placed.withColumn("row_id", F.col("_offset") + F.col("_at") - F.col("_first"))
        .withColumn("line_number", F.col("row_id") + 2)
        .drop("_file", "_block", "_at", "_first", "_offset")
    )
