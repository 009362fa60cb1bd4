"""Reading and writing files."""

import random

import pytest

from sparkcast.config import PreparationConfig
from sparkcast.operators.splits import fold_table, split_bounds, split_manifest
from sparkcast.sources import csv, sinks, tables


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


@pytest.mark.parametrize(
    "content,delimiter",
    [("name,value\nx,1\n", ","), ("name;value\nx;1\n", ";"), ("name\tvalue\nx\t1\n", "\t"), ("name|value\nx|1\n", "|"),
     ('name,value\n"a;b;c",1\n', ","), ("name,value\r\nx,1\r\n", ",")],
)
def test_delimiters(spark, tmp_path, content, delimiter):
    path = write(tmp_path / "f.csv", content)
    assert csv.sniff_delimiter(spark, path) == delimiter
    rows = csv.accepted(csv.read_csv(spark, path)).select("name", "value").collect()
    assert len(rows) == 1 and rows[0]["value"] == "1"


def test_byte_order_mark_and_quotes(spark, tmp_path):
    path = write(tmp_path / "f.csv", b"\xef\xbb\xbfname,note\nx,\"line one\nline \"\"two\"\"\"\n")
    df = csv.accepted(csv.read_csv(spark, path))
    row = df.select("name", "note").first()
    assert (row["name"], row["note"]) == ("x", 'line one\nline "two"')


@pytest.mark.parametrize(
    "data,encoding",
    [(b"a,b\n1,2\n", "utf-8"), (b"\xef\xbb\xbfa,b\n1,2\n", "utf-8"), ("a,b\né,2\n".encode(), "utf-8"),
     ("a,b\n€,2\n".encode("cp1252"), "cp1252"), (b"a,b\n\x81,2\n", "latin-1")],
)
def test_encodings(spark, tmp_path, data, encoding):
    assert csv.detect_encoding(spark, write(tmp_path / "f.csv", data)) == encoding


def test_cp1252_text_is_kept(spark, tmp_path):
    path = write(tmp_path / "f.csv", "name,price\ncafé,€5\n".encode("cp1252"))
    row = csv.accepted(csv.read_csv(spark, path)).select("name", "price").first()
    assert (row["name"], row["price"]) == ("café", "€5")


@pytest.mark.parametrize("names", [["a", "a"], ["a", " "], ["", ""], [f"c{i}" for i in range(501)]])
def test_bad_headers(names):
    with pytest.raises(csv.CsvError):
        csv.check_header(names, max_columns=500)


def test_ragged_rows_are_rejected_with_their_line(spark, tmp_path):
    path = write(tmp_path / "f.csv", "a,b\n1,2\n3\n4,5\n6,7,8\n")
    df = csv.read_csv(spark, path, ",", multi_line=False)
    assert csv.accepted(csv.with_line_numbers(df)).count() == 2
    bad = csv.rejects(csv.with_line_numbers(df)).select("line_number", csv.REJECT).orderBy("line_number").collect()
    assert [tuple(r) for r in bad] == [(3, "3"), (5, "6,7,8")]
    with pytest.raises(csv.CsvError, match="Row 3"):
        csv.accepted(df, strict=True)


def test_line_numbers_over_many_splits(spark, tmp_path):
    lines = "id,v\n" + "".join(f"{i},x{i}\n" for i in range(20000))
    path = write(tmp_path / "f.csv", lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = csv.with_line_numbers(csv.read_csv(spark, path, ",", multi_line=False))
        assert df.rdd.getNumPartitions() > 1
        assert df.filter("cast(id as bigint) <> row_id").count() == 0 and df.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_panel_and_manifest_round_trip(spark, tmp_path):
    cfg = PreparationConfig("y", "date")
    panel = spark.range(30).selectExpr("date_add(DATE '2026-01-01', CAST(id AS INT)) AS date", "CAST(id AS DOUBLE) AS y")
    from sparkcast.operators.splits import assign_split

    labelled = assign_split(panel, cfg)
    path = str(tmp_path / "panel")
    sinks.write_panel(labelled, path)
    assert sinks.read_panel(spark, path, cfg).filter("split = 'test'").count() == labelled.filter("split = 'test'").count()
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_panel(labelled, path)
    text = str(tmp_path / "text")
    sinks.write_panel(labelled, text, "csv")
    assert dict(sinks.read_panel(spark, text, cfg, "csv").dtypes)["y"] == "double"
    manifest = split_manifest(labelled, cfg)
    folds = fold_table(split_bounds(panel, cfg), 2)
    sinks.write_manifest(str(tmp_path / "m"), cfg, manifest, manifest, folds, manifest, {"source_checksum": "abc"})
    assert "abc" in spark.read.text(str(tmp_path / "m" / "manifest")).first()[0]
    assert spark.read.json(str(tmp_path / "m" / "folds")).count() == folds.count()


def test_digest_ignores_order_and_sees_changes(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS v")
    a = tables.table_digest(df.repartition(5)).first()["digest"]
    assert a == tables.table_digest(df.orderBy(df.id.desc())).first()["digest"]
    assert a != tables.table_digest(df.selectExpr("id", "CASE WHEN id = 7 THEN 0 ELSE v END AS v")).first()["digest"]


def test_file_digest(spark, tmp_path):
    import hashlib

    path = write(tmp_path / "f.csv", b"a,b\n1,2\n")
    assert sinks.file_digests(spark, path).first()["checksum"] == hashlib.sha256(b"a,b\n1,2\n").hexdigest()


def test_columns_of_several_files_match_by_name(spark, tmp_path):
    write(tmp_path / "a.csv", "x,y\n1,2\n")
    write(tmp_path / "b.csv", "y,x\n20,10\n")
    rows = csv.accepted(csv.read_csv(spark, str(tmp_path), ",", "utf-8")).select("x", "y").collect()
    assert sorted(map(tuple, rows)) == [("1", "2"), ("10", "20")]
    write(tmp_path / "c.csv", "x,z\n1,2\n")
    with pytest.raises(csv.CsvError):
        csv.read_csv(spark, str(tmp_path), ",", "utf-8")


def test_a_late_line_counts_for_the_delimiter(spark, tmp_path):
    path = write(tmp_path / "f.csv", "a,b;c\n" * 3000 + "a;c\n")
    assert csv.sniff_delimiter(spark, path) == ";"


def test_pages_by_key(spark):
    """Every row on one page, in order, nulls first; ties of the leading column cross pages; pages past the end are empty."""
    from sparkcast.sources.tables import PageIndex, page

    rows = [(None if i % 10 == 0 else i // 25, f"n{i % 25:02d}", i) for i in range(210)]
    df = spark.createDataFrame(rows, "a int, b string, i int").repartition(6)
    index = PageIndex.build(df, ["a", "b", "i"], 40)
    pages = [index.page(k).collect() for k in range(1, 8)]
    assert [len(p) for p in pages] == [40, 40, 40, 40, 40, 10, 0]
    wanted = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert [tuple(r)[:3] for p in pages for r in p] == wanted and {r["total"] for p in pages for r in p} == {210}
    assert page(df, ["i"], 2, 5).select("i").collect() == [(5,), (6,), (7,), (8,), (9,)]
    with pytest.raises(ValueError):
        index.page(0)
    # equal keys are not split, and none is lost
    tied = PageIndex.build(df, ["b"], 30)
    assert sorted(r["i"] for k in range(1, 8) for r in tied.page(k).collect()) == list(range(210))


def test_a_page_reads_a_range_of_keys(spark, tmp_path):
    from sparkcast.sources.tables import PageIndex

    spark.range(1000).write.parquet(str(tmp_path / "rows"))
    index = PageIndex.build(spark.read.parquet(str(tmp_path / "rows")), ["id"], 100)
    plan = index.page(9)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,800)" in plan and "LessThanOrEqual(id,900)" in plan


def _quoted_file(seed, rows, end="\n", delimiter=","):
    """A file whose cells hold line breaks, delimiters, doubled quotes, quotes inside bare cells, and some ragged rows."""
    rng = random.Random(seed)
    bits = ["x", "yy", delimiter, '""', "\n", "\r\n", " ", "é", '""\n""']
    cell = lambda: '"' + "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) + '"' if rng.random() < 0.5 else rng.choice(["", "a", "5 \" pipe", "b c"])
    lines = [delimiter.join(["id", '"note"', "rest"])]
    for i in range(rows):
        lines.append(delimiter.join([str(i), *(cell() for _ in range(2 + (rng.random() < 0.05)))]))
        if rng.random() < 0.05:
            lines.append("")
    return "\ufeff" + end.join(lines) + (end if seed % 2 else "")


@pytest.mark.parametrize("seed,end,delimiter", [(1, "\n", ","), (2, "\r\n", ";"), (3, "\n", "|"), (4, "\r\n", "\t")])
def test_quoted_line_breaks_across_blocks(spark, tmp_path, seed, end, delimiter):
    path = write(tmp_path / "f.csv", _quoted_file(seed, 300, end, delimiter))
    names = ["id", "note", "rest"]
    whole = csv._read_files(spark, path, names, delimiter, "utf-8", True)
    want = [tuple(r) for r in csv.with_line_numbers(whole).orderBy("row_id").collect()]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("23", "400", kept):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = csv.read_csv(spark, path, delimiter, "utf-8")
            got = [tuple(r) for r in csv.with_line_numbers(df).orderBy("row_id").collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        assert len(got) == len(want) >= 300
        for g, w in zip(got, want, strict=True):
            assert g == w


def test_quoted_line_breaks_in_other_encodings_and_several_files(spark, tmp_path):
    write(tmp_path / "a.csv", 'k,v\n1,"é\n€"\n2,x\n'.encode("cp1252"))
    write(tmp_path / "b.csv", 'k,v\n3,"p\nq\nr"\n4,"open\nto the end'.encode("cp1252"))
    df = csv.read_csv(spark, str(tmp_path), ",")
    assert sorted(tuple(r) for r in df.select("k", "v").collect()) == [("1", "é\n€"), ("2", "x"), ("3", "p\nq\nr"), ("4", "open\nto the end")]
