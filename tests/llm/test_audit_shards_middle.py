"""Filter audit, exact shards and fill-in-middle against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcast.llm import fill_in_middle, filter_audit, queries, sharding

from .conftest import EDGE_TEXTS

WIDE = ["a b  ", "  a\tb\x0b\x0c\rc\n", "é", "aé b漢字 \U0001f600 c", " \t\n", "x<P>y", "<<M> z", "漢 " * 400, "ab " * 3000, "\x85a b c"]


# -- 11


def brute_audit(rows, labels):
    good, toxic = ({i for i, *f in labels if f[k] == 1 and i is not None} for k in (0, 1))
    masks = []
    for i, lang, text in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in rows),
        }
        masks.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        here = [m for m in masks if m[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            live = list(here)
            for k, f in enumerate(order):
                gone = [m for m in live if f in m[1]]
                live = [m for m in live if f not in m[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(live), len(gone), sum(f in m[1] and bool(m[1] & set(order[:k])) for m in here), sum(m[1] == {f} for m in here),
                    sum(m[2] for m in gone), sum(m[3] for m in gone),
                ]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return out


def audit_docs(spark, rows):
    rows = [(i, lang, text, 1, "x") for i, lang, text in rows]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string, mask int, part string").repartition(3)


def test_filter_audit(spark):
    long = " ".join(f"w{i}" for i in range(300))
    texts = [*EDGE_TEXTS, long, long, long + " #", "w " * 500, "AB " * 250, "AB " * 250, "a" * 100_000]
    rows = [(i, ["en", "de", None, ""][i % 4], t) for i, t in enumerate(texts)]
    rows += [(None, "en", long), (None, None, None), (3, "en", texts[3]), (3, "de", long), (40, "fr", long), (40, "fr", long)]
    labels = [(0, 1, 1), (3, 0, 1), (8, 1, 0), (9, 1, None), (9, 0, 0), (40, 1, 1), (None, 1, 1), (77, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(audit_docs(spark, rows), frame)
    found = {(r.part, r.filter_order, r.step): [r[c] for c in (*filter_audit.COUNTS, "shapley")] for r in got.collect()}
    assert found == brute_audit(rows, labels)
    assert len(found) == 600 * 4


def test_filter_audit_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(audit_docs(spark, []), frame).count() == 0
    one = filter_audit.filter_audit(audit_docs(spark, [(1, "en", "a")]), frame)
    assert one.count() == 600 and one.agg(F.sum("removed")).first()[0] == 120


# -- 12


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matrix_has_exact_sums_and_tasks_agree(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 400, 37)
    total = int(sizes.sum())
    goal = [total // 7 + (k < total % 7) for k in range(7)]
    whole = dict(sharding.matrix_rows(sizes, goal, seed, 0, 37))
    parts = dict(r for a in range(0, 37, 5) for r in sharding.matrix_rows(sizes, goal, seed, a, min(a + 5, 37)))
    assert whole == parts
    table = np.array([whole[i] for i in range(37)])
    assert (table.sum(1) == sizes).all() and (table.sum(0) == goal).all() and (table >= 0).all()


def test_hypergeometric_law():
    from math import comb

    rng = np.random.default_rng(5)
    good, bad, sample, n = 7, 9, 6, 40_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, sample) for _ in range(n))
    chi = sum((seen[k] - n * p) ** 2 / (n * p) for k in range(7) for p in [comb(good, k) * comb(bad, sample - k) / comb(16, sample)])
    assert chi < 22.5  # 6 degrees, 1 in 1000
    # beyond the sizes that library samplers take
    big = [sharding.hypergeometric(rng, 4 * 10**10, 6 * 10**10, 5 * 10**10) for _ in range(60)]
    spread = (5e10 * 0.4 * 0.6 * 0.5) ** 0.5
    assert abs(np.mean(big) - 2e10) < 5 * spread / 60**0.5 and 0.6 < np.std(big) / spread < 1.4
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 2, 2, 4) == 2


def test_uniform_shards(spark, make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_BITS", 4)  # many blocks and ranges on a small table
    docs = make_docs([None, "", "a"] * 400, ids=[i // 2 if i % 50 else None for i in range(1200)]).withColumn("slot", F.lit(9)).withColumn("block", F.lit(1))
    got = sharding.uniform_shards(docs, shards=7, seed=3)
    assert set(got.columns) == {*docs.columns, "shard"}
    rows = got.collect()
    sizes = Counter(r.shard for r in rows)
    assert sorted(sizes.values()) == [171] * 4 + [172] * 3 and set(sizes) == set(range(7))
    for k in sizes:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None)
    assert sorted(map(key, rows)) == sorted(map(key, docs.collect()))


def test_shuffle_is_uniform(spark):
    """Neighbours land in every shard and slot alike: shards by eighth of the input, and no trend of slots."""
    rows = spark.range(4800).repartition(5)
    for seed in (1, 2):
        got = sharding.uniform_shards(rows, shards=3, seed=seed).collect()
        at = Counter((r.id // 600, r.shard) for r in got)
        assert sum((at[i, k] - 200) ** 2 / 200 for i in range(8) for k in range(3)) < 36.1  # 14 degrees, 1 in 1000
        assert abs(np.corrcoef([r.id for r in got], [r.slot for r in got])[0, 1]) < 0.06


def test_shards_of_few_rows_and_files(spark, make_docs, tmp_path):
    assert sharding.uniform_shards(make_docs([]), shards=4).count() == 0
    few = sharding.uniform_shards(make_docs(["a", "b"]), shards=24).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0)]
    docs = make_docs(EDGE_TEXTS * 5)
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(c for _, c in back.groupBy("shard").count().collect()) == [10] * 4
    assert sorted(str(r.text) for r in back.collect()) == sorted(map(str, EDGE_TEXTS * 5))


def test_sharding_query(spark, sf_dir):
    rows = queries.op12_sharding(spark, sf_dir).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id]) + 8, zlib.crc32(docs[r.doc_id]), "rows", None) for r in rows)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert {(r.shard, r.slot) for r in rows} == {(k, s) for k, n in sizes.items() for s in range(n)}


# -- 13


def test_index_converts_both_ways():
    for text in [t or "" for t in [*EDGE_TEXTS, *WIDE]]:
        raw = np.frombuffer(text.encode(), np.uint8)
        index = fill_in_middle.ExceptionIndex(raw)
        points = np.arange(len(text) + 1)
        offsets = np.array([len(text[:p].encode()) for p in points])
        assert index.length == len(text)
        assert (index.to_bytes(points) == offsets).all() and (index.to_points(offsets) == points).all()
        assert len(index.points) == sum(ord(c) > 127 for c in text)
        ends = [m.end() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]
        assert index.to_points(fill_in_middle.token_ends(raw)).tolist() == ends


def brute_middle(i, text, seed, percent, suffix_first, unit):
    t = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t) if unit == "tokens" else list(t)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, t
    if h[3] % 100 < suffix_first:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit,percent,first", [("tokens", 50, 80), ("points", 100, 50)])
def test_fill_in_middle(make_docs, unit, percent, first):
    texts = [*EDGE_TEXTS, *WIDE] * 6
    ids = [None if k % 17 == 0 else k // 2 for k in range(len(texts))]
    made = fill_in_middle.fill_in_middle(make_docs(texts, ids), 42, percent, first, unit)
    rows = made.withColumn("back", fill_in_middle.restored("output", "form")).collect()
    key = lambda r: tuple(map(str, r))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in rows), key=key)
    want = sorted(((i, *brute_middle(i, t, 42, percent, first, unit), t or "") for i, t in zip(ids, texts, strict=True)), key=key)
    assert got == want
    assert {"psm", "spm", "plain"} == {r.form for r in rows}
    for r in rows:
        if r.form != "plain":
            assert len(r.back.encode()[: r.prefix_bytes].decode()) == r.prefix_chars
            assert len(r.back.encode()[r.prefix_bytes : r.prefix_bytes + r.middle_bytes].decode()) == r.middle_chars


def test_fill_in_middle_of_nothing(make_docs):
    assert fill_in_middle.fill_in_middle(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(make_docs([]), unit="bytes")
