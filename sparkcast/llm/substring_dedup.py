"""Exact repeated substrings by a distributed merge sort of suffixes that knows common prefixes.

Every `span`-byte string holds an anchor: a place where the hash of the next `GRAM` bytes is the smallest among all such
places inside it. The choice depends on the string alone, so equal strings have equal anchors, and only suffixes at
anchors need sorting. Anchors whose gram occurs once in the corpus cannot be part of a repeat and go first.

Each task sorts the suffixes at its anchors (followed by the bytes before them, read backwards), keeps the earliest
of equal ones, and writes them as front-coded runs: common prefix lengths, tails, places. Runs are dealt by gram; each
receiver merges its runs with a loser tree whose nodes remember the prefix shared with the last output, so no known
byte is compared again. The merged order with its prefix lengths, and the order of the bytes before the anchors, tell
for each of the strings around an anchor which places share it; all but the earliest are repeats.

Documents equal to an earlier one are repeats as a whole and take no part in the sort. Null texts are empty; texts
shorter than `span` bytes keep everything. Ids should be unique; of rows that repeat an id and a text the later ones count
as repeats of nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.llm.common import sized, texts
from sparkcast.llm.shingles import mix, powers, span_hashes
from sparkcast.session import materialize

GRAM = 32
_META = np.dtype([("doc", "<i8"), ("at", "<i4"), ("left", "u1"), ("right", "u1")])


def _sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every `width` neighbours, by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = op(out[:-step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of a text and the hashes of their grams. Places that tie are all anchors."""
    if len(data) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.arange(len(data) - GRAM + 1)
    hashes = span_hashes(data, starts, starts + GRAM)
    width = span - GRAM + 1
    low = _sliding(hashes, width, np.minimum)
    # a place is an anchor if it is the smallest of some string around it
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate((pad, low, pad)), width, np.maximum) == hashes)
    return at, hashes[at]


def _anchor_rows(span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, places = [], []
            for text in batch["text"]:
                at, hashes = anchors(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), span)
                keys.append(hashes.view(np.int64))
                places.append(at.astype(np.int32))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "keys": keys, "places": places})

    return run


def front_code(rows: np.ndarray) -> tuple[bytes, bytes]:
    """Common prefix lengths of sorted rows of one width, and their tails."""
    lcp = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        lcp[1:] = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    tails = rows[np.arange(rows.shape[1])[None, :] >= lcp[:, None]]
    return lcp.tobytes(), tails.tobytes()


def decode_run(lcp: bytes, tails: bytes, width: int) -> list[bytes]:
    out, last, at = [], b"", 0
    for n in lcp:
        last = last[:n] + tails[at : at + width - n]
        at += width - n
        out.append(last)
    return out


def _common(a: bytes, b: bytes, known: int) -> int:
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return len(a) - (x.bit_length() + 7) // 8


def loser_tree_merge(runs: list[tuple[list[bytes], bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge sorted runs of (rows, common prefix lengths). Returns run, index in the run, and prefix length shared with
    the row before, in merged order. Rows share one width; equal rows come in the order of the runs."""
    k = max(1, 1 << (len(runs) - 1).bit_length())
    rows = [r for r, _ in runs] + [[] for _ in range(k - len(runs))]
    shared = [s for _, s in runs] + [b""] * (k - len(runs))
    index = [0] * k
    head = [r[0] if r else b"" for r in rows]
    prefix = [0 if r else -1 for r in rows]  # of the head with the last output; -1: the run is over

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two heads; bytes before the known prefix are not looked at."""
        if prefix[a] != prefix[b]:
            return (a, b) if prefix[a] > prefix[b] else (b, a)
        known = prefix[a]
        if known < 0:
            return a, b
        x, y = head[a][known:], head[b][known:]
        win, lose = (a, b) if x < y or (x == y and a < b) else (b, a)
        prefix[lose] = _common(head[a], head[b], known)
        return win, lose

    losers = [0] * k
    winners = [0] * (2 * k)
    winners[k:] = range(k)
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    total = sum(map(len, rows))
    from_run, from_index, lcp = np.empty(total, np.int32), np.empty(total, np.int64), np.empty(total, np.int16)
    for n in range(total):
        i = index[best]
        from_run[n], from_index[n], lcp[n] = best, i, prefix[best]
        index[best] = i = i + 1
        if i < len(rows[best]):
            head[best], prefix[best] = rows[best][i], shared[best][i]
        else:
            prefix[best] = -1
        node = (best + k) >> 1
        while node:
            other = losers[node]
            if prefix[other] > prefix[best]:
                best, losers[node] = other, best
            elif prefix[other] == prefix[best]:
                best, losers[node] = play(best, other)
            node >>= 1
    return from_run, from_index, lcp


def _contexts(data: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor the `span` bytes from it on and the bytes before it backwards, zero-padded, and how many there are."""
    back = span - GRAM
    padded = np.concatenate((np.zeros(back, np.uint8), data, np.zeros(span, np.uint8)))
    after = padded[(at + back)[:, None] + np.arange(span)[None, :]]
    before = padded[(at + back)[:, None] - 1 - np.arange(back)[None, :]]
    return np.concatenate((after, before), 1), np.minimum(at, back), np.minimum(len(data) - at, span)


def _sorted_runs(span: int, targets: int):
    """Front-coded runs, one for each target; target -1 holds the stretches of later copies found right here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for doc, text, places in zip(batch["doc_id"], batch["text"], batch["places"], strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                at = np.unique(np.asarray(places, np.int64))
                rows, left, right = _contexts(data, at, span)
                meta = np.empty(len(at), _META)
                meta["doc"], meta["at"], meta["left"], meta["right"] = doc, at, left, right
                target = span_hashes(data, at, at + GRAM) % np.uint64(targets)
                held.append((rows, meta, target.astype(np.int64)))
                size += rows.nbytes
            if size > 48_000_000:  # a run is bounded; more runs are merged later
                yield _run_rows(held, span)
                held, size = [], 0
        if held:
            yield _run_rows(held, span)

    return run


def _stretch(meta: np.ndarray, low: np.ndarray, high: np.ndarray, span: int) -> np.ndarray:
    """Bytes covered by the strings that start `low` to `high` bytes before the anchors."""
    out = np.empty((len(meta), 3), np.int64)
    out[:, 0], out[:, 1], out[:, 2] = meta["doc"], meta["at"] - high, meta["at"] - low + span
    return out


def _run_rows(held: list, span: int) -> pd.DataFrame:
    rows, meta, target = (np.concatenate([h[i] for h in held]) for i in range(3))
    width = rows.shape[1]
    text = np.ascontiguousarray(rows).view(f"S{width}").ravel()
    order = np.lexsort((meta["at"], meta["doc"]))
    order = order[np.argsort(text[order], kind="stable")]
    rows, meta, target, text = rows[order], meta[order], target[order], text[order]
    # zero bytes at the end of a text look like padding, so lengths must agree too
    repeat = np.concatenate(([False], (text[1:] == text[:-1]) & (meta["left"][1:] == meta["left"][:-1]) & (meta["right"][1:] == meta["right"][:-1])))
    low, high = np.maximum(0, span - meta["right"].astype(np.int64)), meta["left"].astype(np.int64)
    gone = repeat & (low <= high)
    out = [(-1, b"", b"", _stretch(meta[gone], low[gone], high[gone], span).tobytes())]
    rows, meta, target = rows[~repeat], meta[~repeat], target[~repeat]
    by_target = np.argsort(target, kind="stable")
    for part in np.split(by_target, np.flatnonzero(np.diff(target[by_target])) + 1):
        if len(part):
            out.append((int(target[part[0]]), *front_code(rows[part]), meta[part].tobytes()))
    return pd.DataFrame(out, columns=["target", "lcp", "tails", "meta"])


def _merged_repeats(span: int):
    """Stretches of repeats among the runs of one target."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        width = 2 * span - GRAM
        back = span - GRAM
        group = group.sort_values("meta", kind="stable")
        runs = [(decode_run(x, t, width), x) for x, t in zip(group["lcp"], group["tails"], strict=True)]
        metas = [np.frombuffer(m, _META) for m in group["meta"]]
        which, index, shared = loser_tree_merge(runs)
        offsets = np.concatenate(([0], np.cumsum([len(m) for m in metas])))[:-1]
        meta = np.concatenate(metas)[offsets[which] + index]
        before = np.frombuffer(b"".join(runs[r][0][i][span:] for r, i in zip(which.tolist(), index.tolist(), strict=True)), np.uint8).reshape(-1, back)
        n = len(meta)
        by_before = np.argsort(np.ascontiguousarray(before).view(f"S{back}").ravel(), kind="stable")
        differs = before[by_before][1:] != before[by_before][:-1]
        shared_before = np.concatenate(([0], np.where(differs.any(1), differs.argmax(1), back)))
        order = np.lexsort((meta["at"], meta["doc"]))
        repeats = np.zeros((n, back + 1), bool)
        left, right = meta["left"].astype(np.int64), meta["right"].astype(np.int64)
        class_before = np.empty(n, np.int64)
        for s in range(back + 1):
            here = order[(left[order] >= s) & (right[order] >= span - s)]
            class_before[by_before] = np.cumsum(shared_before < s)
            both = (np.cumsum(shared < span - s) * np.int64(n + 1) + class_before)[here]
            repeats[here, s] = True
            _, first = np.unique(both, return_index=True)
            repeats[here[first], s] = False
        edge = np.diff(np.pad(repeats, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        return pd.DataFrame(_stretch(meta[row], low, high - 1, span), columns=["doc_id", "start", "stop"])

    return run


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for meta in batch["meta"]:
            yield pd.DataFrame(np.frombuffer(meta, np.int64).reshape(-1, 3), columns=["doc_id", "start", "stop"])


def repeated_stretches(docs: DataFrame, span: int = 100, per_target: int = 100_000) -> DataFrame:
    """Byte stretches (doc_id, start, stop) covered by strings of `span` bytes that also start earlier. They may overlap.
    `docs` has doc_id and text, no two texts equal."""
    found = docs.filter(F.octet_length("text") >= span).mapInPandas(_anchor_rows(span), "doc_id long, keys array<long>, places array<int>")
    found = materialize(found, "anchors")
    flat = found.select("doc_id", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("places").alias("place"))))
    # written, so that the join below deals both sides anew and adaptive execution can split a hot key
    twice = materialize(flat.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared-keys")
    kept = flat.join(twice, "key", "left_semi").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    kept = materialize(kept, "shared-anchors")
    total = kept.agg(F.sum(F.size("places"))).first()[0] or 0
    listed = docs.join(sized(kept.select("doc_id"), 2_000_000), "doc_id", "left_semi")
    blocks = listed.join(kept, "doc_id").mapInPandas(_sorted_runs(span, max(1, -(-total // per_target))), "target long, lcp binary, tails binary, meta binary")
    blocks = materialize(blocks, "suffix-runs")
    schema = "doc_id long, start long, stop long"
    return blocks.filter("target >= 0").groupBy("target").applyInPandas(_merged_repeats(span), schema).union(
        blocks.filter("target < 0").mapInPandas(_unpack, schema)
    )


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            removed = np.zeros(len(data) + 2, bool)
            for s in spans if spans is not None else ():
                removed[s["start"] + 1 : s["stop"] + 1] = True
            edges = np.flatnonzero(removed[1:] != removed[:-1])
            starts, stops = edges[::2], edges[1::2]
            kept = b"".join(data[a:b] for a, b in zip([0, *stops], [*starts, len(data)], strict=True))
            rows.append((len(data), int((stops - starts).sum()), len(starts), hashlib.sha256(kept).hexdigest(), kept))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        out.insert(0, "doc_id", batch["doc_id"].array)
        yield out


def remove_repeats(docs: DataFrame, span: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    rows = texts(docs, id_col, text_col)
    digests = rows.select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("size")).filter(F.col("size") >= span)
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = materialize(digests.join(first, "digest").filter("doc_id <> first").select("doc_id", "size"), "copies")
    copy_ids = sized(copies.select("doc_id"), 2_000_000)
    stretches = repeated_stretches(rows.join(copy_ids, "doc_id", "left_anti"), span)
    stretches = stretches.union(copies.select("doc_id", F.lit(0).cast("long"), F.col("size").cast("long")))
    spans = stretches.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = materialize(spans, "repeats")
    ids = sized(spans.select("doc_id"), 2_000_000)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    cut = rows.join(ids, "doc_id", "left_semi").join(spans, "doc_id")
    whole = rows.join(ids, "doc_id", "left_anti").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return cut.select("doc_id", "text", "spans").union(whole.select("doc_id", "text", "spans")).mapInPandas(_cut, schema)
