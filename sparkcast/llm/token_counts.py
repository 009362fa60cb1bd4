"""Token counts of a byte-level BPE by rank-synchronous array merging.

Texts are cut into pre-tokens. Pre-tokens not seen before by a worker form one ragged array: symbols laid end to
end with the start of each sequence. In each round every sequence applies its lowest-rank pair at all its places at
once; sequences without a pair leave the array and their surviving symbols are counted. A merge can only make
pairs of higher rank than its own, so the rounds give what merging one pair at a time gives.

Null and empty texts have no bytes and no tokens. A special string inside a text is one token, as the library has it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from sparkcast.llm.common import texts

CHUNK_CHARS = 500_000
CACHE_WORDS = 300_000
# Fixed pattern of byte-level pre-tokens.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_NONE = np.int32(2**31 - 1)
_MODELS: dict[str, ByteBpe] = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself if visible, else from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PairTable:
    """Pair of symbols to (rank, merged symbol), by open addressing in arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.bits = max(10, int(np.ceil(np.log2(len(pairs) + 1))) + 3)
        size = 1 << self.bits
        self.keys = np.full(size + 64, -1, np.int64)
        self.rank = np.full(size + 64, _NONE, np.int32)
        self.merged = np.zeros(size + 64, np.int32)
        self.depth = 1
        for (a, b), (rank, merged) in pairs.items():
            key = (a << 32) | b
            slot = int(self._slots(np.array([key]))[0])
            first = slot
            while self.keys[slot] != -1:
                slot += 1
            self.depth = max(self.depth, slot - first + 1)
            self.keys[slot], self.rank[slot], self.merged[slot] = key, rank, merged

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; the rank is the largest integer where there is none."""
        keys = (a.astype(np.int64) << 32) | b
        slot = self._slots(keys)
        rank = np.where(self.keys[slot] == keys, self.rank[slot], _NONE)
        at = slot
        for d in range(1, self.depth):
            open_ = np.flatnonzero((rank == _NONE) & (self.keys[slot + d - 1] != -1))
            if not len(open_):
                break
            near = slot[open_] + d
            hit = self.keys[near] == keys[open_]
            rank[open_[hit]] = self.rank[near[hit]]
            at = at.copy() if at is slot else at
            at[open_[hit]] = near[hit]
        return rank, self.merged[at]


class ByteBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        letters = _byte_letters()
        self.byte_ids = np.array([ids[letters[b]] for b in range(256)], np.int32)
        self.pairs = PairTable({(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(merges)})
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self.known: dict[str, int] = {}

    def merge_counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each non-empty pre-token."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        counts, live = np.zeros(len(raw), np.int64), np.arange(len(raw))
        while len(live):
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            rank = np.full(len(symbols), _NONE, np.int32)
            rank[:-1], merged = self.pairs.find(symbols[:-1], symbols[1:])
            rank[starts + sizes - 1] = _NONE  # no pair across sequences
            lowest = np.minimum.reduceat(rank, starts)
            going = lowest != _NONE
            counts[live[~going]] = sizes[~going]
            if not going.any():
                break
            picked = np.flatnonzero((rank == np.repeat(lowest, sizes)) & (rank != _NONE))
            # of overlapping places (the same symbol again and again) every second one, from the left
            fresh = np.concatenate(([True], np.diff(picked) != 1))
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(picked)), 0))
            picked = picked[(np.arange(len(picked)) - head) % 2 == 0]
            symbols[picked] = merged[picked]
            keep = np.repeat(going, sizes)
            keep[picked + 1] = False
            sizes = np.add.reduceat(keep.astype(np.int64), starts)[going]
            symbols, live = symbols[keep], live[going]
        return counts

    def count(self, batch: list[str]) -> list[int]:
        extra = [0] * len(batch)
        cut = []
        for k, text in enumerate(batch):
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                extra[k] = len(parts) - 1
                cut.append([w for p in parts for w in PRE_TOKEN.findall(p)])
            else:
                cut.append(PRE_TOKEN.findall(text))
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        fresh = list({w for words in cut for w in words}.difference(self.known))
        if fresh:
            self.known.update(zip(fresh, self.merge_counts(fresh).tolist(), strict=True))
        count = self.known.__getitem__
        return [n + sum(map(count, words)) for n, words in zip(extra, cut, strict=True)]


def chunks(values: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of about `limit` characters; a longer text stands alone and whole."""
    start, held = 0, 0
    for k, v in enumerate(values):
        if k > start and held + len(v) > limit:
            yield start, k
            start, held = k, 0
        held += len(v)
    if start < len(values):
        yield start, len(values)


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. `vocabulary` is the file's path on every machine."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _MODELS.get(vocabulary) or _MODELS.setdefault(vocabulary, ByteBpe(vocabulary))
        for batch in batches:
            values = batch["text"].tolist()
            n = [c for a, b in chunks(values) for c in model.count(values[a:b])]
            sizes = [len(v.encode()) for v in values]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": sizes, "n_tokens": n, "over_limit": [c > limit for c in n]})

    return texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
