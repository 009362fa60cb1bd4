"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text is cut at the runs of word marks, which no piece crosses. Each chunk is merged by an agenda: the best-scored
candidate, leftmost among equals, is taken next, unless its keyed hash over (seed, variant, chunk, left start,
middle, end) falls under the dropout rate; then this candidate is gone for good. A document draws one of
`variants` variants by its id, so equal chunks get different pieces in different documents while a worker can
still keep what it has encoded. Short chunks advance side by side in arrays, one merge each per round; long ones
take a heap. At rate 0 the pieces are the library's. Decoding gives back the text exactly: a literal word mark is
written as bytes, and characters outside the vocabulary fall back to bytes.

Null and empty texts give no pieces and decode to the empty text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.llm.common import texts
from sparkcast.llm.token_counts import PairTable, chunks

MARK = "\u2581"
CACHE_CHUNKS = 250_000
LONG_CHUNK = 200
_LITERAL = ""  # the chunk of a literal word mark
_CHUNK = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_NONE = np.int32(2**31 - 1)
_EMPTY = np.int64(2**63 - 1)
_CODECS: dict[tuple, PieceCodec] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; arithmetic wraps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PieceCodec:
    def __init__(self, path: str, rate: float = 0.1, seed: int = 0, variants: int = 4) -> None:
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.vocab_size()
        plain = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        self.ids = {self.sp.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses a word mark; chunks would not be independent")
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = n  # symbols n + code point: characters without a piece
        score = {i: self.sp.get_score(i) for i in plain}
        levels = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (levels[score[i]], i)
        self.pair_of, self.pairs = pairs, PairTable(pairs)
        self.rate, self.seed, self.variants = rate, seed, variants
        self.limit = np.uint64(min(int(rate * 2.0**64), 2**64 - 1))
        self.of_point = np.arange(0x110000, dtype=np.int32) + np.int32(self.unknown)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_point[ord(piece)] = i
        self.literal = np.array([self.bytes[b] for b in MARK.encode()], np.int32).tobytes()
        self.known: list[dict[str, bytes]] = [{} for _ in range(variants)]
        self.older: list[dict[str, bytes]] = [{} for _ in range(variants)]

    # -- merging

    def _symbols(self, chunk: str) -> list[int]:
        return [self.ids.get(c, self.unknown + ord(c)) for c in chunk]

    def _key(self, variant: int, chunk: str) -> int:
        return xxhash.xxh64_intdigest(f"{self.seed}:{variant}:{chunk}".encode())

    def _skipped(self, key: np.ndarray, left: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        place = (left.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)
        return _mix(key ^ _mix(place)) < self.limit

    def merge_long(self, variant: int, chunk: str) -> list[int]:
        """One chunk by a heap: O(n log n) however long it is."""
        sym = self._symbols(chunk)
        n = len(sym)
        prev, nxt, stop, alive = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1)), [True] * n
        key, agenda = np.array([self._key(variant, chunk)], np.uint64), []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (pair := self.pair_of.get((sym[i], sym[j]))):
                heapq.heappush(agenda, (pair[0], i, j, stop[j], pair[1]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, j, end, merged = heapq.heappop(agenda)
            if not alive[i] or j >= n or not alive[j] or nxt[i] != j or stop[j] != end or self.pair_of.get((sym[i], sym[j]), (0, -1))[1] != merged:
                continue
            if self.rate and self._skipped(key, np.array([i]), np.array([j]), np.array([end]))[0]:
                continue
            sym[i], stop[i], alive[j] = merged, end, False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return [s for s, a in zip(sym, alive, strict=True) if a]

    def _offered(self, keys: np.ndarray, symbols: np.ndarray, left: np.ndarray, middle: np.ndarray, end: np.ndarray, at: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged symbols of the candidates at places `at` = (left, middle) of `symbols`; skipped ones have no rank."""
        rank, merged = self.pairs.find(symbols[at[0]], symbols[at[1]])
        if self.rate:
            some = np.flatnonzero(rank != _NONE)
            rank[some[self._skipped(keys[some], left[some], middle[some], end[some])]] = _NONE
        return rank, merged

    def merge_short(self, items: list[tuple[int, str]]) -> list[bytes]:
        """Many chunks side by side: in each round every chunk takes its next candidate. Returns packed piece ids.
        A chunk's candidates stand in `agenda` as rank and place in one number; a merge changes those of its neighbours only."""
        texts_ = [c for _, c in items]
        sizes = np.fromiter(map(len, texts_), np.int64, len(items))
        first = np.cumsum(sizes) - sizes
        symbols = self.of_point[np.frombuffer("".join(texts_).encode("utf-32-le", "surrogatepass"), np.uint32)]
        odd = np.flatnonzero(np.logical_or.reduceat(symbols >= self.unknown, first)).tolist()
        digest, before_chunk = xxhash.xxh64_intdigest, [f"{self.seed}:{v}:" for v in range(self.variants)]  # as `_key`
        keys = np.array([digest(before_chunk[v] + c) for v, c in items], np.uint64)
        n = len(symbols)
        before, after, alive, merged = np.arange(-1, n - 1), np.arange(1, n + 1), np.ones(n, bool), np.zeros(n, np.int32)
        # the candidates of all neighbours
        whole = np.arange(n)
        inner = np.ones(n, bool)
        inner[first + sizes - 1] = False
        inner = whole[inner]
        owner = np.repeat(np.arange(len(items)), sizes)[inner]
        place = inner - first[owner]
        rank, merged[inner] = self._offered(keys[owner], symbols, place, place + 1, place + 2, (inner, inner + 1))
        agenda = np.full(n, _EMPTY)
        agenda[inner] = np.where(rank != _NONE, (rank.astype(np.int64) << 32) | place, _EMPTY)
        # per chunk still at work: first place, one past the last, first place in the agenda, key
        low, high, at, live = first, first + sizes, first, np.ones(len(items), bool)
        while len(low):
            best = np.minimum.reduceat(agenda, at)
            live = best != _EMPTY
            if 2 * np.count_nonzero(live) < len(live):  # only chunks at work stay in the agenda
                long_ = high - low
                agenda = agenda[np.repeat(live, long_)]
                low, high, keys, best = low[live], high[live], keys[live], best[live]
                at = np.cumsum(high - low) - (high - low)
                if not len(low):
                    break
                live = np.ones(len(low), bool)
            go = slice(None) if live.all() else np.flatnonzero(live)
            lo, hi, shift, key = low[go], high[go], (at - low)[go], keys[go]
            i = (best[go] & 0xFFFFFFFF) + lo
            j = after[i]
            end = after[j]
            symbols[i], alive[j], after[i] = merged[i], False, end
            agenda[i + shift] = _EMPTY
            agenda[j + shift] = _EMPTY
            some = np.flatnonzero(end < hi)
            before[end[some]] = i[some]
            more = np.flatnonzero(i > lo)
            # the merged symbol with its right and its left neighbour
            who = np.concatenate((some, more))
            a = np.concatenate((i[some], before[i[more]]))
            b = np.concatenate((end[some], i[more]))
            base = lo[who]
            left = a - base
            rank, merged[a] = self._offered(key[who], symbols, left, b - base, after[b] - base, (a, b))
            agenda[a + shift[who]] = np.where(rank != _NONE, (rank.astype(np.int64) << 32) | left, _EMPTY)
        stops = (4 * np.cumsum(np.add.reduceat(alive, first, dtype=np.int64))).tolist()
        packed = symbols[alive].tobytes()
        done = [packed[start:stop] for start, stop in zip([0, *stops], stops, strict=False)]
        for k in odd:
            done[k] = self._packed(np.frombuffer(done[k], np.int32).tolist())
        return done

    # -- texts

    def _packed(self, symbols: list[int]) -> bytes:
        """Piece ids as 32-bit integers; characters without a piece become their bytes."""
        out: list[int] = []
        for s in symbols:
            if s < self.unknown:
                out.append(s)
            else:
                out.extend(self.bytes[b] for b in chr(s - self.unknown).encode("utf-8", "surrogatepass"))
        return np.array(out, np.int32).tobytes()

    def encode(self, batch: list[tuple[int, str]]) -> list[np.ndarray]:
        """Pieces of each (document id, text)."""
        if sum(map(len, self.known)) > CACHE_CHUNKS // 2:  # two generations: what is still in use moves on
            self.older, self.known = self.known, [{} for _ in self.known]
        for known in self.known:
            known[_LITERAL] = self.literal
        cut, wanted = [], [set() for _ in self.known]
        for doc, text in batch:
            variant = xxhash.xxh64_intdigest(f"{self.seed}/{doc}".encode()) % self.variants if self.rate else 0
            parts = self._chunks(text)
            cut.append((variant, parts))
            wanted[variant].update(parts)
        fresh, ends = [], []
        for v, some in enumerate(wanted):
            known, older = self.known[v], self.older[v]
            missing = some.difference(known)
            kept = [c for c in missing if c in older]
            known.update(zip(kept, map(older.__getitem__, kept), strict=True))
            for c in missing.difference(kept):
                if len(c) <= LONG_CHUNK:
                    fresh.append((v, c))
                else:
                    known[c] = self._packed(self.merge_long(v, c))
            ends.append(len(fresh))
        if fresh:
            merged = self.merge_short(fresh)
            for known, start, stop in zip(self.known, [0, *ends], ends, strict=False):
                known.update(zip([c for _, c in fresh[start:stop]], merged[start:stop], strict=True))
        return [np.frombuffer(b"".join(map(self.known[v].__getitem__, parts)), np.int32) for v, parts in cut]

    def _chunks(self, text: str) -> list[str]:
        """Chunks of a text with spaces written as marks. A literal mark stands alone as a chunk that is never merged."""
        if not text:
            return []
        if MARK not in text:
            words = text.split(" ")
            if "" not in words:  # single spaces only
                return [MARK + w for w in words]
            return _CHUNK.findall(MARK + text.replace(" ", MARK))
        parts = text.split(MARK)
        cut = _CHUNK.findall(MARK + parts[0].replace(" ", MARK))
        for part in parts[1:]:
            cut.append(_LITERAL)
            cut.extend(_CHUNK.findall(part.replace(" ", MARK)))
        return cut

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


def encode_documents(
    docs: DataFrame, model: str, rate: float = 0.1, seed: int = 0, variants: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, pieces (ids), n_pieces, lossless (the pieces decode to the text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = (model, rate, seed, variants)
        codec = _CODECS.get(key) or _CODECS.setdefault(key, PieceCodec(*key))
        for batch in batches:
            rows = list(zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True))
            for a, b in chunks([t for _, t in rows]):
                pieces = codec.encode(rows[a:b])
                same = [codec.decode(p.tolist()) == t for p, (_, t) in zip(pieces, rows[a:b], strict=True)]
                yield pd.DataFrame(
                    {"doc_id": batch["doc_id"].iloc[a:b].to_numpy(), "pieces": pieces, "n_pieces": [len(p) for p in pieces], "lossless": same}
                )

    return texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, pieces array<int>, n_pieces long, lossless boolean")


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """One row per document: doc_id, text. Null pieces decode to the empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = (model, 0.0, 0, 1)
        codec = _CODECS.get(key) or _CODECS.setdefault(key, PieceCodec(*key))
        for batch in batches:
            decoded = [codec.decode([int(i) for i in p]) if p is not None else "" for p in batch["pieces"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": decoded})

    rows = encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{pieces_col}`").alias("pieces"))
    return rows.mapInPandas(run, "doc_id long, text string")
