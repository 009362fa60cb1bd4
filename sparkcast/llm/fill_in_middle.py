"""Fill-in-middle transformation with a sparse index between code points and bytes.

A text is cut into prefix, middle and suffix at two keyed places and laid out anew behind sentinels. Cuts are found
on the UTF-8 bytes as Arrow holds them, without decoding. Code points and bytes part only at multibyte characters, so
the index of a text records these alone: the code point where each one stands and its excess bytes. A binary search
gives the excess before a cut; everywhere else a cut is arithmetic, and an ASCII text has an empty index.

Null and empty texts have no units and stay plain, as do texts that hold a sentinel. A null id is keyed as an empty one.
Repeated rows are cut alike, as the key is the id. Of a text of white space only, the whole is one token. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcast.llm.common import texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class ExceptionIndex:
    """Multibyte characters of one text: their positions in code points and the excess bytes up to each."""

    def __init__(self, raw: np.ndarray) -> None:
        leads = np.flatnonzero(raw >= 0xC0)
        excess = 1 + (raw[leads] >= 0xE0).astype(np.int64) + (raw[leads] >= 0xF0)
        self.size = len(raw)
        self.excess = np.concatenate(([0], np.cumsum(excess)))
        self.points = leads - self.excess[:-1]
        self.offsets = leads

    @property
    def length(self) -> int:
        """Code points of the text."""
        return self.size - int(self.excess[-1])

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        """Byte offsets of cuts given in code points."""
        return points + self.excess[np.searchsorted(self.points, points)]

    def to_points(self, offsets: np.ndarray) -> np.ndarray:
        """Code points of cuts given as byte offsets between characters."""
        return offsets - self.excess[np.searchsorted(self.offsets, offsets)]


def token_ends(raw: np.ndarray) -> np.ndarray:
    """Byte offsets behind each token `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`: a token ends where white space
    follows a visible character, and at the end of the text. White space is ASCII, so no character is torn."""
    if not len(raw):
        return np.zeros(0, np.int64)
    space = _SPACE[raw]
    return np.append(np.flatnonzero(~space[:-1] & space[1:]) + 1, len(raw))


def _cut(raw: np.ndarray, unit: str, h1: int, h2: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of units, and the two cuts in bytes and in code points."""
    index = ExceptionIndex(raw)
    ends = token_ends(raw) if unit == "tokens" else None
    n = index.length if ends is None else len(ends)
    cuts = np.array(sorted((h1 % (n + 1), h2 % (n + 1))), np.int64)
    if ends is None:
        return n, index.to_bytes(cuts), cuts
    at = np.concatenate(([0], ends))[cuts]
    return n, at, index.to_points(at)


def _strings(column: pa.Array) -> Iterator[memoryview]:
    """UTF-8 of every value, as views into the Arrow buffer; nulls are empty."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield view[a:b]


def fill_in_middle(
    docs: DataFrame, seed: int = 42, percent: int = 50, suffix_first: int = 80, unit: str = "tokens",
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n (units), form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output.

    `percent` of the texts are rearranged, of those `suffix_first` percent as spm (suffix, prefix, middle), else psm. `unit` is
    "tokens" or "points" (code points). Lengths are null where the form is plain."""
    if unit not in ("tokens", "points"):
        raise ValueError("cut by tokens or by points")

    def one(key: str | None, text: memoryview) -> tuple:
        h1, h2, h3, h4 = struct.unpack(">4I", hashlib.sha256(f"{seed}:{key or ''}".encode()).digest()[:16])
        raw = np.frombuffer(text, np.uint8)
        n, at, points = _cut(raw, unit, h1, h2)
        whole = bytes(text)
        if not whole or h3 % 100 >= percent or PREFIX in whole or SUFFIX in whole or MIDDLE in whole:
            return n, "plain", None, None, None, None, whole
        a, b = at.tolist()
        if h4 % 100 < suffix_first:
            form, out = "spm", b"".join((SUFFIX, whole[b:], PREFIX, whole[:a], MIDDLE, whole[a:b]))
        else:
            form, out = "psm", b"".join((PREFIX, whole[:a], SUFFIX, whole[b:], MIDDLE, whole[a:b]))
        return n, form, int(points[0]), int(points[1] - points[0]), a, b - a, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes", "output"]
        for batch in batches:
            if not batch.num_rows:
                continue
            done = list(zip(*map(one, batch.column("key").to_pylist(), _strings(batch.column("text"))), strict=True))
            columns = [pa.array(values, kind) for values, kind in zip(done, kinds, strict=True)]
            columns[-1] = columns[-1].view(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    rows = texts(docs, id_col, text_col)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("string").alias("key"), "text")
    return rows.mapInArrow(run, _SCHEMA)


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that an output was made of. Pieces hold no sentinel, so the three marks cut an output just where it was joined."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    pieces = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == "psm", F.concat(pieces[1], pieces[3], pieces[2]))
        .when(form == "spm", F.concat(pieces[2], pieces[3], pieces[1]))
        .otherwise(output)
    )
