"""URL filtering with a sorted digest array.

Rules are (host, path prefix, verdict). Their keys, `host + path`, are kept as one sorted array of 64-bit xxhash
values with the full strings beside it. The two files go to the shared folder, Spark hands them to every
executor, and workers map them into memory. A URL is probed with every host suffix and every path length that
occurs among the rules; hits are confirmed on the full string, so a digest collision cannot decide.

Null URLs and URLs without `://` have an empty host and path and meet no rule. An empty rule list matches nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcast.session import scratch_path

Rule = tuple[str, str, str]  # verdict, host, path prefix
_MAPPED: dict[str, DigestArray] = {}
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _pack(rules: Iterable[Rule]) -> tuple[bytes, bytes]:
    """Two files: rows (digest, start, end) sorted by digest and string, and the strings `verdict host path` in that order.
    Of rules with the same host and path, a block rule wins."""
    best: dict[tuple[str, str], str] = {}
    for verdict, host, path in rules:
        key = (host.translate(_UPPER), path)
        best[key] = "block" if "block" in (verdict, best.get(key)) else verdict
    rows = sorted((xxhash.xxh64_intdigest((h + p).encode()), h, p, v) for (h, p), v in best.items())
    blob, spans = b"", []
    for digest, h, p, v in rows:
        entry = f"{v}\t{h}\t{p}".encode()
        spans.append((digest, len(blob), len(blob) + len(entry)))
        blob += entry
    return np.array(spans, dtype=np.uint64).reshape(-1, 3).tobytes(), blob


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one file with Hadoop's file system, whatever store the shared folder is in, and hand it out."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path)


class DigestArray:
    """The mapped array in one worker."""

    def __init__(self, name: str) -> None:
        spans = SparkFiles.get(f"{name}.keys")
        size = np.memmap(spans, dtype=np.uint8, mode="r").size if _size(spans) else 0
        self.rows = np.memmap(spans, dtype=np.uint64, mode="r").reshape(-1, 3) if size else np.zeros((0, 3), np.uint64)
        self.keys = np.ascontiguousarray(self.rows[:, 0]) if size else np.zeros(0, np.uint64)
        blob = SparkFiles.get(f"{name}.text")
        self.blob = np.memmap(blob, dtype=np.uint8, mode="r") if _size(blob) else np.zeros(0, np.uint8)
        self.lengths = sorted({len(self.entry(i)[2]) for i in range(len(self.keys))})

    def entry(self, i: int) -> tuple[str, str, str]:
        verdict, host, path = bytes(self.blob[int(self.rows[i, 1]) : int(self.rows[i, 2])]).decode().split("\t")
        return verdict, host, path

    def find(self, probes: list[tuple[str, str]]) -> list[tuple[str, str, str] | None]:
        """The rule of each (host, path) probe, or None: one binary search over all probes, then full strings."""
        digests = np.fromiter((xxhash.xxh64_intdigest((h + p).encode()) for h, p in probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, digests)
        found: list[tuple[str, str, str] | None] = [None] * len(probes)
        for k in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, max(len(self.keys) - 1, 0))] == digests)) if len(self.keys) else ():
            i = int(at[k])
            while i < len(self.keys) and self.keys[i] == digests[k]:
                rule = self.entry(i)
                if (rule[1], rule[2]) == probes[k]:
                    found[k] = rule
                i += 1
        return found


def _size(path: str) -> int:
    with open(path, "rb") as f:
        return f.seek(0, 2)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty when it is null or has no `://`."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    host_end = slash if slash >= 0 else end
    return rest[:host_end].translate(_UPPER), rest[host_end:end]


def _judge(urls: list[str | None], array: DigestArray, default: str) -> list[tuple[str, str, str | None, str]]:
    parts = [split_url(u) for u in urls]
    probes, owner = [], []
    for k, (host, path) in enumerate(parts):
        if not host:
            continue
        suffix = host
        while True:
            for n in array.lengths:
                if n <= len(path):
                    probes.append((suffix, path[:n]))
                    owner.append(k)
            if "." not in suffix:
                break
            suffix = suffix.split(".", 1)[1]
    best: dict[int, tuple[str, str, str]] = {}
    for k, rule in zip(owner, array.find(probes), strict=True):
        if rule and (k not in best or len(rule[1] + rule[2]) > len(best[k][1] + best[k][2])):
            best[k] = rule
    return [(h, p, best[k][1] + best[k][2] if k in best else None, best[k][0] if k in best else default) for k, (h, p) in enumerate(parts)]


def filter_urls(
    pages: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. A rule fits its host and every subdomain when the
    path starts with its own; the longest wins. URLs without a rule are not in the array and get `default`."""
    spark = pages.sparkSession
    name = f"urls-{uuid.uuid4().hex}"
    folder = scratch_path(spark, "digest-array")
    for suffix, data in zip((".keys", ".text"), _pack(rules), strict=True):
        _put(spark, f"{folder}/{name}{suffix}", data)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = _MAPPED.get(name) or _MAPPED.setdefault(name, DigestArray(name))
        for batch in batches:
            urls = [None if pd.isna(u) else u for u in batch["url"].array]
            judged = pd.DataFrame(_judge(urls, array, default), columns=["host", "path", "rule", "verdict"], dtype=object)
            judged.insert(0, "page_id", batch["page_id"].array)
            yield judged

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    return rows.mapInPandas(probe, "page_id long, host string, path string, rule string, verdict string")
