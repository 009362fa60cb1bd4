"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in blocks of at most 131,072 neighbours. How many rows each block sends to each shard is drawn first, as one
multivariate hypergeometric table whose row sums are the blocks' sizes and whose column sums are the shards' sizes: the
law that a uniform shuffle of all rows gives. The table is drawn down a binary tree over the blocks, each node splitting
its counts between two halves from a generator keyed by seed and node, so every task draws the rows of its own blocks and
repeats them exactly after a loss. Then each block is permuted (the first rows go to the first shard, and so on), rows are
exchanged, and each shard is permuted again, which gives the slots.

Blocks and places come from a written table, so later passes and retried tasks see the same ones. Only the sizes of the
blocks reach the driver (one number for 131,072 rows). Permutations order rows by keyed hashes, ties by place.

Shard sizes differ by one row at most (the first shards hold the extra rows), whatever the sizes of texts, ties or hot sources;
equal texts and repeated rows are rows like any others and may part. With fewer rows than shards some shards are empty. An empty
table gives an empty result. Input columns named shard or slot are replaced. The split depends on the seed and on how
the input lies in partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcast.llm.common import sized
from sparkcast.session import materialize

BLOCK_BITS = 17


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Number of good ones in a sample, by inversion. Weights follow from their ratios outward from the mode, over 12 standard
    deviations and 40 more, beyond which less than 1e-28 of the mass lies (a uniform double resolves 1e-16). Works for populations of any size."""
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    whole = good + bad
    mode = (sample + 1) * (good + 1) // (whole + 2)
    spread = (sample * (good / whole) * (bad / whole) * (whole - sample) / max(whole - 1, 1)) ** 0.5
    reach = int(12 * spread) + 40
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    ratio = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    weight = np.concatenate(([0.0], np.cumsum(ratio)))
    mass = np.cumsum(np.exp(weight - weight.max()))
    return a + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def split_counts(rng: np.random.Generator, counts: list[int], sample: int) -> list[int]:
    """A multivariate hypergeometric draw: how many of each kind are among `sample` of all."""
    left, out = sum(counts), []
    for c in counts:
        x = hypergeometric(rng, c, left - c, sample)
        out.append(x)
        left, sample = left - c, sample - x
    return out


def matrix_rows(sizes: np.ndarray, shards: list[int], seed: int, start: int, stop: int) -> Iterator[tuple[int, list[int]]]:
    """Rows start to stop of the communication matrix. Only nodes of the tree above these rows are drawn."""
    before = np.concatenate(([0], np.cumsum(sizes)))

    def below(low: int, high: int, counts: list[int]) -> Iterator[tuple[int, list[int]]]:
        if high <= start or low >= stop:
            return
        if high - low == 1:
            yield low, counts
            return
        mid = (low + high) // 2
        left = split_counts(np.random.default_rng([seed, low, high]), counts, int(before[mid] - before[low]))
        yield from below(low, mid, left)
        yield from below(mid, high, [c - x for c, x in zip(counts, left, strict=True)])

    if start < stop:
        yield from below(0, len(sizes), shards)


def uniform_shards(rows: DataFrame, shards: int = 24, seed: int = 11) -> DataFrame:
    """All columns of `rows`, and shard (int) and slot (long, gapless from 0 within a shard)."""
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c not in ("shard", "slot")]
    at = F.monotonically_increasing_id()
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), at.alias("at"))
    held = materialize(held, "shard-rows").withColumn("block", F.shiftright("at", BLOCK_BITS))

    found = held.groupBy("block").count().orderBy("block").toPandas()
    blocks, sizes = found["block"].to_numpy(np.int64), found["count"].to_numpy(np.int64)
    total = int(sizes.sum())
    goal = [total // shards + (k < total % shards) for k in range(shards)]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                drawn = list(matrix_rows(sizes, goal, seed, int(batch["id"].iloc[0]), int(batch["id"].iloc[-1]) + 1))
                yield pd.DataFrame({"block": blocks[[i for i, _ in drawn]], "ends": [np.cumsum(c) for _, c in drawn]})

    matrix = spark.range(len(sizes)).mapInPandas(draw, "block long, ends array<long>")
    first = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64(F.lit(2 * seed), "at"), "at")) - 1
    # an end that a place has passed is a shard that lies before
    sent = held.withColumn("place", first).join(matrix, "block").withColumn(
        "shard", F.size(F.filter("ends", lambda end: end <= F.col("place"))).cast("int")
    )
    again = F.xxhash64(F.lit(2 * seed + 1), "at")
    ranges = 1 + total // (shards << BLOCK_BITS)
    sent = materialize(sent.select("row", "at", "shard", again.alias("order"), F.pmod(again, F.lit(ranges)).alias("range")), "shard-sent")

    # A shard is ordered range by range, so that no task holds a whole shard.
    counts = sent.groupBy("shard", "range").count()
    along = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("shard", "range", F.coalesce(F.sum("count").over(along), F.lit(0)).alias("offset")), "shard-offsets")
    within = F.row_number().over(Window.partitionBy("shard", "range").orderBy("order", "at"))
    placed = sent.withColumn("within", within).join(sized(offsets), ["shard", "range"])
    return placed.select("row.*", "shard", (F.col("offset") + F.col("within") - 1).cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str, shards: int = 24, seed: int = 11) -> None:
    """Whole rows as Parquet below `path`, a folder for each shard; each file holds a run of slots in order."""
    placed = uniform_shards(rows, shards, seed)
    run = F.shiftright("slot", BLOCK_BITS)
    placed.repartition("shard", run).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
