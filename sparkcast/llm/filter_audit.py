"""Interaction of quality filters over every order in which they can be applied.

Each document becomes a mask of the filters it fails; documents with the same mask, part and labels are one weighted cell.
A cell folds across the array of all orders with higher-order functions: `transform` takes the orders, `aggregate` walks
one order and carries whether the documents are still there. That gives one struct per order and step (600 for five
filters), and structs at the same place add up over the cells. The work after counting depends on masks and parts only.

Null texts are empty; parts of null count as the empty string; labels may repeat (any row counts) or be missing. A null id
is never a copy of a smaller one nor the smaller one. Rows that repeat an id and its text are no copies of each other. Equal
texts are told by SHA-256. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcast.llm.common import sized
from sparkcast.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_STEP = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">"


def text_rules(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions on one text: few words, few distinct words, many capitals, marks of code."""
    n = F.size(words).cast("long")
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n,
        "C": 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def _mask(rules: Mapping[str, Column], letters: str) -> Column:
    bits = [F.when(rule, 1 << letters.index(letter)).otherwise(0) for letter, rule in rules.items()]
    return sum(bits[1:], bits[0]).cast("int")


def failure_cells(docs: DataFrame, labels: DataFrame, letters: str = "ABCDE", copies: str = "E") -> DataFrame:
    """Cells (part, mask, good, toxic, n). Bit i of `mask` says that the filter `letters[i]` fails; the bit of `copies` that
    a smaller id has the same text."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE, -1), ""))
    rules = text_rules(F.col("text"), F.col("words"))
    rows = materialize(
        rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _mask(rules, letters).alias("mask")), "audit-rows"
    )
    # The smallest id of each text, met on text and id together: copies of one text are dealt by their ids, so no text is hot.
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    heads = first.filter("first is not null").select(F.col("digest").alias("digest_"), F.col("first"), F.lit(True).alias("is_first"))
    rows = rows.join(heads, (F.col("digest") == F.col("digest_")) & (F.col("doc_id") == F.col("first")), "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    rows = rows.select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << letters.index(copies)).otherwise(0)).alias("mask"))
    flags = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    flags = sized(materialize(flags.filter("good or toxic"), "audit-flags"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c)
    return rows.join(flags, "doc_id", "left").groupBy("part", "mask", no("good"), no("toxic")).agg(F.count("*").alias("n"))


def order_effects(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step.

    `shapley` is what the filter of the step removes, summed over all orders and over the step where it stands."""
    every = ["".join(o) for o in permutations(letters)]
    orders = F.from_json(F.lit(json.dumps([[letters.index(x) for x in o] for o in every])), "array<array<int>>")
    names = F.from_json(F.lit(json.dumps(every)), "array<string>")
    mask, n = F.col("mask"), F.col("n")

    def meet(state: Column, bit: Column) -> Column:
        fails = F.getbit(mask, bit) == 1
        here = state["here"]
        count = lambda c, weight=n: F.when(c, weight).otherwise(F.lit(0)).cast("long")
        step = F.struct(
            count(here & ~fails), count(here & fails), count(~here & fails), count(mask == F.call_function("shiftleft", F.lit(1), bit)),
            count(here & fails, n * F.col("good")), count(here & fails, n * F.col("toxic")),
        ).cast(_STEP)
        return F.struct((here & ~fails).alias("here"), F.concat(state["steps"], F.array(step)).alias("steps"))

    def walk(order: Column) -> Column:
        start = F.struct(F.lit(True).alias("here"), F.array().cast(f"array<{_STEP}>").alias("steps"))
        return F.aggregate(order, start, meet, lambda state: state["steps"])

    # Elementwise sums: places of the arrays add up, combined before the shuffle.
    places = cells.select("part", F.posexplode(F.flatten(F.transform(orders, walk))).alias("place", "s"))
    sums = places.groupBy("part", "place").agg(*[F.sum(f"s.{c}").alias(c) for c in COUNTS])
    k = len(letters)
    named = sums.withColumn("filter_order", F.element_at(names, F.floor(F.col("place") / k).cast("int") + 1)).withColumn("step", (F.col("place") % k + 1).cast("int"))
    same = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return named.select("part", "filter_order", "step", *COUNTS, F.sum("removed").over(same).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E over whole texts, in all 120 orders, by part (`lang`)."""
    return order_effects(materialize(failure_cells(docs, labels), "audit-cells"))
