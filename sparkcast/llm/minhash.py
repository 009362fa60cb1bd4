"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the 64-bit hashes of its distinct shingles; its sketch keeps the `k` smallest. Documents with
equal sets form one class, which its smallest id stands for. Inverted lists of retained values give the candidates:
sketch values are ordered from the rarest on, and two sets as similar as asked must share a value among the first
few of each, so the values of common lines open no list. In a list every member is first compared with the list's
smallest id. Lists that still hold several components are compared in blocks inside tasks: the sketches of the union
estimate the similarity, the full sets decide, and only links that join components leave a task.

Full sets are confirmed on every link. A document without words is linked with nothing. Null texts are empty.
Rows that repeat an id are one document whose first text in order stands. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.llm.common import components, sized, texts
from sparkcast.llm.shingles import shingle_set
from sparkcast.session import materialize

K = 128
BLOCK = 512
#: A sketch that is cut off estimates the similarity; its bounds are taken this much lower, over four standard errors.
SLACK = 0.14


def _signatures(size: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, whole, sketch = [], [], []
            for text in batch["text"]:
                s = shingle_set(text, size)
                n.append(len(s))
                whole.append(s.tobytes())
                sketch.append((s[:k] >> np.uint64(1)).astype(np.int64))
            import hashlib

            digest = [hashlib.blake2b(w, digest_size=16).hexdigest() for w in whole]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": n, "set_id": digest, "sketch": sketch})

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "shingles": [shingle_set(t, size).tobytes() for t in batch["text"]]})

    return run


def jaccard(a: bytes, b: bytes) -> tuple[int, int]:
    """Sizes of intersection and union of two stored sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common, len(x) + len(y) - common


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [100 * i >= percent * u for i, u in map(jaccard, batch["x"], batch["y"])]
            yield batch.loc[good, ["a", "b"]]

    return run


def _links_in_block(percent: int, k: int):
    """Links between different components in one pair of blocks of a list, at most one for each join of components."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates("doc_id").reset_index(drop=True)
        sets = [np.frombuffer(s, np.uint64) for s in block["shingles"]]
        sizes = np.array([len(s) for s in sets])
        root = {r: r for r in block["root"]}

        def find(r: int) -> int:
            while root[r] != r:
                root[r] = root[root[r]]
                r = root[r]
            return r

        # shared sketch values of all pairs, by a product of incidence slices
        sketches = [s[:k] for s in sets]
        values, code, seen = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sketches])
        shared_codes = np.full(len(values), -1)
        shared_codes[seen > 1] = np.arange(int((seen > 1).sum()))
        code = shared_codes[code]
        owner, code = owner[code >= 0], code[code >= 0]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int((seen > 1).sum()), 2048):
            part = (code >= low) & (code < low + 2048)
            hold = np.zeros((len(sets), 2048), np.float32)
            hold[owner[part], code[part] - low] = 1
            common += hold @ hold.T
        # a sketch that is cut off knows the union only up to its last value
        whole = sizes <= k
        last = np.array([s[-1] if len(s) else 0 for s in sketches], np.uint64)
        last[whole] = np.iinfo(np.uint64).max
        known = np.array([np.searchsorted(s, last, "right") for s in sketches])
        union = known + known.T - common
        floor = np.where(whole[:, None] & whole[None, :], percent / 100 - 1e-6, percent / 100 - SLACK)
        size_ok = 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
        first = block["root"].to_numpy()
        near = np.argwhere(np.triu((common >= floor * union) & size_ok & (first[:, None] != first[None, :]), 1))
        out = []
        for i, j in near:
            a, b = find(first[i]), find(first[j])
            if a != b:
                inter = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                    root[max(a, b)] = min(a, b)
                    out.append((block["doc_id"][i], block["doc_id"][j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _teams(lists: DataFrame, block: int) -> DataFrame:
    """Groups of documents to compare (value, joint, doc_id, root) from lists (value, members, doc_id, root). A family of near
    copies has many long lists with mostly the same documents; these are compared once, as the union of the lists. Every
    document names the longest of its lists, and a list follows the one that most of its members name. Where the union has more pairs
    than the lists have one by one, they stay apart."""
    long_ = lists.filter(F.col("members") > block)
    named = long_.groupBy("doc_id").agg(F.max(F.struct("members", "value")).alias("top"))
    votes = long_.join(named, "doc_id").groupBy("value", "members", F.col("top.value").alias("team")).agg(F.count("*").alias("n"))
    lead = votes.groupBy("value", "members").agg(F.max(F.struct("n", "team")).alias("v")).select("value", "members", "v.team")
    lead = materialize(lead, "teams")
    union = long_.select("value", "doc_id", "root").join(lead.select("value", "team"), "value").select("team", "doc_id", "root").distinct()
    pairs = union.groupBy("team").agg(F.pow(F.count("*"), F.lit(2)).alias("together"))
    cheap = lead.groupBy("team").agg(F.sum(F.pow("members", F.lit(2))).alias("apart")).join(pairs, "team").filter("together <= apart").select("team")
    cheap = materialize(cheap, "joint-teams")
    alone = lists.join(lead.join(cheap, "team").select("value"), "value", "left_anti").select("value", F.lit(False).alias("joint"), "doc_id", "root")
    return alone.union(union.join(cheap, "team").select(F.col("team").alias("value"), F.lit(True).alias("joint"), "doc_id", "root"))


def _dealt(groups: DataFrame, block: int) -> DataFrame:
    """Pairs of blocks (value, joint, i, j, doc_id, root). The members of a group's largest component are linked already: they meet the
    other members only, so rows grow with a group's size times the blocks of documents outside that component. Blocks of
    these others come first; a group of one block stays whole."""
    group = ["value", "joint"]
    groups = materialize(groups, "teamed")
    parts = groups.groupBy(*group, "root").agg(F.count("*").alias("n")).groupBy(*group).agg(F.max(F.struct("n", "root")).alias("core"), F.sum("n").alias("members"))
    count = lambda n: F.ceil(n / block).cast("int")
    small = F.col("members") <= block
    parts = parts.select(
        *group, F.when(~small, F.col("core.root")).alias("core"),
        F.when(small, 1).otherwise(count(F.col("members") - F.col("core.n"))).alias("others"), F.when(small, 0).otherwise(count(F.col("core.n"))).alias("cores"),
    )
    inside = F.coalesce(F.col("root") == F.col("core"), F.lit(False))
    place = F.xxhash64("doc_id")
    rows = groups.join(parts, group).select(
        *group, "doc_id", "root", (F.col("others") + F.col("cores")).alias("blocks"), F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("cores")).alias("met"),
        F.when(inside, F.col("others") + F.pmod(place, F.col("cores"))).otherwise(F.pmod(place, F.col("others"))).cast("int").alias("own"),
    )
    # a block's own pairs are compared with each block that it meets
    meets = F.filter(F.sequence(F.lit(0), F.col("met") - 1), lambda o: (o != F.col("own")) | (F.col("blocks") == 1))
    at = F.explode(F.transform(meets, lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"))))
    return rows.select(*group, "doc_id", "root", at.alias("at")).select(*group, "at.i", "at.j", "doc_id", "root")


def near_duplicate_components(
    docs: DataFrame, percent: int = 80, size: int = 5, k: int = K, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id. Documents are linked when 100 * intersection >=
    percent * union of their sets of `size`-word shingles; the component's id is its smallest document id."""
    rows = texts(docs, id_col, text_col)
    spark = docs.sparkSession
    # classes of equal sets
    signed = rows.mapInPandas(_signatures(size, k), "doc_id long, n long, set_id string, sketch array<long>")
    signed = materialize(signed, "sketches")
    by_set = signed.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    classes = materialize(
        signed.select("doc_id", "n", "set_id").join(by_set, "set_id", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "classes"
    )
    reps = signed.join(sized_ids(classes.filter("n > 0 and doc_id = rep").select("doc_id")), "doc_id", "left_semi")

    # lists of the values that a similar pair must share
    values = reps.select("doc_id", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    scored = values.join(shared, "value").groupBy("doc_id").agg(
        F.first("n").alias("n"), F.first("kept").alias("kept"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("ranked")
    )
    # exact where no similar set is large enough for its sketch to be cut off
    least = F.when(F.col("n") * 100 <= k * percent, F.ceil(F.col("n") * percent / 100)).otherwise(F.ceil(F.col("kept") * (percent / 100 - SLACK)))
    alone = F.col("kept") - F.size("ranked")  # values no other document has come first
    room = (F.col("kept") - least + 1 - alone).cast("int")
    prefix = scored.filter(room > 0).select("doc_id", "n", F.explode(F.slice("ranked", 1, room)).alias("r"))
    lists = materialize(prefix.select(F.col("r.value").alias("value"), "doc_id", "n"), "lists")

    # every member against the smallest of its list
    heads = lists.groupBy("value").agg(F.min(F.struct("doc_id", "n")).alias("head"), F.count("*").alias("members")).filter("members > 1")
    star = lists.join(heads, "value").filter(F.col("doc_id") != F.col("head.doc_id"))
    star = star.filter(100 * F.least("n", "head.n") >= percent * F.greatest("n", "head.n"))
    star = materialize(star.select(F.col("head.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct(), "star")
    members = lists.join(heads.select("value"), "value", "left_semi")
    listed = sized_ids(materialize(members.select("doc_id").distinct(), "listed"))
    sets = materialize(rows.join(listed, "doc_id", "left_semi").mapInPandas(_sets(size), "doc_id long, shingles binary"), "sets")
    pairs = star.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b"
    )
    links = materialize(pairs.select("a", "b", "x", "y").mapInPandas(_confirm(percent), "a long, b long"), "links")
    roots = components(links, "roots")

    # lists that still hold several components, in pairs of blocks
    open_ = members.join(roots, members.doc_id == roots.node, "left").select(
        "value", "doc_id", F.coalesce("root", "doc_id").alias("root")
    )
    several = open_.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"))
    several = several.filter("low < high").select("value", "members")
    # a list whose members are those of another list needs no second look
    whole = open_.join(several, "value").groupBy("value", "members").agg(F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("who"))
    several = whole.groupBy("members", "who").agg(F.min("value").alias("value"))
    open_ = materialize(open_.join(several.select("value", "members"), "value"), "open-lists")
    dealt = _dealt(_teams(open_, block), block)
    dealt = dealt.join(sets, "doc_id").select("value", "joint", "i", "j", "doc_id", "root", "shingles")
    more = dealt.groupBy("value", "joint", "i", "j").applyInPandas(_links_in_block(percent, k), "a long, b long")
    more = materialize(more, "block-links")
    if more.limit(1).count():
        roots = components(links.union(more), "roots")
    joined = classes.join(roots, classes.rep == roots.node, "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def sized_ids(ids: DataFrame) -> DataFrame:
    """Ids hinted for broadcast while they are at most two million (16 MB)."""
    return sized(ids, 2_000_000)
