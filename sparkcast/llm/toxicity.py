"""Toxicity by maximum-scoring segments.

Terms are words and, for words unseen in training, the class of their first letters. Their log-odds between toxic and
clean training texts carry a Dirichlet prior in proportion to the term's overall document counts. A linear scan over the token
scores of a text finds every maximal-scoring segment. For random clean text the best score follows an extreme-value
law: scale from the score distribution of clean tokens, size from the exceedances of clean training documents.
Segments whose expected number in a text of that length is under `significance` are toxic passages; their summed
evidence goes through a one-variable logistic curve to a score from 0 to 1.

The fit uses at most `fit_rows` labelled rows, those with the smallest id hashes. Labels of rows with
crc32(id) mod 5 = 0 are never read. Null and empty texts have no passages and get the score of no evidence. Labels
that are null are left out; of repeated labels the largest counts. Without labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcast.llm.common import texts
from sparkcast.session import materialize

FIT_ROWS = 20_000
MAX_TERMS = 20_000
CLASS_LETTERS = 4
PRIOR_SHARE = 0.01
PASSAGE_DRIFT = 0.1
SIGNIFICANCE = 0.05
_TOKEN = re.compile(r"[^\W_]+")
_RANGE = (-12.0, 60.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


@dataclass
class ToxicModel:
    terms: dict[str, float]
    drift: float = 0.0
    scale: float = 1.0
    log_size: float = 0.0
    intercept: float = -50.0
    slope: float = 0.0

    def token_scores(self, tokens: list[str]) -> np.ndarray:
        get, default = self.terms.get, -self.drift
        return np.array([s if (s := get(t)) is not None else get("^" + t[:CLASS_LETTERS], default) for t in tokens])

    def segments(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """All maximal-scoring segments (start, stop, score), left to right, in linear time. Only positive tokens open a segment; the list keeps
        candidates with the sums before and after them, and a new one absorbs what it dominates."""
        total = np.concatenate(([0.0], np.cumsum(scores)))
        held: list[tuple[int, int, float, float]] = []  # start, stop, sum before, sum after
        for k in np.flatnonzero(scores > 0):
            start, low, high = int(k), total[k], total[k + 1]
            stop = start + 1
            while True:
                j = len(held) - 1
                while j >= 0 and held[j][2] >= low:
                    j -= 1
                if j < 0 or held[j][3] >= high:
                    held.append((start, stop, low, high))
                    break
                start, low = held[j][0], held[j][2]
                del held[j:]
        return [(a, b, float(hi - lo)) for a, b, lo, hi in held]

    def evidence(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Summed evidence of the significant segments, or that of the best one if none is; and the significant ones."""
        tokens = _TOKEN.findall(text.lower())
        if not tokens:
            return _RANGE[0], []
        size = self.log_size + math.log(len(tokens))
        raised = [(a, b, self.scale * s - size) for a, b, s in self.segments(self.token_scores(tokens))]
        strong = [x for x in raised if x[2] > -math.log(SIGNIFICANCE)]
        value = sum(x[2] for x in strong) if strong else max((x[2] for x in raised), default=_RANGE[0])
        return min(max(value, _RANGE[0]), _RANGE[1]), strong

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(max(self.intercept + self.slope * evidence, -50), 50)))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        by_label: list[Counter] = [Counter(), Counter()]
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            words = set(_TOKEN.findall(text.lower()))  # a term counts once in a document
            by_label[toxic].update(words)
            by_label[toxic].update({"^" + w[:CLASS_LETTERS] for w in words})
        terms = list(by_label[0].keys() | by_label[1].keys())
        yield pd.DataFrame({"term": terms, "clean": [by_label[0][t] for t in terms], "bad": [by_label[1][t] for t in terms]})


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted one-variable logistic regression with a light ridge, by Newton's method."""
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        grad = design.T @ (w * (y - p)) - 1e-2 * beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, max_terms: int = MAX_TERMS) -> ToxicModel:
    """Fit on labelled training rows. What reaches the driver: at most `max_terms` terms, sums, and a histogram of fixed range."""
    rows = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = F.broadcast(materialize(rows, "fit-rows"))  # at most fit_rows rows
    train = texts(docs).join(sample, "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    counts = materialize(train.mapInPandas(_count, "term string, clean long, bad long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")), "toxic-terms")
    total = counts.filter(~F.col("term").startswith("^")).agg(F.sum("clean"), F.sum("bad")).first()
    n_clean, n_bad = int(total[0] or 0), int(total[1] or 0)
    if not n_clean or not n_bad:
        return ToxicModel({})
    mass = PRIOR_SHARE * (n_clean + n_bad)
    prior = (F.col("clean") + F.col("bad")) * PRIOR_SHARE
    odds = lambda y, n: F.log((F.col(y) + prior) / (n + mass - F.col(y) - prior))
    scored = counts.withColumn("score", odds("bad", n_bad) - odds("clean", n_clean)).withColumn(
        "z", F.col("score") / F.sqrt(1 / (F.col("bad") + prior) + 1 / (F.col("clean") + prior))
    )
    picked = scored.filter("z > 3 and score > 1").orderBy(F.col("z").desc(), "term").limit(max_terms).collect()
    words = [r for r in picked if not r["term"].startswith("^")]
    model = ToxicModel({r["term"]: float(r["score"]) for r in picked}, PASSAGE_DRIFT)
    # scale of the extreme-value law: the positive root of sum p exp(scale * score) = 1 over clean tokens
    p = np.array([r["clean"] + 0.5 for r in words]) / n_clean
    s = np.array([r["score"] for r in words])
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        excess = (p * np.exp(np.minimum(mid * s, 600))).sum() + (1 - p.sum()) * math.exp(-mid * model.drift) - 1
        low, high = (mid, high) if excess < 0 else (low, mid)
    model.scale = max(low, 0.05) if len(words) else 1.0
    bins = lambda m: {(r["x"], r["toxic"]): r["count"] for r in train.mapInPandas(_evidence(m), "toxic int, x double").groupBy("x", "toxic").count().collect()}
    # size: the share of clean documents above a point gives it, as P(above t) = 1 - exp(-size * exp(-t))
    found = bins(model)
    clean = sorted((x, n) for (x, toxic), n in found.items() if not toxic)
    docs_clean, above, point = sum(n for _, n in clean), 0, 0.0
    for x, n in reversed(clean):
        if above + n > 0.05 * docs_clean:
            break
        above, point = above + n, x
    model.log_size = math.log(-math.log1p(-(above + 0.5) / (docs_clean + 1))) + point
    found = bins(model)
    x, y, w = (np.array(v, float) for v in zip(*((x, t, n) for (x, t), n in found.items()), strict=True))
    model.intercept, model.slope = _logistic(x, y, w)
    return model


def _evidence(model: ToxicModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "x": [round(model.evidence(t)[0], 1) for t in batch["text"]]})

    return run


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_passages, passages ("start:stop" in words, comma-joined)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.evidence(t) for t in batch["text"]]
            p = [model.probability(x) for x, _ in found]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": p, "predicted": [int(v >= 0.5) for v in p],
                    "n_passages": [len(s) for _, s in found], "passages": [",".join(f"{a}:{b}" for a, b, _ in s) for _, s in found],
                }
            )

    rows = texts(docs, id_col, text_col).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, n_passages int, passages string")
