"""Boosted regression trees on histograms, grown level by level for many models at once.

Features are small integers (bins). A level needs, for each open node, the sums of gradients and rows by feature and bin;
splits follow from these alone. Of two siblings only the smaller one is summed, the other is parent less sibling. Gradients
are rounded to whole multiples of a unit, so that sums do not depend on their order and a repeated task gives the same tree.

`grow_pooled` takes the sums from Spark: one aggregate per level for all models (trials and evaluation windows) together. What
reaches the driver is one level's histograms: models x nodes x features x bins, whatever the number of rows. `grow_local` takes
them from the rows of one series inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.session import materialize

REFRESH = 10  # trees after which the rows' predictions are written anew
SUMS = "model int, node int, cell int, g double, n double"


@dataclass(frozen=True)
class TreeParams:
    """`l1` and `l2` shrink the values of leaves; `patience` is the number of trees without a better score on held rows."""

    max_iter: int = 50
    max_depth: int = 4
    step_size: float = 0.1
    subsample: float = 1.0
    feature_share: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    min_rows: int = 1
    patience: int = 50


@dataclass
class Tree:
    """Nodes in heap order: the children of node k are 2k and 2k + 1. Rows with a bin above the cut go to the right."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 << depth
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.ones(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(len(self.value).bit_length() - 2):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            right = bins[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + right, at)
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


@dataclass
class Model:
    base: float
    unit: float
    gain: np.ndarray
    trees: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)

    def predict(self, bins: np.ndarray, start: int = 0) -> np.ndarray:
        total = np.zeros(len(bins))
        for tree in self.trees[start:]:
            total += tree.predict(bins)
        return total

    def note_error(self, error: float, patience: int) -> bool:
        """Take the error on held rows after the trees so far; true when growing should end, with the best number of trees kept."""
        self.errors.append(error)
        best = int(np.argmin(self.errors))
        if len(self.errors) - 1 - best < patience:
            return False
        self.keep_best()
        return True

    def keep_best(self) -> None:
        if self.errors:
            del self.trees[int(np.argmin(self.errors)) :]


def gradient_unit(largest: float, rows: float) -> float:
    """Step of rounded gradients: sums of so many rows stay whole numbers that a double holds exactly."""
    return max(largest, 1e-300) * max(rows, 1.0) / 2.0**52


class Growth:
    """One tree in the making. `wanted` names the nodes whose histograms the next call of `accept` must bring."""

    def __init__(self, model: Model, params: TreeParams, features: int, seed: Sequence[int]):
        self.model, self.params = model, params
        self.tree = Tree.empty(params.max_depth)
        rng = np.random.default_rng(list(seed))
        keep = max(1, round(params.feature_share * features))
        self.allowed = np.zeros(features, bool)
        self.allowed[rng.permutation(features)[:keep]] = True
        self.seed = int(rng.integers(2**62))
        self.wanted, self._level, self._sibling = [1], 0, {}

    def sample(self, keys: np.ndarray) -> np.ndarray | None:
        """Rows that this tree learns from, chosen by a hash of their key; None stands for all."""
        if self.params.subsample >= 1.0:
            return None
        mixed = (keys.astype(np.uint64) ^ np.uint64(self.seed)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(11)).astype(float) * 2.0**-53 < self.params.subsample

    def _score(self, g: np.ndarray, n: np.ndarray) -> np.ndarray:
        kept = np.maximum(np.abs(g) - self.params.l1, 0.0)
        return np.divide(kept * kept, n + self.params.l2, out=np.zeros_like(kept), where=n > 0)

    def _value(self, g: float, n: float) -> float:
        return self.params.step_size * float(np.sign(g) * max(abs(g) - self.params.l1, 0.0) / max(n + self.params.l2, 1.0))

    def accept(self, sums: Mapping[int, np.ndarray]) -> bool:
        """Split the nodes of this level; `sums` has (features, bins, [gradient, rows]) for each wanted node. False when the tree is done."""
        level = dict(sums)
        for node, (other, parent) in self._sibling.items():
            level[other] = parent - sums[node]
        self.wanted, self._sibling = [], {}
        self._level += 1
        unit, floor = self.model.unit, max(self.params.min_rows, 1)
        for node in sorted(level):
            hist = level[node]
            g, n = float(hist[0, :, 0].sum()) * unit, float(hist[0, :, 1].sum())
            if node == 1:
                self.tree.value[1] = self._value(g, n)
            left = hist.cumsum(axis=1)[:, :-1]
            gl, nl = left[..., 0] * unit, left[..., 1]
            gain = self._score(gl, nl) + self._score(g - gl, n - nl)
            gain[~((nl >= floor) & (n - nl >= floor) & self.allowed[:, None])] = -np.inf
            gain -= self._score(np.array(g), np.array(n))
            best = gain.max(initial=-np.inf)
            if not best > 1e-9 * abs(g * g / max(n, 1.0)) + 1e-12 * unit:
                continue
            # equal gains up to noise: the first feature, then the lowest cut
            f, b = divmod(int(np.argmax(gain >= best * (1 - 1e-9))), gain.shape[1])
            self.tree.feature[node], self.tree.cut[node] = f, b
            self.tree.value[2 * node], self.tree.value[2 * node + 1] = self._value(gl[f, b], nl[f, b]), self._value(g - gl[f, b], n - nl[f, b])
            self.model.gain[f] += gain[f, b]
            if self._level < self.params.max_depth:
                small, large = (2 * node, 2 * node + 1) if 2 * nl[f, b] <= n else (2 * node + 1, 2 * node)
                self.wanted.append(small)
                self._sibling[small] = (large, hist)
        if self.wanted:
            return True
        self.model.trees.append(self.tree)
        return False


def histograms(bins: np.ndarray, nodes: np.ndarray, whole: np.ndarray, wanted: Sequence[int], width: int) -> np.ndarray:
    """(wanted node, feature, bin, [gradient, rows]) of rounded gradients."""
    slot = np.full(int(nodes.max(initial=0)) + max(wanted) + 1, -1, np.int64)
    slot[list(wanted)] = np.arange(len(wanted))
    own = slot[nodes]
    rows = np.flatnonzero(own >= 0)
    features = bins.shape[1]
    size = len(wanted) * features * width
    cell = ((own[rows, None] * features + np.arange(features)) * width + bins[rows]).ravel()
    g = np.bincount(cell, weights=np.repeat(whole[rows], features), minlength=size)
    n = np.bincount(cell, minlength=size)
    return np.stack([g, n], axis=-1).reshape(len(wanted), features, width, 2)


def grow_local(
    bins: np.ndarray, y: np.ndarray, held: np.ndarray, keys: np.ndarray, width: int, params: TreeParams, seed: int
) -> Model:
    """A model of the rows of one series; `held` rows only decide when to stop."""
    x, z, own = bins[~held], y[~held], keys[~held]
    base = float(z.mean())
    model = Model(base, gradient_unit(float(np.abs(z - base).max(initial=0.0)) * 4, len(z)), np.zeros(bins.shape[1]))
    ahead, past = np.full(len(z), base), np.full(int(held.sum()), base)
    for t in range(params.max_iter):
        if held.any() and model.note_error(float(((y[held] - past) ** 2).mean()), params.patience):
            return model
        growth = Growth(model, params, bins.shape[1], (seed, t))
        whole = np.rint((z - ahead) / model.unit)
        taken = growth.sample(own)
        rows = slice(None) if taken is None else np.flatnonzero(taken)
        part, whole = x[rows], whole[rows]
        while True:
            found = histograms(part, growth.tree.nodes(part), whole, growth.wanted, width)
            if not growth.accept(dict(zip(growth.wanted, found, strict=True))):
                break
        ahead += growth.tree.predict(x)
        past += growth.tree.predict(bins[held])
    if held.any():
        model.errors.append(float(((y[held] - past) ** 2).mean()))
        model.keep_best()
    return model


def _matrix(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def grow_pooled(
    rows: DataFrame, features: int, width: int, params: Sequence[TreeParams], seed: int = 42
) -> dict[tuple[int, int], Model]:
    """Models by (trial, window). `rows`: window, held, key, y, bins (binary, one byte a feature). All trials see the same rows."""
    facts = rows.filter("not held").groupBy("window").agg(F.avg("y").alias("base"), F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), F.lit(1))
    facts = {r["window"]: r for r in facts.collect()}  # one row per window
    stops = {r["window"] for r in rows.filter("held").select("window").distinct().collect()}
    models: dict[tuple[int, int], Model] = {}
    for w, r in sorted(facts.items()):
        spread = max(r["high"] - r["base"], r["base"] - r["low"])
        for t in range(len(params)):
            models[t, w] = Model(float(r["base"]), gradient_unit(4 * spread, r["n"]), np.zeros(features))
    names = list(models)
    open_ = {k for k in models if params[k[0]].max_iter > 0}
    written = dict.fromkeys(names, 0)
    state = _with_predictions(rows, models, written, len(params), fresh=True)
    step = 0
    while open_:
        growths = {k: Growth(models[k], params[k[0]], features, (seed, k[0], step)) for k in sorted(open_)}
        first = True
        while growths:
            found = _level_sums(state, names, models, written, growths, width, stops if first else set())
            for k in list(growths):
                if first and k[1] in stops:
                    sse, n = found.pop((names.index(k), 0))
                    if models[k].note_error(sse / n, params[k[0]].patience):
                        del growths[k]
                        open_.discard(k)
                        continue
                empty = np.zeros((features, width, 2))
                sums = {node: found.get((names.index(k), node), empty) for node in growths[k].wanted}
                if not growths[k].accept(sums):
                    del growths[k]
            first = False
        step += 1
        ended = {k for k in open_ if step >= params[k[0]].max_iter}
        last = {k for k in ended if k[1] in stops}
        if last:
            errors = _level_sums(state, names, models, written, dict.fromkeys(last), width, stops)
            for k in last:
                sse, n = errors[names.index(k), 0]
                models[k].errors.append(sse / n)
                models[k].keep_best()
        open_ -= ended
        if open_ and step % REFRESH == 0:
            written = {k: len(m.trees) for k, m in models.items()}
            state = _with_predictions(rows, models, written, len(params), fresh=False, before=state)
    return models


def _with_predictions(
    rows: DataFrame, models: Mapping[tuple[int, int], Model], upto: Mapping[tuple[int, int], int], trials: int, fresh: bool,
    before: DataFrame | None = None,
) -> DataFrame:
    """The rows with what each trial predicts for them by its trees so far, written once to the shared folder."""
    start = {k: 0 if fresh else max(0, n - REFRESH) for k, n in upto.items()}

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for w, part in pdf.groupby("window", sort=False):
                bins = _matrix(part["bins"], np.uint8)
                made = np.zeros((len(part), trials)) if fresh else _matrix(part["made"], np.float64).copy()
                for t in range(trials):
                    if (t, w) in models:
                        model = models[t, w]
                        made[:, t] += model.base if fresh else 0.0
                        made[:, t] += model.predict(bins, start[t, w])
                out.append(part.assign(made=[row.tobytes() for row in made]))
            if out:
                yield pd.concat(out)

    source = rows if before is None else before
    known = source.select("window", "held", "key", "y", "bins", *([] if fresh else ["made"]))
    return materialize(known.mapInPandas(add, "window int, held boolean, key long, y double, bins binary, made binary"), "tree-rows")


def _level_sums(
    state: DataFrame, names: Sequence[tuple[int, int]], models: Mapping[tuple[int, int], Model], written: Mapping[tuple[int, int], int],
    growths: Mapping[tuple[int, int], Growth | None], width: int, stops: set[int],
) -> dict[tuple[int, int], Any]:
    """Histograms of all wanted nodes by (model, node); of models with held rows also (squared error, rows) under node 0."""
    number = {k: i for i, k in enumerate(names)}

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        errors: dict[int, list[float]] = {}
        for pdf in batches:
            for w, part in pdf.groupby("window", sort=False):
                bins, made = _matrix(part["bins"], np.uint8), _matrix(part["made"], np.float64)
                y, held, keys = part["y"].to_numpy(float), part["held"].to_numpy(bool), part["key"].to_numpy(np.int64)
                for k, growth in growths.items():
                    if k[1] != w:
                        continue
                    model, i = models[k], number[k]
                    rest = y - made[:, k[0]] - model.predict(bins, written[k])
                    if w in stops:
                        entry = errors.setdefault(i, [0.0, 0.0])
                        entry[0] += float((rest[held] ** 2).sum())
                        entry[1] += float(held.sum())
                    if growth is None:
                        continue
                    taken = growth.sample(keys)
                    use = np.flatnonzero(~held if taken is None else ~held & taken)
                    own = bins[use]
                    found = histograms(own, growth.tree.nodes(own), np.rint(rest[use] / model.unit), growth.wanted, width)
                    for node, hist in zip(growth.wanted, found, strict=True):
                        sums[i, node] = sums[i, node] + hist if (i, node) in sums else hist
        for (i, node), hist in sums.items():
            flat = hist.reshape(-1, 2)
            cell = np.flatnonzero(flat[:, 1])
            yield pd.DataFrame({"model": i, "node": node, "cell": cell, "g": flat[cell, 0], "n": flat[cell, 1]})
        if errors:
            yield pd.DataFrame({"model": list(errors), "node": 0, "cell": 0, "g": [e[0] for e in errors.values()], "n": [e[1] for e in errors.values()]})

    total = state.mapInPandas(add_up, SUMS).groupBy("model", "node", "cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toPandas()
    out: dict[tuple[int, int], Any] = {}
    for (i, node), part in total.groupby(["model", "node"]):
        if node == 0:
            out[i, 0] = (float(part["g"].iloc[0]), float(part["n"].iloc[0]))
            continue
        hist = np.zeros((len(models[names[i]].gain) * width, 2))
        hist[part["cell"].to_numpy()] = part[["g", "n"]].to_numpy()
        out[i, node] = hist.reshape(-1, width, 2)
    return out
