"""Hashes of words and word shingles of one text, in arrays."""

from __future__ import annotations

import numpy as np

_FACTOR = np.uint64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2^64
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, 0 to n."""
    if len(_POWERS["up"]) <= n:
        size = max(n + 1, 2 * len(_POWERS["up"]))
        inverse = np.uint64(pow(int(_FACTOR), -1, 2**64))
        for name, base in (("up", _FACTOR), ("down", inverse)):
            _POWERS[name] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, base, np.uint64))))
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, stop), equal for equal bytes wherever they stand."""
    up, down = powers(len(data))
    run = np.concatenate(([np.uint64(0)], np.cumsum(_TABLE[data] * up[: len(data)])))
    return mix((run[stops] - run[starts]) * down[starts])


def run_hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of hashes [start, stop), equal for equal runs wherever they stand."""
    up, down = powers(len(values))
    run = np.concatenate(([np.uint64(0)], np.cumsum(values * up[: len(values)])))
    return mix((run[stops] - run[starts]) * down[starts])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs without white space."""
    solid = np.concatenate(([False], ~_SPACE[data], [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


def shingle_hashes(text: str, size: int = 5) -> np.ndarray:
    """Hashes of the shingles of a text in order; a text of fewer words has its whole sequence as one."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    starts, stops = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = span_hashes(data, starts, stops)
    width = min(size, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = mix(total * _FACTOR + words[k : k + len(total)])
    return total


def joined_hashes(texts: list[str], size: int = 5, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of several texts one behind another and how many each has; texts of fewer than `least` shingles have none."""
    parts = [text.encode("utf-8", "surrogatepass").lower() for text in texts]
    data = np.frombuffer(b" ".join(parts), np.uint8)
    starts, stops = word_spans(data)
    begins = np.cumsum([0, *(len(part) + 1 for part in parts)])
    counts = np.diff(np.searchsorted(starts, begins))
    counts[counts < least + size - 1] = 0
    sizes = np.maximum(counts - size + 1, 0)
    if not sizes.any():
        return np.zeros(0, np.uint64), sizes
    words = span_hashes(data, starts, stops)
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = mix(total * _FACTOR + words[k : k + len(total)])
    # shingles that begin in a text and end in it
    firsts = np.searchsorted(starts, begins[:-1])
    places = np.arange(sizes.sum()) + np.repeat(firsts - np.cumsum(sizes) + sizes, sizes)
    return total[places], sizes


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    return np.unique(shingle_hashes(text, size))
