"""Quality classifier: a generalised additive model with pairwise interactions.

Fitting: each feature is cut into at most BINS bins at its quantiles. Round after round, every feature in
turn gets a shallow regression tree over its own bins, fitted to the log-loss gradient of all the
features so far; the tree is added, shrunken, to the feature's lookup table. Then the pairs of features
whose joint quadrants explain most of what is left get two-dimensional tables in the same way. A
score is the logistic of an intercept and one lookup per table, added for a whole batch at once.

Features are figures of the text alone: lengths, kinds of characters, lines and repetition. Null texts
count as empty; empty texts have all figures zero and get a score like others. Labels other than 0 and
1 and null ids are ignored; without any labelled row the score is the prior 0.5 for all. Repeated
labels of a document count once (the smallest label), and of several texts of one id the least is fitted on, so that
the order of rows never matters. Rows are scored one by one, very long texts as a whole; an empty table gives an empty result. Columns named
like the outputs give way to them.

The model is fitted on at most max_rows labelled rows (20,000, those with the smallest hash of their
id); its size depends on the number of features alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, small_batches, texts, with_columns

BINS = 32
NAMES = [
    "log_words", "log_bytes", "word_length", "upper", "digits", "marks", "symbols", "spaces", "bars", "wide", "log_lines",
    "line_length", "repeated_lines", "distinct_words", "top_word", "ends_marked", "no_letter", "entropy", "lines_ended", "repeated_pairs", "longest_word", "all_caps",
]

_KIND = np.zeros(256, np.uint8)
for _k, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"-()", b" \t\n\r\x0b\x0c", b"|"], 1):
    _KIND[list(_chars)] = _k
_KIND[128:] = 7
_ENDS = tuple(b".!?:;\"')")


def features(text: str) -> list[float]:
    data = text.encode()
    if not data:
        return [0.0] * len(NAMES)
    codes = np.frombuffer(data, np.uint8)
    counts = np.bincount(codes, minlength=256)
    other, lower, upper, digits, marks, spaces, bars, wide = np.bincount(_KIND, weights=counts, minlength=8)
    words = data.split()
    n, size = max(1, len(words)), len(data)
    lines = [x for x in data.split(b"\n") if x]
    bag: dict[bytes, int] = {}
    for w in words:
        bag[w] = bag.get(w, 0) + 1
    distinct = len(bag)
    share = counts[counts > 0] / size
    pairs = len(set(zip(words, words[1:])))
    seen = set(lines)
    bare = sum(1 for w in words if not (65 <= w[0] <= 90 or 97 <= w[0] <= 122 or w[0] >= 128))
    return [
        np.log1p(len(words)), np.log(size), (size - spaces) / n, upper / max(1.0, upper + lower), digits / size, marks / size, other / size, spaces / size, bars / size, wide / size, np.log1p(len(lines)),
        np.log1p(size / max(1, len(lines))), 1 - sum(map(len, seen)) / max(1, sum(map(len, lines))), distinct / n, max(bag.values(), default=0) / n,
        sum(1 for w in words if w[-1] in _ENDS) / n, bare / n, -float(share @ np.log2(share)), sum(1 for x in lines if x[-1] in _ENDS) / max(1, len(lines)), 1 - pairs / max(1, len(words) - 1),
        np.log1p(max(map(len, words), default=0)), sum(map(bytes.isupper, words)) / n,
    ]


def matrix(batch: list[str]) -> np.ndarray:
    return np.array([features(x) for x in batch], np.float64).reshape(len(batch), len(NAMES))


@dataclass
class Gam:
    """edges: per feature the bins' inner borders; tables: per feature its lookup; pairs: (i, j, table)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        for i, j, t in self.pairs:
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float = 1.0, ridge: float = 1.0) -> np.ndarray:
    """A regression tree over ordered bins with gradients g and weights h: each bin's value."""
    value = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2:
        return value
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge), -np.inf)
    k = int(np.argmax(gain)) + 1
    if gain[k - 1] <= g.sum() ** 2 / (h.sum() + ridge):
        return value
    return np.concatenate([_tree(g[:k], h[:k], depth - 1, least, ridge), _tree(g[k:], h[k:], depth - 1, least, ridge)])


def _grid(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best four quadrants of a two-dimensional table: each cell's value, and the gain."""
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    a_g, a_h = cg[:-1, :-1], ch[:-1, :-1]
    top_g, top_h, left_g, left_h = cg[:-1, -1:], ch[:-1, -1:], cg[-1:, :-1], ch[-1:, :-1]
    parts = [(a_g, a_h), (top_g - a_g, top_h - a_h), (left_g - a_g, left_h - a_h), (cg[-1, -1] - top_g - left_g + a_g, ch[-1, -1] - top_h - left_h + a_h)]
    gain = sum(x**2 / (y + 1) for x, y in parts)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [float(x[i, j] / (y[i, j] + 1)) for x, y in parts]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gain[i, j])


def fit_matrix(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, n_pairs: int = 6) -> Gam:
    """Fits by cyclic boosting on feature rows x and labels y."""
    if len(y) == 0:
        return Gam(0.0, [], [], [])
    p = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(p / (1 - p))), [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T], [], [])
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(k) for k in sizes]
    total = np.full(len(y), model.intercept)
    prob = lambda: 1 / (1 + np.exp(-total))
    for _ in range(rounds):
        for j, k in enumerate(sizes):
            q = prob()
            step = rate * _tree(np.bincount(b[:, j], y - q, k), np.bincount(b[:, j], q * (1 - q), k), 2)
            model.tables[j] += step
            total += step[b[:, j]]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        q, cell, shape = prob(), b[:, i] * sizes[j] + b[:, j], (sizes[i], sizes[j])
        return np.bincount(cell, y - q, shape[0] * shape[1]).reshape(shape), np.bincount(cell, q * (1 - q), shape[0] * shape[1]).reshape(shape)

    split = [j for j, k in enumerate(sizes) if k > 1]
    ranked = sorted(combinations(split, 2), key=lambda ij: -_grid(*sums(*ij))[1])[:n_pairs]
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for i, j in ranked]
    for _ in range(rounds // 3):
        for i, j, t in model.pairs:
            step = rate * _grid(*sums(i, j))[0]
            t += step
            total += step[b[:, i], b[:, j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000) -> Gam:
    """Fits on the whole texts of the at most max_rows labelled documents; labels: doc_id and the label column."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("_y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", filled().alias("text")).join(F.broadcast(chosen), "doc_id")  # max_rows rows of 12 bytes at most
    rows = rows.groupBy("doc_id", "_y").agg(F.min("text").alias("text"))

    def make():
        return lambda b: {"_x": list(matrix(texts(b)))}

    got = with_columns(rows, "_x array<double>", make, keep=["doc_id", "_y"]).toPandas().sort_values("doc_id")  # max_rows rows
    x = np.array(got["_x"].tolist(), np.float64).reshape(len(got), len(NAMES))
    return fit_matrix(x, got["_y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Gam, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with score (0 to 1) and predicted (1 if score >= threshold)."""

    def make():
        def batch(b):
            s = model.score(matrix(texts(b)))
            return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

        return batch

    return with_columns(docs, "score double, predicted int", make, keep)


def accepted(docs: DataFrame, model: Gam, threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose score is threshold or more, with all their columns as they are."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(matrix(texts(b))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
