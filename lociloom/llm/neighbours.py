"""Toxicity by the nearest labelled examples.

Texts are bags of words (lower-cased, ASCII marks part words; a word is known by its 64-bit hash). The terms are all words of the
examples, rare and common ones alike; their document frequencies are counted over all documents. A vector holds (1 + ln tf) * idf,
times how closely the word's presence goes with the label among the examples (the phi coefficient, so that words of the matter
rather than of the subject decide who is near), scaled to length one, and similarity is the
cosine. The examples lie in blocks of an inverted index that keeps every term's largest weight in each
block: a query bounds every block's best cosine by these, reads the blocks of the highest bounds, and then those whose
bound reaches the K-th best so far (or all blocks at once where the bounds hardly differ). Common terms are added up in single precision first, so that
whatever comes near the K-th is weighed again in double precision: the K nearest, and all that are as near as the K-th, are exact on any machine,
and the order of examples and ids never decides who votes.

Each neighbour votes for its label with its cosine as weight, scaled up by the share of its label's rows that the examples
hold; the prior votes with weight one. The examples' own votes, each found without itself, calibrate the score by a logistic curve.
The nearest EVIDENCE neighbours are given with their cosines and labels.

Examples are at most max_examples labelled rows of each label (3,000, those with the smallest hash of their id), which bounds
the terms and the index that all tasks get. Texts without any term (empty and
null ones too) have no neighbour and get the rate among such examples. Labels other than 0 and 1 and null ids are ignored; repeated
labels count once (the smallest), and of several texts of one id the least is the example. Without examples every score is 0.5. Rows are scored one by one, whole; an empty table
gives an empty result. Columns named like the outputs, in whatever case, give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import filled, give_back, shared_dir, small_batches, stored, texts, with_columns

K, EVIDENCE, BLOCK = 25, 3, 64
#: So many blocks are read first.
FIRST = 8
#: A term that one in so many examples has stands in a table of all examples.
COMMON = 16
#: So many texts' common terms are looked up at once.
TOGETHER = 64
#: What tables and sums in single precision may be off by.
SLACK = 1e-5
#: Cosines that differ by no more are equal.
TIE = 1e-12
#: Where the highest bound is less than so many times the middle one, few blocks could be left out, and all are read at once.
ALIKE = 3
_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_SPLIT).split()


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's words, ascending, and how often each occurs."""
    w = words(text)
    return np.unique(np.fromiter(map(xxh3_64_intdigest, w), np.uint64, len(w)), return_counts=True)


def _pieces(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all pieces that begin at start and have that size, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class BlockMaxIndex:
    """Exact nearest neighbours by cosine. rows: per example its terms (ascending) and their weights, of length one."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        #: Examples with the same heaviest term stand together, which keeps the blocks' bounds low.
        self.order = np.array(sorted(range(len(rows)), key=lambda i: (int(rows[i][0][np.argmax(rows[i][1])]), i)), np.int64)
        self.blocks = max(1, -(-len(rows) // BLOCK))
        size = np.array([len(rows[i][0]) for i in self.order], np.int64)
        term = np.concatenate([rows[i][0] for i in self.order])
        weight = np.concatenate([rows[i][1] for i in self.order])
        place = np.repeat(np.arange(len(rows)), size)
        often = np.bincount(term, minlength=n_terms)
        common = np.flatnonzero(often * COMMON > len(rows))
        #: For each common term its row in a table of weights by example, and of the blocks' largest ones.
        self.row = np.full(n_terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.table = np.zeros((len(common), self.blocks * BLOCK))
        dense = self.row[term] >= 0
        self.table[self.row[term[dense]], place[dense]] = weight[dense]
        self.single: tuple[np.ndarray, np.ndarray] | None = None  # blocks' largest weights and all weights in single precision, made where they are used
        #: For the others, by term and block, the largest weight and where the block's examples with it begin.
        key = term[~dense] * self.blocks + place[~dense] // BLOCK
        by = np.argsort(key, kind="stable")
        key, self.place, self.weight = key[by], place[~dense][by], weight[~dense][by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.block = key[first] % self.blocks
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.begin = np.append(first, len(key))
        self.of_term = np.searchsorted(key[first] // self.blocks, np.arange(n_terms + 1))

    def tables(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """What the common terms of some vectors add to the blocks' bounds and to the examples' cosines, by two products of matrices."""
        if self.single is None:
            weights = self.table.astype(np.float32)
            self.single = weights.reshape(len(weights), self.blocks, BLOCK).max(2), weights
        heavy = np.zeros((len(vectors), len(self.table)), np.float32)
        for q, (terms, weights) in zip(heavy, vectors):
            row = self.row[terms]
            q[row[row >= 0]] = weights[row >= 0]
        return list(zip(heavy @ self.single[0], heavy @ self.single[1]))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, tables: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """The k nearest examples with a cosine above zero, and all that are as near as the k-th: their numbers, cosines, and how many blocks were read. tables: of this vector, if known."""
        in_table = self.row[terms] >= 0
        rest, light = terms[~in_table], weights[~in_table]
        common, base = tables or self.tables([(terms, weights)])[0]
        start = self.of_term[rest]
        size = self.of_term[rest + 1] - start
        entry = _pieces(start, size)
        block = self.block[entry]
        bound = common + np.bincount(block, self.most[entry] * np.repeat(light, size), minlength=self.blocks)

        def in_lists(entries: np.ndarray, share: np.ndarray) -> np.ndarray:
            """What some lists' examples have of their cosines from terms that are not common, in double precision."""
            n = self.begin[entries + 1] - self.begin[entries]
            at = _pieces(self.begin[entries], n)
            return np.bincount(self.place[at], self.weight[at] * np.repeat(share, n), minlength=len(base))

        def all_blocks() -> tuple[np.ndarray, np.ndarray]:
            """That part for all examples, and the cosines; a term's lists in all blocks lie side by side."""
            first = self.begin[start]
            n = self.begin[start + size] - first
            at = _pieces(first, n)
            part = np.bincount(self.place[at], self.weight[at] * np.repeat(light, n), minlength=len(base))
            return part, base + part

        def some_blocks(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The same for the examples in some blocks; the others' cosines are -1."""
            now = np.zeros(self.blocks, bool)
            now[which] = True
            mine = now[block]
            part = in_lists(entry[mine], np.repeat(light, size)[mine])
            return part, np.where(np.repeat(now, BLOCK), base + part, -1.0)

        reach = lambda c: float(np.partition(c, len(c) - k)[len(c) - k]) if k < len(c) else 0.0
        read, high = self.blocks, float(bound.max())
        if self.blocks <= FIRST or ALIKE * float(np.median(bound)) > high:
            part, cosine = all_blocks()
        else:
            first = np.argpartition(-bound, FIRST)[:FIRST]
            part, cosine = some_blocks(first)
            left = bound >= max(reach(cosine), 1e-12) - SLACK
            left[first] = True
            read = int(left.sum())
            if read > FIRST:
                part, cosine = some_blocks(np.flatnonzero(left)) if 2 * read < self.blocks else all_blocks()
        cosine = cosine[: len(self.order)]
        some = np.flatnonzero(cosine > max(0.0, reach(cosine) - SLACK))
        c = part[some] + weights[in_table] @ self.table[np.ix_(self.row[terms[in_table]], some)]
        near = c >= max(reach(c) - TIE, 1e-15)
        i, c = self.order[some[near]], c[near]
        top = np.lexsort((i, -np.round(c, 12)))
        return i[top], np.minimum(c[top], 1.0), read


@dataclass
class Model:
    terms: np.ndarray  # the words' hashes, ascending
    weight: np.ndarray  # by term: idf times phi
    index: BlockMaxIndex | None
    ids: np.ndarray
    labels: np.ndarray
    scale: np.ndarray  # by label: rows for each example
    prior: float
    bare: float  # score of texts without a term
    slope: float = 1.0
    shift: float = 0.0

    def vector(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms among the words (hashes, ascending) and their weights, of length one; none if all weigh nothing."""
        if not len(self.terms) or not len(words):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        known = (self.terms[at] == words) & (self.weight[at] > 0)
        t = at[known]
        w = (1 + np.log(counts[known])) * self.weight[t]
        return t, w / np.sqrt((w**2).sum()) if len(t) else w

    def vote(self, who: np.ndarray, cosine: np.ndarray) -> float:
        y = self.labels[who]
        w = cosine * self.scale[y]
        return float(((w * y).sum() + self.prior) / (w.sum() + 1))

    def calibrated(self, vote: float | np.ndarray):
        v = np.clip(vote, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(v / (1 - v)) + self.shift)))

    def score(self, text: str) -> tuple[float, list[dict]]:
        return self.scores([text])[0]

    def scores(self, some: list[str]) -> list[tuple[float, list[dict]]]:
        """Each text's score and its nearest examples."""
        vectors = [self.vector(*counted(x)) for x in some]
        out: list[tuple[float, list[dict]]] = [(self.bare, [])] * len(some)
        known = [k for k, v in enumerate(vectors) if len(v[0])] if self.index else []
        for begin in range(0, len(known), TOGETHER):
            those = known[begin : begin + TOGETHER]
            for k, tables in zip(those, self.index.tables([vectors[k] for k in those])):
                who, cosine, _ = self.index.nearest(*vectors[k], K, tables)
                if len(who):
                    top = [{"doc_id": int(self.ids[i]), "similarity": float(c), "label": int(self.labels[i])} for i, c in zip(who[:EVIDENCE], cosine)]
                    out[k] = float(self.calibrated(self.vote(who, cosine))), top
        return out


def phi(n0: np.ndarray, n1: np.ndarray, a: float, b: float) -> np.ndarray:
    """How closely a word's presence goes with the label (0 to 1): it is in n0 of a examples with label 0, in n1 of b with label 1."""
    n = n0 + n1
    return np.abs(n1 * (a - n0) - n0 * (b - n1)) / np.sqrt(np.maximum(n * (a + b - n) * a * b, 1e-9))


def build(ids: list[int], labels: list[int], bags: list[tuple[np.ndarray, np.ndarray]], terms: np.ndarray, often: np.ndarray, documents: int, totals: tuple[int, int]) -> Model:
    """The model of the given examples. bags: per example its words' hashes and counts; terms: all of these hashes, ascending; often: by
    term in how many of all documents it is; totals: how many labelled rows there are with label 0 and 1."""
    y = np.array(labels, np.int64)
    have = np.maximum(np.bincount(y, minlength=2), 1)
    scale = np.maximum(np.array(totals, np.float64), np.bincount(y, minlength=2)) / have
    prior = float(totals[1] + 0.5) / (sum(totals) + 1)
    within = [np.zeros(len(terms)), np.zeros(len(terms))]
    for label, (words, _) in zip(labels, bags):
        within[label][np.searchsorted(terms, words)] += 1
    weight = (np.log((1 + documents) / (1 + often)) + 1) * phi(*within, float((y == 0).sum()), float((y == 1).sum())) if len(terms) else np.zeros(0)
    m = Model(terms, weight, None, np.zeros(0, np.int64), y, scale, prior, 0.5)
    rows = [m.vector(*bag) for bag in bags]
    keep = [i for i, r in enumerate(rows) if len(r[0])]
    none = y[[i for i, r in enumerate(rows) if not len(r[0])]]
    m.bare = float((scale[1] * none.sum() + 0.5 * prior) / (scale[none].sum() + 0.5)) if len(y) else 0.5
    m.ids, m.labels = np.array([ids[i] for i in keep], np.int64), y[keep]
    if not keep:
        return m
    rows = [rows[i] for i in keep]
    m.index = BlockMaxIndex(rows, len(terms))
    votes = np.full(len(keep), prior)
    for n, (t, w) in enumerate(rows):
        who, cosine, _ = m.index.nearest(t, w, K + 1)
        other = who != n
        votes[n] = m.vote(who[other], cosine[other])
    x, weight = np.log(votes / (1 - votes)), scale[m.labels]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method, held back by a small pull towards slope 1 and shift 0
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (m.labels - p) * x).sum() - (a - 1), (weight * (m.labels - p)).sum() - b])
        h = weight * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 1]])
        step = np.linalg.solve(hess, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    if a > 0 and np.isfinite([a, b]).all():
        m.slope, m.shift = float(a), float(b)
    return m


def frequencies(rows: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of the texts each term is, and how many texts there are. Tasks count, and Spark adds up."""
    held = rows.sparkSession.sparkContext.broadcast(terms)  # the examples' words, eight bytes each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        n = np.zeros(len(known) + 1, np.int64)
        for b in batches:
            for x in texts(b):
                n[-1] += 1
                h = counted(x)[0]
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    n[at[known[at] == h]] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some])], names=["term", "n"])
        give_back()

    out = rows.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term at most
    often = np.zeros(len(terms) + 1, np.int64)
    often[out["term"].to_numpy()] = out["n"].to_numpy()
    return often[:-1], int(often[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_examples: int = 3_000) -> Model:
    """Fits on labels (doc_id and the label column) and the whole texts of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    base = shared_dir(spark, "neighbours")
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    pick = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    chosen = pick(0).unionByName(pick(1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled().alias("text"))
    examples = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # 2 * max_examples rows of 12 bytes are broadcast at most

    def bags(b: pa.RecordBatch) -> dict:
        got = [counted(x) for x in texts(b)]
        return {"words": [h.tobytes() for h, _ in got], "counts": [c.astype("<i8").tobytes() for _, c in got]}

    made = stored(with_columns(examples, "words binary, counts binary", lambda: bags, keep=["doc_id", "y"]), f"{base}/examples")
    got = {r["doc_id"]: (r["y"], np.frombuffer(r["words"], "<u8"), np.frombuffer(r["counts"], "<i8")) for r in made.toLocalIterator()}  # 2 * max_examples rows
    ids = sorted(got)
    own = [got[i][1] for i in ids]
    terms = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
    often, documents = frequencies(rows, terms)
    return build(ids, [got[i][0] for i in ids], [got[i][1:] for i in ids], terms, often, documents, (totals.get(0, 0), totals.get(1, 0)))


def score(docs: DataFrame, model: Model, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with score (0 to 1), predicted (1 if score >= threshold) and evidence."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # the examples bound it

    def make():
        def batch(b):
            got = held.value.scores(texts(b))
            return {"score": [s for s, _ in got], "predicted": [int(s >= threshold) for s, _ in got], "evidence": [e for _, e in got]}

        return batch

    return with_columns(docs, "score double, predicted int, evidence array<struct<doc_id:long,similarity:double,label:int>>", make, keep)
