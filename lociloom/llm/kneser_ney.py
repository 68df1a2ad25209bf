"""Language-model scoring by interpolated modified Kneser-Ney smoothing over word pairs.

Tokens are runs without ASCII white space, A to Z lower-cased, then one end; a begin, which is no token, stands before
the first. Counting: each task sorts the hashes it meets and adds up equal ones; by ranges of the hash
these runs go to the tasks that merge them, each of which writes its range as sorted arrays. A word's place in
the sorted hashes is its number. The numbers of two words side by side, packed in 64 bits and multiplied by an odd constant, are a
pair's hash (no two pairs share one), and pairs are counted like words, so that a frequent word's pairs spread over all
ranges. What a pair says of its words (how often the first is followed, by how many words once, twice or more; how many words
come before the second) is added up and written by ranges of word numbers.

Workers map these files into memory and look a whole batch up at once. With c the counts, D the discounts
(from the counts of counts) and p1 the same over the numbers of words that come before, p(w|h) is
(c(hw) - D) / c(h) + (D1 n1(h) + D2 n2(h) + D3 n3(h)) / c(h) * p1(w), and p1 mixes in 1 / (V + 1) so that unknown words
have a probability. After an unknown word, p is p1.

The model has pairs alone: with the words of this corpus, nearly all different, three words would take the disk beyond
its budget. Null and empty texts have the end alone. Rows are scored one by one; repeated rows count as often as they occur.
Null ids count as training rows. Without training rows every token has the probability 1 / (V + 1) = 1. An empty
table gives an empty result; other columns do not matter, and columns named like the outputs give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import array_file
from .common import filled, give_back, shared_dir, small_batches, stored, texts, with_columns

END = xxh3_64_intdigest(b"")  # words are never empty
ODD = 0x9E3779B97F4A7C15
BACK = pow(ODD, -1, 1 << 64)
#: So many different keys a task holds before it hands them on.
HELD = 1_500_000
#: The training texts' bytes for each range of keys, which one task merges: it has a key for each word at most.
RANGE_BYTES = 16 << 20
#: So many texts are scored at once.
AT_ONCE = 250


def tokens(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of a batch of texts, and where each text begins (and the last ends)."""
    words = [x.encode().lower().split() for x in batch]
    size = np.array([len(w) + 1 for w in words], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(at[-1], END, np.uint64)
    keep = np.ones(at[-1], bool)
    keep[at[1:] - 1] = False
    out[keep] = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, at[-1] - len(words))
    return out, at


def _range(key: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges a hash lies in."""
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def press(a: np.ndarray) -> bytes:
    """An array as bytes, the first bytes of all numbers before the second ones, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpress(x: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(x), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def press_sorted(a: np.ndarray) -> bytes:
    return press(np.diff(a, prepend=a.dtype.type(0)))


def unpress_sorted(x: bytes, kind: str) -> np.ndarray:
    return np.cumsum(unpress(x, kind), dtype=kind)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the values of each added up."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values))


RUNS = "bucket int, keys binary, counts binary"


def counted(rows: DataFrame, keys_of, ranges: int) -> DataFrame:
    """The keys that keys_of(texts) gives for each batch, counted in sorted runs by range."""
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        cut = np.searchsorted(_range(keys, ranges), np.arange(ranges + 1))
        some = [i for i in range(ranges) if cut[i] < cut[i + 1]]
        parts = [slice(cut[i], cut[i + 1]) for i in some]
        return pa.RecordBatch.from_pydict({"bucket": some, "keys": [press_sorted(keys[p]) for p in parts], "counts": [press(counts[p].astype("<u4")) for p in parts]}, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for b in batches:
            k, n = np.unique(keys_of(texts(b)), return_counts=True)
            held.append((k, n))
            waiting += len(k)
            if waiting >= HELD:
                held = [summed(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))]
                waiting = len(held[0][0])
                if waiting >= HELD // 2:
                    yield out(*held[0])
                    held, waiting = [], 0
        if held:
            yield out(*summed(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])))

    return rows.select("text").mapInArrow(run, RUNS)


def by_bucket(df: DataFrame, ranges: int, merge, schema: str) -> DataFrame:
    """merge(bucket, rows) for all rows of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, found = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] != bucket and found:
                    yield from merge(bucket, found)
                    found = []
                bucket = r["bucket"]
                found.append(r)
        if found:
            yield from merge(bucket, found)
        del found
        give_back()

    return df.repartition(ranges, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


@dataclass
class Sorted:
    """Files of sorted keys by range of the key; first is the number of the first key of each."""

    ranges: int
    files: dict[int, str]
    first: dict[int, int]
    size: int
    _open: dict[int, dict] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def file(self, k: int) -> dict[str, np.ndarray]:
        if k not in self._open:
            self._open[k] = array_file.load(self.files[k])
        return self._open[k]

    def find(self, keys: np.ndarray, counts: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The number of each key (-1: none) and its count; keys must be sorted."""
        number, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        cut = np.searchsorted(_range(keys, self.ranges), np.arange(self.ranges + 1)).tolist()
        for k in range(self.ranges):
            a, b = cut[k], cut[k + 1]
            if a == b or k not in self.files:
                continue
            f = self.file(k)
            own = f["keys"]
            at = np.searchsorted(own, keys[a:b])
            hit = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == keys[a:b])
            number[a:b][hit] = self.first[k] + at[hit]
            if counts:
                count[a:b][hit] = f["counts"][at[hit]]
        return number, count


def _write_sorted(df: DataFrame, folder: str, name: str, ranges: int) -> DataFrame:
    schema = pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("n", pa.int64()), ("total", pa.int64())])

    def merge(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        keys, counts = summed(np.concatenate([unpress_sorted(r["keys"], "<u8") for r in rows]), np.concatenate([unpress(r["counts"], "<u4").astype("<u8") for r in rows]))
        path = array_file.save(folder, f"{name}-{bucket}", {"keys": keys, "counts": counts})
        yield pa.RecordBatch.from_pydict({"bucket": [bucket], "path": [path], "n": [len(keys)], "total": [int(counts.sum())]}, schema=schema)

    return by_bucket(df, ranges, merge, "bucket int, path string, n long, total long")


def _sorted(made: list, ranges: int) -> Sorted:
    files, first, at = {}, {}, 0
    for r in sorted(made, key=lambda r: r["bucket"]):
        files[r["bucket"]], first[r["bucket"]] = r["path"], at
        at += r["n"]
    return Sorted(ranges, files, first, at)


def numbers(words: Sorted, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's number (-1: unknown) and count, and where each text begins."""
    h, at = tokens(batch)
    distinct, back = np.unique(h, return_inverse=True)
    number, count = words.find(distinct)
    return number[back], count[back], at


def before(number: np.ndarray, at: np.ndarray, begin: int) -> np.ndarray:
    """The number of the word before each token; begin at a text's start."""
    out = np.empty_like(number)
    out[1:] = number[:-1]
    out[at[:-1]] = begin
    return out


def pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)) * np.uint64(ODD)


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from how many things were counted once, twice, three and four times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.0), k) for k, d in enumerate(raw, 1)]


@dataclass
class Model:
    words: Sorted
    pairs: Sorted
    stats: Sorted  # by word number: its files hold dense arrays
    width: int
    tokens: int
    d: list[float]
    d1: list[float]
    mixed: float  # weight of the uniform distribution in p1
    ways: int  # different pairs

    def stat(self, number: np.ndarray) -> np.ndarray:
        """Rows (c, n1, n2, n3, before) for sorted distinct word numbers."""
        out = np.zeros((len(number), 5), np.int64)
        cut = np.searchsorted(number // self.width, np.arange(self.stats.ranges + 1)).tolist()
        for k in range(self.stats.ranges):
            a, b = cut[k], cut[k + 1]
            if a < b and k in self.stats.files:
                f = self.stats.file(k)
                at = number[a:b] - k * self.width
                for j, name in enumerate(("c", "n1", "n2", "n3", "before")):
                    out[a:b, j] = f[name][at]
        return out

    def score(self, batch: list[str]) -> dict[str, np.ndarray]:
        number, count, at = numbers(self.words, batch)
        v = self.words.size
        base = np.log10((count + 1) / (self.tokens + v + 1))
        context = before(number, at, v)
        used, back = np.unique(np.concatenate([number, context]), return_inverse=True)
        known = used >= 0
        row = np.zeros((len(used), 5), np.int64)
        row[known] = self.stat(used[known])
        own, left = row[back[: len(number)]], row[back[len(number) :]]
        cut = np.array([0.0, *self.d1])[np.minimum(own[:, 4], 3)]
        p = (own[:, 4] - cut) / max(self.ways, 1) + self.mixed / (v + 1)
        both = np.flatnonzero((number >= 0) & (left[:, 0] > 0))
        key = pair(context[both], number[both])
        order = np.argsort(key)
        _, c = self.pairs.find(key[order])
        pairs = np.zeros(len(number), np.int64)
        pairs[both[order]] = c
        follow = left[:, 0] > 0
        c_h = np.maximum(left[:, 0], 1)
        rest = (self.d[0] * left[:, 1] + self.d[1] * left[:, 2] + self.d[2] * left[:, 3]) / c_h
        p = np.where(follow, (pairs - np.array([0.0, *self.d])[np.minimum(pairs, 3)]) / c_h + rest * p, p)
        add = lambda x: np.add.reduceat(x, at[:-1]) if len(batch) else x[:0]
        return {"n_tokens": np.diff(at), "n_known": add((count > 0).astype(np.int64)), "train_tokens": np.full(len(batch), self.tokens), "base_score": add(base), "score": add(np.log10(p))}


def train(rows: DataFrame) -> Model:
    """Counts all rows' whole texts (column text)."""
    spark = rows.sparkSession
    small_batches(spark)
    folder = array_file.as_uri(shared_dir(spark, "model"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0  # one row
    ranges = max(8, -(-size // RANGE_BYTES))
    made = _write_sorted(counted(rows, lambda x: tokens(x)[0], ranges), f"{folder}/words", "words", ranges)
    made = stored(made, f"{folder}/words-made").collect()  # a row for each range
    words, total = _sorted(made, ranges), sum(r["total"] for r in made)
    v = words.size
    width = max(1, -(-(v + 1) // ranges))

    def pairs_of(batch: list[str]) -> np.ndarray:
        number, _, at = numbers(words, batch)
        return pair(before(number, at, v), number)

    names = ("c", "n1", "n2", "n3", "before")
    fields = [("bucket", pa.int32()), ("path", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("counts", pa.list_(pa.int64())), ("ids", pa.binary()), *[(x, pa.binary()) for x in names]]
    ddl = "bucket int, path string, n long, total long, counts array<long>, ids binary, " + ", ".join(f"{x} binary" for x in names)

    def merge(bucket: int, got: list[dict]) -> Iterator[pa.RecordBatch]:
        keys, counts = summed(np.concatenate([unpress_sorted(r["keys"], "<u8") for r in got]), np.concatenate([unpress(r["counts"], "<u4").astype("<u8") for r in got]))
        path = array_file.save(f"{folder}/pairs", f"pairs-{bucket}", {"keys": keys, "counts": counts.astype("<u4") if counts.max() < 1 << 32 else counts})
        both = keys * np.uint64(BACK)
        first, second = (both >> np.uint64(32)).astype("<u8"), (both & np.uint64(0xFFFFFFFF)).astype("<u8")
        of = lambda k: counts == k
        zero, one = np.zeros(len(keys), "<u8"), np.ones(len(keys), "<u8")
        every = summed(np.concatenate([first, second]), *(np.concatenate([x, zero]) for x in (counts, of(1).astype("<u8"), of(2).astype("<u8"), (counts > 2).astype("<u8"))), np.concatenate([zero, one]))
        cut = np.searchsorted(every[0] // np.uint64(width), np.arange(ranges + 1))
        rows = [{"bucket": bucket, "path": path, "n": len(keys), "total": int(counts.sum()), "counts": [int(of(k).sum()) for k in (1, 2, 3, 4)]}]
        for k in range(ranges):
            if cut[k] < cut[k + 1]:
                p = slice(cut[k], cut[k + 1])
                rows.append({"bucket": k, "ids": press_sorted(every[0][p])} | {x: press(y[p]) for x, y in zip(names, every[1:])})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    both = stored(by_bucket(counted(rows, pairs_of, ranges), ranges, merge, ddl), f"{folder}/pairs-made")
    made = both.where("path is not null").select("bucket", "path", "n", "total", "counts").collect()  # a row for each range
    pairs = _sorted(made, ranges)
    d = discounts([sum(r["counts"][k] for r in made) for k in range(4)])

    def merge_stats(bucket: int, got: list[dict]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([unpress_sorted(r["ids"], "<u8") for r in got]).astype(np.int64) - bucket * width
        dense = {x: np.bincount(ids, np.concatenate([unpress(r[x], "<u8") for r in got]), width).astype("<i8") for x in names}
        path = array_file.save(f"{folder}/stats", f"stats-{bucket}", dense)
        rows = [{"bucket": bucket, "path": path, "n": width, "total": int(dense["before"].sum()), "counts": [int((dense["before"] == k).sum()) for k in (1, 2, 3, 4)] + [int((dense["before"] > 2).sum())]}]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields[:5]))

    made = by_bucket(both.where("path is null").drop("path", "n", "total", "counts"), ranges, merge_stats, "bucket int, path string, n long, total long, counts array<long>")
    made = stored(made, f"{folder}/stats-made").collect()  # a row for each range
    n = [sum(r["counts"][k] for r in made) for k in range(5)]
    d1, ways = discounts(n[:4]), sum(r["total"] for r in made)
    mixed = (d1[0] * n[0] + d1[1] * n[1] + d1[2] * n[4]) / ways if ways else 1.0
    return Model(words, pairs, _sorted(made, ranges), width, total, d, d1, mixed, ways)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability)."""

    def make():
        def batch(b):
            x = texts(b)
            parts = [model.score(x[i : i + AT_ONCE]) for i in range(0, len(x), AT_ONCE)] or [model.score([])]
            return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

        return batch

    return with_columns(docs, "n_tokens long, n_known long, train_tokens long, base_score double, score double", make, keep)
