"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Texts are taken as sequences of five-word shingles (words are runs without ASCII white space). Each of
SKETCHES hash functions picks the LENGTH smallest of the occurrence-labelled shingles and keeps them in text
order; one that two texts share makes them candidates. Sharing depends on which shingles there are and on
their order, as the edit distance does. Texts of the same words form one class and are handled once.

Two classes are linked if their shingle sequences, aligned by insertions and deletions alone, agree in at
least 0.8 of all: aligned / (n1 + n2 - aligned) >= 0.8, which holds if and only if the distance D (shingles left over
on both sides) has 9 D <= n1 + n2. The alignment follows furthest-reaching diagonals within the band that this
bound allows. Groups are the connected components of the links; the document with the smallest id stays.

Within the documents that share a sketch, the first is compared to all others. If all fall into one component the
rest needs no comparing. Members outside the first one's component are compared to all members, in buckets of any
size: the larger a bucket's part outside, the more of these comparisons, with the square where nothing links them. Left out
are only pairs that cannot be linked, by their lengths or as too many of BITS parities differ (each shingle left over changes one at most).
So a pair of similarity 0.8 is missed only if all SKETCHES differ: once in 1.7 million times, for texts of nine and eight words once in 27,000.

Null texts count as empty; texts without words are one class of no shingles, linked to nothing. Texts of one to four
words have one shingle, all their words. Null ids come last. Repeated rows are copies: exactly one row of a group is
kept. Very long texts are taken whole. An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_64_intdigest

from ..storage import components
from .common import filled, in_bitmap, shared_dir, small_batches, stored, texts, with_columns
from .stream_dedup import filed, located, without_rows

WORDS, SKETCHES, LENGTH = 5, 20, 3
#: Bits that tell by their parity how many shingles two texts cannot have in common.
BITS = 512
#: A bucket with more documents outside its first one's component is parted by length first; what is compared stays the same.
OUTSIDE = 4096
CHUNK, BLOCK = 256, 4096
_A = np.array([xxh3_64_intdigest(b"a%d" % i) for i in range(SKETCHES)], np.uint64)[:, None]
_B = np.array([xxh3_64_intdigest(b"b%d" % i) | 1 for i in range(SKETCHES)], np.uint64)[:, None]
_M = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str) -> np.ndarray:
    """The text's five-word shingles as hashes, in order."""
    words = text.encode().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, WORDS)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ h[i : n - k + 1 + i]) * _M
        out ^= out >> np.uint64(29)
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCHES hashes, each of the LENGTH smallest occurrence-labelled shingles in text order."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    start = np.ones(n, bool)
    start[1:] = s[order][1:] != s[order][:-1]
    first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    nth = np.empty(n, np.uint64)
    nth[order] = np.arange(n) - first
    x = (s ^ (nth * np.uint64(0xC2B2AE3D27D4EB4F))) * _M
    y = (x ^ (x >> np.uint64(31)) ^ _A) * _B
    y ^= y >> np.uint64(32)
    y *= _M
    if n > LENGTH:
        places = np.sort(np.argpartition(y, LENGTH - 1, axis=1)[:, :LENGTH], axis=1)
    else:
        places = np.broadcast_to(np.arange(n), (SKETCHES, n))
    out = _A[:, 0].copy()
    for j in range(places.shape[1]):
        out = (out ^ s[places[:, j]]) * _M
        out ^= out >> np.uint64(30)
    return out.view(np.int64)


def parities(s: np.ndarray) -> np.ndarray:
    """BITS bits, each the parity of the number of shingles that fall to it."""
    return np.packbits((np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def aligned_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The insertions and deletions that turn a into b if they are at most `most`, else None."""
    if abs(len(a) - len(b)) > most:
        return None
    n = min(len(a), len(b))
    diff = np.flatnonzero(a[:n] != b[:n])
    head = int(diff[0]) if len(diff) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    diff = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(diff[0]) if len(diff) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    na, nb = len(a), len(b)
    if not na or not nb:
        return na + nb if na + nb <= most else None
    la, lb = a.tolist(), b.tolist()
    reach = {1: 0}
    for d in range(most + 1):
        new = {}
        for k in range(-d, d + 1, 2):
            if k < -nb or k > na:
                continue
            down, right = reach.get(k + 1, -1), reach.get(k - 1, -2) + 1
            x = max(down, right)
            y = x - k
            if x < 0 or x > na or y > nb or y < 0:
                continue
            if x < na and y < nb and la[x] == lb[y]:
                step = 16
                while x < na and y < nb:
                    m = min(step, na - x, nb - y)
                    other = a[x : x + m] != b[y : y + m]
                    if other.any():
                        go = int(other.argmax())
                        x, y = x + go, y + go
                        break
                    x, y, step = x + m, y + m, step * 2
            if x >= na and y >= nb:
                return d
            new[k] = x
        reach = new
    return None


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """True if the alignment agrees in 0.8 of all shingles or more."""
    total = len(a) + len(b)
    most = total // 9
    if not len(a) or not len(b) or abs(len(a) - len(b)) > most:
        return False
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if total - 2 * int(np.minimum(ca[ia], cb[ib]).sum()) > most:  # no order could do better
        return False
    return aligned_within(a, b, most) is not None


def classes(docs: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, _file, _row, v) and classes (v, first, n, sketch); v is the SHA-256 of the words."""
    norm = F.trim(F.regexp_replace(filled(), "[\\x20\\x09-\\x0D]+", " "))
    rows = located(docs).select("doc_id", "_file", "_row", norm.alias("text")).withColumn("v", F.unhex(F.sha2("text", 256)))

    def make():
        def batch(b):
            s = [shingles(x) for x in texts(b)]
            return {"n": [len(x) for x in s], "sketch": [sketch(x).tolist() if len(x) else [] for x in s], "parity": [parities(x).tolist() for x in s]}

        return batch

    made = stored(with_columns(rows, "n int, sketch array<long>, parity array<long>", make, keep=["doc_id", "_file", "_row", "v"]), f"{base}/rows")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_file", "_row")
    one = made.groupBy("v").agg(F.min(F.struct(first.alias("first"), "n", "sketch", "parity")).alias("m"), F.count(F.lit(1)).alias("copies"))
    return made.drop("n", "sketch", "parity"), stored(one.select("v", "m.first", "m.n", "m.sketch", "m.parity", "copies"), f"{base}/classes")


def verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those that are linked. known: v and text of all that occur."""
    small_batches(pairs.sparkSession)
    sides = pairs.join(known.select(F.col("v").alias("b"), F.col("text").alias("tb")), "b").join(known.select(F.col("v").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches):
        last: tuple[str, np.ndarray] = "", shingles("")
        for b in batches:
            hit = []
            for ta, tb in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if last[0] != ta:
                    last = ta, shingles(ta)
                hit.append(linked(last[1], shingles(tb)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return sides.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def links(docs: DataFrame, cls: DataFrame, base: str) -> DataFrame:
    """Links (a, b) between classes, enough to connect whatever the links connect."""
    member = cls.where("n > 0").select("v", "n", "first", F.posexplode("sketch").alias("band", "s")).select("v", "n", "first", "band", F.xxhash64("band", "s").alias("bucket"))
    # only hashes are shuffled for all members; whole rows follow for buckets of several
    repeated = stored(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket"), f"{base}/repeated")
    near = in_bitmap(member, F.col("bucket"), repeated, F.col("bucket"))
    heads = near.groupBy("bucket").agg(F.min(F.struct("first.none", "first.doc_id", "v", "n")).alias("h"), F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket", F.col("h.v").alias("a"), F.col("h.n").alias("na"), "size")
    shared = stored(near.select("bucket", "band", "v", "n").join(heads, "bucket"), f"{base}/shared")
    pairs = stored(shared.where("a != v AND abs(na - n) * 9 <= na + n").select("a", F.col("v").alias("b")).distinct(), f"{base}/pairs")
    found = stored(verified(pairs, texts_of(docs, cls, pairs, f"{base}/texts")), f"{base}/links")
    label = components(found)
    named = shared.join(label, "v", "left").withColumn("label", F.coalesce("label", "v"))
    named = stored(named.join(label.select(F.col("v").alias("a"), F.col("label").alias("la")), "a", "left").withColumn("outside", F.col("label") != F.coalesce("la", "a")), f"{base}/named")
    counts = stored(outsiders(named).drop("size"), f"{base}/outsiders")
    if counts.isEmpty():
        return found
    few = named.join(counts.where(F.col("outsiders") <= OUTSIDE), "bucket")
    many = by_length(named.join(counts.where(F.col("outsiders") > OUTSIDE).select("bucket"), "bucket", "semi"))
    return stored(found.union(across(docs, cls, few.unionByName(many), f"{base}/across")), f"{base}/all")


def outsiders(named: DataFrame) -> DataFrame:
    """bucket, outsiders, size for buckets with members outside the first one's component."""
    return named.groupBy("bucket").agg(F.count_if("outside").alias("outsiders"), F.count(F.lit(1)).alias("size")).where("outsiders > 0")


def by_length(named: DataFrame) -> DataFrame:
    """Buckets parted by the members' lengths. Each outsider meets all members whose length allows a link (ratio 1.25 at most, less than a part's 1.26)."""
    part = F.floor(F.log("n") / F.log(F.lit(1.26)))
    each = named.drop("size").withColumn("part", part).withColumn("at", F.explode(F.array(part - 1, part, part + 1)))
    each = each.withColumn("outside", F.col("outside") & (F.col("at") == F.col("part"))).withColumn("bucket", F.xxhash64("bucket", "at")).drop("part", "at")
    return each.join(outsiders(each), "bucket")


def _groups(batches, width: int):
    """Of batches sorted by their first three columns and `role`: for each group its outsiders' rows, then its members' rows, CHUNK at a time."""
    key, own, rest = None, [], []
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(width))):
            if row[:3] != key or len(rest) >= 4 * CHUNK:
                if rest:
                    yield key, own, rest
                rest = []
                if row[:3] != key:
                    key, own = row[:3], []
            (rest if row[3] else own).append(row[4:])
    if rest:
        yield key, own, rest


def _wanted(own: list, rest: list) -> np.ndarray:
    """Which pairs (outsider, member) are compared here. Rows begin with v, label, n, band, sketch, parity."""
    a, b = (np.array([r[4] for r in x], np.int64).reshape(len(x), SKETCHES) for x in (own, rest))
    pa, pb = (np.array([r[5] for r in x], np.int64).reshape(len(x), BITS // 64) for x in (own, rest))
    na, nb = (np.array([r[2] for r in x], np.int64) for x in (own, rest))
    la, lb = (np.array([r[1] for r in x]) for x in (own, rest))
    want = (np.abs(na[:, None] - nb) * 9 <= na[:, None] + nb) & (la[:, None] != lb)
    i, j = np.nonzero(want)
    want[i, j] = np.bitwise_count(pa[i] ^ pb[j]).sum(1, dtype=np.int64) * 9 <= na[i] + nb[j]
    i, j = np.nonzero(want)
    want[i, j] = (a[i] == b[j]).argmax(1) == own[0][3]  # a pair that meets in several buckets is compared in the first of them; all are searched
    return want


def across(docs: DataFrame, cls: DataFrame, named: DataFrame, path: str) -> DataFrame:
    """Links between the outsiders and all members of the buckets.

    Outsiders go by chunks, members by blocks; each chunk meets each block in a group of its own, where the pairs are told
    from lengths, parities and sketches alone; texts travel only for those that some pair needs, and one link between two components is enough.
    """
    spark = docs.sparkSession
    small_batches(spark)
    spread = lambda n, size, salt: F.pmod(F.xxhash64("v", F.lit(salt)), F.ceil(n / size)).cast("int")
    every = lambda n, size: F.explode(F.sequence(F.lit(0), (F.ceil(n / size) - 1).cast("int")))
    outsiders, size = F.col("outsiders"), F.col("size")
    own = named.where("outside").withColumn("chunk", spread(outsiders, CHUNK, 0)).withColumn("blk", every(size, BLOCK)).withColumn("role", F.lit(0))
    rest = named.withColumn("blk", spread(size, BLOCK, 1)).withColumn("chunk", every(outsiders, CHUNK)).withColumn("role", F.lit(1))
    rows = own.unionByName(rest).select("bucket", "chunk", "blk", "role", "v", "label", "n", "band").join(cls.select("v", "sketch", "parity"), "v")
    rows = rows.select("bucket", "chunk", "blk", "role", "v", "label", "n", "band", "sketch", "parity")
    dealt = lambda df: df.repartition("bucket", "chunk", "blk").sortWithinPartitions("bucket", "chunk", "blk", "role")
    schema = rows.schema
    target = to_arrow_schema(schema)

    def needed(batches):
        for key, own, rest in _groups(batches, 10):
            if own:
                want = _wanted(own, rest)
                got = [(*key, 0, *own[i]) for i in np.flatnonzero(want.any(1))] + [(*key, 1, *rest[j]) for j in np.flatnonzero(want.any(0))]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), target.types)], schema=target)

    need = stored(dealt(rows).mapInArrow(needed, schema).dropDuplicates(["bucket", "chunk", "blk", "role", "v"]), f"{path}-need")
    pairs = need.select(F.col("v").alias("a"), F.col("v").alias("b"))
    known = texts_of(docs, cls, pairs, f"{path}-texts")

    def test(batches):
        for _, own, rest in _groups(batches, 11):
            if not own:
                continue
            want, hit = _wanted(own, rest), []
            sa = [shingles(r[6]) for r in own]
            own_keys = [np.unique(x) for x in sa]
            keys, owner = np.concatenate(own_keys), np.repeat(np.arange(len(sa)), [len(x) for x in own_keys])
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            joined: set[tuple[int, str]] = set()
            for j in np.flatnonzero(want.any(0)).tolist():
                sb = shingles(rest[j][6])
                low = np.searchsorted(keys, sb, "left")
                n = np.searchsorted(keys, sb, "right") - low
                at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
                both = np.bincount(owner[at], minlength=len(own))  # no alignment agrees in more
                for i in np.flatnonzero(want[:, j]).tolist():
                    total = len(sa[i]) + len(sb)
                    if total - 2 * int(both[i]) <= total // 9 and (i, rest[j][1]) not in joined and linked(sa[i], sb):
                        joined.add((i, rest[j][1]))
                        hit.append((own[i][0], rest[j][0]))
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in hit], pa.binary()), pa.array([y for _, y in hit], pa.binary())], names=["a", "b"])

    return dealt(need.join(known, "v").select(*schema.names, "text")).mapInArrow(test, "a binary, b binary")


def texts_of(docs: DataFrame, cls: DataFrame, pairs: DataFrame, path: str) -> DataFrame:
    """v and text of every class in the pairs, from its first row."""
    v = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct()
    need = stored(cls.join(v, "v", "semi").select("v", F.col("first._file").alias("_file"), F.col("first._row").alias("_row")), f"{path}-rows")
    rows = in_bitmap(located(docs).select("_file", "_row", "text"), F.xxhash64("_file", "_row"), need, F.xxhash64("_file", "_row"))
    return stored(rows.join(need, ["_file", "_row"]).select("v", "text"), path)


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, group_id, group_size, kept, _file, _row.

    class_id is the smallest id among documents of the same words, group_id among all near copies.
    """
    docs = filed(docs)
    base = shared_dir(docs.sparkSession, "near")
    rows, cls = classes(docs, base)
    label = components(links(docs, cls, base))
    named = cls.join(label, "v", "left").select("v", "first", "copies", F.coalesce("label", "v").alias("label"))
    groups = named.groupBy("label").agg(F.min("first").alias("head"), F.sum("copies").alias("group_size"))
    named = stored(named.join(groups, "label").select("v", F.col("first.doc_id").alias("class_id"), "head", "group_size"), f"{base}/named")
    kept = (F.col("_file") == F.col("head._file")) & (F.col("_row") == F.col("head._row")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id"))
    return rows.join(named, "v").select("doc_id", "class_id", F.col("head.doc_id").alias("group_id"), "group_size", kept.alias("kept"), "_file", "_row")


def drop_near(docs: DataFrame) -> DataFrame:
    """docs with one document of each group."""
    docs = filed(docs)
    return without_rows(docs, near_dedup(docs).where("not kept"))
