"""Removal of repeated passages by super-k-mer partitioning.

A window is WINDOW consecutive words of one document; its minimiser is the smallest hash among its MER-word
sequences, so that equal windows have equal minimisers. Consecutive windows with one minimiser make a
super-k-mer, whose words travel once, as one packed string, to the minimiser's bucket. There the windows of
all the bucket's strings are sorted, and each gets the smallest document id it occurs in. A word goes if a window
over it occurs in a document with a smaller id.

First a round of minimisers alone finds those that occur in more than one document; a bitmap of a fixed size
then lets only their super-k-mers (and a few others, by chance) be packed. Equal strings travel once from each
batch of rows. A minimiser whose different strings have more than HOT bytes gets no bucket: its windows are dealt singly, by their
SHA-256, and combined before the shuffle. In buckets windows are sorted by a hash and compared in full.

Words are runs without ASCII white space, unchanged. Null texts have no words; texts of fewer than WINDOW words
have no window and stay whole. A null id counts as larger than all others. Rows of one id never remove each
other's words; each row gives one result row. Very long texts are taken whole. An empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import PAGES, filled, shared_dir, small_batches, stored, texts, with_columns
from .stream_dedup import filed, free_names, located

WINDOW, MER = 50, 8
#: A bucket's strings have so many bytes at most (about 150,000 windows; a string alone may have more).
HOT = 1 << 20
NONE = 2**63 - 1
#: So many windows of a string are dealt at once where there is no bucket.
AT_ONCE = 10_000
_M = np.uint64(0x9E3779B97F4A7C15)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = ((a * _M) ^ (b + (a >> np.uint64(29)))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def super_kmers(words: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words' super-k-mers: minimiser, first window, and the one after the last window."""
    n = len(words)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    size = 1
    while size < MER:
        h = _join(h[:-size], h[size:])
        size *= 2
    over = window - MER + 1
    pad = -len(h) % over
    blocks = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, over)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - window + 1
    least = np.minimum(behind[:count], ahead[over - 1 : over - 1 + count])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[first].view(np.int64), first, np.append(first[1:], count)


def repeated(rows: DataFrame) -> DataFrame:
    """The minimisers (mini) that occur in documents of different ids. rows: d, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mini, ids = [], []
            for d, x in zip(b.column(0).to_pylist(), texts(b)):
                m = np.unique(super_kmers(x.encode().split())[0])
                mini.append(m)
                ids.append(np.full(len(m), d))
            m, d = np.concatenate(mini), np.concatenate(ids)
            order = np.lexsort((d, m))
            m, d = m[order], d[order]
            first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])) if len(m) else np.zeros(0, int)
            last = np.append(first[1:], len(m)) - 1 if len(m) else first
            yield pa.RecordBatch.from_arrays([pa.array(m[first]), pa.array(d[first]), pa.array(d[last])], names=["mini", "low", "high"])

    found = rows.select("d", "text").mapInArrow(run, "mini long, low long, high long")
    return found.groupBy("mini").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("mini")


def bitmap_of(mini: DataFrame) -> np.ndarray:
    """A bitmap of PAGES * 32,768 bits (16 MB, whatever the input) with a bit for each minimiser."""
    page, bit = F.col("mini").bitwiseAND(PAGES - 1), F.shiftrightunsigned("mini", 12).bitwiseAND(32767)
    out = np.zeros((PAGES, 4096), np.uint8)
    for r in mini.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(bit).alias("bits")).toLocalIterator():  # PAGES rows at most
        out[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def has_bit(bits: np.ndarray, mini: np.ndarray) -> np.ndarray:
    m = mini.view(np.uint64)
    at = ((m >> np.uint64(12)) & np.uint64(32767)).astype(np.int64)
    return (bits[(m & np.uint64(PAGES - 1)).astype(np.int64) * 4096 + at // 8] >> (at % 8).astype(np.uint8)) & 1 > 0


PIECES = "_file long, _row long, d long, start int, windows int, mini long, sid binary, packed string, low long, high long"


def pieces(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """The super-k-mers whose minimiser has a bit; packed (with the ids it has in the batch, low to high) at one of equal ones."""
    held = rows.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema([(x, pa.int64()) for x in ("_file", "_row", "d")] + [("start", pa.int32()), ("windows", pa.int32()), ("mini", pa.int64()), ("sid", pa.binary()), ("packed", pa.string()), ("low", pa.int64()), ("high", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = held.value
        for b in batches:
            out: dict[str, list] = {x: [] for x in schema.names}
            seen: dict[bytes, int] = {}
            for file, row, d, x in zip(*(b.column(k).to_pylist() for k in range(3)), texts(b)):
                words = x.encode().split()
                mini, first, end = super_kmers(words)
                for k in np.flatnonzero(has_bit(mask, mini)).tolist():
                    s, e = int(first[k]), int(end[k])
                    packed = b" ".join(words[s : e + WINDOW - 1])
                    sid = xxh3_128_digest(packed)
                    at = seen.setdefault(sid, len(out["d"]))
                    new = at == len(out["d"])
                    for name, v in zip(schema.names, (file, row, d, s, e - s, int(mini[k]), sid, packed.decode() if new else None, d if new else None, d if new else None)):
                        out[name].append(v)
                    if not new:
                        out["low"][at] = min(out["low"][at], d)
                        out["high"][at] = max(out["high"][at], d)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return rows.select("_file", "_row", "d", "text").mapInArrow(run, PIECES)


def window_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of each window, from those of its words."""
    n, size = len(words) - WINDOW + 1, 1
    of = {1: np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))}
    while size * 2 <= WINDOW:
        of[size * 2] = _join(of[size][:-size], of[size][size:])
        size *= 2
    out, at = None, 0
    for size in sorted(of, reverse=True):
        if at + size <= WINDOW:
            piece = of[size][at : at + n]
            out, at = (piece if out is None else _join(out, piece)), at + size
    return out


def owners_in_bucket(group: list[tuple[bytes, int, int, str]]) -> Iterator[tuple[bytes, list[dict]]]:
    """For the strings (sid, low, high, packed) of one minimiser: sid and runs (start, end, owner) of its windows.

    All windows are sorted by their hashes (24 bytes a window), and those of one hash compared in full.
    """
    packed = [p.encode() for _, _, _, p in group]
    places, hashes = [], []
    for p in packed:
        words = p.split(b" ")
        places.append(np.concatenate([[0], np.cumsum([len(x) + 1 for x in words])]))
        hashes.append(window_hashes(words))
    size = [len(h) for h in hashes]
    every, which = np.concatenate(hashes), np.repeat(np.arange(len(group), dtype=np.int32), size)
    at = np.concatenate([np.arange(n, dtype=np.int64) for n in size])
    low, high = np.array([g[1] for g in group], np.int64), np.array([g[2] for g in group], np.int64)
    order = np.argsort(every, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
    count = np.diff(np.append(first, len(order)))
    owner = np.empty(len(every), np.int64)
    owner[order] = np.repeat(np.minimum.reduceat(low[which[order]], first), count)

    def window(x: int) -> bytes:
        g, j = int(which[x]), int(at[x])
        return packed[g][places[g][j] : places[g][j + WINDOW] - 1]

    for f, n in zip(first[count > 1].tolist(), count[count > 1].tolist()):
        members = order[f : f + n].tolist()
        one = window(members[0])
        if any(window(x) != one for x in members[1:]):  # unlike windows of one hash
            least: dict[bytes, int] = {}
            for x in members:
                least[window(x)] = min(least.get(window(x), NONE), int(low[which[x]]))
            for x in members:
                owner[x] = least[window(x)]
    end = np.cumsum(size)
    for g, (sid, _, _, _) in enumerate(group):
        own = owner[end[g] - size[g] : end[g]]
        runs = runs_of(own, own < high[g])
        if runs:
            yield sid, runs


def runs_of(own: np.ndarray, wanted: np.ndarray) -> list[dict]:
    """The stretches of wanted places with one owner."""
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (wanted[1:] != wanted[:-1])])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(own))
    return [{"start": int(a), "end": int(b), "owner": int(own[a])} for a, b in zip(start, end) if wanted[a]]


RUNS = "array<struct<start:int,end:int,owner:long>>"


def owners(heads: DataFrame) -> DataFrame:
    """mini, sid and runs for all strings that have a window in a document of a smaller id. heads: mini, sid, packed, low, high."""
    schema = pa.schema([("mini", pa.int64()), ("sid", pa.binary()), ("runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("owner", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list = []
        mini = None
        out: dict[str, list] = {x: [] for x in schema.names}

        def close() -> None:
            for sid, runs in owners_in_bucket(group):
                for name, v in zip(schema.names, (mini, sid, runs)):
                    out[name].append(v)

        for b in batches:
            for m, sid, low, high, packed in zip(*(b.column(k).to_pylist() for k in range(5))):
                if m != mini and group:
                    close()
                    group = []
                mini = m
                group.append((sid, low, high, packed))
            if len(out["mini"]) >= 1000:
                yield pa.RecordBatch.from_pydict(out, schema=schema)
                out = {x: [] for x in schema.names}
        if group:
            close()
        yield pa.RecordBatch.from_pydict(out, schema=schema)

    dealt = heads.select("mini", "sid", "low", "high", "packed").repartition("mini").sortWithinPartitions("mini")
    return dealt.mapInArrow(run, f"mini long, sid binary, runs {RUNS}")


def owners_singly(heads: DataFrame) -> DataFrame:
    """The same for minimisers whose strings are too many or too long for one bucket: window by window, each by its SHA-256, dealt by that.

    A string's equal windows (as in a text that repeats itself) travel as one row for each AT_ONCE windows.
    """
    schema = pa.schema([("mini", pa.int64()), ("sid", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("window", pa.binary()), ("runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for mini, sid, low, high, packed in zip(*(b.column(k).to_pylist() for k in range(5))):
                data = packed.encode()
                place = np.concatenate([[0], np.cumsum([len(x) + 1 for x in data.split(b" ")])]).tolist()
                n = len(place) - WINDOW
                for part in range(0, n, AT_ONCE):
                    found: dict[bytes, list[dict]] = {}
                    for j in range(part, min(n, part + AT_ONCE)):
                        runs = found.setdefault(hashlib.sha256(data[place[j] : place[j + WINDOW] - 1]).digest(), [])
                        if runs and runs[-1]["end"] == j:
                            runs[-1]["end"] = j + 1
                        else:
                            runs.append({"start": j, "end": j + 1})
                    k = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(([mini] * k, [sid] * k, [low] * k, [high] * k, list(found), list(found.values())), schema)], schema=schema)

    rows = heads.select("mini", "sid", "low", "high", "packed")
    each = rows.mapInArrow(run, "mini long, sid binary, low long, high long, window binary, runs array<struct<start:int,end:int>>")
    least = each.groupBy("window").agg(F.min("low").alias("owner"))
    own = each.join(least, "window").where("owner < high").select("mini", "sid", "owner", F.explode("runs").alias("r"))
    return own.groupBy("mini", "sid").agg(F.collect_list(F.struct("r.start", "r.end", "owner")).alias("runs"))  # as many as the string has windows


def removed(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """_file, _row and spans (start, end) of the words to remove, for rows that have any. docs must be of files (filed)."""
    base = shared_dir(docs.sparkSession, "super")
    rows = located(docs).select("_file", "_row", F.coalesce("doc_id", F.lit(NONE)).alias("d"), "text")
    small_batches(docs.sparkSession)
    got = stored(pieces(rows, bitmap_of(repeated(rows))), f"{base}/pieces")
    heads = got.where("packed is not null").groupBy("mini", "sid", "packed").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    heads = stored(heads, f"{base}/heads")
    many = stored(heads.groupBy("mini").agg(F.sum(F.octet_length("packed")).alias("bytes")).where(F.col("bytes") > hot).select("mini"), f"{base}/hot")
    if many.isEmpty():
        own = owners(heads)
    else:
        own = owners(heads.join(many, "mini", "anti")).union(owners_singly(heads.join(many, "mini", "semi")))
    hit = got.select("_file", "_row", "d", "start", "mini", "sid").join(own, ["mini", "sid"])
    spans = hit.select("_file", "_row", "d", F.col("start").alias("at"), F.explode("runs").alias("r")).where("r.owner < d")
    span = F.struct((F.col("at") + F.col("r.start")).alias("start"), (F.col("at") + F.col("r.end") - 1 + WINDOW).alias("end"))
    return spans.groupBy("_file", "_row").agg(F.collect_list(span).alias("spans"))


def _mask(n: int, spans: list[dict] | None) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    for s in spans or []:
        step[s["start"]] += 1
        step[s["end"]] -= 1
    return np.cumsum(step[:n]) > 0


def where(meta, names: list[str]) -> list:
    """The columns that locate a row, under the first two names."""
    return [F.xxhash64(meta["file_path"]).alias(names[0]), meta["row_index"].alias(names[1])]


def without_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """docs with text cut down to the kept words, n_words and n_removed; or, as digest, doc_id, n_words, n_removed, kept_sha256."""
    docs = filed(docs)
    free = free_names(docs, 5)
    meta = docs.metadataColumn("_metadata")
    rows = docs.select("doc_id", filled().alias("text"), *where(meta, free)) if digest else docs.select("*", *where(meta, free))
    gone = removed(docs).select(*[F.col(c).alias(n) for c, n in zip(("_file", "_row", "spans"), free[2:])])
    joined = rows.join(gone, (F.col(free[0]) == F.col(free[2])) & (F.col(free[1]) == F.col(free[3])), "left")

    def make():
        def batch(b):
            words, spans = [x.encode().split() for x in texts(b)], b.column(b.schema.get_field_index(free[4])).to_pylist()
            gone = [_mask(len(w), s) for w, s in zip(words, spans)]
            kept = [b" ".join(w if not g.any() else [x for x, y in zip(w, g.tolist()) if not y]) for w, g in zip(words, gone)]
            out = {"n_words": [len(w) for w in words], "n_removed": [int(g.sum()) for g in gone]}
            return out | ({"kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]} if digest else {"text": [k.decode() for k in kept]})

        return batch

    if digest:
        return with_columns(joined, "n_words long, n_removed long, kept_sha256 string", make, keep=["doc_id"])
    return with_columns(joined, "text string, n_words long, n_removed long", make, keep=docs.columns)
