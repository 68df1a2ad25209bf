"""Token ids in binary shards, each a wavelet matrix in one compressed file.

Documents are dealt by ranges of doc_id (null first, then ascending; equal ids by the hash of their
text), encoded, closed by an end id and laid one after the other. A shard's distinct ids get codes by
falling frequency; the codes' bits, highest first, form bit-planes, and every plane lists the tokens
in the order that the planes above it sort them into, zeros before ones. A plane is compressed in blocks
of 32,768 bits, and the file holds the number of ones before each: these give rank and select, and with them the token at a
place, the number of an id's occurrences in a range and the places of an id, by unpacking one or two blocks of each plane.

Shards and the manifest go below the folder in spark.checkpoint.dir. A task's files carry a name of
their own and count only if the manifest, written by Spark when all tasks have ended, lists them; a
task that runs again after a lost executor leaves at most a file that nobody lists.

Null and empty texts have the end id alone. Long documents make a shard larger than shard_tokens, as
a document is never split. Repeated rows are each laid down. Columns other than doc_id and text are
ignored; an empty table makes no shard and an empty result.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memory, filled, give_back, held, shared_dir, small_batches, stored, texts

MAGIC = b"WMSHARD2"
#: Bits in a block of a plane, and how many unpacked blocks of a plane are kept.
STEP, KEPT = 1 << 15, 8
#: ASCII marks at a word's end, at which the tokenizer always parts (not the apostrophe, which may begin a contraction).
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)
#: How a byte-level tokenizer writes bytes that are not printable characters of Latin-1.
BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class Plane:
    """A row of bits in blocks of STEP, each compressed by itself (or as it is, if that is no smaller), with the number of ones before each block."""

    def __init__(self, n: int, sizes: np.ndarray, ranks: np.ndarray, data: bytes | memoryview):
        self.n, self.ranks, self.data = n, ranks, data
        self.at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.open: dict[int, np.ndarray] = {}
        #: How many blocks were unpacked.
        self.unpacked = 0

    @classmethod
    def pack(cls, bits: np.ndarray) -> Plane:
        raw = np.packbits(bits, bitorder="little")
        press = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True).compress
        pieces = [raw[k : k + STEP // 8] for k in range(0, len(raw), STEP // 8)]
        ones = np.array([int(np.bitwise_count(x).sum()) for x in pieces], np.int64)
        small = [min(x.tobytes(), press(x.tobytes()), key=len) for x in pieces]  # of equal length as it is: readers go by the length
        return cls(len(bits), np.array([len(x) for x in small], "<u2"), np.concatenate([[0], np.cumsum(ones)]).astype("<u4"), b"".join(small))

    def _unpack(self, b: int) -> bytes:
        raw = min(STEP, self.n - b * STEP) + 7 >> 3
        x = self.data[self.at[b] : self.at[b + 1]]
        return bytes(x) if len(x) == raw else zstandard.decompress(x)

    def block(self, b: int) -> np.ndarray:
        """The bytes of one block; the last few are kept."""
        if b not in self.open:
            if len(self.open) >= KEPT:
                self.open.pop(next(iter(self.open)))
            self.open[b] = np.frombuffer(self._unpack(b), np.uint8)
            self.unpacked += 1
        return self.open[b]

    def bits(self) -> np.ndarray:
        """All bits, as booleans."""
        return np.unpackbits(np.frombuffer(b"".join(map(self._unpack, range(len(self.at) - 1))), np.uint8), count=self.n, bitorder="little").view(bool)

    def bit(self, i: int) -> int:
        b, r = divmod(i, STEP)
        return int(self.block(b)[r // 8]) >> (r % 8) & 1

    def ones(self, i: int) -> int:
        """How many ones there are before place i."""
        b, r = divmod(i, STEP)
        got = int(self.ranks[b])
        if r:
            p = self.block(b)
            got += int(np.bitwise_count(p[: (r + 7) // 8]).sum())
            if r % 8:
                got -= int(int(p[r // 8]) >> (r % 8)).bit_count()
        return got

    def find(self, j: int, bit: int) -> int:
        """The place of the j-th (from 0) zero or one."""
        r = self.ranks.astype(np.int64)
        r = r if bit else np.minimum(np.arange(len(r)) * STEP, self.n) - r
        b = int(np.searchsorted(r, j, side="right")) - 1
        bits = np.unpackbits(self.block(b), count=min(STEP, self.n - b * STEP), bitorder="little")
        return b * STEP + int(np.flatnonzero(bits == bit)[j - int(r[b])])


class WaveletMatrix:
    """A sequence of codes below 2**levels as bit-planes with rank and select."""

    def __init__(self, n: int, planes: list[Plane], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros

    @classmethod
    def build(cls, codes: np.ndarray, levels: int) -> WaveletMatrix:
        planes, zeros, now = [], [], codes
        for k in range(levels - 1, -1, -1):
            ones = (now & codes.dtype.type(1 << k)).astype(bool)
            planes.append(Plane.pack(ones))
            low = now.compress(~ones)
            zeros.append(len(low))
            now = np.concatenate([low, now.compress(ones)])
        return cls(len(codes), planes, zeros)

    def all(self, dtype=np.uint32) -> np.ndarray:
        """The whole sequence, from the last plane back to the first."""
        out = np.zeros(self.n, dtype)
        last = len(self.planes) - 1
        for k in range(last, -1, -1):
            ones = self.planes[k].bits()
            z = self.zeros[k]
            if z == self.n:
                continue
            before = np.empty(self.n, dtype)
            before[np.flatnonzero(~ones)] = out[:z]
            before[np.flatnonzero(ones)] = out[z:] | dtype(1 << (last - k))
            out = before
        return out

    def at(self, i: int) -> int:
        code = 0
        for p, z in zip(self.planes, self.zeros):
            bit, one = p.bit(i), p.ones(i)
            i = z + one if bit else i - one
            code = code << 1 | bit
        return code

    def span(self, code: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of a code within [lo, hi) lie after the last plane."""
        last = len(self.planes) - 1
        for k in range(last + 1):
            a, b = self.planes[k].ones(lo), self.planes[k].ones(hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if code >> (last - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def place(self, code: int, j: int) -> int:
        """The place in the sequence of what lies at j after the last plane."""
        last = len(self.planes) - 1
        for k in range(last, -1, -1):
            bit = code >> (last - k) & 1
            j = self.planes[k].find(j - self.zeros[k] * bit, bit)
        return j


class Shard:
    """A shard as read from its file: documents, their places, and the wavelet matrix of the ids."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard file")
        (size,) = struct.unpack("<I", data[8:12])
        head = json.loads(data[12 : 12 + size])
        at = 12 + size
        parts = []
        for n in head["parts"]:
            parts.append(data[at : at + n])
            at += n
        if at != len(data):
            raise ValueError("shard file is cut off or has bytes too many")
        plain = lambda x, t: np.frombuffer(zstandard.decompress(x), t)
        self.doc_ids, self.none, self.lengths, self.symbols, sizes, ranks = (plain(x, t) for x, t in zip(parts, ("<i8", "u1", "<u4", "<u4", "<u2", "<u4")))
        n, levels = head["tokens"], len(head["zeros"])
        sizes, ranks = sizes.reshape(levels, -1), ranks.reshape(levels, -1)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        self.matrix = WaveletMatrix(n, [Plane(n, *x) for x in zip(sizes, ranks, parts[6:])], head["zeros"])
        self.code = {int(s): k for k, s in enumerate(self.symbols)}

    @staticmethod
    def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
        flat = np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)
        counts = np.bincount(flat)
        symbols = np.flatnonzero(counts)
        symbols = symbols[np.argsort(-counts[symbols], kind="stable")]
        kind = np.uint16 if len(symbols) <= 1 << 16 else np.uint32
        codes = np.zeros(len(counts), kind)
        codes[symbols] = np.arange(len(symbols))
        levels = max(1, (len(symbols) - 1).bit_length())
        m = WaveletMatrix.build(codes[flat], levels)
        press = zstandard.ZstdCompressor(level=1).compress
        arrays = [np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], "u1"), np.array([len(x) for x in ids], "<u4"), symbols.astype("<u4")]
        arrays += [np.concatenate([p.at[1:] - p.at[:-1] for p in m.planes]).astype("<u2"), np.concatenate([p.ranks for p in m.planes])]
        parts = [*(press(x.tobytes()) for x in arrays), *(p.data for p in m.planes)]
        head = json.dumps({"tokens": m.n, "zeros": m.zeros, "parts": [len(x) for x in parts]}).encode()
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])

    def __len__(self) -> int:
        return self.matrix.n

    def token(self, i: int) -> int:
        return int(self.symbols[self.matrix.at(i)])

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the token occurs in [lo, hi)."""
        if token not in self.code:
            return 0
        a, b = self.matrix.span(self.code[token], lo, self.matrix.n if hi is None else hi)
        return b - a

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> Iterator[int]:
        """The places of the token in [lo, hi), ascending."""
        if token in self.code:
            c = self.code[token]
            for j in range(*self.matrix.span(c, lo, self.matrix.n if hi is None else hi)):
                yield self.matrix.place(c, j)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, by token access."""
        return np.array([self.token(i) for i in range(self.starts[k], self.starts[k + 1])], np.uint32)

    def tokens(self) -> np.ndarray:
        kind = np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32
        return self.symbols[self.matrix.all(kind)]


#: What a tokenizer's normalizer, pre-tokenizer and model say if words can be encoded one by one (fixed values).
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}


def by_word(tokenizer: dict) -> bool:
    """True if a tokenizer (as its file says) drops white space, never merges over it, and is else as WordMemory takes it to be."""
    model = {k: v for k, v in tokenizer["model"].items() if k not in ("vocab", "merges")}
    plain = all(not t["normalized"] and not t["single_word"] and not t["lstrip"] and not t["rstrip"] for t in tokenizer["added_tokens"])
    return plain and {k: tokenizer[k] for k in ("normalizer", "pre_tokenizer")} | {"model": model} == BY_WORD and not tokenizer["truncation"] and not tokenizer["padding"]


class WordMemory:
    """Encodes with the tokenizers library, remembering the words it has met.

    A tokenizer that is as BY_WORD says drops white space and never merges over it, so that a text's ids are those of its
    parts between ASCII white space. As it lower-cases, ASCII letters are lower-cased first, unless the text
    has combining marks, with which they could form one character. With any other tokenizer whole texts are encoded.
    """

    def __init__(self, path: str, end: int, memory: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.encoder.get_added_tokens_decoder().values()) or "(?!)", re.I)
        self.model = self.encoder.model
        self.end, self.known = array("I", [end]).tobytes(), Memory(self.one, memory)
        self.by_word = by_word(json.loads(self.encoder.to_str()))

    def one(self, word: bytes) -> bytes:
        body = word.rstrip(MARKS)
        if len(body) < len(word):
            return self.known[body] + self.known[word[len(body) :]] if body and self.letters(body) else self.whole(word)
        if self.letters(word):
            return array("I", [t.id for t in self.model.tokenize(word.decode("latin-1").translate(BYTE_LETTERS))]).tobytes()
        return self.whole(word)

    def letters(self, word: bytes) -> bool:
        """True if the tokenizer hands the word to its model as it is: small Latin letters in composed form alone."""
        s = word.decode()
        return s.isalpha() and s.islower() and (s.isascii() or max(s) < "\u0250" and is_normalized("NFC", s))

    def whole(self, word: bytes) -> bytes:
        return array("I", self.encoder.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def packed(self, text: str) -> bytes:
        """The ids of a text and the end id, as little-endian unsigned 32-bit integers."""
        data = text.encode()
        if not self.by_word:
            return self.whole(data) + self.end
        if b"\xcc" not in data and b"\xcd" not in data and not (b"<" in data and self.special.search(text)):
            data = data.lower()
        return b"".join([*map(self.known.__getitem__, data.split()), self.end])


def write(docs: DataFrame, tokenizer: str, end: int = 1, shard_tokens: int = 1 << 20) -> DataFrame:
    """Writes the shards and gives the manifest: part, shard, path, docs, tokens, bytes, start (tokens before it)."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark, "tokens")
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + os.path.abspath(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled().alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(f"{where}/shards", recursive=True)
        memory, part = held(("words", tokenizer, end), lambda: WordMemory(tokenizer, end)), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        shard = size = 0

        def close() -> pa.RecordBatch:
            nonlocal shard, size
            data = Shard.pack(names, ids)
            path = f"{where}/shards/{part:06d}-{shard:06d}-{uuid.uuid4().hex[:12]}.wm"
            with store.open_output_stream(path) as f:
                f.write(data)
            row = {"part": [part], "shard": [shard], "path": [path], "docs": [len(names)], "tokens": [size], "bytes": [len(data)]}
            shard, size = shard + 1, 0
            ids.clear()
            names.clear()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), map(memory.packed, texts(b))):
                names.append(name)
                ids.append(np.frombuffer(x, "<u4"))
                size += len(ids[-1])
                if size >= shard_tokens:
                    yield close()
        if names:
            yield close()
        give_back()

    made = stored(rows.mapInArrow(run, "part int, shard int, path string, docs long, tokens long, bytes long"), f"{folder}/made")
    totals = sorted((r["part"], r["n"]) for r in made.groupBy("part").agg(F.sum("tokens").alias("n")).collect())  # a row for each task
    bases, base = [], 0
    for part, n in totals:
        bases.append((part, base))
        base += n
    bases = spark.createDataFrame(bases, "part int, base long")
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stored(made.withColumn("before", before).join(bases, "part").select(*made.columns, (F.col("base") + F.col("before")).alias("start"), F.lit(folder).alias("folder")), f"{folder}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Per document what its shard file holds: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                store, _ = pa.fs.FileSystem.from_uri(r["folder"])
                with store.open_input_stream(r["path"]) as f:
                    shard = Shard(f.read())
                flat = shard.tokens().astype("<u4", copy=False)
                at = shard.starts.tolist()
                crc = [zlib.crc32(flat[i:j]) for i, j in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64(), mask=shard.none.astype(bool)), pa.array(shard.starts[:-1] + r["start"], pa.int64()), pa.array(shard.lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # a number of partitions that is given is not coalesced: small rows, large files
    dealt = manifest.select("folder", "path", "start").repartition(max(1, min(manifest.count(), 20_000)), F.xxhash64("path"))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
