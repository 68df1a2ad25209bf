"""Chat formatting by prefix trees.

Conversations that begin with the same turns share these turns' nodes. Each node's text, in the template
below, is emitted once, parents before children, depth first. A token's position is its place on
the way from the root, not in the sequence; a node may attend to itself and to its ancestors, whose places
come as intervals of the sequence (adjacent ones as one). The loss mask covers the texts of assistant turns.

Template: <|turn|>role<|text|>text<|end|> for each turn. In roles and texts a backslash is doubled, and one
is put after the first character of whatever looks like a control string (of this template or of other known
ones); taking a backslash away before each character that follows one gives the text back.

Conversations are sorted by their turns' digests over ranges of partitions, which brings shared beginnings
together in depth-first order; ever so many conversations with one beginning fall into several ranges. A sequence (shard) ends with
its range or when it holds shard_units; what the next one shares with it is emitted again there, once. A conversation
itself is never cut: its turns are gathered in one row.

Null texts and roles count as empty, null turn numbers come first. Turns of equal number are ordered by role and text; all rows count. Each row
with a null conversation id is a conversation of its own, as nothing tells which belong together. Equal conversations end at the same node, each with a leaf of its own. An
empty table gives an empty result; columns of other names are ignored. Units are code points, or the ids of a tokenizer of the tokenizers library.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings that texts must not contain as such: these and all that begin with <|.
CONTROLS = re.compile(r"(<(?=\||/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\]))")
_PLAIN = re.compile(r"\\(.)", re.S)
_TURNS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)


def escape(s: str) -> str:
    return CONTROLS.sub(r"\1\\", s.replace("\\", "\\\\"))


def unescape(s: str) -> str:
    return _PLAIN.sub(r"\1", s)


def parse(s: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    out, at = [], 0
    for m in _TURNS.finditer(s):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(s):
        raise ValueError("not a formatted conversation")
    return out


class Packer:
    """Builds one shard: text (and ids), nodes and leaves."""

    def __init__(self, encode=None):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.parts: list[str] = []
        self.ids: list[int] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.stack: list[tuple[tuple[str, str], int]] = []

    def units(self, s: str) -> int:
        self.parts.append(s)
        if self.encode is None:
            return len(s)
        ids = self.encode(s)
        self.ids += ids
        return len(ids)

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        same = 0
        while same < min(len(turns), len(self.stack)) and self.stack[same][0] == turns[same]:
            same += 1
        del self.stack[same:]
        for turn in turns[same:]:
            parent = self.stack[-1][1] if self.stack else -1
            up = self.nodes[parent] if self.stack else None
            start = self.size
            head = self.units(TURN + escape(turn[0]) + TEXT)
            body = self.units(escape(turn[1]))
            tail = self.units(END)
            self.size += head + body + tail
            attends = [dict(x) for x in up["attends"]] if up else []
            if up:
                if attends and attends[-1]["end"] == up["start"]:
                    attends[-1]["end"] = up["end"]
                else:
                    attends.append({"start": up["start"], "end": up["end"]})
            loss = (start + head, start + head + body) if turn[0] == "assistant" else (start, start)
            self.nodes.append({"parent": parent, "start": start, "end": self.size, "position": up["position"] + up["end"] - up["start"] if up else 0, "loss_start": loss[0], "loss_end": loss[1], "attends": attends})
            self.stack.append((turn, len(self.nodes) - 1))
        self.leaves.append({"conv_id": conv_id, "node": self.stack[-1][1] if self.stack else -1})


SHARD = "shard string, text string, ids array<int>, nodes array<struct<parent:int,start:long,end:long,position:long,loss_start:long,loss_end:long,attends:array<struct<start:long,end:long>>>>, leaves array<struct<conv_id:long,node:int>>"


def format_trees(rows: DataFrame, tokenizer: str | None = None, shard_units: int = 1 << 20) -> DataFrame:
    """One row for each shard. rows: conv_id, turn, role, text."""
    spark = rows.sparkSession
    small_batches(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    conv = rows.select(F.col("conv_id").cast("long").alias("conv_id"), alone, turn.alias("t")).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    key = F.array_join(F.transform("turns", lambda t: F.substring(F.md5(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"])), 1, 16)), "")
    conv = conv.withColumn("key", key).repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    schema = pa.schema([("shard", pa.string()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("nodes", pa.list_(pa.struct([("parent", pa.int32()), *[(x, pa.int64()) for x in ("start", "end", "position", "loss_start", "loss_end")], ("attends", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))), ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        if tokenizer:
            from tokenizers import Tokenizer

            coder = Tokenizer.from_file(tokenizer)
            encode = lambda s: coder.encode(s, add_special_tokens=False).ids
        packer, n, part = Packer(encode), 0, TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            nonlocal n
            row = {"shard": f"{part:06d}-{n:06d}", "text": "".join(packer.parts), "ids": packer.ids if encode else None, "nodes": packer.nodes, "leaves": packer.leaves}
            out = pa.RecordBatch.from_pylist([row], schema=schema)
            n += 1
            packer.clear()
            return out

        for b in batches:
            for conv_id, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                packer.add(conv_id, [(t["role"], t["text"]) for t in turns])
                if packer.size >= shard_units:
                    yield close()
        if packer.leaves:
            yield close()

    return conv.select("conv_id", "turns").mapInArrow(run, SHARD)


def conversations(shard: dict) -> Iterator[tuple[int | None, str, list[str]]]:
    """Of a shard in code points: each leaf's conversation id, its formatted text and the texts under the loss mask.

    Read by what a leaf may attend to; the positions of these units must be 0, 1, 2 and so on.
    """
    text, nodes = shard["text"], shard["nodes"]
    for leaf in shard["leaves"]:
        k = leaf["node"]
        if k < 0:
            yield leaf["conv_id"], "", []
            continue
        path = []
        while k >= 0:
            path.append(nodes[k])
            k = nodes[k]["parent"]
        path.reverse()
        at = 0
        for x in path:
            if x["position"] != at:
                raise ValueError("positions do not go on from the parent's")
            at += x["end"] - x["start"]
        last = path[-1]
        whole = "".join([*(text[i["start"] : i["end"]] for i in last["attends"]), text[last["start"] : last["end"]]])
        yield leaf["conv_id"], whole, [unescape(text[x["loss_start"] : x["loss_end"]]) for x in path if x["loss_end"] > x["loss_start"]]


def read_back(shards: DataFrame) -> DataFrame:
    """Per conversation, read from the shards: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.to_pylist():
                out = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
                for conv_id, whole, loss in conversations(shard):
                    turns, learned = parse(whole), "".join(loss)
                    for k, v in zip(out, (conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(whole))):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return shards.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
