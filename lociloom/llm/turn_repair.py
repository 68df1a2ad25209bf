"""Repair of a conversation's structure: a forward Viterbi pass over four grammar states.

A conversation is well formed if it is empty, or may begin with a system turn and goes on with pairs of a user's and an assistant's
turn; a role goes by its first letter (s, u, a). Each turn is kept (K, at no cost), gets the role that the grammar asks for (R, user
or assistant, RELABEL), or is deleted (D, DELETE); empty turns of user or assistant may be inserted anywhere (I, INSERT). Turns that are
blank or repeat an earlier turn of the conversation must be deleted, and one that is cut off (truncated) costs CUT more if it stays.
Of the cheapest repairs the one whose letters come first in ASCII is taken. The letters decide the repair: a state tells which role R and I give.

The states are: nothing yet, after a system turn, after a user's, after an assistant's. The pass carries for each the least (cost, letters)
from turn to turn and closes each turn's layer with at most two inserts, as no state is further from another. Of equal cost, letters for the same turns are never
the beginning of one another, so that the lesser of two stays the lesser whatever follows.

Two streams by conversation, sorted within a task, so that neither holds a conversation: the first sees a row of some 50 bytes for each
turn and gives the letters (as long as the conversation has turns: that row the result asks for), the second puts the texts in order
behind their letters. A conversation of a third of all rows therefore flows through one task, which sorts on disk and holds a
few rows, the letters and nothing else; the letters are chained in pieces, so that the work stays in proportion to the turns.

Null roles and texts count as one space; a turn without a role, or of another one, cannot be kept as it is. Null turn numbers come first; turns of one number go by role and the text's SHA-256, so that equal
ones are neighbours and order never depends on the input's. Rows with a null conversation id make one conversation. An empty table gives an empty result, a
conversation of whose turns nothing is left a row of zeros and no turns. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, stored

#: Costs of the edits, and of a cut-off turn that stays.
RELABEL, DELETE, INSERT, CUT = 3, 4, 3, 3
#: After so many turns what the states' letters begin with is put away.
PIECE = 512
#: The pass's output columns.
SUMMARY = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
#: From a state (0 nothing, 1 system, 2 user, 3 assistant) the state after a turn of user or assistant, whichever may follow.
_NEXT = (2, 2, 3, 2)
#: States from which a turn leads to the state of its role.
_BEFORE = {"s": (1, (0,)), "u": (2, (0, 1, 3)), "a": (3, (2,))}
_ROLE = {2: "user", 3: "assistant"}
_LEGAL = ("su", "ua", "au")


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and digest of the rows, with one space for nulls."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


def _faults(rows: DataFrame) -> DataFrame:
    """A light row for each turn: conv_id, turn, role, digest and fault (0 none, 1 blank, 2 duplicate, 3 truncated)."""
    solid = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    last = F.right(solid, F.lit(1))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("turn")) > 1
    light = rows.select("conv_id", "turn", "role", "digest", (solid == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    fault = F.when(F.col("blank"), 1).when(again, 2).when(F.col("cut"), 3).otherwise(0)
    return light.repartition("conv_id").withColumn("fault", fault).drop("blank", "cut")  # the window and the pass need no other exchange


class Pass:
    """The states' least (cost, letters) along one conversation."""

    def __init__(self):
        self.best: list[tuple[int, str] | None] = [(0, ""), None, None, None]
        self.chain: dict[str, tuple] = {"": ()}  # what a first character stands for: (piece, chain before)
        self.turns = 0
        self._close()

    def _close(self) -> None:
        best = self.best
        for state in (0, 1, 3, 2):  # users' turns are inserted first, so that an assistant's may follow one
            if best[state]:
                self._offer(_NEXT[state], best[state][0] + INSERT, best[state][1] + "I")

    def _offer(self, state: int, cost: int, letters: str) -> None:
        if self.best[state] is None or (cost, letters) < self.best[state]:
            self.best[state] = (cost, letters)

    def turn(self, initial: str, fault: int) -> None:
        old, stays = self.best, CUT if fault == 3 else 0
        self.best = [x and (x[0] + DELETE, x[1] + "D") for x in old]
        if fault in (0, 3):
            if initial in _BEFORE:
                to, before = _BEFORE[initial]
                for state in before:
                    if old[state]:
                        self._offer(to, old[state][0] + stays, old[state][1] + "K")
            for state in range(4):
                if old[state]:
                    self._offer(_NEXT[state], old[state][0] + stays + RELABEL, old[state][1] + "R")
        self._close()
        self.turns += 1
        if self.turns % PIECE == 0:
            self._put_away()

    def _put_away(self) -> None:
        """Each state's letters up to the inserts at their end become one character, in the order of the letters."""
        base = [x and x[1].rstrip("I") for x in self.best]
        names = {b: chr(33 + k) for k, b in enumerate(sorted({b for b in base if b}))}
        first = lambda b: b[:1] if self.turns > PIECE else ""
        self.chain = {n: (b[len(first(b)) :], self.chain[first(b)]) for b, n in names.items()}
        self.best = [x and (x[0], names[b] + x[1][len(b) :] if b else x[1]) for x, b in zip(self.best, base)]

    def result(self) -> tuple[int, str]:
        cost, letters = min(x for x in (self.best[0], self.best[3]) if x)
        if self.turns < PIECE:
            return cost, letters
        pieces, link = [letters[1:]], self.chain[letters[:1]]
        while link:
            pieces.append(link[0])
            link = link[1]
        return cost, "".join(reversed(pieces))


def summaries(rows: DataFrame) -> DataFrame:
    """conv_id, gaps (turn numbers missing between the first and the last), blank, duplicate, truncated (turns by their first fault),
    illegal (neighbours whose roles may not follow each other), cost and audit (letters) of each conversation of the rows."""
    small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    light = _faults(ordered(rows)).sortWithinPartitions("conv_id", "turn", "role", "digest", F.col("fault") == 2)
    light = light.select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = [], None

        def close() -> None:
            gaps = high - low + 1 - numbers if numbers else 0
            out.append((at[0], gaps, *faults[1:], illegal, *path.result()))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 8
            made = pa.RecordBatch.from_arrays([pa.array(cols[0], conv_type), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.string())], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])
            out.clear()
            return made

        for b in batches:
            conv_type = b.schema.field(0).type
            for conv, turn, initial, fault in zip(*(c.to_pylist() for c in b.columns)):
                if at is None or conv != at[0]:
                    if at:
                        close()
                    at, path, faults, illegal, before, low, high, numbers = (conv,), Pass(), [0, 0, 0, 0], 0, None, None, None, 0
                path.turn(initial, fault)
                faults[fault] += 1
                illegal += before is not None and before + initial not in _LEGAL
                before = initial
                if turn is not None and turn != high:
                    low, high, numbers = turn if low is None else low, turn, numbers + 1
            if len(out) >= 1000:
                yield batch()
        if at:
            close()
            yield batch()

    return light.mapInArrow(run, SUMMARY.format(kind))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The turns after repair: conv_id, place (from 0), role, text and edit (K, R or I), by the letters of summaries(rows).

    The rows of a conversation come together and in order.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    letters = found.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.col("audit").alias("text"))
    every = letters.unionByName(ordered(rows).select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", "text"))
    every = every.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest").select("conv_id", "part", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        audit, k, state, place, conv = "", 0, 0, 0, None

        def inserts() -> None:
            nonlocal k, state, place
            while k < len(audit) and audit[k] == "I":
                state = _NEXT[state]
                out.append((conv, place, _ROLE[state], "", "I"))
                k, place = k + 1, place + 1

        for b in batches:
            conv_type = b.schema.field(0).type
            for own, part, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if part == 0:
                    inserts()
                    audit, k, state, place, conv = text, 0, 0, 0, own
                    continue
                inserts()
                edit = audit[k]
                k += 1
                if edit != "D":
                    state = _BEFORE[role[:1]][0] if edit == "K" else _NEXT[state]
                    out.append((conv, place, role if edit == "K" else _ROLE[state], text, edit))
                    place += 1
            yield _turns(out, conv_type)
            out = []
        if conv is not None or audit:
            inserts()
            yield _turns(out, conv_type)

    return every.mapInArrow(run, f"conv_id {kind}, place long, role string, text string, edit string")


def _turns(out: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*out)) or [[]] * 5
    types = (conv_type, pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["conv_id", "place", "role", "text", "edit"])


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of the turns as repaired() gives them: of role:text, joined by line ends."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for b in batches:
            conv_type = b.schema.field(0).type
            out = []
            for conv, place, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if at is None or conv != at[0]:
                    if at:
                        out.append((at[0], sha.hexdigest()))
                    at, sha = (conv,), hashlib.sha256()
                sha.update((f"{role}:{text}" if place == 0 else f"\n{role}:{text}").encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], conv_type), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], conv_type), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return turns.select("conv_id", "place", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with faults put in by crc32 of conv_id:turn, modulo 20: 0 drops a row, 1 empties its text, 2 takes its
    sentence ends away, 3 repeats it, 4 makes it a user's. Nulls count as one space, in the key too."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    part: Column = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    role = F.when(F.col("_part") == 4, "user").otherwise(space("role"))
    text = F.when(F.col("_part") == 1, "").when(F.col("_part") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    held = rows.select("conv_id", "turn", "role", "text", part.alias("_part")).where("_part != 0")
    times = F.array_repeat(F.lit(0), F.when(F.col("_part") == 3, 2).otherwise(1))
    return held.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


def repair(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """summaries() with repaired_sha256; the conversations of every (conv_id) that have no row get zeros, no letters and the digest of nothing."""
    found = stored(summaries(rows), shared_dir(rows.sparkSession, "repair"))
    out = (every if every is not None else rows).select("conv_id").distinct()
    for other in (found, digests(repaired(rows, found))):
        out = out.join(other.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))})
