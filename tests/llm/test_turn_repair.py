"""Conversation repair against a search over all edits."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from lociloom.llm import turn_repair
from lociloom.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"
COLS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = text.rstrip(SPACE)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_edit(rows, marks):
    """(cost, letters, turns) of all repairs that can be the cheapest: no more than two inserts in one place."""
    if len(rows) > 5:
        raise ValueError
    inserts = ["", "I", "II"]
    for edits in product(*["D" if m in ("blank", "duplicate") else "KRD" for m in marks]):
        for gaps in product(inserts, repeat=len(rows) + 1):
            letters = gaps[0] + "".join(e + g for e, g in zip(edits, gaps[1:]))
            cost, k, roles, turns = 0, 0, "", []
            for e in letters:
                if e == "I":
                    cost, role, text = cost + 3, None, ""
                else:
                    (role, text), mark = rows[k], marks[k]
                    k += 1
                    cost += {"K": 0, "R": 3, "D": 4}[e] + (3 if mark == "truncated" and e != "D" else 0)
                    if e == "D":
                        continue
                    role = role if e == "K" else None
                role = ("assistant" if roles.endswith("u") else "user") if role is None else role
                roles += role[:1] or "?"
                turns.append(f"{role}:{text}")
            if re.fullmatch("(s?(ua)+)?", roles):
                yield cost, letters, turns


def by_hand(rows):
    """A conversation's columns from its rows (turn, role, text) in order."""
    texts = [(r, t) for _, r, t in rows]
    marks = faults(texts)
    cost, audit, turns = min(every_edit(texts, marks))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(texts, texts[1:]))
    return (gaps, *[marks.count(m) for m in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def put_in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def test_equals_all_edits(spark):
    rng = random.Random(7)
    convs = {c: [(rng.choice([None, *range(6)]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), rng.choice(["Yes.", "No!", "cut off", " \n", "", "Yes. \t", "é?"])) for _ in range(rng.randint(0, 4))] for c in range(120)}
    rows = [(c, *r) for c, turns in convs.items() for r in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: tuple(r[c] for c in COLS[1:]) for r in turn_repair.repair(df, spark.range(120).withColumnRenamed("id", "conv_id")).collect()}
    assert got == {c: by_hand(put_in_order(turns)) for c, turns in convs.items()}


@pytest.mark.parametrize("piece", [1, 2, 3, 512])
def test_pieces_change_nothing(monkeypatch, piece):
    rng = random.Random(piece)
    for _ in range(200):
        turns = [(rng.choice("suax"), rng.choice([0, 0, 1, 3])) for _ in range(rng.randint(1, 40))]
        results = []
        for n in (10**9, piece):
            monkeypatch.setattr(turn_repair, "PIECE", n)
            path = turn_repair.Pass()
            for t in turns:
                path.turn(*t)
            results.append(path.result())
        assert results[0] == results[1]


def test_long_conversation_in_proportion():
    """Turns of no known role never let the states' letters meet; 200,000 of them take seconds, and what is held apart from the letters stays small."""
    path = turn_repair.Pass()
    for _ in range(200_000):
        path.turn("x", 0)
        assert max(len(x[1]) for x in path.best if x) <= turn_repair.PIECE + 3
    cost, letters = path.result()
    assert cost == 600_000 and letters == "R" * 200_000


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 4, "assistant", "cut"), (2, 0, "user", " "), (None, 3, None, "No role."), (None, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit("x"), "Edit": F.lit(1), "part": F.lit(2)})
    found = turn_repair.summaries(df)
    assert {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) for r in found.collect()} == {1: (1, 0, 1, 1, 1, 10, "IKKDK"), 2: (0, 1, 0, 0, 0, 4, "D"), None: (0, 1, 0, 0, 1, 8, "DD")}
    turns = sorted(((r["conv_id"], r["place"], r["role"], r["text"], r["edit"]) for r in turn_repair.repaired(df, found).collect()), key=lambda r: r[:2])
    assert turns == [(1, 0, "user", "", "I"), (1, 1, "assistant", "Hello.", "K"), (1, 2, "user", "Hi.", "K"), (1, 3, "assistant", "cut", "K")]


def test_long_texts_repeats_and_nothing(spark):
    long = "word " * 200_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", long), (1, 2, "user", long)]
    schema = "conv_id long, turn long, role string, text string"
    got = turn_repair.repair(spark.createDataFrame(rows, schema)).first()
    assert (got["duplicate"], got["cost"], got["audit"]) == (2, 8, "KKDD")
    assert got["repaired_sha256"] == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
    assert turn_repair.repair(spark.createDataFrame([], schema)).collect() == []


def test_damage(spark):
    rows = [(c, t, "system", f"One. Two! {t}?") for c in range(12) for t in range(6)] + [(None, None, None, None), (3, None, "user", "x.")]
    got = sorted(map(str, turn_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = []
    for c, t, role, text in rows:
        show = lambda x: " " if x is None else x
        k = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        role, text = ("user" if k == 4 else show(role)), "" if k == 1 else re.sub("[.!?]", "", show(text)) if k == 2 else show(text)
        want += [(c, t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    assert got == sorted(f"Row(conv_id={c}, turn={t}, role={r!r}, text={x!r})" for c, t, r, x in want)


def test_a_row_for_each_conversation(spark, data, tables):
    got = sorted(r["conv_id"] for r in QUERIES["op11_turn_repair"](spark, data).collect())
    assert got == sorted(r["conv_id"] for r in tables["conversations"].select("conv_id").distinct().collect())
