"""Rules that run in order, decided in rounds of joins: against the loops that they stand for."""

import logging
import random
import re

import pytest
from pyspark.sql import functions as F

from lociloom.operators import clusters as cl
from lociloom.operators import kernel, overlaps
from lociloom.operators import remap as rm


def replay(rows):
    """takes (by y, the clusters that come to its first one) and gone, from the candidates (y, x, x_k) one after the other."""
    takes, gone, active = {}, set(), {}
    for y, x, x_k in sorted(rows):
        if y not in active:
            active[y] = (y, 1) not in gone
        if active[y]:
            takes.setdefault(y, set()).add((x, x_k))
            if x_k == 1:
                takes[y] |= takes.get(x, set())
            gone.add((x, x_k))
    return takes, gone


def near_of(spark, rows):
    return spark.createDataFrame(rows, "y string, x string, x_k int").repartition(4)


@pytest.mark.parametrize("few", [0, 10**9])
def test_visits_of_many_graphs(spark, few):
    """20,000 random graphs of two to six nodes side by side."""
    rng, rows = random.Random(5), []
    for g in range(20_000):
        names = [f"{g:05d}{c}" for c in rng.sample("abcdefgh", rng.randint(2, 6))]
        single = {n: rng.choice([1, 1, 2]) for n in names}
        rows += [(y, x, single[x]) for y in names for x in rng.sample(names, rng.randint(0, min(3, len(names))))]
    takes, gone = replay(rows)
    took = cl.visits(near_of(spark, rows), few)
    assert {(r["x"], r["x_k"]) for r in took.collect()} == gone
    every = {}
    for r in cl.taken(took, gone_too=True).collect():
        every.setdefault(r["y"], set()).add((r["x"], r["x_k"]))
    assert every == takes
    some = {}
    for r in cl.taken(took, gone_too=False).collect():
        some.setdefault(r["y"], set()).add((r["x"], r["x_k"]))
    assert some == {y: t for y, t in takes.items() if (y, 1) not in gone}


@pytest.mark.parametrize("forward", [True, False])
def test_a_long_chain(spark, caplog, forward):
    """Nodes in a row, named in its order or against it: as many rounds as the length has binary digits, and every node in one cluster or in pairs."""
    caplog.set_level(logging.INFO, "lociloom")
    n = 400
    name = lambda k: f"{k if forward else n - k:05d}"
    rows = [(name(k + 1), name(k), 1) for k in range(n - 1)]
    takes, gone = replay(rows)
    took = cl.visits(near_of(spark, rows), few=0)
    got = {}
    for r in cl.taken(took, gone_too=False).collect():
        got.setdefault(r["y"], set()).add((r["x"], r["x_k"]))
    assert got == {y: t for y, t in takes.items() if (y, 1) not in gone} and max(map(len, got.values())) == (n - 1 if forward else 1)
    rounds = [int(x) for x in re.findall(r"who stays: (\d+) rounds", caplog.text)]
    assert max(rounds) <= 11


@pytest.mark.parametrize("few", [0, 10**9])
def test_who_stays(spark, few):
    rng = random.Random(3)
    refs = {(y, x) for y in range(1, 400) for x in rng.sample(range(max(0, y - rng.choice([1, 5, 300])), y), 1 if rng.random() < 0.6 else 0)}
    refs |= {(y, x) for y in range(300, 400) for x in rng.sample(range(y), rng.randint(0, 4))}
    stays = {}
    for v in range(400):
        stays[v] = not any(stays[x] for y, x in refs if y == v)
    df = spark.createDataFrame([*refs, *list(refs)[:50], (None, 1), (1, None)], "y long, x long")
    got = kernel.stays(df, few).collect()
    known = {v for r in refs for v in r}
    assert len(got) == len(known) and {r["v"]: r["stays"] for r in got} == {v: stays[v] for v in known}
    assert kernel.stays(df.where("false"), few).collect() == []


def greedy(rows):
    out, kept = {}, {}
    for name, path, start, end, size in sorted(rows, key=lambda r: (-r[4], r[0])):
        hap = re.match(r"H1-|H2-|None-|", name)[0]
        have = kept.setdefault((hap, path), [])
        n = lambda s, e: min(e - s, end - start)  # noqa: E731, B023
        again = any(n(s, e) > 0 and (min(end, e) - max(start, s)) / n(s, e) > 0.9 for s, e in have)  # noqa: B023
        if not again:
            have.append((start, end))
        out[name] = again
    return out


SCHEMA = "name string, path string, start int, end int, size int"


@pytest.mark.parametrize("group", [0, 40, 10**9])
def test_duplicates_are_the_greedy_ones(spark, group, caplog):
    """Intervals of all lengths within each other, equal ones, ones of no length; sizes with and against the lengths, and many ties."""
    caplog.set_level(logging.INFO, "lociloom")
    rng, rows = random.Random(8), []
    for k in range(1500):
        path = rng.choice([">a", ">a", ">a", ">b<c"])
        length = rng.choice([0, 1, 3, 10, 100, 120, 500, 1000, -5])
        start = rng.choice([-30, 0, rng.randrange(1500), rng.randrange(100) * 10])
        size = rng.choice([length, 1000 - length, rng.randrange(50), 7])
        rows.append((f"{rng.choice(['H1-', 'H2-', 'None-', ''])}{k:05d}", path, start, start + length, size))
    got = rm.without_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), group)
    assert {r["name"]: r["duplicate"] for r in got.collect()} == greedy(rows)
    rounds = [int(x) for x in re.findall(r"overlaps: (\d+) rounds", caplog.text)]
    assert max(rounds, default=0) < 40 and bool(rounds) == (group < 100)


def test_duplicates_of_odd_rows(spark):
    rows = [("a", None, 0, 100, 5), ("b", None, 0, 100, 6), ("c", ">x", None, 100, 5), ("c2", ">x", 0, None, 5), ("d", ">x", 0, 100, None), ("e", ">x", 1, 100, 3), ("e", ">x", 1, 100, 3), (None, ">y", 0, 9, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"place": F.lit(1), "level": F.lit(2), "_n": F.lit(3)})
    got = rm.without_duplicates(df).collect()
    assert len(got) == len(rows) and {(r["name"], r["duplicate"]) for r in got} == {("a", True), ("b", False), ("c", False), ("c2", False), ("d", False), ("e", True), (None, False)}
    assert set(df.columns) <= set(got[0].asDict())
    assert rm.without_duplicates(df.where("false")).collect() == []


def test_a_large_group_is_spread(spark, monkeypatch):
    """No plan of a round has a step that needs a whole group in one task or row."""
    plans = []
    monkeypatch.setattr(overlaps, "written", lambda df, path: (plans.append(df._jdf.queryExecution().executedPlan().toString()), overlaps_written(df, path))[1])
    rows = spark.range(3000).select(F.concat(F.lit("H1-"), "id").alias("name"), F.lit(">a").alias("path"), (F.col("id") * 37 % 9000).cast("int").alias("start"), (F.col("id") * 37 % 9000 + 100 + F.col("id") % 900).cast("int").alias("end"), (F.col("id") % 1000).cast("int").alias("size"))
    got = {r["name"]: r["duplicate"] for r in rm.without_duplicates(rows, 10).collect()}
    assert got == greedy([tuple(r) for r in rows.collect()])
    assert plans and not any(re.search("Window|collect_list|Python|MapInArrow|CartesianProduct|NestedLoop", p) for p in plans)


overlaps_written = overlaps.written
