"""The built-in consensus on simulated reads."""

import random
from dataclasses import replace

import numpy as np
from test_pipeline import inputs, text

from lociloom.operators import consensus
from lociloom.plans.pipeline import run


def edits(a, b):
    """Levenshtein distance, a row at a time."""
    b, at = np.frombuffer(b.encode(), np.uint8), np.arange(len(b) + 1)
    row = at.copy()
    for k, c in enumerate(a.encode(), 1):
        new = np.concatenate([[k], np.minimum(row[:-1] + (b != c), row[1:] + 1)])
        row = np.minimum.accumulate(new - at) + at
    return int(row[-1])


def noisy(rng, seq, rate=0.05):
    out = []
    for c in seq:
        x = rng.random()
        out.append("" if x < rate / 3 else c + rng.choice("ACGT") if x < 2 * rate / 3 else rng.choice("ACGT") if x < rate else c)
    return "".join(out)


def turned(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_an_allele_from_noisy_reads(spark):
    """20 reads of 5 % errors, from both strands, give back an allele of 5,000 bases to 99 %; two alleles of one candidate give two contigs."""
    rng = random.Random(12)
    allele = {n: "".join(rng.choices("ACGT", k=5000 if n == "one" else 1500)) for n in ("one", "a", "b")}
    rows = [("one", f"r{k}", noisy(rng, allele["one"])) for k in range(20)]
    rows += [("two", f"{n}{k}", noisy(rng, allele[n])) for n, m in (("a", 20), ("b", 16)) for k in range(m)]
    rows = [(n, r, turned(s) if n == "one" and k % 2 else s) for k, (n, r, s) in enumerate(rows)] + [("one", "none", None), ("one", "short", "ACG"), ("bare", "x", "ACGT"), ("bare", "y", None)]
    got = {r["name"]: (r["parent"], r["sequence"]) for r in consensus.contigs(spark.createDataFrame(rows, "name string, read string, sequence string").repartition(3)).collect()}
    assert set(got) == {"one", "two", "two_2"} and got["two_2"][0] == "two"
    found = got["one"][1]
    assert min(edits(found, allele["one"]), edits(turned(found), allele["one"])) <= 50
    assert edits(got["two"][1], allele["a"]) <= 15 and edits(got["two_2"][1], allele["b"]) <= 15
    assert consensus.contigs(spark.createDataFrame([], "name string, read string, sequence string")).collect() == []


def test_circles_and_reads_of_errors(spark):
    rows = [("c", f"r{k}", "ACGTTGCAGGCTA" * 20) for k in range(4)] + [("d", f"r{k}", "".join(random.Random(k).choices("ACGT", k=300))) for k in range(3)]
    assert consensus.contigs(spark.createDataFrame(rows, "name string, read string, sequence string")).collect() == []


def test_run_without_programs(spark, tmp_path):
    rng = random.Random(4)
    params = replace(inputs(tmp_path), no_remap=True, assembler="consensus")
    allele = "".join(rng.choices("ACGT", k=600))
    (tmp_path / "r.fa").write_text("".join(f">r{k}\n{noisy(rng, allele, 0.01)}\n" for k in range(8)))
    got = run(spark, params)
    assert [(r["name"], r["reason"]) for r in got.decisions.collect()] == [("s1_401", "pass")]
    out = text(tmp_path / "out" / "sample_svtigs.fa").split("\n")
    assert out[0] == ">s1_401 contig=chr1 pos=401 support=8" and edits("".join(out[1:]), allele) <= 12
