"""Small literal cases for every operator, and the folds against slow plain versions."""

import gzip
import random
import time

import pytest
from pyspark.sql import functions as F

from lociloom.functions import text as fx
from lociloom.operators import alignments as al
from lociloom.operators import clusters as cl
from lociloom.operators import gap_affine as ga
from lociloom.operators import haplotypes as hp
from lociloom.operators import loci as lo
from lociloom.operators import remap as rm
from lociloom.params import Params
from lociloom.plans.queries import QUERIES, _nodes, derived, sequences
from lociloom.sources import files


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_cigar(spark):
    ops = lambda s: [tuple(x) for x in one(spark, fx.cigar_ops(F.lit(s)))[0]]
    assert ops("10M5I3D") == [(10, "M"), (5, "I"), (3, "D")]
    assert ops("5M3I2D1N4S6H7X") == [(5, "M"), (3, "I"), (2, "D"), (1, "N"), (4, "S"), (6, "H"), (7, "X")]
    assert ops("150M50I200M75D100M")[3] == (75, "D")
    assert ops("") == [] and ops("10MM") == [] and ops("M") == [] and ops("99999999999M5I") == []
    assert ops("10M12") == [(10, "M")]
    assert len(ops("1M" * 20000)) == 20000
    assert one(spark, fx.has_sv_run(F.lit("50X")), fx.has_sv_run(F.lit("49X100=")))[:] == (True, False)


def test_scalars(spark):
    r = lambda *a: one(spark, fx.overlap_ratio(*map(F.lit, a)))[0]
    assert r(0, 10, 5, 15) == 0.5 and r(0, 100, 10, 20) == 1 and r(0, 10, 10, 20) == 0 and r(5, 5, 0, 10) == 0
    assert one(spark, fx.reverse_complement(F.lit("ACTGn")))[0] == "nCAGT"
    assert [tuple(x) for x in one(spark, fx.path_steps(F.lit(">s1<s2")))[0]] == [(1, ">", "s1"), (2, "<", "s2")]
    assert [tuple(x) for x in one(spark, fx.path_steps(F.lit("pathA")))[0]] == [(1, "p", "athA")]
    ints = spark.createDataFrame([("12abc",), (" -7",), ("x1",), ("99999999999",), ("",)], "s string").select(fx.prefix_int(F.col("s"))).collect()
    assert [x[0] for x in ints] == [12, -7, None, None, None]
    g = spark.createDataFrame([(x,) for x in (0.75, 0.0, 1.0, 0.123456789, 1e-5, 123456.0, 1234567.0, 0.1, 100.0, 0.00012345)], "x double").select(fx.general(F.col("x"))).collect()
    assert [x[0] for x in g] == ["%g" % x for x in (0.75, 0.0, 1.0, 0.123456789, 1e-5, 123456.0, 1234567.0, 0.1, 100.0, 0.00012345)]
    assert one(spark, fx.parent_name(F.lit("H1-s1_20_2")), fx.parent_name(F.lit("H1-s1_20")))[:] == ("H1-s1_20", None)
    assert one(spark, fx.wrapped(F.lit("A" * 121)))[0] == "A" * 60 + "\n" + "A" * 60 + "\nA"
    assert one(spark, fx.wrapped(F.lit("A" * 60)))[0] == "A" * 60


GFA = "S\ts1\tACGTACGT\tLN:i:8\tSN:Z:chr1\tSO:i:0\nS\ts2\tACGT\tLN:i:8\tSN:Z:chr1\tSO:i:8\nS\ts3\tGG\tLN:i:8\tSN:Z:chr2\tSO:i:0\nS\tbad\tA\tLN:i:1\tSN\tSO:i:0\nS\tfew\tA\tLN:i:1\nL\ts1\t+\ts2\t+\t0M\nL\ts2\t+\ts3\t+\t0M"


@pytest.mark.parametrize("packed", [False, True])
def test_gfa(spark, tmp_path, packed):
    p = tmp_path / ("g.gfa.gz" if packed else "g.gfa")
    (gzip.open if packed else open)(p, "wt").write(GFA + "\nS\tlong\t" + "A" * 2_000_000 + "\tLN:i:5\tSN:Z:chr3\tSO:i:0")
    nodes, edges = files.read_gfa(spark, str(p))
    assert {(r["name"], r["len"], r["offset"], r["contig"]) for r in files.first_nodes(nodes).collect()} == {("s1", 8, 0, "chr1"), ("s2", 8, 8, "chr1"), ("s3", 8, 0, "chr2"), ("long", 5, 0, "chr3")}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("s1", "s2"), ("s2", "s3")}
    assert {(r[0], r[1]) for r in al.contig_length(nodes).collect()} == {("chr1", 16), ("chr2", 8), ("chr3", 5), ("overall", 29)}


def gaf_line(name="r", ql=1000, qs=0, qe=900, path=">s1", plen=1000, ps=0, pe=1000, mapq=60, tags=("tp:A:P",)):
    return "\t".join(map(str, [name, ql, qs, qe, "+", path, plen, ps, pe, 0, 0, mapq, *tags]))


@pytest.mark.parametrize("packed", [False, True])
def test_gaf(spark, tmp_path, packed):
    lines = [
        gaf_line("read1 ch=3", tags=("tp:A:P", "cg:Z:1000M")),
        gaf_line("read2", tags=("tp:A:P", "cg:Z:1M", "cg:Z:400M100I500M", "AS:f:99.5")),
        gaf_line("read1", path=">s2"),
        gaf_line("read4", mapq=2),
        gaf_line("read5", tags=("tp:A:S",)),
        gaf_line("low", tags=("AS:f:49",)),
        gaf_line("broken", tags=("AS:f:x",)),
        "too\tshort",
        gaf_line("un", qe=0),
        gaf_line("notnum", ql="x"),
        gaf_line("cr", tags=("tp:A:P\r",)),
    ]
    p = tmp_path / ("a.gaf.gz" if packed else "a.gaf")
    (gzip.open if packed else open)(p, "wt", newline="").write("\n".join(lines))
    g = files.read_gaf(spark, str(p)).cache()
    rows = g.orderBy("line_no").collect()
    assert [r["query_name"] for r in rows] == ["read1", "read2", "read1", "read4", "read5", "low", "un", "cr"]
    assert rows[1]["cigar"] == "400M100I500M" and rows[1]["aln_score"] == 99.5 and not rows[4]["is_primary"] and not rows[7]["is_primary"]
    assert sorted(r[0] for r in al.valid(g).select("query_name").collect()) == ["read1", "read1", "read2", "un"]
    assert g.rdd.getNumPartitions() > 1 or not packed
    assert [tuple(r) for r in al.multi_mapped(g).collect()] == [("read1", 2)]
    assert [r[0] for r in al.unmapped_reads(g).collect()] == ["un"]


def align(spark, *rows):
    base = {"line_no": 0, "query_name": "r", "query_length": 1000, "query_start": 0, "query_end": 900, "path": ">s1", "path_start": 0, "path_end": 0, "mapq": 60, "is_primary": True, "cigar": ""}
    return spark.createDataFrame([base | {"line_no": i} | r for i, r in enumerate(rows)], "line_no long, query_name string, query_length int, query_start int, query_end int, path string, path_start int, path_end int, mapq int, is_primary boolean, cigar string")


def node(spark, *rows):
    return spark.createDataFrame(rows, "name string, len int, offset int, contig string")


def test_coverage(spark):
    nodes = node(spark, ("s1", 100, 0, "chr1"), ("s2", 200, 100, "chr1"), ("s3", 300, 300, "chr1"), ("x", 10, 0, "alt"))
    cov = lambda *rows: {r["contig"]: (r["mapped_bases"], r["mapped_reads"]) for r in al.contig_coverage(align(spark, *rows), nodes).collect()}
    assert cov({"path": ">s1>s2>s3", "path_start": 50, "path_end": 450}) == {"chr1": (400, 1), "alt": (0, 0), "overall": (400, 1)}
    assert cov({"path": ">s1>x>s2", "path_end": 200})["chr1"] == (190, 2)
    assert cov({"path": ">s1>nope", "path_end": 150})["overall"] == (100, 1)
    assert cov({"path": ">nope", "path_end": 150})["overall"] == (0, 0)
    assert cov({"path": ">s2", "path_start": 5, "path_end": 25})["overall"] == (20, 1)


def places(df):
    return sorted((r["node"], r["pos"]) for r in df.collect())


def test_breakpoints(spark):
    nodes = node(spark, ("node1", 100, 0, "c"), ("node2", 100, 100, "c"), ("nodeA", 20000, 0, "c"))
    both = lambda **r: align(spark, {"query_start": 300, "query_end": 500} | r, {"path": ">q"})
    assert places(lo.inter_breakpoints(both(path=">node1>node2", path_start=10, path_end=160), nodes)) == [("node1", 10), ("node2", 60)]
    assert places(lo.inter_breakpoints(both(path="<nodeA", path_start=2000, path_end=19000), nodes)) == [("nodeA", 1000), ("nodeA", 18000)]
    assert places(lo.inter_breakpoints(both(path=">zz>node2", path_start=10, path_end=60), nodes)) == [("node2", 60)]
    assert places(lo.inter_breakpoints(both(path=">node1>node2", path_start=10, path_end=160, query_start=199), nodes)) == [("node2", 60)]


def test_intra_loci_on_last_base(spark):
    nodes = node(spark, ("node1", 120, 0, "c"), ("node2", 120, 120, "c"), ("node3", 120, 240, "c"))
    at = lambda before: places(lo.intra_loci(align(spark, {"path": ">node1>node2>node3", "path_end": 360, "cigar": f"{before}M60I10M"}), nodes))
    assert at(119) == [("node1", 120)] and at(149) == [("node2", 30)] and at(279) == [("node3", 40)]


def walk(steps, ps, op, v, cig):
    """A plain rendering of the placement rules."""
    n, tot, nms, spilled = len(steps), 0, 0, False
    for i, (strand, name, length) in enumerate(steps, 1):
        if length is None:
            continue
        d = op == "D"
        if n == 1:
            hit, pos = True, ps + cig
        elif i < n:
            nms = length - ps if i == 1 else tot + length
            hit = (not d and cig <= nms) or (spilled and cig <= nms) or (strand == ">" and cig <= nms) or (strand == "<" and d and not spilled and cig + v <= nms)
            pos = ps + cig if i == 1 else cig - tot
        else:
            hit = (not d and cig >= nms) or (spilled and cig >= nms) or (strand == ">" and cig >= nms) or (strand == "<" and d and not spilled and cig + v >= nms)
            pos = ps + cig if i == 1 else cig - tot
        if hit:
            return name, pos if strand == ">" else length - pos - v if d and not spilled else length - pos
        if i < n:
            tot = nms
            if strand == "<" and d and cig < nms:
                cig, spilled = cig + v, True
    return None


def test_intra_loci_against_plain(spark):
    rng = random.Random(5)
    lens = {f"n{i}": rng.randint(60, 400) for i in range(12)}
    nodes = node(spark, *[(k, v, 0, "c") for k, v in lens.items()])
    rows, want = [], []
    for i in range(400):
        steps = [(rng.choice("<>"), rng.choice([*lens, "hole"])) for _ in range(rng.randint(1, 5))]
        before, v, op, ps = rng.randint(0, 900), rng.randint(50, 300), rng.choice("ID"), rng.randint(0, 50)
        if rng.random() < 0.2:
            steps[0] = rng.choice("x* "), steps[0][1]
        rows.append({"query_name": f"q{i}", "path": "".join(a + b for a, b in steps), "path_start": ps, "cigar": f"{before}M{v}{op}5M"})
        got = walk([(a, b, lens.get(b)) for a, b in steps], ps, op, v, before + 1)
        if got:
            want.append((f"q{i}", *got))
    found = lo.intra_loci(align(spark, *rows), nodes).select("read", "node", "pos").collect()
    assert sorted(map(tuple, found)) == sorted(want) and len(want) > 200


def cluster_plain(loci, dist):
    out = []
    for pos, reads in sorted(loci):
        if out and (out[-1]["last"] + dist >= pos or reads <= out[-1]["reads"]):
            out[-1]["reads"] |= reads
        else:
            out.append({"start": pos, "reads": set(reads)})
        out[-1]["last"] = pos
    return [(c["start"], sorted(c["reads"])) for c in out]


def test_clusters(spark):
    rng = random.Random(3)
    loci, want = [("node1", 10, ["r1"]), ("node1", 15, ["r2"]), ("node1", 50, ["r3"])], {"node1": [(10, ["r1", "r2"]), (50, ["r3"])]}
    for k in range(60):
        own = {rng.randint(0, 300): {f"r{rng.randint(0, 5)}" for _ in range(rng.randint(1, 3))} for _ in range(rng.randint(1, 12))}
        loci += [(f"m{k}", p, sorted(r)) for p, r in own.items()]
        want[f"m{k}"] = cluster_plain([(p, set(r)) for p, r in own.items()], 10)
    df = spark.createDataFrame([(n, p, p, "c", r) for n, p, r in loci] + [("unknown", 5, 5, "c", ["r"])], "node string, pos long, ref long, contig string, reads array<string>")
    got: dict = {}
    for r in cl.within_nodes(df, node(spark, *[(n, 1000, 0, "c") for n in want]), 10).orderBy("node", "k").collect():
        got.setdefault(r["node"], []).append((r["start"], list(r["reads"])))
    assert got == want


def merge_plain(clusters, incoming, lens, d):
    """Visits nodes by name as the rules say, changing clusters in place."""
    state = {n: [{"k": k, "start": s, "reads": set(r), "gone": False} for k, (s, r) in enumerate(c, 1)] for n, c in clusters.items()}
    for y in sorted(state):
        front = state[y][0]
        if front["gone"] or front["start"] >= d:
            continue
        for x in incoming.get(y, []):
            if x in state:
                back = state[x][-1]
                if lens[x] - back["start"] + front["start"] < d:
                    front["reads"] |= back["reads"]
                    back["gone"] = True
    return sorted((n, c["k"], tuple(sorted(c["reads"])), c["gone"]) for n, cs in state.items() for c in cs)


def run_merge(spark, clusters, incoming, lens, d):
    df = spark.createDataFrame([(n, k, s, s, "c", sorted(r)) for n, cs in clusters.items() for k, (s, r) in enumerate(cs, 1)], "node string, k int, start long, ref long, contig string, reads array<string>")
    edges = spark.createDataFrame([(x, y, i) for y, xs in incoming.items() for i, x in enumerate(xs)], "src string, dst string, ord int")
    got = cl.merge_neighbours(df, edges, node(spark, *[(n, lens[n], 0, "c") for n in lens]), d)
    return sorted((r["node"], r["k"], tuple(r["reads"]), r["merged_away"]) for r in got.collect())


def test_merge_neighbours(spark):
    clusters = {"nA": [(10, {"a"})], "nX": [(990, {"x"})], "nY": [(50, {"y"})]}
    lens = {"nA": 1000, "nX": 1000, "nY": 100}
    assert run_merge(spark, clusters, {"nA": ["nY"], "nY": ["nX"]}, lens, 100) == [("nA", 1, ("a", "y"), False), ("nX", 1, ("x",), False), ("nY", 1, ("y",), True)]
    assert not any(r[3] for r in run_merge(spark, {"a": [(2, {"p"})], "b": [(97, {"q"})]}, {"a": ["b"]}, {"a": 100, "b": 100}, 5))


def test_merge_neighbours_against_plain(spark):
    rng = random.Random(11)
    clusters, incoming, lens = {}, {}, {}
    for g in range(150):  # many small graphs side by side
        names = [f"g{g}{c}" for c in "abcde"[: rng.randint(2, 5)]]
        for n in names:
            starts = sorted(rng.sample(range(0, 100, 10), rng.randint(1, 2)))
            clusters[n] = [(s, {f"{n}r{i}"}) for i, s in enumerate(starts)]
            lens[n] = 100
            incoming[n] = [rng.choice(names) for _ in range(rng.randint(0, 3))]
    assert run_merge(spark, clusters, incoming, lens, 90) == merge_plain(clusters, incoming, lens, 90)


def test_final_and_phase(spark):
    reads = [f"r{i}" for i in range(6)]
    merged = spark.createDataFrame([("n", 1, 5, 5, "c", reads, False), ("n", 2, 9, 9, "c", reads, True), ("m", 1, 5, 5, "c", reads[:5], False)], "node string, k int, start long, ref long, contig string, reads array<string>, merged_away boolean")
    final = cl.final_clusters(merged, 5)
    assert [(r["node"], r["k"]) for r in final.collect()] == [("n", 1)]
    phase = spark.createDataFrame([("r0", "H1", "p", "c"), ("r1", "H2", "p", "c"), ("r2", "H1", "none", "c"), ("r3", "none", "p", "c"), ("r4", "H3", "p", "c")], "read_name string, haplotype string, phase_set string, contig string")
    s = hp.phase_split(final, phase).first()
    assert (s["h1"], s["h2"], s["untagged"]) == (["r0"], ["r1"], ["r2", "r3", "r4", "r5"])
    assert {tuple(r) for r in hp.phase_summary(final, phase).collect()} == {("H1", 1, 1), ("H2", 1, 1), ("untagged", 3, 1)}
    names = {r["name"] for r in hp.candidates(hp.phase_split(final, phase), True, skip_untagged=True).collect()}
    assert names == {"H1-n_5", "H2-n_5"}
    assert [r["name"] for r in hp.candidates(hp.phase_split(final, None), False).collect()] == ["n_5"]


def test_gate(spark):
    def reason(depth, cluster, reads):
        df = spark.createDataFrame([(depth, cluster, [str(i) for i in range(reads)])], "depth double, cluster_reads int, reads array<string>")
        return hp.reasoned(df, 3.0).first()["reason"]

    assert reason(150.0, 30, 24) == "max_contig_depth" and reason(150.0, 6, 6) == "low_coverage"
    z = spark.createDataFrame([(4.0, 3, ["a"] * 8), (0.0, 3, ["a"])], "depth double, cluster_reads int, reads array<string>")
    assert [r["zscore"] for r in hp.reasoned(z, 3.0).collect()] == [2.0, 0.0]
    assert reason(5.0, 11, 11) == "high_coverage" and reason(5.0, 10, 10) == "pass" and reason(5.0, 6, 2) == "low_support"


def test_unmapped_candidate(spark):
    names = lambda n: spark.range(n).select(F.col("id").cast("string").alias("query_name"))
    assert hp.unmapped_candidate(names(2), 5).first()["reason"] == "low_support"
    assert hp.unmapped_candidate(names(50), 5).first()["reason"] == "pass"
    assert hp.unmapped_candidate(names(101), 5).first()["reason"] == "max_contig_depth"


def dedup(spark, *rows):
    df = spark.createDataFrame(rows, "name string, path string, start int, end int, size int")
    return {r["name"]: r["duplicate"] for r in rm.without_duplicates(df).collect()}


def test_duplicates(spark):
    assert dedup(spark, ("H1-a_1", ">x", 0, 100, 100), ("H1-b_1", ">x", 200, 300, 100)) == {"H1-a_1": False, "H1-b_1": False}
    assert dedup(spark, ("H1-a_1", ">x", 0, 100, 90), ("H1-b_1", ">x", 0, 100, 100)) == {"H1-a_1": True, "H1-b_1": False}
    assert dedup(spark, ("H1-a_1", ">x", 0, 100, 100), ("H2-b_1", ">x", 0, 100, 100), ("H1-c_1", ">y", 0, 100, 100)) == {"H1-a_1": False, "H2-b_1": False, "H1-c_1": False}
    assert dedup(spark, ("H1-a_1", ">x", 0, 100, 100), ("H1-b_1", ">x", 10, 110, 100))["H1-b_1"] is False  # 0.9 is not more than 0.9
    assert dedup(spark, ("H1-a_1", ">x", 0, 100, 100), ("H1-b_1", ">x", 5, 105, 100))["H1-b_1"] is True


def lines(spark, *rows):
    base = {"query_length": 100, "query_start": 0, "query_end": 95, "path": ">a", "path_start": 0, "path_end": 50, "mapq": 60, "is_primary": True, "has_sv": False}
    return spark.createDataFrame([base | {"line_no": i, "query_name": "v"} | r for i, r in enumerate(rows)], "line_no long, query_name string, query_length int, query_start int, query_end int, path string, path_start int, path_end int, mapq int, is_primary boolean, has_sv boolean")


def test_fold_and_decision(spark):
    f = lambda *r: rm.decisions(rm.fold(lines(spark, *r)), 0.9).first()
    assert f({})["reason"] == "high_map_ratio" and not f({})["keep"]
    assert f({"query_end": 50})["reason"] == "low_map_ratio" and f({"has_sv": True})["reason"] == "sv_in_alignment"
    assert f({}, {})["reason"] == "several_mappings" and f({"query_end": 0})["reason"] == "no_mapping"
    late = f({}, {"mapq": 1, "has_sv": True, "path": ">b"})
    assert late["sv"] and late["path"] == ">b" and late["freq"] == 1
    wide = f({"query_end": 40}, {"path": ">c", "path_end": 70, "has_sv": True})
    assert (wide["path"], wide["ratio"], wide["sv"], wide["freq"]) == (">c", 0.95, False, 2)


def test_counters(spark):
    out = spark.createDataFrame([("H1-a_1",), ("H1-a_1_2",), ("H1-a_1_3",)], "name string")
    got = rm.counters(lines(spark, {}, {"is_primary": False}, {"mapq": 4}, {"mapq": 4, "is_primary": False}), out).first()
    assert got.asDict() == {"good": 1, "secondary": 2, "low_mapq": 2, "extra": 2}


def test_output(spark):
    unique = spark.createDataFrame([("H1-a_1", ">x", 0.75, False), ("H1-a_1_2", ">y", 0.5, False), ("gone_1", ">z", 0.5, False), ("H2-b_1", ">x", 1.0, True)], "name string, path string, ratio double, duplicate boolean")
    reg = spark.createDataFrame([("H1-a_1", 7, "chr1", 4), ("H2-b_1", 7, "chr1", 4)], "name string, pos int, contig string, support int")
    got = {r["name"]: r["header"] for r in rm.headers(rm.flagged(unique, reg)).collect()}
    assert got == {"H1-a_1": ">H1-a_1 contig=chr1 pos=7 support=4 path=>x map_ratio=0.75", "H1-a_1_2": ">H1-a_1_2 contig=chr1 pos=7 support=4 path=>y map_ratio=0.5"}
    names = spark.createDataFrame([("H1-x_1",), ("n-H2H1_3",), ("None-y_2",)], "name string")
    assert {tuple(r) for r in rm.haplotype_files(names).collect()} == {("H1-x_1", "H1"), ("n-H2H1_3", "H1"), ("n-H2H1_3", "H2"), ("None-y_2", "untagged")}


def penalty_plain(a, b):
    big = 10**9
    m = [[big] * (len(b) + 1) for _ in range(len(a) + 1)]
    x = [[big] * (len(b) + 1) for _ in range(len(a) + 1)]
    y = [[big] * (len(b) + 1) for _ in range(len(a) + 1)]
    m[0][0] = 0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i:
                x[i][j] = min(m[i - 1][j] + 8, x[i - 1][j] + 2)
            if j:
                y[i][j] = min(m[i][j - 1] + 8, y[i][j - 1] + 2)
            if i and j:
                m[i][j] = m[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else 4)
            m[i][j] = min(m[i][j], x[i][j], y[i][j])
    return m[-1][-1]


def test_gap_affine_against_plain():
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choice("ACG") for _ in range(rng.randint(0, 25)))
        b = "".join(c for c in a if rng.random() > 0.2) if rng.random() < 0.5 else "".join(rng.choice("ACG") for _ in range(rng.randint(0, 25)))
        ops = ga.operations(a, b)
        assert ga.penalty(ops) == penalty_plain(a, b), (a, b, ops)
        assert ga.penalty(ga.operations(*ga._trimmed(a, b))) == penalty_plain(a, b), (a, b)
        i = j = 0
        for n, op in ops:
            for _ in range(n):
                if op in "MX":
                    assert (a[i] == b[j]) == (op == "M")
                i, j = i + (op != "D"), j + (op != "I")
        assert (i, j) == (len(a), len(b))
    s = "".join(rng.choice("ACGT") for _ in range(20_000))
    t = "".join("" if (u := rng.random()) < 0.02 else c + "T" if u < 0.04 else "A" if u < 0.06 else c for c in s)
    began = time.time()
    ops = ga.operations(s, t)
    assert time.time() - began < 5 and sum(n for n, op in ops if op != "D") == 20_000 and sum(n for n, op in ops if op != "I") == len(t)
    s = s[:400]
    assert ga.run_of_sv(s[:100] + "T" * 50 + s[100:], s) and not ga.run_of_sv(s[:100] + "T" * 49 + s[100:], s)


def test_path_sequence(spark):
    nodes = node(spark, ("a", 4, 0, "c"), ("b", 3, 0, "c"))
    seq = spark.createDataFrame([("a", "AACC"), ("b", "GAT")], "name string, sequence string")
    rows = spark.createDataFrame([(">a<b", 1, 5), (">a>zz>b", 0, 100), (">zz", 0, 5), (">a", 9, 12)], "path string, path_start int, path_end int")
    got = {r["path"]: r["path_sequence"] for r in rm.path_sequences(rows, nodes, seq).collect()}
    assert got == {">a<b": "ACCAT", ">a>zz>b": "AACCGAT", ">zz": "", ">a": ""}


def test_params(tmp_path):
    for n in "abc":
        (tmp_path / n).write_text("")
    good = Params(gaf=str(tmp_path / "a"), graph=str(tmp_path / "b"), fasta=str(tmp_path / "c"))
    assert good.checked() == good
    from dataclasses import replace

    assert replace(good, asm=True).checked().support == 0
    for bad in ({"gaf": ""}, {"gaf": "/no/such"}, {"reads": "x"}, {"support": -1}):
        with pytest.raises(ValueError):
            replace(good, **bad).checked()


def test_headers_of_all_alleles_with_any_map_ratio(spark):
    """At sf0.1 some alleles have a map ratio below 0.1."""
    big = "/root/testdata/sf0.1"
    kept = {r["name"] for r in QUERIES["haplotype_files"](spark, big).collect()}
    got = {r["name"]: float(r["header"].rsplit("map_ratio=", 1)[1]) for r in QUERIES["svtig_headers"](spark, big).collect()}
    assert got.keys() == kept and min(got.values()) < 0.1


def test_realignment_meets_whole_paths(spark, data, monkeypatch):
    seen = []
    monkeypatch.setattr(rm, "with_has_sv", lambda rows: seen.append(rows) or rows.withColumn("has_sv", F.lit(False)))
    QUERIES["realign_has_sv"](spark, data)
    want = rm.path_sequences(derived(spark, data, "remap").select("line_no", "path", "path_start", "path_end"), _nodes(spark, data), sequences(spark, data))
    longest = lambda df: df.agg(F.max(F.length("path_sequence"))).first()[0]
    assert longest(seen[0]) == longest(want) > 300 and seen[0].count() == want.count()
