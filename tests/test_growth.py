"""What goes through the shuffles of the larger queries, and how often it is worked out."""

from pyspark.sql import functions as F

from lociloom.adapters.external import attempts, median_read
from lociloom.operators import alignments as al
from lociloom.plans.queries import QUERIES, _gaf, _nodes
from lociloom.sources.derived import derived


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_line_numbers_keep_the_order(spark, data):
    own = [c for c in _gaf(spark, data).columns if c != "line_no"]
    rows = lambda name: [tuple(r[c] for c in own) for r in derived(spark, data, name).orderBy("line_no").collect()]
    assert rows("gaf_by_read") == rows("gaf")


def test_clusters_take_no_line_numbers_along_and_write_nothing(spark, data):
    got = plan(QUERIES["clusters_within_node"](spark, data))
    assert "l_partkey" in got and "l_extendedprice" not in got


def lines(spark, *rows):
    base = {"line_no": 0, "query_name": "r", "query_length": 1000, "query_start": 0, "query_end": 900, "path": ">a>b>c", "path_start": 5, "path_end": 150, "mapq": 60, "is_primary": True, "cigar": ""}
    schema = "line_no long, query_name string, query_length int, query_start int, query_end int, path string, path_start int, path_end int, mapq int, is_primary boolean, cigar string"
    return spark.createDataFrame([base | r for r in rows], schema)


def test_coverage_is_summed_by_path_first(spark):
    nodes = spark.createDataFrame([("a", 50, 0, "x"), ("b", 60, 50, "x"), ("c", 100, 0, "y")], "name string, len int, offset int, contig string")
    some = lines(spark, {}, {"path_start": 7}, {"path_end": None}, {"path_start": None}, {"path": ">c"}, {"path": ">c", "path_start": 1}, {"path": "<q>a"}, {"path": None})
    credit = al.credits(some, nodes)
    assert credit.count() == 3 + 1 + 1  # a row for each step of a path, not of a line
    got = {r["contig"]: (r["mapped_bases"], r["mapped_reads"]) for r in al.contig_coverage(some, nodes).collect()}
    a, b, last = 45 + 43 + 45, 4 * 60, (145 - 45 - 60) + (143 - 43 - 60)
    assert got == {"x": (a + b + 145, 5), "y": (last + 145 + 149, 6), "overall": (a + b + 145 + last + 145 + 149, 7)}


def test_clusters_of_dealt_loci_are_the_same(spark, data):
    from lociloom.operators import clusters as cl, loci as lo

    found = [cl.within_nodes(lo.sv_loci(_gaf(spark, data), _nodes(spark, data), by_node), _nodes(spark, data), 100).select("node", "k", "start", F.array_join("reads", ",")) for by_node in (False, True)]
    assert found[0].exceptAll(found[1]).isEmpty() and found[1].exceptAll(found[0]).isEmpty()


def test_ranges_are_no_more_than_a_bound(tmp_path):
    from lociloom.sources import blocks

    (tmp_path / "a.fa").write_bytes(b">r\nACGT\n" * 40_000)
    reader = blocks.RecordsReader({"path": str(tmp_path), "range": "100"})
    parts = reader.partitions()
    assert len(parts) <= blocks.TASKS and parts[-1].end == 320_000
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 40_000
    assert blocks.range_size([str(tmp_path / "a.fa")], 50_021) == 50_021


def test_attempts_join_sequences_once(spark):
    passed = spark.createDataFrame([("n1", ["r1", "r2", "r9"]), ("n2", ["r9"]), ("n3", []), ("n4", ["r2"])], "name string, reads array<string>")
    reads = spark.createDataFrame([("r1", "A"), ("r2", "CC")], "name string, sequence string")
    made = attempts(passed, reads, median_read)
    assert plan(made).count("Join") == 1
    assert sorted(map(tuple, made.collect()), key=str) == sorted([("n1", "n1", "CC", None), ("n4", "n4", "CC", None), (None, "n2", None, "no_contig"), (None, "n3", None, "no_contig")], key=str)




def test_a_path_brings_its_sums_of_lengths(spark):
    nodes = spark.createDataFrame([("a", 50, 0, "x"), ("b", 60, 50, "x"), ("c", 100, 0, "y")], "name string, len int, offset int, contig string")
    got = {r["path"]: [(k["i"], k["node"], k["before"], k["upto"]) for k in r["known"]] for r in al.resolved(lines(spark, {}, {"path": "<q>a>c"}, {"path": ">q"}), nodes).collect()}
    assert got == {">a>b>c": [(1, "a", 0, 50), (2, "b", 50, 110), (3, "c", 110, 110)], "<q>a>c": [(2, "a", 0, 50), (3, "c", 50, 50)], ">q": []}


def test_clusters_of_signals_put_no_loci_together(spark, data):
    from lociloom.operators import clusters as cl, loci as lo

    loci = cl.within_nodes(lo.sv_loci(_gaf(spark, data), _nodes(spark, data)), _nodes(spark, data), 100, last=True)
    found = cl.of_signals(lo.signals(_gaf(spark, data), _nodes(spark, data)), _nodes(spark, data), 100, last=True)
    assert loci.exceptAll(found).isEmpty() and found.exceptAll(loci).isEmpty()
    assert found.where("last").count() == found.select("node").distinct().count()
    # reads are collected for islands only, and a node's islands once
    assert plan(found).count("partial_collect") < plan(loci).count("partial_collect")


def test_loci_of_nodes_that_share_a_base_and_a_place(spark):
    from lociloom.operators import clusters as cl

    some = [("n:1", 500, 7, "c", ["r2"]), ("n:2", 500, 8, "c", ["r3"]), ("n", 5, 9, "c", ["r2"]), ("n", 900, 9, "c", []), ("n", None, 9, "c", ["r9"])]
    loci = spark.createDataFrame(some, "node string, pos long, ref long, contig string, reads array<string>")
    nodes = spark.createDataFrame([("n", 1000, 0, "c")], "name string, len int, offset int, contig string")
    got = [(r["k"], r["start"], r["ref"], list(r["reads"])) for r in cl.within_nodes(loci, nodes, 10).collect()]
    assert got == [(1, 5, 9, ["r2", "r3"])]  # the first locus at 500 brings no new read, nor does the one without reads


def test_clusters_between_the_ends_of_a_node_go_through_no_shuffle(spark):
    from lociloom.operators import clusters as cl

    schema = "node string, k int, start long, ref long, contig string, reads array<string>, last boolean"
    rows = [(n, k, s, s, "c", [f"{n}{k}"], k == 3) for n in "abcd" for k, s in ((1, 5), (2, 50), (3, 97))]
    both = spark.createDataFrame(rows, schema)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "a")], "src string, dst string")
    nodes = spark.createDataFrame([(n, 100, 0, "c") for n in "abcd"], "name string, len int, offset int, contig string")
    told = cl.merge_neighbours(both, edges, nodes, 20)
    want = cl.merge_neighbours(both.drop("last"), edges, nodes, 20)
    assert sorted(map(str, told.collect())) == sorted(map(str, want.collect())) and told.where("merged_away").count() == 3
    p = plan(told)
    assert "Union" in p and "Exchange" not in p[p.rindex("(NOT (k") if "(NOT (k" in p else p.rindex("NOT"):]


def test_coverage_looks_paths_up_in_one_go(spark):
    """The sums of a path go along with its first step: alignments are scanned once, and no path is joined to itself."""
    nodes = spark.createDataFrame([("a", 50, 0, "x"), ("b", None, 50, "x"), ("c", 100, 0, None)], "name string, len int, offset int, contig string")
    some = lines(spark, {}, {"path": "<q>a>c>a"}, {"path": ">c", "path_end": None}, {"path": ""}, {"path": ">q"})
    assert plan(al.with_steps(al.path_sums(some), nodes)).count("Scan ExistingRDD[line_no") == 1
    got = {r["path"]: (r["lines"], r["span"], r["n"], [k["i"] for k in r["known"]]) for r in al.with_steps(al.path_sums(some), nodes).collect()}
    assert got == {">a>b>c": (1, 145, 3, [1, 2, 3]), "<q>a>c>a": (1, 145, 4, [2, 3, 4]), ">c": (1, None, 1, [1]), ">q": (1, 145, 1, [])}
    assert sorted(map(tuple, al.credits(some, nodes).collect()), key=str) == sorted([("x", 45, 1, 1), ("x", None, 0, 0), (None, None, 0, 0), ("x", 50, 1, 1), (None, 100, 0, 0), ("x", -5, 0, 0), (None, None, 1, 1)], key=str)


def test_tallies_are_the_sizes_of_the_split(spark):
    """Odd tags too: several rows of a read, nulls, reads without a row. The clusters' rows are worked out once for the split."""
    from lociloom.operators import haplotypes as hp

    clusters = spark.createDataFrame([("n", 1, 5, None, ["a", "b", "c", "d", "e", "f"]), ("n", 2, 9, "x", ["a"]), ("m", 1, 0, "y", [None]), ("m", 2, 1, "y", [])], "node string, k int, start long, contig string, reads array<string>")
    tags = [("a", "H1", "p"), ("a", "H2", "p"), ("a", "H1", "q"), ("b", "none", "p"), ("b", "H2", "none"), ("c", None, None), ("d", "H3", "p"), ("e", "H2", None), (None, "H1", "p")]
    phase = spark.createDataFrame(tags, "read_name string, haplotype string, phase_set string")
    split, tally = hp.phase_split(clusters, phase), hp.tallied(clusters, phase)
    sizes = split.select("node", "k", "start", "contig", *[F.size(c).alias(c) for c in ("h1", "h2", "untagged")])
    assert sorted(map(tuple, sizes.collect()), key=str) == sorted(map(tuple, tally.collect()), key=str)
    assert plan(split).count("Scan ExistingRDD[node") == 1
    assert {(r["node"], r["k"]): (r["h1"], r["h2"], r["untagged"]) for r in tally.collect()} == {("n", 1): (1, 2, 4), ("n", 2): (1, 1, 0), ("m", 1): (0, 0, 0)}


def test_fold_over_many_batches(spark):
    """Clusters are as the rule has them locus by locus, wherever batches end."""
    import random

    import pyarrow as pa

    from lociloom.operators.clusters import fold

    rng = random.Random(4)
    kinds = pa.schema([("node", pa.string()), ("pos", pa.int64()), ("rest", pa.string()), ("ref", pa.int64()), ("contig", pa.string()), ("read", pa.string())])
    rows, want = [], []
    for n in range(40):
        node, known = f"n{n:02}", n % 7 != 3
        rows += [(node, None, None, None, None, None)] * (known + known * (n % 2))
        loci = sorted({(rng.randrange(2**53, 2**53 + 600), rng.choice(["", ":1"])) for _ in range(n)})
        done = []
        for pos, rest in loci:
            reads = {rng.choice([*"abcdefgh", None]) for _ in range(rng.randint(1, 3))}
            rows += [(node, pos, rest, pos + 5 + k, "c", r) for k, r in enumerate(sorted(reads, key=str))]
            reads -= {None}
            if done and (pos - at <= 20 or reads <= done[-1][2]):
                done[-1][2].update(reads)
            else:
                done.append([pos, pos + 5, set(reads)])
            at = pos
        want += [(node, k + 1, s, r, "c", sorted(x), k + 1 == len(done)) for k, (s, r, x) in enumerate(done)] if known else []
    for size in (1, 7, 5000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), kinds.types)], schema=kinds) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in fold(iter(batches), 20) for r in b.to_pylist()]
        assert got == want and len(want) > 100
