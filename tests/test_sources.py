"""Ranges of block-gzipped files, FASTA by an index, line numbers, and lines that are too short."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from lociloom.functions.text import general
from lociloom.operators import alignments, loci
from lociloom.params import MAX_FETCH
from lociloom.sources import blocks, files, sinks


def put(path, data, cuts):
    """A block-gzipped file whose members end at the cuts."""
    edges = [0, *sorted(cuts), len(data)]
    path.write_bytes(b"".join(blocks.member(data[a:b]) for a, b in zip(edges, edges[1:])) + blocks.member(b""))


@pytest.mark.parametrize("end", ["", "\n", "\n\n"])
def test_every_border(tmp_path, end):
    """Whatever the members and ranges are, each line comes once and in order."""
    rng = random.Random(len(end))
    for k in range(30):
        text = "\n".join("".join(rng.choices("abé\r", k=rng.choice([0, 1, 5, 400]))) for _ in range(rng.randint(0, 60))) + end
        data, path = text.encode(), tmp_path / f"{k}.gz"
        put(path, data, [rng.randint(0, len(data)) for _ in range(rng.randint(0, 40))])
        assert gzip.decompress(path.read_bytes()) == data and blocks.is_blocked(str(path))
        want = data.split(b"\n")[: -1 if data.endswith(b"\n") or not data else None]
        size = rng.choice([1, 7, 50, 300, 10**9])
        got = [line for r in blocks.ranges(str(path), size) for some in blocks.member_lines(str(path), r.begin, r.end) for line in some]
        assert got == want


def test_what_looks_like_a_member(tmp_path):
    """Bytes of a member's head within a member's data are no border."""
    inner = blocks.member(b"not a line\n" * 5)
    data = (inner[:-1] + b"\n") * 40
    body = blocks.MEMBER + bytes(5) + b"\xff\x06\x00BC\x02\x00" + (len(data) + 30).to_bytes(2, "little") + b"\x01" + len(data).to_bytes(2, "little") + (len(data) ^ 0xFFFF).to_bytes(2, "little") + data
    import zlib

    stored = body + zlib.crc32(data).to_bytes(4, "little") + len(data).to_bytes(4, "little")
    (tmp_path / "a.gz").write_bytes(stored + blocks.member(b"end\n"))
    got = [x for r in blocks.ranges(str(tmp_path / "a.gz"), 100) for some in blocks.member_lines(str(tmp_path / "a.gz"), r.begin, r.end) for x in some]
    assert got == [*data.split(b"\n")[:-1], b"end"]
    (tmp_path / "b.gz").write_bytes(stored + b"rubbish")
    with pytest.raises(OSError, match="no whole member"):
        list(blocks.member_lines(str(tmp_path / "b.gz"), 0, 10**6))


def test_ranges_are_tasks_and_plain_files_read_alike(spark, tmp_path):
    text = "".join(f"line {k} {'x' * (k % 700)}\n" for k in range(3000))
    (tmp_path / "blocks").mkdir()
    put(tmp_path / "blocks" / "a.gz", text.encode(), range(0, len(text), 5000))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.gz").write_bytes(gzip.compress(text[:1000].encode()) + gzip.compress(text[1000:].encode()))
    (tmp_path / "plain").write_text(text)
    want = text.split("\n")[:-1]
    for folder, tasks in (("blocks", 4), ("one", 1)):
        got = files.lines(spark, str(tmp_path / folder), range_bytes=3_000)
        assert got.rdd.getNumPartitions() >= tasks
        assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == (folder == "one")  # only what one task unpacks is dealt out
        assert [r["value"] for r in got.orderBy("line_no").collect()] == want
    for path in ("blocks", "one", "plain"):
        got = files.numbered(files.lines(spark, str(tmp_path / path), range_bytes=3_000))
        assert [(r["line"], r["value"]) for r in got.orderBy("line").collect()] == list(enumerate(want, 1))


def test_numbers_over_files_and_blocks(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k} {i}\n" for i in range(4000 + k)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = [(r["line"], r["value"]) for r in files.numbered(files.lines(spark, str(tmp_path))).orderBy("line").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate([f"{k} {i}" for k in range(3) for i in range(4000 + k)], 1))


def test_a_limit_of_lines(spark, tmp_path):
    (tmp_path / "a.gaf").write_text("".join(f"r{k}\t9\t0\t9\t+\t>s1\t9\t0\t9\t9\t9\t60\n" for k in range(20)))
    assert files.read_gaf(spark, str(tmp_path / "a.gaf"), max_lines=7).count() == 7 and files.read_gaf(spark, str(tmp_path / "a.gaf")).count() == 20


def test_written_blocks(spark, tmp_path):
    rows = spark.range(500).selectExpr("concat('line ', id) AS value").repartition(3)
    sinks.write_blocks(rows, str(tmp_path / "out"), member_bytes=100)
    sinks.write_blocks(rows, str(tmp_path / "out"), member_bytes=100)
    got = [r["value"] for r in files.lines(spark, str(tmp_path / "out"), range_bytes=150).collect()]
    assert sorted(got) == sorted(f"line {k}" for k in range(500))


def test_fasta_by_index(spark, tmp_path):
    rng = random.Random(2)
    records = {}
    text = ""
    for k in range(400):
        name, seq, width = f"r{k}", "".join(rng.choices("ACGT", k=rng.choice([0, 1, 59, 60, 61, 500]))), rng.choice([60, 7, 1000])
        records[name] = seq
        text += f">{name}{rng.choice(['', ' more > text', chr(9) + 'x'])}{rng.choice([chr(10), chr(13) + chr(10)])}" + "".join(seq[i : i + width] + "\n" for i in range(0, len(seq), width))
    text += ">\nACGT\n>last with a name\nAC>GT\nA C"
    records["last"] = "AC>GTAC"
    path = tmp_path / "r.fa"
    path.write_text(text, newline="")
    whole = {tuple(r) for r in files.read_fasta(spark, str(path)).collect()}
    for size in (17, 1000, 10**9):
        index = files.fasta_index(spark, f"file://{path}", range_bytes=size)
        wanted = spark.createDataFrame([(f"r{k}",) for k in range(0, 500, 3)] + [("r3",), ("last",)], "name string")
        got = [tuple(r) for r in files.fetch_fasta(index, wanted).collect()]
        assert len(got) == len(set(got)) and set(got) == {x for x in whole if x[0] == "last" or int(x[0][1:]) % 3 == 0} and set(got) <= set(records.items())
    with pytest.raises(ValueError, match="executors"):
        files.fasta_index(spark, "hdfs://store/r.fa")


def test_what_is_read_grows_with_what_is_wanted(spark, tmp_path):
    """Long sequences are cut as they are read; the rest of the file may be unreadable rubbish."""
    line = b"ACGTACGTAC\n"
    with open(tmp_path / "r.fa", "wb") as f:
        f.write(b">long\n" + line * 150_000 + b">short\n" + line + b">other\n")
    index = files.fasta_index(spark, str(tmp_path / "r.fa")).collect()
    with open(tmp_path / "r.fa", "r+b") as f:
        f.seek(index[0]["start"] + 1_200_000)
        f.write(b"\xff" * 100_000)
    index = spark.createDataFrame(index)
    got = {r["name"]: r["sequence"] for r in files.fetch_fasta(index, spark.createDataFrame([("long",), ("short",), ("none",)], "name string")).collect()}
    assert set(got) == {"long", "short"} and len(got["long"]) == MAX_FETCH and set(got["long"]) == set("ACGT") and got["short"] == "ACGTACGTAC"


def test_fasta_output_is_cut(spark):
    rows = spark.createDataFrame([("a", ">a")], "name string, header string")
    long = spark.range(1).select(F.lit("a").alias("name"), F.repeat(F.lit("A"), MAX_FETCH + 5).alias("sequence"))
    assert sinks.fasta_records(rows, long).select(F.length(F.replace("record", F.lit("\n"), F.lit(""))).alias("n")).first()["n"] == MAX_FETCH + 2


SHORT = ["bad line", "", "a\tb\tc", "r\t1\t0\t1\t+\t>s1\t9\t0\t9\t9\t9", "\t" * 11]


def test_short_lines_before_filters(spark, tmp_path):
    """A line with few fields never fails a query, whatever filter or operator comes after the reader."""
    good = "".join(f"r{k % 3}\t900\t210\t600\t+\t>s1\t900\t5\t800\t9\t9\t60\tcg:Z:300M60I300M\n" for k in range(6))
    (tmp_path / "a.gaf").write_text(good + "\n".join(SHORT) + "\n")
    nodes = spark.createDataFrame([("s1", 900, 0, "chr1")], "name string, len int, offset int, contig string")
    rows = files.read_gaf(spark, str(tmp_path / "a.gaf"))
    assert rows.where("mapq >= 5").count() == 6 and rows.where("is_primary AND cigar LIKE '%I%'").count() == 6
    for f in (alignments.valid, alignments.multi_mapped, alignments.unmapped_reads):
        f(rows).collect()
    for f in (alignments.contig_coverage, loci.inter_breakpoints, loci.intra_loci, loci.sv_loci, loci.signal_counters):
        assert f(rows, nodes).collect()
    (tmp_path / "g.gfa").write_text("S\ts1\tACGT\tLN:i:4\tSN:Z:c\tSO:i:0\nS\nS\tx\nL\nL\ta\nL\ta\t+\tb\t+\t0M\n\n")
    node, edge = files.read_gfa(spark, str(tmp_path / "g.gfa"))
    assert node.where("len > 0 AND contig = 'c'").count() == 1 and edge.where("src = 'a' AND dst != 'x'").count() == 1
    (tmp_path / "p.tsv").write_text("r1\nr1\tH1\nr1\tH2\tps\tchr1\n")
    assert files.read_phase(spark, str(tmp_path / "p.tsv")).where("haplotype != 'H1'").count() == 1


def test_general_is_printf(spark):
    rng = random.Random(1)
    ties = [k / 2**n for k in range(1, 400) for n in (1, 5, 8, 11)]
    values = [0.0, 0.3515625, 123456.5, 999999.5, 1e6, 1e-5, 0.0001, -2.5, 1e300, float("nan"), float("inf"), -float("inf"), *ties, *[rng.random() * 10 ** rng.randint(-8, 9) for _ in range(2000)]]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", general(F.col("x")).alias("g")).collect()
    assert [r["g"] for r in got] == ["%g" % r["x"] for r in got]


def test_no_sequences_are_broadcast(spark, data):
    """A sequence that is worked out counts as 20 bytes in Spark's estimates, so that a table of gigabytes would go to the driver."""
    from lociloom.adapters.external import read_sequences
    from lociloom.operators.remap import path_index
    from lociloom.plans.queries import _gfa_lines
    from lociloom.sources.derived import derived, sequences
    from lociloom.sources.sinks import fasta_records

    seq, gaf = sequences(spark, data), derived(spark, data, "gaf")
    heads = seq.select("name", F.lit(">x").alias("header"))
    passed = spark.range(3).select(F.col("id").cast("string").alias("name"), F.array(F.lit("s1")).alias("reads"))
    for df in (_gfa_lines(spark, data), fasta_records(heads, seq), path_index(gaf.select("path"), seq), read_sequences(passed, seq)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not [x for x in plan.split("\n") if "BroadcastHashJoin" in x and "name" in x]


def test_packed_text_is_written_by_all_tasks(spark):
    from lociloom.plans.queries import _put

    path = _put(spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("value")), spark, packed=True)
    assert len([f for f in blocks.files_of(path) if f.endswith(".gz")]) == 4
    assert sorted(int(r["value"]) for r in files.lines(spark, path).collect()) == list(range(40))
