"""A small run from files to files, the adapters with stub programs, and the stream."""

import os
import stat

from lociloom.__main__ import main, parser
from lociloom.adapters import external
from lociloom.operators.alignments import contig_coverage
from lociloom.params import Params
from lociloom.plans.pipeline import run
from lociloom.sources import files
from lociloom.streaming.coverage import add_up, stream_lines, totals


def inputs(d):
    seq = "ACGTTGCAAG" * 100
    (d / "g.gfa").write_text(f"S\ts1\t{seq}\tLN:i:1000\tSN:Z:chr1\tSO:i:0\nS\ts2\t{seq}\tLN:i:1000\tSN:Z:chr1\tSO:i:1000\nL\ts1\t+\ts2\t+\t0M\n")
    names = [f"r{i}" for i in range(8)]
    (d / "a.gaf").write_text("".join(f"{n}\t1100\t0\t1100\t+\t>s1>s2\t2000\t0\t1040\t1000\t1100\t60\ttp:A:P\tcg:Z:{400 + i}M60I{640 - i}M\n" for i, n in enumerate(names)))
    (d / "r.fa").write_text("".join(f">{n} x\n{seq[:400]}\n{'T' * 60}{seq[400:640]}\n" for n in names))
    (d / "p.tsv").write_text("#read\thap\n" + "".join(f"{n}\tH{1 + i % 2}\tps1\tchr1\n" for i, n in enumerate(names)) + "bad\tline\n\n")
    return Params(gaf=str(d / "a.gaf"), graph=str(d / "g.gfa"), fasta=str(d / "r.fa"), out=str(d / "out"))


def text(folder):
    return "".join((folder / p).read_text() for p in sorted(os.listdir(folder)) if p.startswith("part"))


def test_run_without_remap(spark, tmp_path):
    from dataclasses import replace

    params = replace(inputs(tmp_path), no_remap=True)
    got = run(spark, params, external.median_read)
    assert [(r["node"], r["start"], len(r["reads"])) for r in got.clusters.collect()] == [("s1", 401, 8)]
    assert [tuple(r) for r in got.decisions.collect()] == [("s1_401", "assembly", "pass")]
    out = text(tmp_path / "out" / "sample_svtigs.fa")
    assert out.startswith(">s1_401 contig=chr1 pos=401 support=8\nACGTTGCAAG") and max(map(len, out.split("\n")[1:])) == 60


def test_run_with_phase_and_remap(spark, tmp_path):
    from dataclasses import replace

    params = inputs(tmp_path)
    (tmp_path / "m.gaf").write_text("".join(f"{h}-s1_401\t700\t0\t700\t+\t>s1\t1000\t0\t639\t0\t0\t60\ttp:A:P\n" for h in ("H1", "H2")))
    got = run(spark, replace(params, phase=str(tmp_path / "p.tsv"), remap_gaf=str(tmp_path / "m.gaf")), external.median_read)
    assert {(r["name"], r["reason"]) for r in got.decisions.where("step = 'remap'").collect()} == {("H1-s1_401", "sv_in_alignment"), ("H2-s1_401", "sv_in_alignment")}
    assert text(tmp_path / "out" / "sample_svtigs_H1.fa").startswith(">H1-s1_401 contig=chr1 pos=401 support=4 path=>s1 map_ratio=1\n")
    assert text(tmp_path / "out" / "sample_svtigs_untagged.fa") == ""


def test_phase_file(spark, tmp_path):
    (tmp_path / "p").write_text("r1\tH1\ta\tc\nr1\tH2\ta\tc\n\nx\ty\n#r2\tH1\ta\tc\n")
    assert [tuple(r) for r in files.read_phase(spark, str(tmp_path / "p")).collect()] == [("r1", "H1", "a", "c")]


def test_adapters(tmp_path, caplog):
    tool = tmp_path / "tool"
    tool.write_text('#!/bin/sh\nn=$(cat "$1" 2>/dev/null || echo 0); echo $((n + 1)) > "$1"; [ "$n" -ge 1 ]\n')
    tool.chmod(tool.stat().st_mode | stat.S_IXUSR)
    assert external.find_executable("tool", (str(tmp_path),)) == str(tool) and external.find_executable(str(tool)) == str(tool) and external.find_executable("no-such-tool") is None
    assert external.run_and_log([str(tool), str(tmp_path / "n")], "tool", retries=2, backoff=0.01) == 0
    assert external.run_and_log("exit 7", "it") == 7 and "7" in caplog.text
    assert external.run_and_log(["sleep", "5"], "slow", timeout=0.1) == 124
    assert external.fasta_sequences(">a\nAC\nGT\n>b\n\n>c\nT") == ["ACGT", "T"]


def test_wtdbg2_with_stubs(tmp_path):
    import pytest

    for name, body in {"wtdbg2": "echo '>ctg1' | gzip > out.ctg.lay.gz", "wtpoa-cns": 'while [ "$1" != -fo ]; do shift; done; printf ">c1\\nACGT\\n>c2\\nGG\\n" > "$2"', "minimap2": "echo", "samtools": "cat > /dev/null || true"}.items():
        (tmp_path / name).write_text(f"#!/bin/sh\n{body}\n")
        (tmp_path / name).chmod(0o755)
    run_it = lambda: external.wtdbg2_assembler(Params(extra_dirs=(str(tmp_path),)))("n", [("r", "ACGT")])
    assert run_it() == ["ACGT", "GG"]
    for name, body, why in (("wtpoa-cns", "touch final.fa raw.fa", "unassembled"), ("minimap2", "exit 3", "failed"), ("wtdbg2", "echo no | gzip > out.ctg.lay.gz", "no_contig"), ("wtdbg2", "exit 1", "failed")):
        (tmp_path / name).write_text(f"#!/bin/sh\n{body}\n")
        with pytest.raises(external.NoContigs, match=why):
            run_it()


def test_remap_by_tasks(spark, tmp_path, monkeypatch):
    tool = tmp_path / "GraphAligner"
    tool.write_text("""#!/bin/sh
while [ $# -gt 0 ]; do case "$1" in -f) in=$2;; -a) out=$2;; esac; shift; done
sed -n 's/^>\\(.*\\)/\\1\\t9\\t0\\t9\\t+\\t>s1\\t9\\t0\\t9\\t9\\t9\\t60/p' "$in" > "$out"
""")
    tool.chmod(0o755)
    monkeypatch.setattr(external, "ALIGNED_AT_ONCE", 2)
    contigs = spark.createDataFrame([(f"a{i}", "ACGT") for i in range(7)], "name string, sequence string")
    got = files.parse_gaf(external.remap(Params(extra_dirs=(str(tmp_path),)), contigs)).collect()
    assert sorted(r["query_name"] for r in got) == [f"a{i}" for i in range(7)]


def test_outcomes(spark, tmp_path):
    from dataclasses import replace

    params = replace(inputs(tmp_path), no_remap=True)
    (tmp_path / "a.gaf").write_text((tmp_path / "a.gaf").read_text() + "".join(f"u{i}\t500\t0\t0\t+\t*\t0\t0\t0\t0\t0\t0\n" for i in range(4)))

    def none(name, reads):
        raise external.NoContigs("unassembled")

    got = run(spark, params, none)
    assert {tuple(r) for r in got.decisions.collect()} == {("s1_401", "assembly", "unassembled"), ("None-unmapped_0", "assembly", "no_contig")}
    assert got.contigs.count() == 0 and text(tmp_path / "out" / "sample_svtigs.fa") == ""


def test_contig_names(spark):
    passed = spark.createDataFrame([("c", ["r1", "r2", "none"])], "name string, reads array<string>")
    fasta = spark.createDataFrame([("r1", "A"), ("r2", "CC")], "name string, sequence string")
    got = external.assemble(passed, fasta, lambda name, reads: [s for _, s in reads])
    assert sorted(map(tuple, got.collect())) == [("c", "c", "A"), ("c_2", "c", "CC")]


def test_command_line(tmp_path, capsys):
    assert main(["-a", "/none", "-g", "/none", "-f", "/none"]) == 2
    p = Params(**vars(parser().parse_args("-a x -g y -f z -s 3 -d 50 -j -w hifi".split())))
    assert (p.support, p.dist, p.skip_untagged, p.reads) == (3, 50, True, "hifi")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = "r\t10\t0\t9\t+\t>s1\t100\t5\t25\t0\t0\t60\n"
    (tmp_path / "in" / "1.gaf").write_text(line)
    (tmp_path / "in" / "2.gaf").write_text(line * 2)
    nodes = spark.createDataFrame([("s1", 100, 0, "chr1"), ("s2", 40, 0, "chr2"), ("s3", 20, 0, "chr2")], "name string, len int, offset int, contig string")
    add = lambda: add_up(stream_lines(spark, str(tmp_path / "in"), 1), nodes, str(tmp_path / "sums"), str(tmp_path / "cp")).awaitTermination()
    add()
    (tmp_path / "in" / "3.gaf").write_text("r\t10\t0\t9\t+\t>s1<s2>none\t100\t5\t125\t0\t0\t60\nbad line\nr\t10\t0\t9\t+\t>s3>s1\t100\t5\t125\t0\t0\t60\n")
    add()
    every = files.read_gaf(spark, str(tmp_path / "in"))
    got = {tuple(r) for r in totals(spark, nodes, str(tmp_path / "sums")).collect()}
    assert got == {tuple(r) for r in contig_coverage(every, nodes).collect()} and ("chr1", 60 + 95 + 105, 3 + 1 + 1) in {r[:3] for r in got}
    assert len(list((tmp_path / "sums").glob("batch=*"))) == 3
