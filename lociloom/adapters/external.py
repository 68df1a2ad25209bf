"""External programs: finding and running them, assembling a candidate's reads, remapping alleles."""

from __future__ import annotations

import gzip
import logging
import os
import shutil
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fetched
from ..params import Params
from ..session import ship
from ..storage import by_shuffle

log = logging.getLogger("lociloom")

#: Settings by read type: the assembler's preset and the read mapper's (fixed values).
PRESETS = {"ont": ("ont", "map-ont"), "hifi": ("ccs", "map-hifi"), "clr": ("rs", "map-pb")}
#: Seconds that a step may take.
ASSEMBLE_S, CONSENSUS_S, MAP_S, POLISH_S = 600, 120, 300, 120


def find_executable(name: str, extra_dirs: tuple[str, ...] = ()) -> str | None:
    """An absolute path as it is, else the first of extra_dirs, the working folder and PATH that holds it."""
    if os.path.isabs(name):
        return name if os.access(name, os.X_OK) else None
    return shutil.which(name, path=os.pathsep.join([*extra_dirs, os.getcwd()])) or shutil.which(name)


def run_and_log(command: list[str] | str, label: str, retries: int = 0, backoff: float = 2.0, timeout: float | None = None, fatal: bool = False, cwd: str | None = None) -> int:
    """Runs a command (a string goes through bash with pipefail) and gives its exit code; tries again after backoff, twice that, and so on."""
    argv = ["bash", "-o", "pipefail", "-c", command] if isinstance(command, str) else command
    code = 1
    for attempt in range(retries + 1):
        if attempt:
            time.sleep(backoff * 2 ** (attempt - 1))
        try:
            done = subprocess.run(argv, timeout=timeout, cwd=cwd, capture_output=True, text=True)
            code = done.returncode
            err = done.stderr[-500:]
        except (subprocess.TimeoutExpired, OSError) as e:
            code, err = 124 if isinstance(e, subprocess.TimeoutExpired) else 127, str(e)
        if code == 0:
            return 0
        log.warning("%s failed with %d: %s", label, code, err)
    if fatal:
        raise RuntimeError(f"{label} failed with {code}")
    return code


Assembler = Callable[[str, list[tuple[str, str]]], list[str]]


class NoContigs(Exception):
    """Why a candidate has no contig: no_contig (nothing to lay out), unassembled (no consensus) or failed."""


def wtdbg2_assembler(params: Params) -> Assembler:
    """Assembles with wtdbg2, its consensus tool, minimap2 and samtools; raises NoContigs if a step fails or gives nothing."""

    def assemble(name: str, reads: list[tuple[str, str]]) -> list[str]:
        tool = {t: find_executable(t, params.extra_dirs) for t in ("wtdbg2", "wtpoa-cns", "minimap2", "samtools")}
        if not all(tool.values()):
            raise RuntimeError("not found: " + ", ".join(t for t, p in tool.items() if not p))
        preset, mapping = PRESETS[params.reads]
        with tempfile.TemporaryDirectory(prefix="lociloom-") as d:
            Path(d, "reads.fa").write_text("".join(f">{n}\n{s}\n" for n, s in reads))
            t = params.threads
            steps = [
                (f"{tool['wtdbg2']} -x {preset} -t {t} -i reads.fa -fo out", ASSEMBLE_S),
                (f"{tool['wtpoa-cns']} -t {t} -i out.ctg.lay.gz -fo raw.fa", CONSENSUS_S),
                (f"{tool['minimap2']} -t {t} -ax {mapping} raw.fa reads.fa | {tool['samtools']} sort -@ {t} -m 2g -o map.bam", MAP_S),
                (f"{tool['samtools']} view -F0x900 map.bam | {tool['wtpoa-cns']} -t {t} -d raw.fa -i - -fo final.fa", POLISH_S),
            ]
            for k, (command, seconds) in enumerate(steps):
                if k == 1 and not has_layout(Path(d, "out.ctg.lay.gz")):
                    raise NoContigs("no_contig")
                if run_and_log(command, f"assembly of {name}", timeout=seconds, cwd=d):
                    raise NoContigs("failed")
            found = fasta_sequences(Path(d, "final.fa").read_text() if Path(d, "final.fa").exists() else "")
            if not found:
                raise NoContigs("unassembled")
            return found

    return assemble


def has_layout(path: Path) -> bool:
    """True if the assembler's packed layout has a line that begins a contig."""
    try:
        with gzip.open(path, "rt", errors="replace") as f:
            return any(line.startswith(">") for line in f)
    except (OSError, EOFError):
        return False


def fasta_sequences(text: str) -> list[str]:
    return [s for s in ("".join(record.split("\n")[1:]) for record in ("\n" + text).split("\n>")[1:]) if s]


def median_read(name: str, reads: list[tuple[str, str]]) -> list[str]:
    """Built-in stand-in for an assembler: the read of middle length, as an approximation of the allele. Not the assembler's result."""
    some = sorted((s for _, s in reads if s), key=lambda s: (len(s), s))
    return [some[len(some) // 2]] if some else []


def read_sequences(passed: DataFrame, fasta: DataFrame, every: bool = False) -> DataFrame:
    """name, read and sequence of the candidates' (name, reads) reads that have one; long ones are cut to MAX_FETCH bases. every: reads without one and candidates without reads come too, with nulls."""
    reads = passed.select("name", (F.explode_outer if every else F.explode)("reads").alias("read"))
    return reads.join(by_shuffle(fasta.select(F.col("name").alias("read"), fetched("sequence").alias("sequence"))), "read", "left" if every else "inner").select("name", "read", "sequence")


#: Bytes of contigs that attempts hands over at once.
BATCH = 1 << 20


def attempts(passed: DataFrame, fasta: DataFrame, assembler: Assembler) -> DataFrame:
    """What comes of the candidates (name, reads): a row for each contig (name, parent, sequence), or one with parent and reason alone.

    The second contig of a candidate is named name_2, the third name_3. A candidate without any read sequence has the reason
    no_contig, as has one for which the assembler gives nothing. A candidate has MAX_CONTIG_DEPTH * 5 reads or so at most, as the
    gate lets no more pass. The sequences are joined once; candidates without any go along with a null. Rows leave a task many at a time.
    """
    ship(passed.sparkSession)
    rows = read_sequences(passed, fasta, every=True).repartition("name").sortWithinPartitions("name", "read")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, have, out, size = None, None, [], 0

        def close() -> int:
            try:
                got, reason = assembler(name, have) if have else [], "no_contig"
            except NoContigs as e:
                got, reason = [], str(e)
            out.extend((name if k == 0 else f"{name}_{k + 1}", name, s, None) for k, s in enumerate(got))
            if not got:
                out.append((None, name, None, reason))
            return 100 + sum(map(len, got))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["name", "parent", "sequence", "reason"])

        for b in batches:
            for n, r, s in zip(*(c.to_pylist() for c in b.columns)):
                if n != name or have is None:
                    size += close() if have is not None else 0
                    if size > BATCH:
                        yield batch()
                        out, size = [], 0
                    name, have = n, []
                if s is not None:
                    have.append((r, s))
        if have is not None:
            close()
        if out:
            yield batch()

    return rows.mapInArrow(run, "name string, parent string, sequence string, reason string")


def assemble(passed: DataFrame, fasta: DataFrame, assembler: Assembler) -> DataFrame:
    """The contigs (name, parent, sequence) of the candidates (name, reads)."""
    return attempts(passed, fasta, assembler).where("sequence IS NOT NULL").drop("reason")


#: So many alleles are aligned by one run of the aligner, which reads the whole graph each time.
ALIGNED_AT_ONCE = 2000


def remap(params: Params, contigs: DataFrame) -> DataFrame:
    """GAF lines (value, line_no) of the alleles (name, sequence) aligned to the graph with GraphAligner, by as many tasks as the
    number of alleles asks for; each writes its own alleles to a folder that goes when it ends. The graph must be where all executors see it."""
    ship(contigs.sparkSession)
    tool = find_executable("GraphAligner", params.extra_dirs)
    if not tool:
        raise RuntimeError("GraphAligner is not found; give its alignments with --remap-gaf, or run with --no-remap")
    rows = contigs.select("name", "sequence")
    rows = rows.repartition(max(1, -(-rows.count() // ALIGNED_AT_ONCE)), "name").sortWithinPartitions("name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="lociloom-") as d:
            some = False
            with open(f"{d}/in.fa", "w") as f:
                for b in batches:
                    for n, s in zip(*(c.to_pylist() for c in b.columns)):
                        some = bool(f.write(f">{n}\n{s}\n"))
            if not some:
                return
            command = [tool, "-g", params.graph, "-f", f"{d}/in.fa", "-a", f"{d}/out.gaf", "-x", "vg", "-t", str(params.threads), "--precise-clipping", f"{params.precise_clipping}", "--min-alignment-score", str(params.min_alignment_score), "--multimap-score-fraction", "0.9"]
            run_and_log(command, "remapping", retries=2, fatal=True)
            with open(f"{d}/out.gaf", newline="\n") as f:  # line by line, however long the output
                for k, line in enumerate(f):
                    yield pa.RecordBatch.from_arrays([pa.array([line.rstrip("\n")]), pa.array([k], pa.int64())], names=["value", "line_no"])

    return rows.mapInArrow(run, "value string, line_no long")
