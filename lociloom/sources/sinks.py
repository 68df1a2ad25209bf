"""FASTA output, and block-gzipped text."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fetched, wrapped
from ..session import ship
from ..storage import by_shuffle
from . import blocks

FILES = {"H1": "_svtigs_H1.fa", "H2": "_svtigs_H2.fa", "untagged": "_svtigs_untagged.fa", "": "_svtigs.fa"}


def fasta_records(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """name and record of the rows (name, header) that have a sequence, which is cut to MAX_FETCH bases and goes in lines of 60."""
    return rows.join(by_shuffle(sequences.select("name", fetched("sequence").alias("sequence"))), "name").select("name", F.concat("header", F.lit("\n"), wrapped(F.col("sequence"))).alias("record"))


def write_fasta(records: DataFrame, path: str) -> None:
    """The records in byte order of their names, as text files below path, one for each range of names; in the order of the files'
    names they make one FASTA file. Ranges are as large as Spark's advisory partition size, so that few records make one file."""
    records.orderBy("name").select("record").write.mode("overwrite").text(path)


def write_blocks(lines: DataFrame, path: str, member_bytes: int = 65_280) -> None:
    """The lines (value) as block-gzipped files below path, one for each task, in a folder that all executors see. A task that runs again writes its file anew."""
    ship(lines.sparkSession)
    folder = blocks.local(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        context = TaskContext.get()
        name, n, rest = f"{folder}/part-{context.partitionId():05d}.gz", 0, b""
        with open(f"{folder}/.{context.taskAttemptId()}", "wb") as f:
            for b in batches:
                rest += "".join(f"{x}\n" for x in b.column(0).to_pylist()).encode()
                n += b.num_rows
                while len(rest) >= member_bytes:
                    f.write(blocks.member(rest[:member_bytes]))
                    rest = rest[member_bytes:]
            f.write((blocks.member(rest) if rest else b"") + blocks.member(b""))
        os.replace(f.name, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    lines.select("value").mapInArrow(run, "n long").agg(F.sum("n")).collect()
