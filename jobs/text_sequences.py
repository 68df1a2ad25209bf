"""Catalogue of nucleotide sequences that stand in texts, kept up to date as texts arrive.

Reports, papers and pages name alleles, probes and primers by their bases. The job finds the words of bases (A, C, G, T and N, in either case, min_bases
of them at least) in the documents and gives each the spelling that it shares with its reverse complement (the lesser of the two), so that texts which speak of
the same sequence from either strand come together.

A file stream takes the files that are new since the last run (its checkpoint knows them) and adds a row for each mention to out/mentions, partitioned by
language; Spark's file sink makes each batch count once, however often a run is broken off. The texts are therefore read once. The catalogue, out/sequences, is
then made anew from the mentions, which are few against the texts, partitioned by length. Running again without new files changes nothing.
A file that is changed after it was taken is not taken again.

Null texts have no mentions. Rows with null or repeated ids count as they are. Languages that are no two or three small letters share the
partition 'other', with the language itself in a column. Other columns are ignored, whatever they are called.

    python -m jobs.text_sequences --documents /data/documents.parquet --out /data/sequences --checkpoint /data/sequences-checkpoint
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, log
from lociloom.functions.text import reverse_complement

DOCUMENTS = "doc_id long, text string, lang string, source string"
MENTIONS = "doc_id long, source string, language string, nth int, found string, sequence string, bases int, reversed boolean, lang string"
SEQUENCES = "sequence string, mentions long, forward long, languages long, bases int"
#: What stands between words.
APART = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class Config:
    """Bases that a word must have, and files that a batch takes."""

    min_bases: int = 4
    files_per_batch: int = 64


def mentions(docs: DataFrame, min_bases: int) -> DataFrame:
    """A row for each word of bases: the document's doc_id, source and language, nth (from 0) of its mentions, the word as found, its sequence, whether that is the reverse complement, and the partition lang."""
    some = docs.where(F.col("text").rlike(f"[ACGTNacgtn]{{{min_bases}}}"))
    found = F.filter(F.split("text", APART), lambda w: w.rlike(f"^[ACGTNacgtn]{{{min_bases},}}$"))
    each = some.select("doc_id", "source", F.col("lang").alias("language"), F.posexplode(found).alias("nth", "found"))
    upper = F.upper("found")
    other = reverse_complement(upper)
    part = F.when(F.col("language").rlike("^[a-z]{2,3}$"), F.col("language")).otherwise("other")
    rows = each.withColumns({"sequence": F.least(upper, other), "bases": F.length("found"), "reversed": other < upper, "lang": part})
    return rows.select(*[c.split(" ")[0] for c in MENTIONS.split(", ")])


def catalogue(rows: DataFrame) -> DataFrame:
    """sequence, mentions, forward (mentions that are not of the reverse complement), languages (different ones), bases."""
    return rows.groupBy("sequence").agg(F.count(F.lit(1)).alias("mentions"), F.count_if(~F.col("reversed")).alias("forward"), F.count_distinct("language").alias("languages"), F.any_value("bases").alias("bases"))


def run(spark: SparkSession, settings: Config, documents: str, out: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Takes the documents' new files, and gives mentions and catalogue as read back."""
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", settings.files_per_batch).parquet(documents)
    sink = mentions(stream, settings.min_bases).writeStream.format("parquet").partitionBy("lang").option("path", f"{out}/mentions").option("checkpointLocation", checkpoint)
    query = sink.trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s: %d documents in the last %d batches", documents, sum(p["numInputRows"] for p in query.recentProgress), len(query.recentProgress))
    rows = spark.read.schema(MENTIONS).parquet(f"{out}/mentions")
    catalogue(rows).repartition("bases").write.mode("overwrite").partitionBy("bases").parquet(f"{out}/sequences")
    every = spark.read.schema(SEQUENCES).parquet(f"{out}/sequences")
    log.info("wrote %s: %d mentions of %d sequences", out, rows.count(), every.count())
    return rows, every


def main(argv: list[str] | None = None) -> int:
    paths = {"documents": "folder to which files of documents come, or a pattern of files or folders", "out": "folder of the output", "checkpoint": "folder that remembers which files were taken"}
    return command("text_sequences", __doc__.split("\n")[0], paths, Config, run, argv)


if __name__ == "__main__":
    sys.exit(main())
