"""Coverage over alignment files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import alignments
from ..sources.files import parse_gaf

_SUMS = "contig string, bases long, reads long, first long"


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Alignments of all GAF files that come into the folder, as a stream; line_no is 0, as nothing here depends on the order of lines."""
    reader = spark.readStream.option("lineSep", "\n")
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return parse_gaf(reader.text(folder).withColumn("line_no", F.lit(0).cast("long")))


def add_up(stream: DataFrame, nodes: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that writes what each batch of alignments adds to its contigs, one small folder for each batch below out.

    A batch goes through the operators of the whole run, so that paths of any length count. A batch that is repeated after a
    failure replaces its own folder: every alignment counts once.
    """

    def each(batch: DataFrame, number: int) -> None:
        sums = alignments.credits(batch, nodes).groupBy("contig").agg(*[F.sum(c).cast("long").alias(c) for c in ("bases", "reads", "first")])
        sums.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a row for each contig

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def totals(spark: SparkSession, nodes: DataFrame, out: str) -> DataFrame:
    """Coverage by contig and 'overall' of all batches so far, as contig_coverage gives it for all their alignments at once."""
    return alignments.coverage_of(spark.read.schema(_SUMS).parquet(out), nodes)
