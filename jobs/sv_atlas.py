"""Atlas of structural-variant clusters by contig.

From the alignments of reads to a graph, the graph's nodes and edges and the reads' haplotypes (all derived from the tables lineitem, part and
orders) it makes a row for each cluster with enough reads: where it lies, how many reads of each haplotype support it, the contig's
depth, what the gate says of each haplotype, and on which haplotypes the variant is (zygosity). Output is Parquet below out, in a
folder for each contig.

A whole run replaces the output. With contigs in the config only these contigs' folders are replaced (dynamic partition overwrite), all others stay as
they are: after a change of the graph's annotation, say. A contig of the list without clusters keeps its folder, as nothing is written for it.
Running again gives the same output.

Reads without a haplotype count as untagged; alignments with a null among the fields that are used are no signal. Empty tables give an
output without rows. Columns other than those used are ignored.

    python -m jobs.sv_atlas --tables /data/tables --out /data/atlas [--config jobs/sv_atlas.json]
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, log
from lociloom.operators import alignments, clusters, haplotypes, loci
from lociloom.sources.derived import derived
from lociloom.storage import scratch, written

COLUMNS = "contig string, node string, k int, start bigint, ref bigint, bin bigint, reads int, h1 int, h2 int, untagged int, depth double, h1_gate string, h2_gate string, untagged_gate string, zygosity string"


@dataclass(frozen=True)
class Config:
    """Reads that a cluster must have more of, how far loci may lie apart, whether untagged reads are left out, bases of a bin, contigs to renew (all if none)."""

    support: int = 5
    dist: int = 100
    skip_untagged: bool = False
    bin_size: int = 100_000
    contigs: list[str] = field(default_factory=list)


def atlas(split: DataFrame, coverage: DataFrame, settings: Config) -> DataFrame:
    """The rows from clusters tallied by haplotype: what the gate says of each haplotype is worked out within a cluster's row."""
    deep, least = haplotypes.with_depth(split.withColumn("reads", F.expr("h1 + h2 + untagged")), coverage), haplotypes.least_reads(settings.support)
    counts = ("h1", "h2") if settings.skip_untagged else ("h1", "h2", "untagged")
    if settings.skip_untagged:
        deep = deep.withColumns({"untagged": F.lit(0), "untagged_gate": F.lit(None).cast("string")})
    rows = deep.withColumns({f"{c}_gate": haplotypes.reason(F.col("depth"), F.col("reads"), F.col(c), least) for c in counts})
    passed = lambda c: F.coalesce(F.col(f"{c}_gate") == "pass", F.lit(False))
    zygosity = F.when(passed("h1") & passed("h2"), "1|1").when(passed("h1"), "1|0").when(passed("h2"), "0|1").when(passed("untagged"), "0/1").otherwise("./.")
    rows = rows.withColumns({"bin": F.floor(F.col("ref") / settings.bin_size), "zygosity": zygosity})
    return rows.selectExpr(*[f"CAST({n} AS {t}) AS {n}" for n, t in (c.split(" ") for c in COLUMNS.split(", "))])


def run(spark: SparkSession, settings: Config, tables: str, out: str) -> DataFrame:
    """Makes the atlas of the tables' folder below out, and gives it as read back. Paths are looked up once, for both coverage and signals."""
    base = scratch(spark, "atlas")
    lines, nodes = derived(spark, tables, "gaf"), derived(spark, tables, "gfa_node")
    log.info("read %s: %d alignments, %d nodes", tables, lines.count(), nodes.count())
    paths = written(alignments.with_steps(alignments.path_sums(lines), nodes).drop("steps"), f"{base}/paths")
    coverage = written(alignments.coverage_of(alignments.credits_of(paths), nodes), f"{base}/coverage")
    found = written(clusters.of_signals(loci.on_paths(loci.signal_rows(lines), paths), nodes, settings.dist, last=True), f"{base}/within")
    final = clusters.final_clusters(clusters.merge_neighbours(found, derived(spark, tables, "gfa_edge"), nodes, settings.dist, gone_too=False), settings.support)
    rows = atlas(haplotypes.tallied(final, derived(spark, tables, "phase")), coverage, settings)
    put = (rows.where(F.col("contig").isin(settings.contigs)) if settings.contigs else rows).repartition("contig").sortWithinPartitions("contig", "ref", "node", "k").write.mode("overwrite").partitionBy("contig")
    put.option("partitionOverwriteMode", "dynamic" if settings.contigs else "static").parquet(out)
    made = read(spark, out)
    log.info("wrote %s: %s", out, {r["zygosity"]: r["n"] for r in made.groupBy("zygosity").agg(F.count(F.lit(1)).alias("n")).collect()})  # five rows at most
    return made


def read(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(COLUMNS).parquet(out).select(*[c.split(" ")[0] for c in COLUMNS.split(", ")])


def main(argv: list[str] | None = None) -> int:
    return command("sv_atlas", __doc__.split("\n")[0], {"tables": "folder of the tables", "out": "folder of the output"}, Config, run, argv)


if __name__ == "__main__":
    sys.exit(main())
