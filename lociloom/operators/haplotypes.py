"""Haplotype split of clusters, assembly candidates and their gate.

Nulls: a read with a null haplotype is untagged, as is one that the table of tags has not; a null phase set does not change a tag. A contig without coverage has the least depth. Clusters without reads do not
come through the split. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import MAX_CONTIG_DEPTH, MIN_DEPTH

_KINDS = ("H1", "H2", "other", "untagged")


def tagged_reads(clusters: DataFrame, phase: DataFrame) -> DataFrame:
    """node, k, read, tag: H1, H2, untagged (no tag or phase set none, or not in the table), or other (untagged, not tallied)."""
    return _tagged(clusters.select("node", "k", F.explode("reads").alias("read")), phase)


_KEY = ("node", "k", "reads")

#: Which of h1, h2 and untagged a tag counts for.
_SAYS = {"h1": "tag = 'H1'", "h2": "tag = 'H2'", "untagged": "tag IN ('untagged', 'other')"}


def _tag():
    none = F.col("haplotype").isNull() | (F.col("haplotype") == "none") | (F.col("phase_set") == "none")
    return F.when(none, "untagged").when(F.col("haplotype").isin("H1", "H2"), F.col("haplotype")).otherwise("other")


def _tagged(reads: DataFrame, phase: DataFrame) -> DataFrame:
    tags = phase.select(F.col("read_name").alias("read"), "haplotype", "phase_set")
    met = reads.join(tags, "read", "left")
    return met.select(*[c for c in reads.columns if c != "read"], "read", _tag().alias("tag"))


def _each_read(clusters: DataFrame) -> DataFrame:
    """node, k, own (the cluster's other columns, with one of its reads alone) and read: what a cluster has goes along with its reads, so that it is worked out once."""
    own = F.struct(*[c for c in clusters.columns if c not in _KEY])
    each = clusters.select("node", "k", own.alias("own"), F.posexplode("reads").alias("nth", "read"))
    return each.select("node", "k", F.when(F.col("nth") == 0, F.col("own")).alias("own"), "read")


def phase_split(clusters: DataFrame, phase: DataFrame | None) -> DataFrame:
    """clusters with h1, h2 and untagged (sorted arrays) in place of reads."""
    if phase is None:
        empty = F.array().cast("array<string>")
        return clusters.select("*", empty.alias("h1"), empty.alias("h2"), F.col("reads").alias("untagged")).drop("reads")
    some = lambda *t: F.sort_array(F.collect_set(F.when(F.col("tag").isin(*t), F.col("read"))))
    sets = _tagged(_each_read(clusters), phase).groupBy("node", "k").agg(F.any_value("own", True).alias("own"), some("H1").alias("h1"), some("H2").alias("h2"), some("untagged", "other").alias("untagged"))
    return sets.select("node", "k", *[f"own.{c}" for c in clusters.columns if c not in _KEY], "h1", "h2", "untagged")


def tallied(clusters: DataFrame, phase: DataFrame) -> DataFrame:
    """clusters with the numbers of the different reads h1, h2 and untagged in place of reads: the sizes of phase_split's arrays, without putting these together. What a read's rows of tags say comes down to
    a row before they are joined."""
    tags = phase.select(F.col("read_name").alias("read"), _tag().alias("tag")).groupBy("read").agg(*[F.bool_or(F.expr(c)).alias(n) for n, c in _SAYS.items()])
    met = _each_read(clusters).join(tags, "read", "left").withColumn("untagged", F.coalesce("untagged", F.col("read").isNotNull()))
    sums = met.groupBy("node", "k").agg(F.any_value("own", True).alias("own"), *[F.count_if(n).cast("int").alias(n) for n in _SAYS])
    return sums.select("node", "k", *[f"own.{c}" for c in clusters.columns if c not in _KEY], *_SAYS)


def phase_summary(clusters: DataFrame, phase: DataFrame) -> DataFrame:
    """tag, reads (different ones) and clusters (that have any) for H1, H2 and untagged."""
    tags = tagged_reads(clusters, phase).where("tag != 'other'")
    return tags.groupBy("tag").agg(F.count_distinct("read").alias("reads"), F.count_distinct("node", "k").alias("clusters"))


def candidates(split: DataFrame, phased: bool, skip_untagged: bool = False) -> DataFrame:
    """A row for each cluster and haplotype to assemble: name, hap, reads, cluster_reads and the cluster's columns."""
    total = (F.size("h1") + F.size("h2") + F.size("untagged")).alias("cluster_reads")
    plain = F.concat("node", F.lit("_"), F.col("start").cast("string"))
    one = lambda hap, reads: F.struct(F.lit(hap).alias("hap"), F.concat(F.lit(f"{hap}-" if hap else ""), plain).alias("name"), F.col(reads).alias("reads"))
    if not phased:
        each = [one("", "untagged")]
    else:
        each = [one("H1", "h1"), one("H2", "h2")] + ([] if skip_untagged else [one("None", "untagged")])
    return split.select("node", "k", "start", "ref", "contig", total, F.explode(F.array(*each)).alias("c")).select("c.name", "c.hap", "c.reads", "cluster_reads", "node", "k", "start", "ref", "contig")


def gate(found: DataFrame, coverage: DataFrame, support: int) -> DataFrame:
    """The candidates with depth and reason: pass, or why not."""
    return reasoned(with_depth(found, coverage), least_reads(support))


def least_reads(support: int) -> float:
    return float(max(3, support // 2))


def with_depth(found: DataFrame, coverage: DataFrame) -> DataFrame:
    """found with its contigs' depth. Contigs are few, and a table of theirs that was written before is broadcast by its size."""
    depth = F.greatest(F.lit(float(MIN_DEPTH)), F.coalesce("coverage", F.lit(0.0)))
    return found.join(coverage.select("contig", "coverage"), "contig", "left").withColumn("depth", depth).drop("coverage")


def reason(depth: Column, cluster_reads: Column, reads: Column, least: float) -> Column:
    """What the gate says of so many reads of a cluster."""
    d, c = depth, cluster_reads
    return F.when(2 * d < c, "high_coverage").when(d > 5 * c, "low_coverage").when(reads < least, "low_support").when(d > MAX_CONTIG_DEPTH, "max_contig_depth").otherwise("pass")


def reasoned(found: DataFrame, least: float) -> DataFrame:
    """With zscore (how far the reads lie from the depth, in its standard deviations) and reason, from depth, cluster_reads and reads."""
    d, c, r = F.col("depth"), F.col("cluster_reads"), F.size("reads")
    found = found.withColumn("zscore", F.when(d > 0, (r - d) / F.sqrt(F.when(d > 0, d))).otherwise(F.lit(0.0)))
    return found.withColumn("reason", reason(d, c, r, least))


def unmapped_candidate(unmapped: DataFrame, support: int) -> DataFrame:
    """All unmapped reads as one candidate; what comes of it is never registered, so never put out. Gathers them only if the gate lets them pass."""
    n = unmapped.count()
    least = max(3, support // 2)
    some = unmapped.limit(0) if n < least or n > MAX_CONTIG_DEPTH else unmapped
    got = some.agg(F.sort_array(F.collect_list("query_name")).alias("reads"))
    return got.select(F.lit("None-unmapped_0").alias("name"), "reads", F.lit(n).cast("long").alias("cluster_reads"), F.lit(float(n)).alias("depth"), F.lit("pass" if least <= n <= MAX_CONTIG_DEPTH else "low_support" if n < least else "max_contig_depth").alias("reason"))


def outcomes(gated: DataFrame, attempts: DataFrame) -> DataFrame:
    """gated with the reason of what passed but has no contig (no_contig, unassembled or failed). attempts: parent and reason (null for a contig)."""
    none = attempts.where("reason IS NOT NULL").select(F.col("parent").alias("name"), F.col("reason").alias("_why"))
    return gated.join(none, "name", "left").withColumn("reason", F.coalesce("_why", "reason")).drop("_why")


def gate_counts(gated: DataFrame) -> DataFrame:
    """reason and n (of the gate, and of outcomes if these are in); candidates over the contig depth count as high coverage."""
    return gated.groupBy(F.when(F.col("reason") == "max_contig_depth", "high_coverage").otherwise(F.col("reason")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
