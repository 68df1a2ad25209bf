"""The whole run: from graph and alignments to alleles in FASTA files."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import external
from ..functions.text import svtig_header
from ..operators import alignments, clusters, consensus, haplotypes, loci, remap
from ..params import Params
from ..sources import files, sinks
from ..storage import scratch, written

log = logging.getLogger("lociloom")


@dataclass
class Result:
    """What each step gives; decisions has a reason for every candidate and every remapped allele."""

    coverage: DataFrame
    clusters: DataFrame
    candidates: DataFrame
    contigs: DataFrame
    output: DataFrame
    decisions: DataFrame


def run(spark: SparkSession, params: Params, assembler: external.Assembler | None = None) -> Result:
    """Runs all steps, writes the alleles and gives the steps' results. Steps that others use more than once, and those that call
    programs, are written below the shared folder."""
    params = params.checked()
    base = scratch(spark, "run")
    nodes, edges = files.read_gfa(spark, params.graph)
    nodes = written(files.first_nodes(nodes), f"{base}/nodes")
    aligned = written(files.read_gaf(spark, params.gaf, params.max_lines), f"{base}/alignments")
    coverage = written(alignments.contig_coverage(aligned, nodes), f"{base}/coverage")
    found = written(clusters.of_signals(loci.signals(aligned, nodes), nodes, params.dist, last=True), f"{base}/within")
    final = written(clusters.final_clusters(clusters.merge_neighbours(found, edges, nodes, params.dist, gone_too=False), params.support), f"{base}/clusters")
    phase = files.read_phase(spark, params.phase) if params.phase else None
    split = haplotypes.phase_split(final, phase)
    gated = written(haplotypes.gate(haplotypes.candidates(split, bool(params.phase), params.skip_untagged), coverage, params.support), f"{base}/candidates")
    passed = gated.where("reason = 'pass'")
    unmapped = haplotypes.unmapped_candidate(alignments.unmapped_reads(aligned), params.support).where("cluster_reads > 0")
    tried = passed.select("name", "reads").union(unmapped.where("reason = 'pass'").select("name", "reads"))
    svtigs = passed.select("name", F.col("start").cast("int").alias("pos"), "contig", F.size("reads").alias("support"))
    reads = files.wanted_fasta(spark, params.fasta, tried.select(F.explode("reads").alias("name")), f"{base}/fasta-index")
    if assembler is None and params.assembler == "consensus":
        done = consensus.attempts(tried, reads)
    else:
        done = external.attempts(tried, reads, assembler or external.wtdbg2_assembler(params))
    done = written(done, f"{base}/attempts")
    contigs = done.where("sequence IS NOT NULL").drop("reason")
    gated = written(haplotypes.outcomes(gated, done), f"{base}/gated")
    reasons = gated.select("name", "reason").union(haplotypes.outcomes(unmapped.select("name", "reason"), done)).select("name", F.lit("assembly").alias("step"), "reason")
    if params.no_remap:
        output = svtigs.select("*", F.lit(None).cast("string").alias("path"), F.lit(None).cast("double").alias("ratio"))
    else:
        if params.remap_gaf:
            remapped = files.read_gaf(spark, params.remap_gaf)
        else:
            remapped = files.parse_gaf(written(external.remap(params, contigs), f"{base}/remapped"))
        lines = remapped.join(contigs.select(F.col("name").alias("query_name"), F.col("sequence").alias("query_sequence")), "query_name", "left")
        lines = written(remap.with_has_sv(remap.path_sequences(lines, nodes, nodes.select("name", "sequence"))), f"{base}/remap")
        decided = written(remap.decisions(remap.fold(lines), params.min_map_ratio), f"{base}/decisions")
        unique = written(remap.without_duplicates(decided.where("keep")), f"{base}/unique")
        output = written(remap.flagged(unique, svtigs), f"{base}/flagged")
        log.info("remapping: %s", remap.counters(lines, output).first().asDict())  # one row
        more = decided.select("name", F.lit("remap").alias("step"), "reason").unionByName(unique.where("duplicate").select("name", F.lit("duplicates").alias("step"), F.lit("duplicate").alias("reason")))
        reasons = reasons.unionByName(more)
    output = written(output, f"{base}/output")
    write(output, contigs, params)
    if params.debug:
        events(reasons).orderBy("name", "step").write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{params.out}/{params.sample}_events")
    log.info("candidates: %s", {r["reason"]: r["n"] for r in haplotypes.gate_counts(reasons.where("step = 'assembly'")).collect()})  # a row for each reason
    log.info("%d alleles", output.count())
    return Result(coverage, final, gated, contigs, output, reasons)


def events(reasons: DataFrame) -> DataFrame:
    """name, step, event (OK, FILTERED, FAILED, KEPT or DUPLICATE) and reason of the decisions; what no gate or rule holds back is OK after assembly, KEPT after remapping."""
    event = F.when(F.col("reason") == "duplicate", "DUPLICATE").when(F.col("reason").isin("no_contig", "unassembled", "failed"), "FAILED").when(F.col("reason") == "pass", "OK")
    event = event.when((F.col("step") == "remap") & ~F.col("reason").isin("no_mapping", "high_map_ratio"), "KEPT").otherwise("FILTERED")
    return reasons.select("name", "step", event.alias("event"), "reason")


def write(output: DataFrame, contigs: DataFrame, params: Params) -> None:
    """One FASTA folder, or one for each haplotype where reads are tagged, and the same rows as Parquet."""
    rows = output.withColumn("header", svtig_header(F.col("name"), F.col("contig"), F.col("pos"), F.col("support"), F.col("path"), F.col("ratio")))
    records = sinks.fasta_records(rows, contigs)
    if params.phase:
        routed = records.join(remap.haplotype_files(output.select("name")), "name")
        for hap in ("H1", "H2", "untagged"):
            sinks.write_fasta(routed.where(F.col("file") == hap), f"{params.out}/{params.sample}{sinks.FILES[hap]}")
    else:
        sinks.write_fasta(records, f"{params.out}/{params.sample}{sinks.FILES['']}")
    rows.write.mode("overwrite").parquet(f"{params.out}/{params.sample}_svtigs.parquet")
