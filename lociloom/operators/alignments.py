"""Filters, path resolution and coverage of alignments.

Nulls: an alignment with a null mapping quality or mark of being primary is not valid, one with a null place on the read counts as neither mapped nor unmapped, one with a null path adds nothing to any contig; a
null score counts as none in scored tables alone. Repeated lines count each. Empty tables give empty results, and contigs without alignments coverage 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_steps
from ..params import MIN_MAPQ, MIN_SV_SIZE

#: Node tables of so many rows at most are broadcast (under 100 bytes a row without sequences); larger ones are joined by shuffling.
BROADCAST_NODES = 1_000_000


def is_valid() -> Column:
    """Primary, of enough mapping quality, and not of a positive alignment score below MIN_SV_SIZE (NaN passes)."""
    s = F.col("aln_score")
    low = (s > 0) & (s < MIN_SV_SIZE) & ~F.isnan(s)
    return (F.col("mapq") >= MIN_MAPQ) & F.col("is_primary") & ~low


def is_unmapped() -> Column:
    return (F.col("query_start") == 0) & (F.col("query_end") == 0)


def scored(alignments: DataFrame) -> DataFrame:
    """With aln_score, 0 where the source has none."""
    return alignments if "aln_score" in alignments.columns else alignments.withColumn("aln_score", F.lit(0.0).cast("float"))


def valid(alignments: DataFrame) -> DataFrame:
    """The valid alignments, unmapped ones among them."""
    return scored(alignments).where(is_valid())


def mapped(alignments: DataFrame) -> DataFrame:
    return valid(alignments).where(~is_unmapped())


def unmapped_reads(alignments: DataFrame) -> DataFrame:
    """Names of the reads with an unmapped line, valid or not."""
    return alignments.where(is_unmapped()).select("query_name").distinct()


def multi_mapped(alignments: DataFrame) -> DataFrame:
    """query_name and n of the reads with several valid lines."""
    return valid(alignments).groupBy("query_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def node_table(nodes: DataFrame) -> DataFrame:
    """Without sequences, and marked for broadcasting if it is small."""
    lean = nodes.select("name", "len", "offset", "contig")
    return F.broadcast(lean) if lean.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else lean


#: The known steps of a path, with the sums of the lengths of those before (before) and up to its end (upto; at the last step of all that before it).
_KNOWN = """aggregate(filter(steps, s -> s.present), named_struct('at', 0L, 'out', cast(array() AS array<struct<i:int,strand:string,node:string,len:bigint,offset:bigint,contig:string,before:bigint,upto:bigint>>)),
 (a, s) -> named_struct('at', a.at + s.len, 'out', concat(a.out, array(named_struct('i', s.i, 'strand', s.strand, 'node', s.node, 'len', s.len, 'offset', s.offset, 'contig', s.contig,
   'before', a.at, 'upto', IF(s.i < size(steps), a.at + s.len, a.at))))),
 a -> a.out)"""


def resolved(alignments: DataFrame, nodes: DataFrame, paths_of: DataFrame | None = None) -> DataFrame:
    """alignments with steps: array of struct(i, strand, node, len, offset, contig, present), n of them, and known, those of known nodes (_KNOWN). Each distinct path is looked up once. paths_of: a table that has their paths and is cheaper to work out."""
    paths = with_steps((alignments if paths_of is None else paths_of).select("path").distinct(), nodes)
    return alignments.join(paths, "path")


def with_steps(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """A table of distinct paths with steps, n and known, as in resolved. Its other columns go along with a path's first step, so that no path is joined to itself; paths without steps are left out."""
    own = F.struct(*[c for c in paths.columns if c != "path"]) if len(paths.columns) > 1 else F.lit(None)
    step = paths.select("path", own.alias("own"), F.explode(path_steps(F.col("path"))).alias("s")).select("path", F.when(F.col("s.i") == 1, F.col("own")).alias("own"), "s.*")
    table = node_table(nodes).withColumn("present", F.lit(True))
    met = step.join(table, step["node"] == table["name"], "left").select("path", "own", F.struct("i", "strand", "node", F.col("len").cast("long").alias("len"), F.col("offset").cast("long").alias("offset"), "contig", F.coalesce("present", F.lit(False)).alias("present")).alias("s"))
    rows = met.groupBy("path").agg(F.sort_array(F.collect_list("s")).alias("steps"), F.any_value("own", True).alias("own"))
    return rows.select("path", *(["own.*"] if len(paths.columns) > 1 else []), "steps", F.size("steps").alias("n"), F.expr(_KNOWN).alias("known"))


def path_sums(alignments: DataFrame) -> DataFrame:
    """A row for each path of the valid, mapped alignments: how many there are, and the sums of their ends (credits_of)."""
    start, span = F.col("path_start").cast("long"), F.col("path_end").cast("long") - F.col("path_start").cast("long")
    known = span.isNotNull()  # the last step's bases need both ends, the first one's only the start
    return mapped(alignments).where("path IS NOT NULL").groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"), F.count(start).alias("starts"), F.sum(start).alias("start"),
        F.count(span).alias("spans"), F.sum(span).alias("span"), F.sum(F.when(known, start)).alias("span_start"),
    )


def credits(alignments: DataFrame, nodes: DataFrame) -> DataFrame:
    """What the valid, mapped alignments of a path add at each of its steps: contig, bases, reads (where a run of one contig begins), first.

    All of it is linear in an alignment's start and end, so that alignments are summed up by path first and only the sums go on.
    """
    return credits_of(with_steps(path_sums(alignments), nodes))


def credits_of(paths: DataFrame) -> DataFrame:
    """The same from path_sums with_steps. What lies before a step is looked up in the sums of lengths that a path brings."""
    x, n, first = F.col("x"), F.col("n"), F.try_element_at("known", F.lit(1))
    own = F.when(n == 1, F.col("span")).when(x["i"] == 1, x["len"] * F.col("starts") - F.col("start")).otherwise(x["len"] * F.col("lines"))
    before = x["before"] * F.col("spans") - F.when(first["i"] == 1, F.col("span_start")).otherwise(F.lit(0))
    new = (F.col("k") == 0) | (F.get("known", F.col("k") - 1)["contig"] != x["contig"])
    return paths.select("*", F.posexplode("known").alias("k", "x")).select(
        x["contig"].alias("contig"),
        F.when((x["i"] == n) & (n > 1), F.col("span") - F.when(F.col("k") == 0, F.lit(0)).otherwise(before)).otherwise(own).alias("bases"),
        F.when(new, F.col("lines")).otherwise(F.lit(0)).alias("reads"),
        F.when(F.col("k") == 0, F.col("lines")).otherwise(F.lit(0)).alias("first"),
    )


def contig_length(nodes: DataFrame) -> DataFrame:
    """contig and contig_length, with a row for all contigs together ('overall')."""
    total = nodes.rollup("contig").agg(F.sum(F.col("len").cast("long")).alias("contig_length"), F.grouping("contig").alias("g"))
    return total.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("contig")).alias("contig"), "contig_length")


def contig_coverage(alignments: DataFrame, nodes: DataFrame) -> DataFrame:
    """contig, mapped_bases, mapped_reads, contig_length, coverage; 'overall' counts an alignment once."""
    return coverage_of(credits(alignments, nodes), nodes)


def coverage_of(credit: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same from what alignments add to contigs: contig, bases, reads, first."""
    sums = credit.rollup("contig").agg(F.sum("bases").alias("mapped_bases"), F.sum("reads").alias("r"), F.sum("first").alias("a"), F.grouping("contig").alias("g"))
    name = F.when(F.col("g") == 1, "overall").otherwise(F.col("contig"))
    sums = sums.select(name.alias("contig"), "mapped_bases", F.when(F.col("g") == 1, F.col("a")).otherwise(F.col("r")).alias("mapped_reads"))
    out = contig_length(nodes).join(sums, "contig", "left")
    bases, reads = F.coalesce("mapped_bases", F.lit(0)), F.coalesce("mapped_reads", F.lit(0))
    length = F.col("contig_length")
    return out.select("contig", bases.cast("long").alias("mapped_bases"), reads.cast("long").alias("mapped_reads"), "contig_length", F.when(length > 0, bases / F.when(length > 0, length)).otherwise(F.lit(0.0)).alias("coverage"))
