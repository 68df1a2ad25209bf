"""From alleles remapped to the graph to those put out: realignment, decision, duplicates, headers.

Nulls: a line without a length or with one of zero has map ratio 0; a null quality or mark of being primary makes a line not good; alleles or paths without a sequence have no variant in their realignment. Lines of
one number are ordered by their other fields. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import haplotype_of, parent_name, path_steps, reverse_complement, svtig_header
from ..params import MIN_MAPQ_REMAP
from ..session import ship
from ..storage import by_shuffle, scratch, written
from .gap_affine import run_of_sv
from .overlaps import GROUP, staying


def path_index(paths: DataFrame, sequences: DataFrame) -> DataFrame:
    """path, i, strand, node, first and after of each step of the distinct paths on a known node: the bases of the path before the step and up to its end."""
    step = paths.select("path").distinct().select("path", F.explode(path_steps(F.col("path"))).alias("s")).select("path", "s.*")
    met = step.join(by_shuffle(sequences.select(F.col("name").alias("node"), F.length("sequence").cast("long").alias("bases"))), "node")
    after = F.sum("bases").over(Window.partitionBy("path").orderBy("i"))  # no more steps than the path's text has
    return met.select("path", "i", "strand", "node", (after - F.col("bases")).alias("first"), after.alias("after"))


def path_sequences(rows: DataFrame, nodes: DataFrame, sequences: DataFrame) -> DataFrame:
    """rows (path, path_start, path_end) with path_sequence: the known nodes' sequences, reversed ones complemented, cut to the
    places from path_start to path_end, both included; empty if they lie beyond the end, or if a place is null or below zero.

    An index of the paths' steps tells which of them a slice meets: these alone fetch their node's sequence, and what is cut from it is all that goes on. Each distinct slice is put
    together once, and no row is longer than a node or a slice.
    """
    spark = rows.sparkSession
    slices = rows.select("path", F.col("path_start").alias("_start"), F.col("path_end").alias("_end")).where("path IS NOT NULL AND _start >= 0 AND _end >= _start").distinct()
    index = written(path_index(slices, sequences), scratch(spark, "path-index"))
    met = slices.join(index, "path").where("first <= _end AND after > _start")
    cut = met.select("path", "_start", "_end", "i", "strand", "node", (F.col("after") - F.col("first")).alias("bases"), F.greatest(F.lit(0), F.col("_start") - F.col("first")).alias("skip"), F.least(F.col("after"), F.col("_end") + 1).alias("to"), "first")
    size = F.col("to") - F.col("first") - F.col("skip")
    at = F.when(F.col("strand") == "<", F.col("bases") - F.col("skip") - size).otherwise(F.col("skip"))
    piece = F.substring(F.col("sequence"), (at + 1).cast("int"), size.cast("int"))
    part = cut.join(by_shuffle(sequences.select(F.col("name").alias("node"), "sequence")), "node").select("path", "_start", "_end", "i", F.when(F.col("strand") == "<", reverse_complement(piece)).otherwise(piece).alias("part"))
    whole = part.groupBy("path", "_start", "_end").agg(F.sort_array(F.collect_list(F.struct("i", "part"))).alias("parts"))  # a slice's pieces
    whole = whole.select(F.col("path").alias("_path"), "_start", "_end", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("path_sequence"))
    out = rows.join(whole, (F.col("path") == F.col("_path")) & (F.col("path_start") == F.col("_start")) & (F.col("path_end") == F.col("_end")), "left").drop("_path", "_start", "_end")
    return out.withColumn("path_sequence", F.coalesce("path_sequence", F.lit("")))


def with_has_sv(rows: DataFrame) -> DataFrame:
    """rows (query_sequence, query_start, query_end, path_sequence) with has_sv: an end-to-end gap-affine alignment of the query's
    part (both ends included) has a run of 50 insertions, deletions or mismatches. False if either side is empty."""
    ship(rows.sparkSession)
    query = F.substring(F.coalesce("query_sequence", F.lit("")), F.col("query_start") + 1, F.greatest(F.lit(0), F.col("query_end") - F.col("query_start") + 1))
    lean = rows.withColumns({"_q": query, "has_sv": F.lit(False)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, p = b.column(b.schema.get_field_index("_q")).to_pylist(), b.column(b.schema.get_field_index("path_sequence")).to_pylist()
            hit = pa.array([bool(x and y) and run_of_sv(x, y) for x, y in zip(q, p)], pa.bool_())
            yield b.set_column(b.schema.get_field_index("has_sv"), "has_sv", hit)

    return lean.mapInArrow(run, lean.schema).drop("_q")


_FOLD = """aggregate(rows, named_struct('ratio', cast(NULL AS double), 'path', cast(NULL AS string), 'start', 0, 'end', 0, 'sv', false, 'size', 0, 'freq', 0L),
 (a, r) -> CASE
   WHEN a.ratio IS NULL THEN named_struct('ratio', r.ratio, 'path', r.path, 'start', r.path_start, 'end', r.path_end, 'sv', r.has_sv, 'size', r.query_length, 'freq', IF(r.good, 1L, 0L))
   WHEN NOT r.good AND NOT a.sv AND r.has_sv THEN named_struct('ratio', greatest(a.ratio, r.ratio), 'path', r.path, 'start', r.path_start, 'end', r.path_end, 'sv', true, 'size', a.size, 'freq', a.freq)
   WHEN NOT r.good THEN a
   WHEN a.end - a.start < r.path_end - r.path_start THEN named_struct('ratio', greatest(a.ratio, r.ratio), 'path', r.path, 'start', r.path_start, 'end', r.path_end, 'sv', a.sv, 'size', a.size, 'freq', a.freq + 1)
   ELSE named_struct('ratio', greatest(a.ratio, r.ratio), 'path', a.path, 'start', a.start, 'end', a.end, 'sv', a.sv, 'size', a.size, 'freq', a.freq + 1) END)"""


def fold(remap: DataFrame) -> DataFrame:
    """One row for each allele from its lines in order: name, ratio, path, start, end, sv, size, freq (good lines)."""
    ratio = F.coalesce(F.try_divide(F.col("query_end") - F.col("query_start"), F.col("query_length")), F.lit(0.0))
    good = ((F.col("mapq") >= MIN_MAPQ_REMAP) & F.col("is_primary")).alias("good")
    row = F.struct("line_no", ratio.alias("ratio"), "path", "path_start", "path_end", "has_sv", "query_length", good)
    got = remap.groupBy("query_name").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return got.select(F.col("query_name").alias("name"), F.expr(_FOLD).alias("f")).select("name", "f.*")


def counters(remap: DataFrame, output: DataFrame) -> DataFrame:
    """One row: primary, secondary and low-quality lines (one line may be both of the latter), and the fragments put out (extra)."""
    low = F.col("mapq") < MIN_MAPQ_REMAP
    names = ("good", "secondary", "low_mapq", "extra")
    only = lambda **counts: [counts.get(n, F.lit(0).cast("long")).alias(n) for n in names]
    lines = remap.agg(*only(good=F.count_if(F.col("is_primary") & ~low), secondary=F.count_if(~F.col("is_primary")), low_mapq=F.count_if(low)))
    more = output.agg(*only(extra=F.count_if(parent_name(F.col("name")).isNotNull())))
    return lines.unionByName(more).agg(*[F.sum(n).alias(n) for n in names])


def decisions(folded: DataFrame, min_map_ratio: float) -> DataFrame:
    """folded with reason (why kept or dropped) and keep."""
    reason = F.when(F.col("ratio") <= 0, "no_mapping").when(F.col("freq") > 1, "several_mappings").when(F.col("ratio") < min_map_ratio, "low_map_ratio").when(F.col("sv"), "sv_in_alignment").otherwise("high_map_ratio")
    out = folded.withColumn("reason", reason)
    return out.withColumn("keep", ~F.col("reason").isin("no_mapping", "high_map_ratio"))


def without_duplicates(kept: DataFrame, group: int = GROUP) -> DataFrame:
    """kept (name, path, start, end, size, ...) with hap and duplicate. Of one haplotype and path, from the largest on (then by name), one is a
    duplicate if it overlaps one that is kept by more than MIN_DUP_OVERLAP.

    Of equal intervals only the first can stay, so that the others take no part in the search. Intervals that are null or have no length are no duplicates; a null path is a path. Rows
    of one name, path and interval share their fate. A haplotype and path may have any number of alleles (overlaps.py).
    """
    rows = kept.withColumn("hap", haplotype_of(F.col("name")))
    place = F.struct((-F.col("size").cast("long")).alias("first"), F.col("name"))
    key = ["hap", "_path"]
    some = rows.where("end > start").select("hap", F.struct("path").alias("_path"), "start", "end", place.alias("place"))  # a struct is never null
    first = some.groupBy(*key, "start", "end").agg(F.min("place").alias("place"))
    stay = staying(first, key, group).select(F.col("place.name").alias("_name"), F.col("_path.path").alias("_on"), F.col("start").alias("_start"), F.col("end").alias("_end")).withColumn("_stays", F.lit(True))
    met = rows.join(stay, F.col("name").eqNullSafe(F.col("_name")) & F.col("path").eqNullSafe(F.col("_on")) & (F.col("start") == F.col("_start")) & (F.col("end") == F.col("_end")), "left")
    long = F.coalesce(F.col("end") > F.col("start"), F.lit(False))
    return met.withColumn("duplicate", long & F.col("_stays").isNull()).drop("_name", "_on", "_start", "_end", "_stays")


def flagged(unique: DataFrame, svtigs: DataFrame) -> DataFrame:
    """The alleles to put out: name, pos, contig, support, path, ratio. A fragment (name with a second underscore) takes its parent's place,
    contig and support; names that are not registered are left out."""
    rows = unique.where("NOT duplicate").select("name", "path", "ratio", F.coalesce(parent_name(F.col("name")), F.col("name")).alias("parent"))
    return rows.join(svtigs.select(F.col("name").alias("parent"), "pos", "contig", "support"), "parent").select("name", "pos", "contig", "support", "path", "ratio")


def headers(output: DataFrame) -> DataFrame:
    """name and FASTA header."""
    return output.select("name", svtig_header(F.col("name"), F.col("contig"), F.col("pos"), F.col("support"), F.col("path"), F.col("ratio")).alias("header"))


def haplotype_files(names: DataFrame) -> DataFrame:
    """name and file (H1, H2, untagged): by the text H1 or H2 anywhere in the name; one name may go to both."""
    h1, h2 = F.col("name").contains("H1"), F.col("name").contains("H2")
    where = F.array_compact(F.array(F.when(h1, "H1"), F.when(h2, "H2"), F.when(~h1 & ~h2, "untagged")))
    return names.select("name", F.explode(where).alias("file"))
