"""Clusters of loci: within nodes, across the edges between nodes, and those with enough reads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..storage import drop, scratch, written
from .kernel import FEW, stays

_CLUSTER = "node string, k int, start bigint, ref bigint, contig string, reads array<string>, last boolean"


def within_nodes(loci: DataFrame, nodes: DataFrame, dist: int, last: bool = False) -> DataFrame:
    """Clusters (node, k from 1, start, ref, contig, reads; last: and whether it is its node's last one), by each node's loci in order of place.

    A locus joins if it lies no further than dist from the last one, or if all its reads are in the cluster already; else it
    begins a new cluster. One shuffle, by node, in which the loci are sorted by place.
    Loci of unknown nodes are left out, as are those without a place; no reads count as an empty set. A node's name ends before its first colon.
    """
    base = F.col("base") if "base" in loci.columns else F.substring_index("node", ":", 1)
    return _folded(loci.select(base.alias("base"), "node", "pos", "ref", "contig", F.explode_outer("reads").alias("read")), nodes, dist, last)


def of_signals(found: DataFrame, nodes: DataFrame, dist: int, last: bool = False) -> DataFrame:
    """The clusters of the loci that signals make, without putting these loci together."""
    return _folded(found.select(F.substring_index("node", ":", 1).alias("base"), "node", "pos", "ref", "contig", "read"), nodes, dist, last)


def _folded(rows: DataFrame, nodes: DataFrame, dist: int, last: bool) -> DataFrame:
    """Clusters from a row for each read at a locus. These are dealt out and sorted by node and place once, each node's own row before them, and a task goes over them in that order; it holds one cluster's reads."""
    ship(rows.sparkSession)
    rest = F.substring(F.col("node"), F.length("base") + 1, F.length("node"))
    rows = rows.where("base IS NOT NULL AND pos IS NOT NULL").select(F.col("base").alias("node"), F.col("pos").cast("long").alias("pos"), rest.alias("rest"), F.col("ref").cast("long").alias("ref"), "contig", "read")
    null = lambda kind: F.lit(None).cast(kind)
    known = nodes.where("name IS NOT NULL").select(F.col("name").alias("node"), null("long").alias("pos"), null("string").alias("rest"), null("long").alias("ref"), null("string").alias("contig"), null("string").alias("read"))
    dealt = rows.unionByName(known).repartition("node").sortWithinPartitions("node", "pos", "rest")
    out = dealt.mapInArrow(lambda batches: fold(batches, dist), _CLUSTER)
    return out if last else out.drop("last")


def _values(column: pa.Array) -> list:
    """A column as Python objects, by numpy, as to_pylist takes ten times as long."""
    if not column.null_count or not pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    return [v if there else None for v, there in zip(column.fill_null(0).to_numpy().tolist(), column.is_valid().to_numpy(zero_copy_only=False).tolist())]


def fold(batches: Iterator[pa.RecordBatch], dist: int) -> Iterator[pa.RecordBatch]:
    """Clusters of rows node, pos, rest, ref, contig, read in the order of node, place and rest. A row without a place says that its node is known; nodes that have none are left out."""
    kinds = [("node", pa.string()), ("k", pa.int32()), ("start", pa.int64()), ("ref", pa.int64()), ("contig", pa.string()), ("reads", pa.list_(pa.string())), ("last", pa.bool_())]
    done: list[tuple] = []
    held, node, known, at, cluster, locus = 0, None, False, 0, None, None

    def close() -> None:
        """The locus goes into the cluster, or begins another."""
        nonlocal cluster, at
        pos, _, ref, contig, reads = locus
        if cluster is not None and (pos - at <= dist or reads <= cluster[5]):
            cluster[5].update(reads)
        else:
            if cluster is not None:
                put(False)
            cluster = [node, cluster[1] + 1 if cluster else 1, pos, ref, contig, reads]
        at = pos

    def put(last: bool) -> None:
        nonlocal held
        done.append((*cluster[:5], sorted(cluster[5]), last))
        held += len(cluster[5]) + 1

    def record() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*done), kinds)], names=[n for n, _ in kinds])

    for batch in batches:
        for name, pos, rest, ref, contig, read in zip(*map(_values, batch.columns)):
            if name != node:
                if locus is not None:
                    close()
                    put(True)
                node, known, cluster, locus = name, False, None, None
            if pos is None:
                known = True
            elif known:
                if locus is None or locus[0] != pos or locus[1] != rest:
                    if locus is not None:
                        close()
                    locus = [pos, rest, ref, contig, set()]
                else:
                    if ref is not None and (locus[2] is None or ref < locus[2]):
                        locus[2] = ref
                    if contig is not None and (locus[3] is None or contig < locus[3]):
                        locus[3] = contig
                if read is not None:
                    locus[4].add(read)
        if held > 50_000:
            yield record()
            done, held = [], 0
    if locus is not None:
        close()
        put(True)
    if done:
        yield record()


def candidates(clusters: DataFrame, edges: DataFrame, nodes: DataFrame, dist: int) -> DataFrame:
    """Edges (x -> y) over which y's first cluster lies nearer than dist to x's last one: y, x, ord, y_k, x_k (cluster numbers), distance."""
    ends = clusters.groupBy("node").agg(F.min(F.struct("k", "start")).alias("front"), F.max(F.struct("k", "start")).alias("back"))
    front = ends.select(F.col("node").alias("y"), F.col("front.k").alias("y_k"), F.col("front.start").alias("y_start")).where(F.col("y_start") < dist)
    back = ends.join(nodes.select(F.col("name").alias("node"), F.col("len").cast("long").alias("len")), "node").select(F.col("node").alias("x"), F.col("back.k").alias("x_k"), (F.col("len") - F.col("back.start")).alias("x_rest"))
    edge = edges.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("ord") if "ord" in edges.columns else F.lit(0).alias("ord"))
    met = edge.join(front, "y").join(back, "x").withColumn("distance", F.col("x_rest") + F.col("y_start"))
    return met.where(F.col("distance") < dist).select("y", "x", "ord", "y_k", "x_k", "distance")


def visits(near: DataFrame, few: int = FEW) -> DataFrame:
    """y, x, x_k: the first cluster of each active y takes in the cluster x_k of each of its candidates x.

    Nodes are visited in byte order of their names. One whose first cluster was merged away before is not active, and whether it was depends on nodes before it
    alone: on those y that have it, with a single cluster, as a candidate, and are active. A last cluster that is merged away gives again.
    """
    nodes = near.select("y").distinct()
    before = near.where("x_k = 1 AND y < x").select(F.col("x").alias("y"), F.col("y").alias("x")).join(nodes, "y", "semi")
    idle = stays(before, few).where("NOT stays").select(F.col("v").alias("y"))
    return near.select("y", "x", "x_k").distinct().join(idle, "y", "anti")


def passed_on(took: DataFrame) -> DataFrame:
    """a, b: node b takes in what a has taken in, as a's only cluster is taken in by b, after a was visited."""
    return took.where("x_k = 1 AND x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).join(took.select(F.col("y").alias("a")).distinct(), "a", "semi")


def taken(took: DataFrame, gone_too: bool) -> DataFrame:
    """y, x, x_k: all clusters that come to the first cluster of y, over any number of nodes; for y that are merged away themselves only if gone_too.

    The ways between nodes double in each round. A way that ends at a node which stays needs no more rounds, so that without the nodes that go a chain
    of a million nodes gives a million rows; with them the result itself grows with the square of a chain's length.
    """
    spark = took.sparkSession
    base, k = scratch(spark, "taken"), 0
    gone = took.where("x_k = 1").select(F.col("x").alias("b")).distinct()
    ways = written(passed_on(took), f"{base}/ways-0")
    while True:
        k += 1
        open_ = ways if gone_too else ways.join(gone, "b", "semi")
        on = open_.join(ways.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        ends = ways if gone_too else ways.join(gone, "b", "anti")
        last, ways = ways, written(ends.unionByName(on).distinct(), f"{base}/ways-{k}")
        if ways.count() == last.count() if gone_too else ways.join(gone, "b", "semi").isEmpty():
            break
        drop(spark, f"{base}/ways-{k - 1}")
    direct = took if gone_too else took.join(gone.withColumnRenamed("b", "y"), "y", "anti")
    far = took.join(ways, F.col("y") == F.col("a")).select(F.col("b").alias("y"), "x", "x_k")
    return direct.select("y", "x", "x_k").union(far).distinct()


def merge_neighbours(clusters: DataFrame, edges: DataFrame, nodes: DataFrame, dist: int, gone_too: bool = True, few: int = FEW) -> DataFrame:
    """Clusters with their final reads, and merged_away. Clusters that are merged away have what they took in before only if gone_too, else their own reads.

    Whether two clusters lie near enough never changes, so that the order of visits comes down to who is active (kernel.py) and what comes
    to whom: rounds of joins, of which none gathers a connected component. No reads count as an empty set; clusters of unknown nodes take no part. Where it is known which are their
    nodes' last ones (the column last, from within_nodes), those between a node's first and last one, which nothing can touch, go through no shuffle.
    """
    base = scratch(clusters.sparkSession, "neighbours")
    ends, between = (clusters.where("k = 1 OR last"), clusters.where("NOT (k = 1 OR last)")) if "last" in clusters.columns else (clusters, None)
    near = written(candidates(ends, edges, nodes, dist), f"{base}/near")
    took = written(visits(near, few), f"{base}/took")
    moves = taken(took, gone_too).select(F.col("y").alias("node"), F.lit(1).alias("k"), F.col("x").alias("from_node"), F.col("x_k").alias("from_k"))
    given = moves.join(ends.select(F.col("node").alias("from_node"), F.col("k").alias("from_k"), F.col("reads").alias("more")), ["from_node", "from_k"])
    given = given.groupBy("node", "k").agg(F.array_distinct(F.flatten(F.collect_list("more"))).alias("more"))
    gone = took.select(F.col("x").alias("node"), F.col("x_k").alias("k")).distinct().withColumn("merged_away", F.lit(True))
    out = ends.join(given, ["node", "k"], "left").join(gone, ["node", "k"], "left")
    empty = F.array().cast("array<string>")
    told = lambda df, more, away: df.select("node", "k", "start", "ref", "contig", F.sort_array(F.array_union(F.coalesce("reads", empty), more)).alias("reads"), away.alias("merged_away"))
    out = told(out, F.coalesce("more", empty), F.coalesce("merged_away", F.lit(False)))
    return out if between is None else out.unionByName(told(between, empty, F.lit(False)))


def final_clusters(merged: DataFrame, support: int) -> DataFrame:
    """Clusters that are not merged away and have more than support reads."""
    return merged.where(~F.col("merged_away") & (F.size("reads") > support)).drop("merged_away")
