"""Who stays, where each may be displaced by those before it: a rule that runs in order, decided in rounds of joins.

Each vertex y has references (y, x) to vertices x before it. In the order of the vertices, y stays unless one of its x has stayed. The rule is
sequential, but what it needs is little: y is decided as soon as one x stays (it goes) or all have gone (it stays). Where all hang on one another in a row,
as in a chain of vertices with one reference each, deciding from the front would take as many rounds as the chain is long. Such a vertex
stays if and only if its x does not, so that a reference to it says the opposite of a reference to its x, and is replaced by that; chains thus halve
with every round, whatever stands beside them. When few references are left, one task settles them.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship
from ..storage import drop, scratch, written

log = logging.getLogger("lociloom")

#: So many references at most are settled by one task (200 bytes each or so).
FEW = 100_000


def settle(refs: list[tuple]) -> dict:
    """Who stays of the y of references (y, x, says, sure): sure tells whether y goes by this one, null if that depends on x."""
    of: dict = {}
    for y, x, says, sure in refs:
        of.setdefault(y, []).append((x, says, sure))
    done: dict = {}
    for v in of:
        stack = [v]
        while stack:
            y = stack[-1]
            waits = [x for x, _, sure in of[y] if sure is None and x not in done] if y not in done else []
            if waits:
                stack += waits
                continue
            if y not in done:
                done[y] = not any(done[x] == says if sure is None else sure for x, says, sure in of[y])
            stack.pop()
    return done


def _settled(told: DataFrame) -> DataFrame:
    ship(told.sparkSession)
    schema = T.StructType([T.StructField("v", told.schema["y"].dataType), T.StructField("stays", T.BooleanType())])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = settle([r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip((done.keys(), done.values()), target.types)], schema=target)

    return told.coalesce(1).mapInArrow(run, schema)


def stays(refs: DataFrame, few: int = FEW) -> DataFrame:
    """v and stays (boolean) of every vertex of the references (y, x), which must have no circle; repeated ones count once.

    Each round is three joins by vertex over what is undecided, written below the shared folder; the rounds are logged. A vertex that many refer to
    (or with many references) is spread by Spark's own skew joins, and nothing gathers the references of one.
    """
    spark = refs.sparkSession
    base, k = scratch(spark, "kernel"), 0
    refs = refs.select("y", "x").where("y IS NOT NULL AND x IS NOT NULL").distinct()
    left = written(refs.withColumn("says", F.lit(True)), f"{base}/refs-0")  # y goes if (x stays) = says
    free = left.select(F.col("x").alias("v")).distinct().join(left.select(F.col("y").alias("v")).distinct(), "v", "anti")
    decided = [written(free.withColumn("stays", F.lit(True)), f"{base}/decided-0")]
    while not left.isEmpty():
        k += 1
        # what is known of the x
        told = left.join(decided[-1].withColumnRenamed("v", "x"), "x", "left").select("y", "x", "says", (F.col("stays") == F.col("says")).alias("sure"))
        told = written(told, f"{base}/told-{k}")
        if told.count() <= few:
            decided.append(written(_settled(told), f"{base}/decided-{k}"))
            break
        gone = told.where("sure").select("y").distinct()
        open_ = told.where("sure IS NULL").select("y", "x", "says")
        kept = told.select("y").distinct().join(open_.select("y").distinct(), "y", "anti").join(gone, "y", "anti")
        # an x that is referred to in both ways stays or goes, and displaces y either way
        sides = open_.join(gone, "y", "anti").groupBy("y", "x").agg(F.min("says").alias("low"), F.max("says").alias("says"))
        sides = written(sides, f"{base}/sides-{k}")
        both = sides.where("low != says").select("y").distinct()
        flag = lambda df, value: df.select(F.col("y").alias("v"), F.lit(value).alias("stays"))
        decided.append(written(flag(gone.union(both), False).unionByName(flag(kept, True)), f"{base}/decided-{k}"))
        open_ = sides.join(both, "y", "anti").select("y", "x", "says")
        # a vertex of one reference says the opposite of it
        single = open_.groupBy("y").agg(F.min("x").alias("_x"), F.min("says").alias("_says"), F.count(F.lit(1)).alias("n")).where("n = 1")
        single = single.select(F.col("y").alias("x"), "_x", "_says")
        opposite: Column = F.col("says") != F.col("_says")
        through = open_.join(single, "x", "left").select("y", F.coalesce("_x", "x").alias("x"), F.when(F.col("_x").isNull(), F.col("says")).otherwise(opposite).alias("says"))
        left = written(through.distinct(), f"{base}/refs-{k}")
        for name in (f"told-{k}", f"sides-{k}", f"refs-{k - 1}"):
            drop(spark, f"{base}/{name}")
    log.info("who stays: %d rounds", k)
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out
