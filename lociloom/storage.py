"""Tables that cut lineage, in the folder that all executors share; and what is built on them."""

from __future__ import annotations

import atexit
import logging
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .session import ship

#: A graph with so many edges at most is finished by one task, which holds its vertices in memory (200 bytes each or so).
ONE_TASK = 200_000
_made: list[str] = []
log = logging.getLogger("lociloom")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, one on this machine, if all of Spark runs here; else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lociloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    _made.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder, in whatever store it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Removes all folders that scratch has given out; what was read from them can't be read any more."""
    while _made:
        drop(spark, _made.pop())


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(sequences: DataFrame) -> DataFrame:
    """A table with sequences, or with a row for each, as a side of a join that no one broadcasts: Spark takes a text that is worked out for 20 bytes, and the driver would hold them all."""
    return sequences.hint("merge")


def _joined(edges: DataFrame) -> DataFrame:
    """v, label (some v of the component) of a graph that one task can hold."""
    ship(edges.sparkSession)
    kind = edges.schema["a"].dataType
    schema = T.StructType([T.StructField("v", kind), T.StructField("label", kind)])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                up.setdefault(a, a)
                up.setdefault(b, b)
                x, y = top(a), top(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
        every = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(every, target.types[0]), pa.array([top(v) for v in every], target.types[1])], schema=target)

    return edges.select("a", "b").coalesce(1).mapInArrow(run, schema)


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """v, label: the smallest v of each connected component of the edges (a, b), for all v that occur; edges with a null are left out.

    As long as there are more than one_task edges the graph is contracted: each vertex goes over into the one of the smallest hash
    among itself and its neighbours, by another hash in each round, which leaves three quarters of the vertices on average at most.
    What is left is joined in one task, and the rounds are undone from the last to the first. All but the result is removed.
    """
    spark = edges.sparkSession
    base = scratch(spark, "components")
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    every = edges.union(edges.select("b", "a")).distinct()  # both ways, and each vertex's own loops
    now = written(every, f"{base}/edges-0")
    alone = now.where("a = b").select(F.col("a").alias("v"), F.col("a").alias("label"))
    now = now.where("a != b")
    steps: list[DataFrame] = []
    while now.count() > 2 * one_task:
        k = len(steps) + 1
        by = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        chosen = now.groupBy("a").agg(F.min(by("b")).alias("m")).select(F.col("a").alias("v"), F.least("m", by("a"))["v"].alias("into"))
        steps.append(written(chosen, f"{base}/into-{k}"))
        of = lambda c: steps[-1].select(F.col("v").alias(c), F.col("into").alias(f"_{c}"))
        now = written(now.join(of("a"), "a").join(of("b"), "b").where("_a != _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), f"{base}/edges-{k}")
    label = written(_joined(now.where("a < b")), f"{base}/left")
    for k, into in reversed(list(enumerate(steps))):
        above = label.select(F.col("v").alias("into"), "label")
        label = written(into.join(above, "into", "left").select("v", F.coalesce("label", "into").alias("label")), f"{base}/label-{k}")
    label = label.union(alone.join(label, "v", "anti"))
    least = label.groupBy("label").agg(F.min("v").alias("least"))
    done = written(label.join(least, "label").select("v", F.col("least").alias("label")), f"{base}/done")
    for name in ["left", "edges-0", *(f"{x}-{k + i}" for k in range(len(steps)) for x, i in (("edges", 1), ("into", 1), ("label", 0)))]:
        drop(spark, f"{base}/{name}")
    log.debug("components: %d rounds", len(steps))
    return done
