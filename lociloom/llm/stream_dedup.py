"""Exact deduplication by a stateful stream.

Each row becomes a small record: the SHA-256 of its normalised text, the document's id and a content
locator (file and row). The records run through a Structured Streaming aggregation whose keyed state
lies in RocksDB on disk and never expires; for each digest it retains the smallest id with its
locator and the number of rows. The state is then read as a table. Whenever a digest has been hit more than once the full
bytes of those texts are compared: the rows of hit digests, found by a bitmap of fixed size, are grouped by digest and
full text, where equal texts combine before the shuffle. Digests under which different texts
meet are told apart by the texts themselves.

A call with a state folder goes on with what earlier calls left there: records, state, and which digests hold several texts.
A new row that hits a digest of an earlier call is compared with the text that the retained locator names, which is
read again from its file: the files of earlier calls must still be there. Rows that are no rows of Parquet files are
kept as files below the state folder. A call that is repeated after a failure with the same batch name counts its rows once.

Texts are equal if they are identical after every run of ASCII white space became one space (nothing
is trimmed). Null texts count as empty, and all empty texts are equal. Of equal rows the one with the smallest id
stays, null ids coming last; among repeated rows of one id, the first by locator stays. Each row
gives one result row. An empty table gives an empty result. Columns of other names are ignored, whatever they are called.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_dir, filled, in_bitmap, shared_dir, stored

_STATE = "spark.sql.streaming.stateStore"
#: Of the stream. RocksDB otherwise reserves megabytes for each store, however little it holds.
SETTINGS = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.allowFAllocate": "false",
    # all stores of an executor share this much native memory, which otherwise comes on top of its heap for each store; a store goes
    # from memory when its batch is written, as a change log
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}.rocksdb.maxMemoryUsageMB": "128",
    f"{_STATE}.rocksdb.writeBufferSizeMB": "8",
    f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STATE}.unloadOnCommit": "true",
}
#: In a folder of the machine's own, where the usual manager starts a program for each file it renames.
LOCAL = {"spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"}


def normal(text: str = "text") -> Column:
    return F.regexp_replace(filled(text), "[\\x20\\x09-\\x0D]+", " ")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def of_files(docs: DataFrame) -> bool:
    """True if docs are rows of Parquet files, each once at most: a scan with nothing but filters and projections on it."""
    node = docs._jdf.queryExecution().analyzed()
    while node.children().size():
        if node.nodeName() not in ("Project", "Filter", "SubqueryAlias"):
            return False
        node = node.children().head()
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        return False
    return True


def filed(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """docs as rows of Parquet files, so that file and row number locate them; written to the folder (a shared one) if need be."""
    return docs if of_files(docs) else stored(docs, folder or shared_dir(docs.sparkSession, "located"))


def located(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), path, _file (a hash of path) and _row, by which a row is found again. docs must be of files."""
    meta = docs.metadataColumn("_metadata")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled().alias("text"), meta["file_path"].alias("path"), F.xxhash64(meta["file_path"]).alias("_file"), meta["row_index"].alias("_row"))


def records(docs: DataFrame, digest=sha256) -> DataFrame:
    return located(docs).select("doc_id", digest(normal()).alias("digest"), "path", "_row")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _once(df: DataFrame, path: str) -> DataFrame:
    """df as written below path, by this call or by an earlier one that came to its end."""
    return df.sparkSession.read.schema(df.schema).parquet(path) if _exists(df.sparkSession, f"{path}/_SUCCESS") else stored(df, path)


def of_stream(spark: SparkSession, state: str) -> SparkSession:
    """A session with the stream's settings, which are nobody else's."""
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"):
        own.conf.set(k, spark.conf.get(k))
    for k, v in (SETTINGS | (LOCAL if "://" not in state or state.startswith("file:") else {})).items():
        own.conf.set(k, v)
    return own


def first_of(df: DataFrame) -> Column:
    """The smallest id (null last), then the first by locator."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "path", "_row"))


def run_stream(spark: SparkSession, folders: str, state: str, files_per_batch: int | None = None) -> None:
    """Feeds all new record files of the folders (a glob pattern) into the state and ends."""
    feed = of_stream(spark, state).readStream.schema("doc_id long, digest string, path string, _row long")
    feed = feed.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else feed
    rows = feed.parquet(folders)
    keyed = rows.groupBy("digest").agg(first_of(rows).alias("first"), F.count(F.lit(1)).alias("n"))
    keyed.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def read_state(spark: SparkSession, state: str, path: str) -> DataFrame:
    """digest, first (none, doc_id, path, _row) and n as the state retains them, written to path."""
    s = of_stream(spark, state).read.format("statestore").load(state)
    value = [f"value.`{f.name}`" for f in s.schema["value"].dataType]
    made = stored(s.select(F.col("key.digest").alias("digest"), F.col(value[0]).alias("first"), F.col(value[1]).alias("n")), path)
    return spark.read.schema(made.schema).parquet(path)


def texts_at(spots: DataFrame) -> DataFrame:
    """spots (path, _row, ...) with the normalised text that each names, read again from its file."""
    paths = [r["path"] for r in spots.select("path").distinct().collect()]  # names of files, which the driver lists for any scan
    if not paths:
        return spots.withColumn("text", F.lit(""))
    rows = located(spots.sparkSession.read.schema("doc_id long, text string").parquet(*paths)).select("path", "_row", normal().alias("text"))
    return rows.join(spots, ["path", "_row"])


def exact_dedup(docs: DataFrame, state: str | None = None, files_per_batch: int | None = None, digest=sha256, batch: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text), _file, _row.

    state: folder to go on with, as left by earlier calls (or to leave one in); by default a new one that goes. Ids and group
    sizes then take the earlier rows into account.
    batch: names these rows among all that the state folder gets, so that they count once if the call is repeated.
    digest: gives the key of a normalised text; another than SHA-256 serves to test its collisions.
    """
    spark = docs.sparkSession
    base, name = shared_dir(spark, "dedup"), batch or uuid.uuid4().hex
    where = state or base
    if of_files(docs):
        pass
    elif state:
        docs = _once(docs, f"{where}/texts/{name}")
    else:
        docs = filed(docs)
    rec = _once(records(docs, digest), f"{where}/records/{name}")
    run_stream(spark, f"{where}/records/*", f"{where}/state", files_per_batch)
    keyed = read_state(spark, f"{where}/state", f"{base}/index")
    if state is None:
        drop_dir(spark, f"{where}/state")
    # full bytes: of the rows here under digests that were hit, and of earlier texts that they hit
    rows = located(docs).select("doc_id", normal().alias("text"), "path", "_row").withColumn("digest", digest(F.col("text")))
    hit = keyed.where("n > 1").select("digest", "first")
    met = in_bitmap(rows, F.col("digest"), hit, F.col("digest")).groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))
    known = f"{where}/mixed"
    if state:
        spots = hit.join(rec.select("digest").distinct(), "digest", "semi").select("digest", "first.path", F.col("first._row").alias("_row"))
        spots = stored(spots.join(rec, ["path", "_row"], "anti"), f"{base}/earlier")
        met = met.select("digest", "text").union(texts_at(spots).select("digest", "text")).distinct()
    mixed = met.groupBy("digest").count().where("count > 1").select("digest")
    if state and _exists(spark, known):
        mixed = mixed.union(spark.read.schema("digest string").parquet(f"{known}/*")).distinct()
    mixed = stored(mixed, f"{known}/{uuid.uuid4().hex}")
    if state:
        mixed = mixed.join(rec.select("digest").distinct(), "digest", "semi")
    here = lambda c: ((F.col("path") == F.col("first.path")) & (F.col("_row") == F.col("first._row")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).alias(c)
    out = lambda d, sha: d.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), here("kept"), sha.alias("text_sha256"), F.xxhash64("path").alias("_file"), "_row")
    if digest is sha256:
        clear = rec.join(keyed, "digest")
    else:
        clear = rows.drop("digest").join(rec.select("path", "_row", "digest"), ["path", "_row"]).withColumn("sha", F.sha2("text", 256)).drop("text").join(keyed, "digest")
    sha = F.col("digest" if digest is sha256 else "sha")
    if mixed.isEmpty():
        return out(clear, sha)
    every = spark.read.schema(rec.schema).parquet(f"{where}/records/*").join(mixed, "digest", "semi")
    groups = texts_at(every)
    groups = stored(groups.groupBy("digest", "text").agg(first_of(groups).alias("first"), F.count(F.lit(1)).alias("n")), f"{base}/groups")
    told = rows.join(groups, ["digest", "text"])
    return out(clear.join(mixed, "digest", "anti"), sha).unionByName(out(told, F.sha2("text", 256)))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, of files, without the rows that gone (doc_id, _file, _row) names. No column of docs is touched, whatever its name."""
    free = free_names(docs, 6)
    meta = docs.metadataColumn("_metadata")
    gone = gone.select(*[F.col(c).alias(n) for c, n in zip(("_file", "_row", "doc_id"), free[3:])])
    here = docs.select("*", F.xxhash64(meta["file_path"]).alias(free[0]), meta["row_index"].alias(free[1]), F.col("doc_id").cast("long").alias(free[2]))
    same = (F.col(free[0]) == F.col(free[3])) & (F.col(free[1]) == F.col(free[4])) & F.col(free[2]).eqNullSafe(F.col(free[5]))
    return here.join(gone, same, "anti").drop(*free[:3])


def free_names(docs: DataFrame, n: int) -> list[str]:
    """n names that no column of docs has, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    return [c for c in (f"_at{k}" for k in range(len(taken) + n)) if c not in taken][:n]


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that repeat an earlier text."""
    docs = filed(docs)
    return without_rows(docs, exact_dedup(docs).where("not kept"))
