"""The corpus pipeline: STAGES, run() and ORACLE_SQL.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last give the columns of documents; the last gives doc_id, n_tokens, ids (packed
little-endian unsigned 32-bit integers) and whether decoding them gives the text back.

In every stage null texts count as empty, texts of any length are taken whole, an empty table gives an empty one, and columns
pass untouched, whatever they are called; what a stage does with ties, repeated rows and null ids stands with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociloom.llm import gam, order_minhash, prefix_table, stream_dedup, templates
from lociloom.llm.common import filled, shared_dir, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the classifier, fitted on all labels, does not predict to be good. Each row is judged on its own, repeated and null ids alike; an empty text gets a score as others do."""
    return gam.accepted(docs, gam.fit(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (but for the length of white space) the one with the smallest id stays, null ids coming last; of one id, the first row. All empty texts are equal."""
    return stream_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays, as above. Texts without words are copies of each other alone."""
    return order_minhash.drop_near(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects all rows of the ids that a benchmark item contaminates; rows with a null id stay, as no match can be told to be theirs."""
    return templates.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's text as token ids, with begin and end (an empty text has these alone). A row for each row, in no order."""
    rows = docs.select("doc_id", filled().alias("text"))
    out = prefix_table.encode(rows, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("same_text"))


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmarks", benchmarks),
    ("encoding", encoding),
]

#: SQL can express neither the classifier nor the encoding; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of sf_dir."""
    docs, base = table(spark, sf_dir, "documents"), shared_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
