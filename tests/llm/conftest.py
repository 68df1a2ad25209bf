import zlib

import pytest

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="session")
def tables(spark, data):
    return {t: spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels", "benchmark", "conversations")}


def crc(x, m):
    return zlib.crc32(str(x).encode()) % m


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Rows of all the odd kinds: nulls in every column, empty and very long texts, ties, repeats, and columns that clash with outputs."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "some words that are said here and there by one and another", 0.5, "x", 1), (2, "", None, None, None), (3, None, 1.0, "y", 2), (None, "no id at all here, but a text", 1.0, "z", 3),
        (4, long, 0.1, "l", 4), (5, long, 0.1, "l", 4), (6, " \n\t ", 0.0, "", 0), (1, "some words that are said here and there by one and another", 0.5, "x", 1), (7, "é \U0001f600 中文 ▁ <s> </s> <|end|>", 0.0, "q", 9),
        (None, None, None, None, None),
    ]
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, score double, ids string, kept int").repartition(3).write.parquet(path)
    return spark.read.parquet(path)
