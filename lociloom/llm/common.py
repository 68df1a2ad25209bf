"""Helpers shared by the operators of this subpackage: the shared folder, row splits, Arrow batches, what workers keep."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship
from ..storage import drop, scratch, written

#: An Arrow batch has so many bytes at most (but one row at least): whole texts travel in it, and what is made of them takes many times their size.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share (a temporary one where that is unset, as in tests)."""
    return scratch(spark, name)


#: Removes a folder made by shared_dir, in whatever store it is.
drop_dir = drop

#: Writes a DataFrame as Parquet below the shared folder and reads it back: the lineage ends there.
stored = written


def small_batches(spark: SparkSession) -> None:
    """Readies the session for Python workers: this package is there, and an Arrow batch has BATCH_BYTES at most.

    The setting stays, as results are computed later; it changes no result, the session's own or anybody's.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_held: dict[tuple, object] = {}


def held(key: tuple, build: Callable):
    """What build() gives, kept by the worker for later batches and tasks that ask for the same key; one thing at a time is kept."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def give_back() -> None:
    """Returns the memory that a worker has freed to the machine."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def remainder(doc_id: str | Column, m: int) -> Column:
    """crc32 of doc_id as text, modulo m; null for a null doc_id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string")) % m


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(c: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def with_columns(df: DataFrame, added: str, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list | np.ndarray | pa.Array]]], keep: list[str] | None = None, holds: tuple | None = None) -> DataFrame:
    """df (or its columns keep) with the columns of the DDL string added, computed by Arrow batch.

    make() is called once a task and gives the function of a batch; holds names what it takes from held(), if anything. Columns of
    df that have a new column's name, in whatever case, give way to it.
    """
    small_batches(df.sparkSession)
    new = T.StructType.fromDDL(added)
    names = {n.lower() for n in new.names}
    stay = [f for f in df.schema if f.name.lower() not in names and (keep is None or f.name in keep)]
    schema = T.StructType(stay + list(new.fields))
    target = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if holds not in _held:
            _held.clear()
        f = make()
        for b in batches:
            out = f(b)
            cols = [b.column(b.schema.get_field_index(x.name)) for x in stay]
            cols += [out[x.name] if isinstance(out[x.name], pa.Array) else pa.array(out[x.name], type=x.type) for x in target]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        del f
        give_back()

    return df.mapInArrow(run, schema)


def texts(b: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [x or "" for x in b.column(b.schema.get_field_index(name)).to_pylist()]


class Memory(dict):
    """Results of a function by argument, `bound` of them at most: when the younger half is full it takes the older one's place, so
    that what is asked for again and again stays."""

    def __init__(self, function: Callable, bound: int):
        self.function, self.half, self.old = function, max(1, bound // 2), {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.function(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


#: Size of the bitmap that in_bitmap passes to all tasks: so many pages of 32,768 bits (16 MB), whatever the input.
PAGES = 4096


def in_bitmap(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """The rows whose key may be among the wanted keys: all that are, and some by chance of the hash.

    What is passed to all tasks is a bitmap of a fixed size; with very many wanted keys it only lets more rows pass.
    """
    page = lambda c: F.pmod(F.xxhash64(c), F.lit(PAGES)).cast("int")
    bit = lambda c: F.pmod(F.xxhash64(c, F.lit("bit")), F.lit(32768)).cast("int")
    pages = wanted.groupBy(page(wanted_key).alias("_page")).agg(F.bitmap_construct_agg(bit(wanted_key).cast("long")).alias("_bits"))
    near = rows.withColumns({"_page": page(key), "_at": bit(key)}).join(F.broadcast(pages), "_page")  # PAGES rows of 4 KB at most
    byte = F.conv(F.hex(F.expr("substring(_bits, _at div 8 + 1, 1)")), 16, 10).cast("int")
    return near.where(byte.bitwiseAND(F.expr("shiftleft(1, _at % 8)")) != 0).drop("_page", "_at", "_bits")
