"""Helpers that the document operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.scratch import Scratch
from graphloom.plans.session import findable

__all__ = ["MAX_BROADCAST", "Scratch", "arrow_map", "held_out", "hash_bound", "hash_bounds", "match", "read_table", "readable", "small", "unused", "utf8"]

#: Arrow batches that Python workers hold at a time: rows and bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, so that a batch of very long texts fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Tables of up to this many keys are broadcast (a few MB); larger ones are joined by a shuffle, keys of HOT rows apart, in
#: SALTS parts of each key.
MAX_BROADCAST, SALTS, HOT = 1 << 18, 16, 4096

#: What a Python worker keeps from task to task, by owner; a task of another owner drops it.
KEPT: dict[str, object] = {}


def release() -> None:
    """Gives memory that a task has freed back to the system, as workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema, owner: str = "") -> DataFrame:
    """mapInArrow with bounded batches. Tasks start without what workers keep for other owners and return memory at their end."""
    bounded_batches(df.sparkSession)
    findable(df.sparkSession)

    def run(batches):
        from graphloom.llm.common import KEPT, release

        for key in [k for k in KEPT if k != owner]:
            del KEPT[key]
            release()
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of a string column as UTF-8, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def readable(column: pa.Array) -> list[str | None]:
    """The texts of a string column; bytes that are no UTF-8 count as U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in utf8(column)]


def held_out(doc_id) -> F.Column:
    """Rows that no operator learns labels from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of the table has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST else table


def match(rows: DataFrame, table: DataFrame, keys: list[str], salt: str, how: str = "inner", size: str = "") -> DataFrame:
    """Joins rows, of which a few keys may hold most, with a table of one row per key.

    A table of few keys is broadcast. Else, if a column tells the size of keys, those of HOT rows are taken apart first;
    what is still too large is repeated SALTS times, so that the rows of a key are dealt to as many tasks.
    """
    if table.count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(table), keys, how)
    if size and (hot := table.filter(F.col(size) >= HOT)).count() <= MAX_BROADCAST:
        marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
        cold = marked.filter("_hot IS NULL").drop("_hot").join(table.filter(F.col(size) < HOT), keys, how)
        return cold.unionByName(marked.filter("_hot").drop("_hot").join(F.broadcast(hot), keys, how))
    parts = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(parts, [*keys, "salt"], how).drop("salt")


def hash_bounds(rows: DataFrame, column: str, limit: int, by: str | None = None) -> dict:
    """For each value of `by` (None: one for all) a bound that at most `limit` distinct hashes do not pass, and half as many
    at least where there are so many.

    Counts come from 4096 ranges of hashes; a range that goes over the limit is counted again in ranges 4096 times narrower,
    so the bound is as close at any number of rows. Repeated hashes count once.
    """
    keyed = rows.select((F.col(by) if by else F.lit("")).alias("k"), F.col(column).alias("h")).distinct()
    bounds, left, todo, last = {}, {}, None, 64
    for shift in (52, 40, 28, 16, 4, 0):
        part = keyed
        if todo is not None:
            narrow = rows.sparkSession.createDataFrame(todo, keyed.select("k").schema.add("bin", "long"))
            part = keyed.withColumn("bin", F.shiftright("h", last)).join(F.broadcast(narrow), ["k", "bin"]).drop("bin")
        counts = part.groupBy("k", F.shiftright("h", shift).alias("bin")).agg(F.count("*").alias("n")).toArrow().sort_by([("k", "ascending"), ("bin", "ascending")])
        over = {}
        for k, bin_, n in zip(*(counts[c].to_pylist() for c in ("k", "bin", "n")), strict=True):
            if k in over:
                continue
            if n > left.setdefault(k, limit):
                over[k] = bin_
            else:
                left[k] -= n
                bounds[k] = ((bin_ + 1) << shift) - 1
        todo, last = [(k, b) for k, b in over.items() if left[k] > limit // 2], shift
        if not todo:
            break
    return bounds


def hash_bound(rows: DataFrame, column: str, limit: int) -> int:
    """The bound of hash_bounds for all rows together."""
    return hash_bounds(rows, column, limit).get("", (1 << 63) - 1)
