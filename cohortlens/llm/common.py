"""What the operators share: intermediate tables, word tables, ragged arrays, Arrow batches."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import shared_dir, tune

#: Bytes that Spark hands to a Python worker at a time, one row at least.
SENT = str(16 << 20)

_MADE: list[tuple[SparkSession, str]] = []


class Stage:
    """Intermediate tables of one run, below the session's shared folder.

    A written table outlives lost executors and has known sizes. ``drop`` removes a table that
    no later step reads; whatever is left goes when the process ends, since the returned
    DataFrame still reads it.
    """

    def __init__(self, spark: SparkSession, name: str):
        tune(spark)
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/cohortlens-llm/{name}-{uuid.uuid4().hex}"
        _MADE.append((spark, self.folder))

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, f"{self.folder}/{name}")

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of stages whose plans are gone."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    for spark, folder in _MADE:
        if spark.sparkContext._jsc is not None:
            _remove(spark, folder)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def remainder(column: Column, parts: int) -> Column:
    """crc32 of a key written as text, modulo ``parts``."""
    return F.crc32(column.cast("string").cast("binary")) % parts


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` over batches cut at about 4 MB, so that a worker's arrays stay small."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch):
                yield from fn(part)

    return df.mapInArrow(run, schema)


def cut(batch: pa.RecordBatch, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes, of one row at least."""
    if batch.num_rows == 0:
        return
    if batch.nbytes <= limit:
        yield batch
        return
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
        elif pa.types.is_list(column.type):
            sizes += 8 * np.asarray(pc.list_value_length(column).fill_null(0)).astype(np.int64)
    group = np.cumsum(sizes + 16) // limit
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def carried(df: DataFrame, carry: bool = True) -> list[Column]:
    """The row itself as one column, which takes part in no name clash."""
    return [F.struct(*(df[c] for c in df.columns)).alias("row")] if carry else []


def unpacked(df: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The carried rows as a table with the columns of ``like``, some of them changed."""
    return df.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in like.columns))


def schema_of(rows: DataFrame, result: str) -> str:
    """key, the result columns, and the carried row if there is one."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return f"key {kinds['key']}, {result}" + (f", row {kinds['row']}" if "row" in kinds else "")


def texts_of(column: pa.Array) -> list[str]:
    """Texts, null as empty."""
    return [t or "" for t in column.to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(offsets_of(lengths).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in ``data``."""
    offsets = offsets_of(lengths).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    )


class Numbered(dict):
    """Keys numbered in the order in which they are first seen."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number

    def codes(self, parts: Iterable[list]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, chain.from_iterable(parts)), np.int64)


def word_hashes(parts: list[list[bytes]]) -> np.ndarray:
    """64-bit hash of every word of the documents, one document after the other.

    A hash takes less time than a look for the word in a table of known ones.
    """
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(parts)), np.uint64, sum(map(len, parts)))


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Odd multipliers of the two window polynomials.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def windows(words: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of every run of ``width`` values, by doubling: log2(width) passes over the array."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = pow(base, 1, 1 << 64)
    block, size, done, out = words, 1, 0, None
    rest = width
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                part = block[done: done + n]
                out = part.copy() if out is None else out * np.uint64(pow(base, size, 1 << 64)) + part
                done += size
            rest >>= 1
            if rest:
                power = pow(base, size, 1 << 64)
                block = block[: len(block) - size] * np.uint64(power) + block[size:]
                size *= 2
        return mix(out)


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every run of ``width`` values, by doubling."""
    size, block = 1, values
    while size * 2 <= width:
        block = best(block[: len(block) - size], block[size:])
        size *= 2
    n = len(values) - width + 1
    return best(block[:n], block[width - size: width - size + n])
