"""Vectors of a table, and the blocks in which two sets of them meet."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, dim) of the rows that can take part.

    Left out: rows without key, null or empty vectors, and vectors that hold null or non-finite
    components. Of rows that share a key the vector that is least in array order counts, so
    repeated rows count once. Other columns are ignored.
    """
    v = df[vector].cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(df[key].cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0).flatten() if isinstance(flat, pa.ChunkedArray) else flat.flatten()
    return np.asarray(flat, np.float64).reshape(-1, dim)


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks())


def every_part(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
