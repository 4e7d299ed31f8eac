"""Operator 1: exact top-k search by distributed histogram selection.

Queries and candidates meet in blocks of bounded size. Every round scores all pairs and counts, for
each query, the scores in 256 bins of the interval that holds its kth value; the bin in which the
kth value lies is the next interval. When a bin is one score wide, a last pass keeps the scores
from that value on, and ties go to the smaller id.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import Stage, read
from cohortlens.llm.vectors import every_part, matrix, numbers, part, usable

CANDIDATES = 1024  # rows of a block, on average
QUERIES = 2048
BITS = 8  # of the bins of a round
KEY = ["dim", "cb", "qb"]


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(values * scale)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; exact, and held to the range of 64 bits."""
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in q], [[int(x) for x in row] for row in c]
    exact = np.array(whole[0], object) @ np.array(whole[1], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _pairs(key: tuple, left: pa.Table, right: pa.Table, scale: int):
    dim = key[0].as_py()
    ids, query_ids = numbers(left["vec_id"]), numbers(right["vec_id"])
    found = scores(scaled(matrix(right["v"], dim), scale), scaled(matrix(left["v"], dim), scale))
    return ids, query_ids, found, query_ids[:, None] == ids[None, :]


def _counts(key: tuple, left: pa.Table, right: pa.Table, scale: int, bits: int) -> pa.Table:
    """Scores in each bin, from the top down to the bin with which this block alone has enough."""
    shape = {"query_id": pa.int64(), "bin": pa.int32(), "n": pa.int64()}
    if not left.num_rows or not right.num_rows:
        return pa.schema(list(shape.items())).empty_table()
    _, query_ids, found, own = _pairs(key, left, right, scale)
    low, need = numbers(right["low"]), numbers(right["need"])
    shift = max(0, bits - BITS)
    # low may be near the end of the range: compare shifted scores, whose difference fits
    bins = (found >> shift) - (low >> shift)[:, None]
    inside = (bins >= 0) & (bins < 1 << min(bits, BITS)) & ~own
    rows, _ = np.nonzero(inside)
    width = 1 << BITS
    table = np.bincount(rows * width + bins[inside], minlength=len(query_ids) * width).reshape(-1, width)
    above = np.cumsum(table[:, ::-1], 1)[:, ::-1] - table
    row, at = np.nonzero((table > 0) & (above < need[:, None]))
    return pa.table([pa.array(query_ids[row]), pa.array(at.astype(np.int32)), pa.array(table[row, at])], list(shape))


def _best(key: tuple, left: pa.Table, right: pa.Table, scale: int, k: int) -> pa.Table:
    shape = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
    if not left.num_rows or not right.num_rows:
        return pa.schema(list(shape.items())).empty_table()
    ids, query_ids, found, own = _pairs(key, left, right, scale)
    rows, at = np.nonzero((found >= numbers(right["low"])[:, None]) & ~own)
    order = np.lexsort((ids[at], ~found[rows, at], rows))  # ~x falls as x rises, without overflow
    rows, at = rows[order], at[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    rows, at = rows[place < k], at[place < k]
    return pa.table([pa.array(query_ids[rows]), pa.array(ids[at]), pa.array(found[rows, at])], list(shape))


def search(
    vectors: DataFrame, is_query: Column, k: int, scale: int = 64, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The ``k`` candidates of largest score of every query: query_id, rank, vec_id, score.

    Queries are the rows for which ``is_query`` (over ``vec_id``) holds, candidates all rows but
    the query's own. Components become floor(scale * x); the score is the inner product of these
    integers. Equal scores rank by vec_id. A query with fewer candidates gets them all; one without
    any has no row. Vectors meet only vectors of their own length. What takes no part, and what
    repeated rows and null keys count for, is said at ``usable``. An empty table gives no rows.

    A hot vector makes many ties; each block hands on at most k of them, the smallest ids.
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "topk")
    rows = stage.store(usable(vectors, key, vector), "rows")
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(F.floor(x * scale).cast("double")))
    most = F.array_max(F.transform("v", lambda x: F.abs(F.floor(x * scale).cast("double"))))
    n, asked, norm, peak = rows.agg(
        F.count("*"), F.count(F.when(is_query, 1)), F.max(F.when(is_query, size)), F.max(most)
    ).first()
    blocks, groups = max(1, -(-n // CANDIDATES)), max(1, -(-asked // QUERIES))
    bits = min(63, int((norm or 0) * (peak or 0)).bit_length())
    # scores lie within +-2^bits: bits + 1 bits above the lowest
    low = -(1 << bits)
    bits += 1
    left = rows.select("dim", part(F.col("vec_id"), blocks).alias("cb"), "vec_id", "v").withColumn("qb", every_part(groups))

    def meet(state: DataFrame, fn, schema: str) -> DataFrame:
        right = state.select("dim", "qb", "vec_id", "v", "low", "need").withColumn("cb", every_part(blocks))
        return left.groupBy(*KEY).cogroup(right.groupBy(*KEY)).applyInArrow(fn, schema)

    state = rows.where(is_query).select(
        "dim", part(F.col("vec_id"), groups).alias("qb"), "vec_id", "v", F.lit(low).cast("long").alias("low"),
        F.lit(k).cast("long").alias("need"),
    )
    turn = 0
    while bits > 0:
        counted = meet(state, partial(_counts, scale=scale, bits=bits), "query_id long, bin int, n long")
        counted = counted.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        # at most 256 bins of a query
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        above = counted.withColumn("above", F.sum("n").over(down) - F.col("n"))
        # the bin of the kth value is the lowest one that has fewer than ``need`` scores above it
        found = above.join(state.select(F.col("vec_id").alias("query_id"), "need"), "query_id")
        found = found.where(F.col("above") < F.col("need")).groupBy("query_id")
        found = found.agg(F.min_by(F.struct("bin", "above"), "bin").alias("at"))
        step = 1 << max(0, bits - BITS)
        state = state.join(found.withColumnRenamed("query_id", "vec_id"), "vec_id").select(
            # from the middle bin, so that no sum leaves 64 bits
            "dim", "qb", "vec_id", "v",
            (F.col("low") + F.lit(step << (BITS - 2)) + F.lit(step << (BITS - 2)) + (F.col("at.bin") - (1 << (BITS - 1))) * F.lit(step).cast("long")).alias("low"),
            (F.col("need") - F.col("at.above")).alias("need"),
        )
        state = stage.store(state, f"state{turn}")
        turn, bits = turn + 1, max(0, bits - BITS)
    best = meet(state, partial(_best, scale=scale, k=k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best of every row whose id is divisible by 20, against all rows."""
    return search(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 20
"""
