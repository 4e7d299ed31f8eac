"""Operator 13: hard negatives by a secondary sort.

Anchors meet the rows in blocks of bounded size. A first pass finds each anchor's positives, which
open windows of scores; a second pass lets every block hand on, for each window, the rows of other
labels that may be among its first. The shuffle orders positives and negatives by (anchor,
descending score, positives first, id), so one pass over each partition opens a window when its
positive comes by and writes negatives down while it is open. It keeps the open windows of one
anchor and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import Stage, read
from cohortlens.llm.topk import scaled, scores
from cohortlens.llm.vectors import every_part, matrix, numbers, part

CANDIDATES = 4096  # rows of a block, on average
ANCHORS = 1024
KEY = ["dim", "cb", "qb"]
BATCH = 20_000  # rows that the pass writes at a time


def labelled(df: DataFrame, label: Column, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v array<double>, dim) of the rows that can take part.

    Left out: rows without key or label, null or empty vectors, and vectors that hold null or
    non-finite components. Of rows that share a key the one least by (vector, label) counts, so
    repeated rows count once. Other columns are ignored.
    """
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(
        df[key].cast("long").alias("vec_id"), df[vector].cast("array<double>").alias("v"), label.cast("long").alias("label")
    )
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)).where(fine)
    least = rows.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("least"))
    return least.select("vec_id", "least.label", "least.v", F.size("least.v").alias("dim"))


def _first(rows: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first ``k`` of their row by descending value, then id; in that order."""
    order = np.lexsort((ids, ~values, rows))  # ~x falls as x rises, without overflow
    place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
    return order[place < k]


def _positives(key: tuple, left: pa.Table, right: pa.Table, scale: int, k: int) -> pa.Table:
    """The best ``k`` rows of the anchor's label in this block."""
    shape = {"anchor_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
    none = pa.schema(list(shape.items())).empty_table()
    if not left.num_rows or not right.num_rows:
        return none
    dim = key[0].as_py()
    ids, anchors = numbers(left["vec_id"]), numbers(right["vec_id"])
    c, q = scaled(matrix(left["v"], dim), scale), scaled(matrix(right["v"], dim), scale)
    labels, wanted = numbers(left["label"]), numbers(right["label"])
    parts = [none]
    for label in np.intersect1d(labels, wanted):  # only rows of one label are compared
        a, b = np.flatnonzero(wanted == label), np.flatnonzero(labels == label)
        found = scores(q[a], c[b])
        rows, at = np.nonzero(anchors[a][:, None] != ids[b][None, :])
        values = found[rows, at]
        best = _first(rows, values, ids[b][at], k)
        parts.append(pa.table([anchors[a][rows[best]], ids[b][at[best]], values[best]], list(shape)))
    return pa.concat_tables(parts)


def _negatives(key: tuple, left: pa.Table, right: pa.Table, scale: int, k: int) -> pa.Table:
    """The rows of other labels that are among the first ``k`` of a window in this block."""
    shape = {"anchor_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
    if not left.num_rows or not right.num_rows:
        return pa.schema(list(shape.items())).empty_table()
    dim = key[0].as_py()
    order = np.argsort(numbers(left["vec_id"]))
    ids, anchors = numbers(left["vec_id"])[order], numbers(right["vec_id"])
    found = scores(scaled(matrix(right["v"], dim), scale), scaled(matrix(left["v"], dim)[order], scale))
    other = numbers(right["label"])[:, None] != numbers(left["label"])[order][None, :]
    low, high = (right[c].to_pylist() for c in ("low", "high"))
    inside = (found >= np.array([min(x) for x in low])[:, None]) & (found <= np.array([max(x) for x in high])[:, None])
    rows, at = np.nonzero(other & inside)
    values = found[rows, at]
    by = np.lexsort((at, ~values, rows))
    rows, at, values = rows[by], at[by], values[by]
    edges = np.searchsorted(rows, np.arange(len(anchors) + 1))
    kept = np.zeros(len(rows), bool)
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        falling = ~values[a:b]  # ascending
        for below, above in zip(low[i], high[i], strict=True):
            start = a + int(np.searchsorted(falling, ~above, "left"))
            stop = a + int(np.searchsorted(falling, ~below, "right"))
            kept[start: min(stop, start + k)] = True
    return pa.table([anchors[rows[kept]], ids[at[kept]], values[kept]], list(shape))


def _open_windows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """One pass over rows sorted by (anchor_id, descending score, positives first, vec_id)."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    anchor, windows, out = None, [], []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32() if n == "rank" else pa.int64() for n in names]
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    for part_ in batches:
        columns = (part_.column(n).to_pylist() for n in ("anchor_id", "score", "negative", "vec_id", "low"))
        for this, score, negative, vec_id, low in zip(*columns, strict=True):
            if this != anchor:
                anchor, windows = this, []
            if not negative:
                windows.append([vec_id, score, low, 0])  # positive, its score, least score, written
                continue
            for window in windows:
                if window[3] < k and score >= window[2]:
                    window[3] += 1
                    out.append((anchor, window[0], window[3], vec_id, window[1], score))
            # scores only fall: a window is over once it is full or the score is below it
            windows = [w for w in windows if w[3] < k and score >= w[2]]
        if len(out) >= BATCH:
            yield batch(out)
            out = []
    if out:
        yield batch(out)


def mine(
    vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 5,
    least: int = 80, scale: int = 256, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which ``is_anchor`` (over ``vec_id``) holds. Components become
    floor(scale * x); the score of two rows is the inner product of these integers. Higher scores
    come first, ties go to the smaller vec_id. An anchor's positives are its first ``positives``
    other rows of its label; for each of them the first ``negatives`` rows of other labels are
    returned whose score is at most the positive's and at least ``least`` percent of it. A positive
    without such a row has no row, and neither has an anchor without positives, nor a positive of
    negative score, whose window is empty. Vectors meet only vectors of their own length. What
    takes no part, and what repeated rows and null keys count for, is said at ``labelled``. An empty
    table gives no rows.

    A label or vector that many rows share makes many ties; a block hands on at most ``negatives``
    of them for each window, the smallest ids.
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "negatives")
    rows = stage.store(labelled(vectors, label, key, vector), "rows")
    n, asked = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1))).first()
    blocks, groups = max(1, -(-n // CANDIDATES)), max(1, -(-asked // ANCHORS))
    left = rows.select("dim", part(F.col("vec_id"), blocks).alias("cb"), "vec_id", "label", "v")
    left = left.withColumn("qb", every_part(groups))
    anchors = rows.where(is_anchor).withColumn("qb", part(F.col("vec_id"), groups))
    shape = "anchor_id long, vec_id long, score long"

    def meet(anchors: DataFrame, fn) -> DataFrame:
        right = anchors.withColumn("cb", every_part(blocks))
        return left.groupBy(*KEY).cogroup(right.groupBy(*KEY)).applyInArrow(fn, shape)

    found = meet(anchors, partial(_positives, scale=scale, k=positives))
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    # least * positive <= 100 * negative, in whole numbers of any size
    wide = F.col("score").cast("decimal(28,0)")
    low = F.ceil(wide * least / 100).cast("long")
    opened = found.withColumn("place", first).where((F.col("place") <= positives) & (F.col("score") >= 0))
    opened = stage.store(opened.select("anchor_id", "vec_id", "score", low.alias("low")), "positives")
    windows = opened.groupBy(F.col("anchor_id").alias("vec_id")).agg(  # at most ``positives`` of an anchor
        F.sort_array(F.collect_list(F.struct("score", "low"))).alias("w")
    )
    asking = anchors.join(windows, "vec_id").select(
        "dim", "qb", "vec_id", "label", "v", F.col("w.low").alias("low"), F.col("w.score").alias("high")
    )
    asking = stage.store(asking, "asking")
    near = meet(asking, partial(_negatives, scale=scale, k=negatives))
    ordered = opened.withColumn("negative", F.lit(False)).unionByName(
        near.withColumns({"low": F.lit(None).cast("long"), "negative": F.lit(True)})
    )
    ordered = ordered.repartition("anchor_id").sortWithinPartitions(
        "anchor_id", F.desc("score"), "negative", "vec_id"
    )
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return ordered.mapInArrow(partial(_open_windows, k=negatives), out)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; where it is divisible by 7, the next label counts."""
    vectors = read(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, label, F.col("vec_id") % 100 == 0)


SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
    CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same
  ) WHERE place <= 5
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score,
    n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5
"""
