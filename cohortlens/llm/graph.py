"""Operator 5: approximate nearest neighbours in robust-pruned directed graphs.

Rows are dealt to shards by a hash of their key. In each shard equal vectors become one node, and
nodes are inserted in batches: a greedy search from the entry node proposes neighbours, relaxed
distance pruning keeps a diverse few of them, and edges back are added and pruned likewise. A query
runs a beam search in every shard; the found rows are scored again on the original vectors.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import Stage, read
from cohortlens.llm.vectors import every_part, matrix, numbers, part, usable

SHARD = 1024  # rows, on average
QUERIES = 2048  # of a block
DEGREE, BEAM, RELAX, BATCH = 24, 64, 1.2, 128


def greedy(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, ...]:
    """Beam search of all queries at once: ids and squared distances, nearest first, and the expanded nodes."""
    m, n = len(q), len(x)
    ids, far = np.full((m, beam), -1, np.int64), np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    seen = np.zeros((m, n), bool)
    ids[:, 0], far[:, 0], done[:, 0], seen[:, entry] = entry, ((q - x[entry]) ** 2).sum(1), False, True
    expanded, rows = [], np.arange(m)
    while True:
        live = rows[~done.all(1)]
        if not len(live):
            break
        at = (~done[live]).argmax(1)  # the nearest that is not expanded
        done[live, at] = True
        node = ids[live, at]
        step = np.full(m, -1, np.int64)
        step[live] = node
        expanded.append(step)
        near = edges[node]
        new = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(new, near, node[:, None])] = True
        away = 2 - 2 * np.einsum("qd,qnd->qn", q[live], x[near])
        all_far = np.concatenate([far[live], np.where(new, away, np.inf)], 1)
        all_ids = np.concatenate([ids[live], np.where(new, near, -1)], 1)
        all_done = np.concatenate([done[live], ~new], 1)
        best = np.argsort(all_far, 1, kind="stable")[:, :beam]
        far[live], ids[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_far, all_ids, all_done))
    return ids, far, np.stack(expanded, 1)


def prune(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """At most ``degree`` of each node's candidates: the nearest, then whatever it does not shadow, and so on."""
    alive = (near >= 0) & (near != nodes[:, None])
    at = x[near]
    away = np.where(alive, 2 - 2 * np.einsum("bd,bnd->bn", x[nodes], at), np.inf)
    order = np.argsort(away, 1, kind="stable")
    near, away, alive = (np.take_along_axis(a, order, 1) for a in (near, away, alive))
    at = np.take_along_axis(at, order[:, :, None], 1)
    out, rows = np.full((len(nodes), degree), -1, np.int64), np.arange(len(nodes))
    for slot in range(degree):
        any_left = alive.any(1)
        if not any_left.any():
            break
        pick = alive.argmax(1)
        out[any_left, slot] = near[rows, pick][any_left]
        between = 2 - 2 * np.einsum("bd,bnd->bn", at[rows, pick], at)
        alive &= relax * relax * between > away
        alive[rows, pick] = False
    return out


def build(x: np.ndarray, seed: int, degree: int = DEGREE, beam: int = BEAM) -> tuple[np.ndarray, int]:
    """Edges (n x degree, -1 where there are fewer) over unit vectors, and the entry node."""
    n = len(x)
    degree = max(1, min(degree, n - 1))
    random = np.random.default_rng(seed)
    edges = random.integers(0, n, (n, degree))
    entry = int((x @ x.mean(0)).argmax())
    for relax in (1.0, RELAX):
        order = random.permutation(n)
        for i in range(0, n, BATCH):
            nodes = order[i: i + BATCH]
            ids, _, expanded = greedy(x, edges, entry, x[nodes], beam)
            edges[nodes] = prune(x, nodes, np.concatenate([expanded, ids, edges[nodes]], 1), degree, relax)
            source, slot = np.nonzero(edges[nodes] >= 0)
            target, back = edges[nodes][source, slot], nodes[source]
            by = np.argsort(target, kind="stable")
            target, back = target[by], back[by]
            hit, first, times = np.unique(target, return_index=True, return_counts=True)
            wide = np.full((len(hit), degree + times.max(initial=0)), -1, np.int64)
            wide[:, :degree] = edges[hit]
            wide[np.repeat(np.arange(len(hit)), times), degree + np.arange(len(target)) - np.repeat(first, times)] = back
            for j in range(0, len(hit), BATCH):
                some = slice(j, j + BATCH)
                edges[hit[some]] = prune(x, hit[some], wide[some], degree, relax)
    return edges, entry


def _index(key: tuple, table: pa.Table, copies: int) -> pa.Table:
    """Nodes of a shard: number, the smallest ids that share the vector, the vector, edges, entry."""
    dim = key[0].as_py()
    ids, v = numbers(table["vec_id"]), matrix(table["v"], dim) + 0.0  # no negative zeros
    order = np.lexsort((ids, *v.T[::-1]))
    ids, v = ids[order], v[order]
    new = np.concatenate([[True], (v[1:] != v[:-1]).any(1)])
    start = np.flatnonzero(new)
    node, size = v[start], np.diff(np.append(start, len(ids)))
    scale = np.abs(node).max(1, keepdims=True)
    unit = node / scale
    unit = (unit / np.sqrt((unit**2).sum(1, keepdims=True))).astype(np.float32)
    edges, entry = build(unit, seed=key[1].as_py())
    return pa.table(
        {
            "dim": pa.array(np.full(len(start), dim, np.int32)),
            "shard": pa.array(np.full(len(start), key[1].as_py(), np.int32)),
            "node": pa.array(np.arange(len(start), dtype=np.int32)),
            "ids": pa.array([ids[a: a + min(s, copies)] for a, s in zip(start, size, strict=True)], pa.list_(pa.int64())),
            "v": pa.array(list(node), pa.list_(pa.float64())),
            "edges": pa.array(list(edges.astype(np.int32)), pa.list_(pa.int32())),
            "entry": pa.array(np.full(len(start), entry, np.int32)),
        }
    )


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision, summed in the order of the components."""
    dot, left, right = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        left += a[:, j] * a[:, j]
        right += b[:, j] * b[:, j]
    return dot / (np.sqrt(left) * np.sqrt(right))


def _search(key: tuple, nodes: pa.Table, asked: pa.Table, k: int, beam: int) -> pa.Table:
    shape = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not nodes.num_rows or not asked.num_rows:
        return shape.empty_table()
    dim = key[0].as_py()
    nodes = nodes.sort_by("node")
    v, q, query_ids = matrix(nodes["v"], dim), matrix(asked["v"], dim), numbers(asked["vec_id"])
    ids = nodes["ids"].to_pylist()
    edges = np.array(nodes["edges"].to_pylist(), np.int64)
    unit = lambda a: (u := a / np.abs(a).max(1, keepdims=True)) / np.sqrt((u**2).sum(1, keepdims=True))
    found, _, _ = greedy(
        unit(v).astype(np.float32), edges, nodes["entry"][0].as_py(), unit(q).astype(np.float32), max(beam, 2 * k + 2)
    )
    rows, at = np.nonzero(found[:, : 2 * k + 2] >= 0)
    node = found[rows, at]
    score = cosine(q[rows], v[node])
    times = np.array([len(ids[i]) for i in node])
    rows, score = np.repeat(rows, times), np.repeat(score, times)
    vec = np.array([i for x in node for i in ids[x]], np.int64)
    other = vec != query_ids[rows]
    rows, score, vec = rows[other], score[other], vec[other]
    order = np.lexsort((vec, -score, rows))
    rows, score, vec = rows[order], score[order], vec[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return pa.table([query_ids[rows[keep]], vec[keep], score[keep]], schema=shape)


def index(vectors: DataFrame, copies: int, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """Nodes of the graphs over every usable row: dim, shard, node, ids, v, edges, entry.

    ``ids`` holds the smallest ``copies`` keys of the rows that share the vector ``v``; a search for
    k neighbours needs k + 1 of them. Zero vectors have no direction and take no part, nor does what
    ``usable`` leaves out. Vectors of different lengths lie in different graphs.
    """
    stage = Stage(vectors.sparkSession, "graph")
    rows = usable(vectors, key, vector).where(F.exists("v", lambda x: x != 0))
    rows = stage.store(rows, "rows")
    shards = max(1, -(-rows.count() // shard))
    rows = rows.withColumn("shard", part(F.col("vec_id"), shards))
    schema = "dim int, shard int, node int, ids array<long>, v array<double>, edges array<int>, entry int"

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _index(key, table, copies)

    return stage.store(rows.groupBy("dim", "shard").applyInArrow(run, schema), "nodes")


def search(
    vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", beam: int = BEAM,
    shard: int = SHARD,
) -> DataFrame:
    """The ``k`` nearest found rows by cosine of every query: query_id, rank, vec_id, score.

    Every row is indexed and every shard is searched. ``score`` is the cosine of the original vectors
    in double precision; equal scores rank by vec_id. A query has itself as no candidate, and no row
    if there is no other vector of its length. An empty table gives no rows.
    """
    nodes = index(vectors, k + 1, key, vector, shard)
    rows = usable(vectors, key, vector).where(F.exists("v", lambda x: x != 0)).where(is_query)
    rows = Stage(vectors.sparkSession, "graph").store(rows, "queries")
    shards = nodes.agg(F.max("shard")).first()[0]
    shards = 1 if shards is None else shards + 1
    groups = max(1, -(-rows.count() // QUERIES))
    asked = rows.select("dim", part(F.col("vec_id"), groups).alias("qb"), "vec_id", "v")
    asked = asked.withColumn("shard", every_part(shards))
    held = nodes.withColumn("qb", every_part(groups))
    by = ["dim", "shard", "qb"]
    found = held.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(
        partial(_search, k=k, beam=beam), "query_id long, vec_id long, score double"
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest of every row whose id is divisible by 50, among all rows."""
    return search(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)
