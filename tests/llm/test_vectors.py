"""Exact and approximate search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import graph, topk

SCHEMA = "vec_id long, embedding array<double>, label int, score string"


@pytest.fixture(scope="module")
def data():
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(0, 0.2, (700, 16))
    vectors[100:330] = vectors[99]  # a hot vector
    vectors[400:420] = 2 * vectors[399]
    return {i: v for i, v in enumerate(vectors)}


@pytest.fixture(scope="module")
def table(spark, data):
    rows = [(i, [float(x) for x in v], 0, "x") for i, v in data.items()]
    rows += [rows[0], rows[100], (None, rows[5][1], 0, "x"), (1000, None, 0, "x"), (1020, [], 0, "x")]
    rows += [(1040, [1.0, None] + [0.0] * 14, 0, "x"), (1060, [float("nan")] + [0.0] * 15, 0, "x"), (1080, [float("inf")] * 16, 0, "x")]
    rows += [(1100, [1.0, 2.0], 0, "x"), (1101, [2.0, 1.0], 0, "x"), (1120, [1.0, 2.0, 3.0], 0, "x"), (2000, [0.0] * 16, 0, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def test_top_k_equals_brute_force(table, data, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 100)
    monkeypatch.setattr(topk, "QUERIES", 16)
    found = topk.search(table, F.col("vec_id") % 20 == 0, 20).collect()
    ids = np.array([*data, 2000])
    whole = np.floor(64 * np.array([*data.values(), np.zeros(16)])).astype(int)
    got: dict = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {}
    for q in ids[ids % 20 == 0]:
        score = whole @ whole[ids == q][0]
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        want[q] = [(k + 1, ids[i], score[i]) for k, i in enumerate(best)]
    want[1100] = [(1, 1101, 64 * 64 * 4)]
    assert got == want


def test_top_k_of_little(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.search(empty, F.col("vec_id") % 20 == 0, 20).count() == 0
    large = spark.createDataFrame([(0, [3e7, 1.0], 0, ""), (1, [3e7, 2.0], 0, ""), (2, [3e7, 1.0], 0, "")], SCHEMA)
    found = topk.search(large, F.col("vec_id") == 0, 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 4096 * (9 * 10**14 + 2)), (2, 4096 * (9 * 10**14 + 1))]


def test_graph_search_recall_and_scores(table, data, monkeypatch):
    found = graph.search(table, F.col("vec_id") % 20 == 0, 5, shard=200).collect()
    ids, v = np.array(list(data)), np.array(list(data.values()))
    unit = v / np.sqrt((v * v).sum(1, keepdims=True))
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        score = unit @ unit[q]
        best = [i for i in np.lexsort((ids, -np.round(score, 12))) if i != q][:5]
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - score[r.vec_id]) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hit += len(set(best) & {r.vec_id for r in mine})
        total += 5
    assert hit / total >= 0.9
    assert [(r.vec_id, round(r.score, 12)) for r in found if r.query_id == 1100] == [(1101, 0.8)]
    assert not {2000, 1000, 1020, 1040, 1060, 1080, 1120} & {r.query_id for r in found}


def test_every_row_is_indexed_once(table, data):
    nodes = graph.index(table, 1000, shard=200).where("dim = 16").collect()
    assert sorted(i for n in nodes for i in n.ids) == sorted(data)


def test_graph_search_of_nothing(spark):
    assert graph.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_scores_beyond_64_bits_are_held(spark):
    rows = [(i, [x], 0, "") for i, x in enumerate((1e10, -1e10, 1e10, 1.0))]
    found = topk.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(2, 2**63 - 1), (3, 4096 * 10**10)]
