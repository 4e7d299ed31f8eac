"""Hard negatives against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import negatives


def brute(rows, positives=5, k=5, scale=256, least=80):
    usable = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable[i] = min(usable.get(i, (list(v), label)), (list(v), label))
    held = {i: ([math.floor(scale * x) for x in v], label) for i, (v, label) in usable.items()}
    out = Counter()
    for a, (v, label) in held.items():
        if a % 3:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w, strict=True)), i, other)
            for i, (w, other) in held.items() if i != a and len(w) == len(v)
        )
        same = [(i, -s) for s, i, other in scored if other == label][:positives]
        for p, ps in same:
            fit = [(i, -s) for s, i, other in scored if other != label and least * ps <= -100 * s <= 100 * ps][:k]
            out.update((a, p, rank, i, ps, ns) for rank, (i, ns) in enumerate(fit, 1))
    return out


def mined(spark, rows, **sizes):
    table = spark.createDataFrame(
        [(i, v, label, 1, 2, "x") for i, v, label in rows],
        "vec_id long, embedding array<double>, label int, score int, anchor_id int, negative string",
    ).repartition(3)
    found = negatives.mine(table, F.col("label"), F.col("vec_id") % 3 == 0, **sizes)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, found.collect()))


NAN, INF = float("nan"), float("inf")
ODD = [
    (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.0, 9.0], 2), (1, None, 1), (2, [], 1), (3, [1.0, None], 1), (4, [NAN, 1.0], 1),
    (5, [INF, 1.0], 1), (6, [1.0, 0.25], None), (None, [1.0, 1.0], 1), (7, [1.0, 0.5, 0.25], 1), (9, [1.0], 1), (12, [1.0], 2),
    (15, [0.0, 0.0], 1), (18, [0.0, 0.0], 1), (21, [0.0, 0.0], 2), (24, [-1.0, -1.0], 1), (27, [-1.0, -1.0], 2),
]


def test_odd_rows(spark):
    rows = ODD + [(100 + i, [1.0, 0.5], i % 3) for i in range(20)]  # one vector many times: ties
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("block, positives, k", [(4096, 5, 5), (16, 2, 3), (5, 5, 1)])
def test_blocks_equal_brute_force(spark, monkeypatch, block, positives, k):
    monkeypatch.setattr(negatives, "CANDIDATES", block)
    monkeypatch.setattr(negatives, "ANCHORS", block)
    rnd = random.Random(block)
    centre = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rnd.gauss(0, 0.4) for c in centre[rnd.randrange(4)]], rnd.randrange(4)) for i in range(140)]
    found = mined(spark, rows, positives=positives, negatives=k)
    assert found == brute(rows, positives, k) and len(found) > 50


def test_nothing(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(0, [1.0], 1)])
