"""Ranked lexical search against a plain scorer."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import lexical
from llm_cases import docs, nothing, rows  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(documents, items, k):
    """Ranked (doc_id, score) of every item; nulls last among ties."""
    held = [(i, Counter(terms(t))) for i, t in documents]
    n = sum(1 for _, c in held if c)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * n) // total if total else 0
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2.0 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def got(df):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in items], "item_id long, text string, source string, n long")


ITEMS = [
    (1, "word1 word2 WORD3 tail end"), (2, "the the cat MAT"), (3, None), (4, ""), (5, "!?-_ \n"), (6, "nowhere at all"), (6, "other3 thing5"),
    (7, "😀 x-ray b\x85c ONE"), (None, "word5 word6"), (8, "zz " * 50 + "z" * 5000),
]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_odd_texts_equal_brute_force(spark, docs, rows, k):  # noqa: F811
    assert got(lexical.search(docs, items_of(spark, ITEMS), k)) == brute(rows, ITEMS, k)


@pytest.mark.parametrize("rows_of_block", [1, 7, 64])
def test_buckets_equal_brute_force(spark, monkeypatch, rows_of_block):
    monkeypatch.setattr(lexical, "ROWS", rows_of_block)
    monkeypatch.setattr(lexical, "ITEMS", 5)
    rnd = random.Random(rows_of_block)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]

    def text(n):
        return " ".join(rnd.choices(words, weights, k=n))

    documents = [(i, text(rnd.choice([1, 3, 10, 40, 300]))) for i in range(150)]
    documents += [(200 + i, documents[0][1]) for i in range(70)]  # copies: ties
    items = [(i, text(rnd.choice([1, 4, 12, 30]))) for i in range(14)]
    table = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    for k in (2, 20):
        assert got(lexical.search(table, items_of(spark, items), k)) == brute(documents, items, k)


def test_block_search_prunes_nothing_that_counts():
    rng = np.random.default_rng(4)
    lengths = rng.integers(0, 12, 400)
    held = [np.sort(rng.choice(40, n, replace=False)) for n in lengths]
    values = [rng.integers(1, 900_000, n) for n in lengths]
    wanted = np.arange(0, 40, 2)
    block = lexical.Postings(lengths, np.concatenate(held), np.concatenate(values), wanted)
    for trial in range(60):
        asked = rng.choice(len(wanted), rng.integers(1, 15), replace=False)
        weights = rng.integers(1, 9000, len(asked)) ** int(rng.integers(1, 3))
        exact = np.zeros(400, np.int64)
        for t, w in zip(wanted[asked], weights, strict=True):
            for d in range(400):
                exact[d] += w * int(values[d][held[d] == t].sum())
        best = np.sort(exact)[::-1]
        least = int(best[4]) if trial % 2 else 0
        places, found = block.best(asked, weights, 5, least)
        assert (exact[block.order[places]] == found).all()
        floor = max(int(best[4]), 1)
        assert set(np.flatnonzero(exact >= floor)) <= set(block.order[places])


def test_empty_tables(spark, docs, nothing):  # noqa: F811
    none = items_of(spark, [])
    assert lexical.search(nothing, items_of(spark, ITEMS)).count() == 0
    assert lexical.search(docs, none).count() == 0
    assert lexical.search(nothing, none).columns == ["item_id", "rank", "doc_id", "score"]
