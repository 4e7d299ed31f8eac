"""Packing by local search: ids by the library, whole documents, few sequences."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import bestfit
from llm_cases import docs, nothing, rows  # noqa: F401

BYTES = P.path("byte_bpe_50k.json")


def squared(bins, width):
    return sum((width - b.free) ** 2 for b in bins)


@pytest.mark.parametrize("low, high", [(1, 100), (30, 60), (40, 99), (1, 12)])
def test_search_keeps_items_and_empties_bins(low, high):
    rnd = random.Random(low)
    sizes = Counter(rnd.randint(low, high) for _ in range(400))
    start = [bestfit.Bin(100, {s: 1}) for s in sizes.elements()]
    bins = bestfit.improve([bestfit.Bin(100, b.sizes) for b in start], 100)
    assert sum((b.sizes for b in bins), Counter()) == sizes
    assert all(b.free == 100 - sum(b.sizes.elements()) >= 0 for b in bins)
    assert squared(bins, 100) >= squared(start, 100) and len(bins) < len(start)
    fitted = bestfit.best_fit(sizes, 100)
    assert sum((b.sizes for b in fitted), Counter()) == sizes
    assert len(bestfit.improve(fitted, 100)) <= len(fitted)


def test_exchanges_beat_best_fit():
    # one for two: 7 against 4 + 2 fills the first bin and leaves the second to be emptied
    bins = [bestfit.Bin(10, {4: 1, 2: 1, 3: 1}), bestfit.Bin(10, {7: 1}), bestfit.Bin(10, {4: 1})]
    assert len(bestfit.improve(bins, 10)) == 2


@pytest.mark.parametrize("width", [2048, 16])
def test_pieces_hold_every_document(docs, rows, width):  # noqa: F811
    library = Tokenizer.from_file(BYTES)
    pieces = bestfit.pack(docs, BYTES, width).collect()
    filled = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and 0 < p.length <= width
        filled[p.sequence_id].append((p.offset, p.length))
    for held in filled.values():
        held.sort()
        assert [o for o, _ in held] == list(np.cumsum([0] + [n for _, n in held[:-1]]))
        assert sum(n for _, n in held) <= width
    want, got = Counter(), Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % width or width
        edges = [0, *range(first, len(ids) + 1, width)]
        for piece, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            want[i, piece, a, tuple(ids[a:b])] += 1
    for p in pieces:
        got[p.doc_id, p.piece, p.start, tuple(np.frombuffer(bytes(p.ids), "<u4").tolist())] += 1
    assert got == want
    rests = Counter(p.length for p in pieces if p.length < width)
    whole = sum(p.length == width for p in pieces)
    assert len(filled) <= whole + len(bestfit.best_fit(rests, width))


def test_groups_meet_again(spark, monkeypatch):
    monkeypatch.setattr(bestfit, "GROUP", 40)
    rnd = random.Random(5)
    texts = [" a" * rnd.choice([3, 5, 7, 9, 12, 40]) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    pieces = bestfit.pack(docs, BYTES, 32)
    found = pieces.agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("bins")).first()
    assert found.n == sum(t.count("a") + 1 for t in texts)
    assert found.bins <= 1.03 * found.n / 32 + 1
    crowded = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("k"), F.count("*").alias("c"))
    assert crowded.where("n > 32 or k <> c").count() == 0


def test_nothing(nothing):  # noqa: F811
    assert bestfit.pack(nothing, BYTES).count() == 0
