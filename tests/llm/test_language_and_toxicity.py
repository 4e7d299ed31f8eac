"""Language and toxicity: held-out accuracy, gradients, and the cases that hold little."""

import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm import language, toxicity
from cohortlens.llm.common import read
from llm_cases import docs, nothing, rows  # noqa: F401

DATA = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    truth = read(spark, DATA, "documents").select("doc_id", "lang")
    found = language.query(spark, DATA).join(truth, "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_of_odd_rows(spark, docs, nothing, rows):
    profiles = language.learn(docs.withColumn("lang", F.when(F.col("doc_id") < 10, "en").when(F.col("doc_id") == 14, "xx")))
    found = language.predict(docs, profiles).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    none = {r.doc_id for r in found if r.lang_pred == "und"}
    assert none >= {4, 5, 6}
    assert all(r.lang_pred == "und" for r in language.predict(docs, language.learn(nothing)).collect())
    assert language.predict(nothing, profiles).count() == 0


def test_trigrams_equal_plain_code():
    texts = ["The cat.", "", "a1b", "é! Zed", "  x"]
    gram, owner = language.grams(texts)
    symbol = language._letters()[0]
    want = []
    for i, t in enumerate(texts):
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        for w in words:
            codes = [0, *(int(symbol[ord(c)]) for c in w), 0]
            want += [(i, (a * 64 + b) * 64 + c) for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)]
    assert list(zip(owner.tolist(), gram.tolist(), strict=True)) == want


def test_gradients_equal_differences():
    rnd = np.random.default_rng(1)
    codes = [rnd.integers(0, 9, n) for n in (3, 7, 1)]
    inputs = rnd.normal(size=(9, 4)).astype(np.float32)
    labels = np.array([1, 0, 1])
    weights = toxicity._fit(inputs, codes, labels)
    x, mask = toxicity.padded(inputs, codes)

    def loss(w):
        p = toxicity.sigmoid(toxicity.forward(w, x, mask).astype(float))
        return -np.log(np.where(labels == 1, p, 1 - p)).sum()

    keep = []
    error = toxicity.sigmoid(toxicity.forward(weights, x, mask, keep)) - labels
    found = toxicity.backward(weights, x, mask, keep, error.astype(np.float32))
    for name, w in weights.items():
        for at in list(np.ndindex(w.shape))[:6]:
            up, down = ({k: v.copy() for k, v in weights.items()} for _ in range(2))
            up[name][at] += 3e-3
            down[name][at] -= 3e-3
            assert abs((loss(up) - loss(down)) / 6e-3 - found[name][at]) < 2e-2


def test_windows_cover_every_word():
    for n in (0, 1, 127, 128, 129, 224, 1000):
        covered = set()
        for s in toxicity.starts(n):
            covered |= set(range(s, min(n, s + toxicity.WINDOW)))
        assert covered == set(range(n))


def test_toxicity_of_planted_words(spark):
    rnd = np.random.default_rng(4)
    words = [f"{a}{b}" for a in ("ba", "ko", "mi", "ta") for b in ("ren", "lus", "dor", "pim", "vat")]
    texts = [" ".join(rnd.choice(words, rnd.integers(5, 400))) for _ in range(400)]
    for i in range(0, 400, 4):
        parts = texts[i].split()
        parts[rnd.integers(len(parts))] = ("zorgle!", "Zorglest", "VILEST")[i // 4 % 3]
        texts[i] = " ".join(parts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(0, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    found = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).where("held").collect()
    assert len(found) > 50
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in found]) > 0.95


def test_pieces_hold_every_run_of_a_word():
    rnd = np.random.default_rng(3)
    for word in ("z" * 64, "\u4f60\u597d" * 90, "".join(rnd.choice(list("abc-_\u00e9\u4f60\U0001f600\ud800"), 500)), "!" * 200):
        whole = toxicity.bare(word.encode("utf-8", "surrogatepass"))
        parts = toxicity.cells(word)
        assert all(len(p.strip(toxicity.CUT)) <= toxicity.PIECE for p in parts)
        text = b"^" + whole + b"$"
        want = {int.from_bytes(text[i: i + n]) for n in toxicity.RUNS for i in range(len(text) - n + 1)}
        assert set(toxicity.runs([toxicity.bare(p) for p in parts])[0].tolist()) == want


def test_toxicity_behind_the_start_of_a_long_word(spark):
    rnd = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("ba", "ko", "mi", "ta") for b in ("ren", "lus", "dor", "pim", "vat")]
    texts = ["\u00a0".join(rnd.choice(words, 60)) for _ in range(400)]
    texts = [t + "\u00a0zorglevilest\u00a0" + "\u00a0".join(words) if i % 4 == 0 else t for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    found = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).where("held").collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in found]) > 0.95


def test_toxicity_of_odd_rows(spark, docs, nothing, rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    for labels in (none, one):
        assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()} == {0.0}
    two = spark.createDataFrame([(i, int(i > 8)) for i in range(1, 16)], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.learn(docs, two), carry=True).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score(nothing, toxicity.learn(docs, two)).count() == 0
