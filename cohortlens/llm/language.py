"""Operator 7: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds its letters, permuted by their place,
into one vector; a text bundles the vectors of its trigrams; a language bundles its texts. The
prediction is the language whose profile has the largest cosine with the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import carried, cut, map_batches, read, remainder, schema_of, texts_of
from cohortlens.session import tune

DIM = 1024
SYMBOLS = 64  # 0: no letter, 1-26: a-z, the rest shared by all other letters
SEED = 20240607
GRAMS = SYMBOLS**3
OPEN = 32  # languages a task counts at a time
UNKNOWN = "und"
LOW, PART = 0.01, 0.5  # a text is unlike all languages below this part of this quantile of the learned rows' cosines
BEGINNINGS = (8, 32, 128, 512)  # characters of learned rows that stand for short texts
ENOUGH = 20  # learned rows of a length from which it has a limit of its own
STEPS = 1000  # of a cosine, in which quantiles are counted


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of every code point, and the letters' vectors as they stand in the three places."""
    symbol = np.zeros(0x110000, np.uint8)
    points = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    symbol[points] = 27 + (points * 2654435761 % 4294967296 >> 16) % (SYMBOLS - 27)
    symbol[ord("a"): ord("z") + 1] = np.arange(1, 27)
    vectors = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIM))
    return symbol, np.stack([np.roll(vectors, 2, 1), np.roll(vectors, 1, 1), vectors])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of letters, with one mark for what stands between words, and the text of each."""
    joined = " ".join(t.lower() for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t.lower()) + 1 for t in texts])[: len(points)]
    code = _letters()[0][points].astype(np.int32)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    code, owner = code[keep], owner[keep]
    code, owner = np.concatenate([[0], code, [0]]), owner
    gram = (code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:]
    inner = code[1:-1] != 0
    return gram[inner], owner[inner]


def vectors_of(gram: np.ndarray) -> np.ndarray:
    """Bound vectors of trigrams."""
    first, second, third = _letters()[1]
    out = first[gram // SYMBOLS**2] * second[gram // SYMBOLS % SYMBOLS]
    out *= third[gram % SYMBOLS]
    return out


def learn(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, np.ndarray]:
    """Profile of every language of the labelled rows; rows with null language are left out.

    Sums of whole numbers, so any order of the rows gives the same profiles. The driver gets one
    vector of ``DIM`` numbers per language. No labelled row with a letter gives no profile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterable[pa.RecordBatch]:
            for name, n in counts.items():
                hit = np.flatnonzero(n)
                total = np.zeros(DIM, np.int64)
                for i in range(0, len(hit), 8192):
                    some = hit[i: i + 8192]
                    total += (n[some].astype(np.float64) @ vectors_of(some).astype(np.float64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * DIM), pa.array(np.arange(DIM)), pa.array(total)], ["lang", "at", "value"]
                )
            counts.clear()

        for big in batches:
            for batch in cut(big):
                names = batch.column(1).to_pylist()
                gram, owner = grams(texts_of(batch.column(0)))
                number = {name: i for i, name in enumerate(dict.fromkeys(names))}
                which = np.array([number[x] for x in names])[owner]
                for name, i in number.items():
                    if len(counts) >= OPEN and name not in counts:
                        yield from flush()
                    mine = np.bincount(gram[which == i], minlength=GRAMS)
                    counts[name] = counts[name] + mine if name in counts else mine
        yield from flush()

    rows = docs.where(docs[lang].isNotNull()).select(docs[text].cast("string"), docs[lang].cast("string"))
    sums = rows.mapInArrow(run, "lang string, at long, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    profiles: dict[str, np.ndarray] = {}
    for name, at, value in sums.collect():  # DIM rows per language
        profiles.setdefault(name, np.zeros(DIM))[at] = value
    return {name: v for name, v in sorted(profiles.items()) if v.any()}


def predict(
    docs: DataFrame, profiles: dict[str, np.ndarray], key: str = "doc_id", text: str = "text", carry: bool = False
) -> DataFrame:
    """(key, lang_pred, score, n_grams) of every row from its whole text; with ``carry`` also ``row``, the row itself.

    ``score`` is the cosine with the nearest profile, held to 0..1; of equal cosines the language
    that comes first in the alphabet counts. Null texts and texts without a letter are ``und`` with
    score 0, and so is every text if there is no profile. Repeated rows and null keys are predicted
    like any other row; other columns are ignored.
    """
    names = list(profiles)
    unit = np.array([v / np.linalg.norm(v) for v in profiles.values()]).reshape(len(names), DIM).astype(np.float32)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        found, score = np.full(n, -1), np.zeros(n)
        gram, owner = grams(texts_of(batch.column(1)))
        edges = np.searchsorted(owner, np.arange(n + 1))
        if len(names) and len(gram):
            used = np.flatnonzero(np.bincount(gram, minlength=GRAMS))
            small = np.zeros(GRAMS, np.int32)
            small[used] = np.arange(len(used))
            bound, small = vectors_of(used).astype(np.float32), small[gram]
            for i in range(n):
                count = np.bincount(small[edges[i]: edges[i + 1]], minlength=len(used))
                hit = np.flatnonzero(count)
                if len(hit):
                    whole = np.zeros(DIM, np.float32)
                    for j in range(0, len(hit), 4096):
                        whole += count[hit[j: j + 4096]].astype(np.float32) @ bound[hit[j: j + 4096]]
                    near = unit @ whole
                    found[i] = near.argmax()
                    score[i] = near[found[i]] / max(np.linalg.norm(whole), 1e-12)
        label = [names[i] if i >= 0 else UNKNOWN for i in found]
        found_score = pa.array(np.clip(score, 0, 1).astype(np.float64))
        n_grams = pa.array(np.diff(edges), pa.int64())
        columns = [batch.column(0), pa.array(label, pa.string()), found_score, n_grams, *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(columns, ["key", "lang_pred", "score", "n_grams", "row"][: len(columns)])

    rows = docs.select(docs[key].alias("key"), docs[text].cast("string"), *carried(docs, carry))
    return map_batches(rows, run, schema_of(rows, "lang_pred string, score double, n_grams long")).withColumnRenamed("key", key)


def limits(learned: DataFrame, profiles: dict[str, np.ndarray], text: str = "text") -> list[float]:
    """Least cosine of a text that resembles a language, for texts of 1, 2-3, 4-7, ... trigrams.

    It is ``PART`` of the ``LOW`` quantile of the cosines of all learned rows and their beginnings,
    by length, since short texts have lower ones, and at least the limit of the next shorter length as
    far as that lies below the quantile; so it lies below nearly all of them. A length with
    fewer than ``ENOUGH`` of them has the limit of the next shorter one, or none: a word or two tell
    no language. The driver gets a histogram of ``STEPS`` bins for each of at most 64 lengths.
    """
    whole = F.col(text).cast("string")
    some = [F.when(F.char_length(whole) > n, F.substring(whole, 1, n)) for n in BEGINNINGS]
    rows = learned.select(F.explode(F.array(whole, *some)).alias("text")).where(F.col("text").isNotNull())
    rows = predict(rows.select(F.lit(0).alias("key"), "text"), profiles, "key").where(F.col("n_grams") > 0)
    rows = rows.select(_bits().alias("bits"), F.floor(F.col("score") * STEPS).alias("step"))
    counts: dict[int, np.ndarray] = {}
    for bits, step, n in rows.groupBy("bits", "step").count().collect():
        counts.setdefault(bits, np.zeros(STEPS + 1, np.int64))[step] = n
    out, last = [], 0.0
    for bits in range(1, 65):
        n = counts.get(bits, np.zeros(1, np.int64))
        if n.sum() >= ENOUGH:
            low = int(np.searchsorted(np.cumsum(n), LOW * n.sum(), side="right")) / STEPS
            last = max(PART * low, min(last, low))
        out.append(last)
    return out


def _bits() -> Column:
    return F.length(F.bin("n_grams"))


def resembles(least: list[float]) -> Column:
    """Whether a predicted row has a letter and a cosine from the limit of its length on."""
    limit = F.element_at(F.array(*map(F.lit, least)), _bits())
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= limit)


def held_out(doc_id: Column) -> Column:
    """Rows that no profile learns from; a null id is one of them."""
    return F.coalesce(remainder(doc_id, 3) == 1, F.lit(True))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the documents that aren't held out."""
    tune(spark)
    docs = read(spark, folder, "documents")
    found = predict(docs, learn(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
