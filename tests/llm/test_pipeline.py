"""Stages of the pipeline against brute force on the small tables, and the SQL of the operators."""

import random
from collections import Counter

import corpus_pipeline as pipeline
import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from cohortlens.llm import neardup, queries
from cohortlens.llm.common import read
from conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_operator_equals_sql(spark, name):
    assert compare(entry.queries()[name](spark, DATA), connect(DATA), queries.ORACLES[name]) == ""


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_stages_keep_columns_and_order(spark):
    docs = read(spark, DATA, "documents")
    for _, step in pipeline.STAGES[:-1]:
        after = step(spark, docs, DATA)
        assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString()
        assert after.select("doc_id").subtract(docs.select("doc_id")).count() == 0
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "passages", "packing"]


def test_language_stage_drops_what_no_language_resembles(spark):
    rnd = random.Random(6)
    odd = [
        "wszystko co dobre szybko się kończy a potem nadchodzi kolejny dzień pełen pracy i obowiązków domowych oraz zawodowych",
        "suomalaiset ovat tunnettuja saunasta ja järvistä sekä pitkistä talvista jolloin aurinko ei nouse lainkaan pohjoisessa",
        "Привет мир это совсем другой язык который никто тут не учил",
        *("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)) for n in (200, 1000, 5000)),
    ]
    docs = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang").where("doc_id is not null")
    planted = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(odd)], docs.schema)
    kept = {r.doc_id for r in pipeline.drop_unknown_language(spark, docs.union(planted), DATA).select("doc_id").collect()}
    assert not {i for i in kept if i < 0}
    assert len(kept) >= 0.995 * docs.select("doc_id").distinct().count()


def test_near_duplicate_stage_keeps_one_of_a_group(spark):
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(900)}" for _ in range(120)]
    rows = [(i, " ".join([*base[:-1], f"end{i}"])) for i in range(20)] + [(50, "something else entirely"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = pipeline.drop_near_duplicates(spark, docs, DATA).collect()
    assert Counter(r.doc_id for r in kept) == Counter([0, 50, None])
    assert neardup.linked(*(neardup.shingles(t.encode().split(), 5) for _, t in rows[:2]), 80)


def test_run_packs_all_that_is_left(spark):
    pieces = pipeline.run(spark, DATA).collect()
    ends = Counter(p.doc_id for p in pieces if p.start + p.length == p.doc_tokens)
    assert set(ends.values()) == {1}
    assert all(len(p.ids) == 4 * p.length for p in pieces)
