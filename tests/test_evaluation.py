import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from cohortlens.operators import evaluation as ev
from cohortlens.operators import scorecard as sc
from cohortlens.operators import split
from cohortlens.plans import catalogue as cat


def rows(spark, pairs):
    return spark.createDataFrame([(int(y), float(p)) for y, p in pairs], "y int, p double")


def test_auc_with_ties(spark):
    df = rows(spark, [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)])
    got = ev.gini(df, "y", "p").first()
    assert got["auc"] == 0.875 and got["gini"] == 0.75


def test_auc_agrees_with_spark_ml(spark):
    rnd = random.Random(6)
    pairs = [(y, min(1, max(0, rnd.gauss(0.4 + 0.2 * y, 0.2)))) for y in (rnd.random() < 0.3 for _ in range(3000))]
    df = rows(spark, pairs)
    want = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="p", numBins=0).evaluate(df.withColumn("y", F.col("y").cast("double")))
    assert ev.auc(df, "y", "p").first()["auc"] == pytest.approx(want, abs=1e-9)


def test_roc_points(spark):
    df = rows(spark, [(0, 0.1), (1, 0.4), (0, 0.4), (1, 0.8)])
    got = [tuple(r) for r in ev.roc_curve(df, "y", "p").orderBy("threshold").collect()]
    assert got == [(float("-inf"), 1.0, 0.0), (0.25, 1.0, 0.5), (pytest.approx(0.6), 0.5, 1.0), (float("inf"), 0.0, 1.0)]


def test_direction_follows_the_medians(spark):
    rnd = random.Random(3)
    pairs = [(y, round(rnd.gauss(0.4 + 0.2 * y, 0.2), 2)) for y in (rnd.random() < 0.4 for _ in range(300))]
    plain, turned = rows(spark, pairs), rows(spark, [(y, 1 - p) for y, p in pairs])
    both = plain.withColumn("d", F.lit("plain")).unionByName(turned.withColumn("d", F.lit("turned")))
    areas = {r["d"]: (r["auc"], r["direction"]) for r in ev.auc(both, "y", "p", ["d"], ev.AUTO).collect()}
    assert areas["plain"][1] == "<" and areas["turned"][1] == ">"
    assert areas["plain"][0] == pytest.approx(areas["turned"][0]) == pytest.approx(ev.auc(plain, "y", "p").first()["auc"])
    assert ev.auc(turned, "y", "p", direction=ev.AUTO).first()["direction"] == ">"
    best = {r["d"]: r for r in ev.optimal_threshold(both, "y", "p", ["d"], ev.AUTO).collect()}
    assert best["plain"]["youden"] == pytest.approx(best["turned"]["youden"])
    hit = [ev.classify(F.col("p"), best[d]["threshold"], best[d]["direction"]).alias("z") for d in ("plain", "turned")]
    same = [[r["z"] for r in df.coalesce(1).select(z).collect()] for df, z in zip((plain, turned), hit, strict=True)]
    assert same[0] == same[1]
    points = ev.roc_curve(turned, "y", "p", direction=ev.AUTO)
    assert points.where("threshold = 'Infinity' and sensitivity = 1 and specificity = 0").count() == 1
    for r in points.where("abs(threshold) < 9").limit(5).collect():
        seen = [(y, 1 - p < r["threshold"]) for y, p in pairs]
        assert r["sensitivity"] == pytest.approx(sum(z for y, z in seen if y) / sum(y for y, _ in seen))


def test_direction_with_one_class_is_up(spark):
    df = rows(spark, [(1, 0.2), (1, 0.4)])
    assert ev.auc(df, "y", "p", direction=ev.AUTO).first()["direction"] == "<"
    with pytest.raises(ValueError):
        ev.auc(df, "y", "p", direction="up")


def test_youden_tie_takes_the_lower_threshold(spark):
    # both 0.25 and 0.6 give index 0.5
    df = rows(spark, [(0, 0.1), (1, 0.4), (0, 0.4), (1, 0.8)])
    got = ev.optimal_threshold(df, "y", "p").first()
    assert got["threshold"] == 0.25 and got["youden"] == 0.5


def test_youden_brute_force(spark):
    rnd = random.Random(9)
    pairs = [(rnd.random() < 0.4, round(rnd.random(), 2)) for _ in range(400)]
    values = sorted({p for _, p in pairs})
    cuts = [float("-inf"), *[(a + b) / 2 for a, b in zip(values, values[1:])], float("inf")]
    pos, neg = sum(y for y, _ in pairs), sum(not y for y, _ in pairs)
    best = max((sum(y and p > t for y, p in pairs) * neg + sum(not y and p <= t for y, p in pairs) * pos, -i) for i, t in enumerate(cuts))
    got = ev.optimal_threshold(rows(spark, pairs), "y", "p").first()
    assert got["threshold"] == pytest.approx(cuts[-best[1]])


def test_classification_metrics(spark):
    pairs = [(1, 1)] * 30 + [(1, 0)] * 10 + [(0, 1)] * 20 + [(0, 0)] * 40
    got = ev.classification_metrics(spark.createDataFrame(pairs, "y int, z int"), "y", "z").first()
    assert got["accuracy"] == 0.7 and got["sensitivity"] == 0.75 and got["specificity"] == pytest.approx(2 / 3)
    assert got["kappa"] == pytest.approx((0.7 - 0.5) / 0.5) and got["pos_pred_value"] == 0.6 and got["neg_pred_value"] == 0.8


def test_metrics_without_predicted_positives(spark):
    got = ev.classification_metrics(spark.createDataFrame([(1, 0), (0, 0)], "y int, z int"), "y", "z").first()
    assert got["pos_pred_value"] is None and got["kappa"] == 0.0


def test_compare_models_is_long(spark):
    one = ev.classification_metrics(spark.createDataFrame([(1, 1), (0, 0)], "y int, z int"), "y", "z")
    long = ev.compare_models({"Train": one, "Test": one})
    assert long.columns == ["dataset", "variable", "value"] and long.count() == 12


@pytest.mark.parametrize("p, score", [(0.9375, 62.0), (0.2, 800.0), (0.0, 1000.0)])
def test_score_rounds_half_even(spark, p, score):
    assert rows(spark, [(1, p)]).select(sc.risk_score(F.col("p"))).first()[0] == score


def test_band_edges(spark):
    df = spark.createDataFrame([(s,) for s in (0.0, 749.0, 750.0, 860.0, 1000.0, -1.0, 1000.5)], "s double")
    got = [r[0] for r in df.select(sc.band(F.col("s"), cat.BOOSTING_CUTS)).collect()]
    assert got == [1, 1, 2, 2, 4, None, None]


@pytest.mark.parametrize("top_good", [True, False])
def test_band_table_adds_up(spark, top_good):
    rnd = random.Random(7)
    df = spark.createDataFrame([(int(rnd.random() < 0.3), float(rnd.randrange(0, 1001))) for _ in range(500)], "y int, s double")
    table = sc.band_table(df, "y", "s", cat.FOREST_CUTS, top_good).orderBy("orden").collect()
    assert sum(r["nroestudiantes"] for r in table) == 500 and table[-1]["porc_acum"] == 100.0
    assert table[0]["grupos"] == ("(875,1000]" if top_good else "[0,649]")
    total = sum(r["dropout"] for r in table)
    assert table[-1]["porc_dropout_acum"] == pytest.approx(100 * total / 500, abs=0.01)


def test_quantile_cuts(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "s double")
    assert sc.quantile_cuts(df, "s") == pytest.approx([0.0, 15.0, 25.0, 60.0, 90.0, 1000.0])


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(4001).select(F.col("id").alias("key"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    first = split.stratified_split(df, "y", ["key"], 0.75, 1234)
    sizes = {(r["y"], r["train"]): r["count"] for r in first.groupBy("y", "train").count().collect()}
    assert sizes[1, True] == int(np.ceil(0.75 * 801)) and sizes[0, True] == 2400
    again = split.stratified_split(df.repartition(7), "y", ["key"], 0.75, 1234)
    assert first.exceptAll(again).count() == 0
    assert split.stratified_split(df, "y", ["key"], 0.75, 99).exceptAll(first).count() > 0


def test_split_equals_global_ranking(spark):
    df = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") % 3).cast("int").alias("y"))
    got = {r["key"] for r in split.stratified_split(df, "y", ["key"], 0.6, 7).where("train").collect()}
    hashed = df.select("key", "y", split.hash_value(["key"], 7).alias("h")).collect()
    want = set()
    for y in range(3):
        mine = sorted((r["h"], r["key"]) for r in hashed if r["y"] == y)
        want |= {k for _, k in mine[: int(np.ceil(0.6 * len(mine)))]}
    assert got == want


def test_split_tiny_classes(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "key long, y int")
    got = {r["key"]: r["train"] for r in split.stratified_split(df, "y", ["key"], 0.75, 1).collect()}
    assert got == {1: True, 2: True, 3: True}


def test_four_sets(spark):
    df = split.stratified_split(spark.range(100).select(F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("y")), "y", ["key"], 0.75, 1)
    sets = split.four_sets(df, df.drop("train").limit(3))
    assert {k: v.count() for k, v in sets.items()} == {"Train": 76, "Test": 24, "Toda": 100, "Back": 3}
