import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators.prefix import quantiles, quantiles_by, running_totals
from cohortlens.operators.skew import heavy_keys, spread_join


@pytest.fixture(scope="module")
def crowded(spark):
    """One key holds about a third of the rows, one row per hundred has no key."""
    rnd = random.Random(5)
    rows = [(("hot" if rnd.random() < 0.35 else f"k{rnd.randrange(900)}") if rnd.random() > 0.01 else None, i) for i in range(6000)]
    return spark.createDataFrame(rows, "k string, v int"), rows


def test_heavy_keys_are_few(spark, crowded):
    assert [r["k"] for r in heavy_keys(crowded[0], ["k"]).collect()] == ["hot"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_join(spark, crowded, how):
    left, _ = crowded
    right = spark.createDataFrame(
        [("hot", "a"), ("hot", "b"), *[(f"k{i}", "c") for i in range(0, 900, 2)], (None, "n")], "k string, t string"
    )
    want = sorted(map(str, left.join(right, "k", how).collect()))
    got = sorted(map(str, spread_join(left, right, ["k"], how, ["v"], salts=16).collect()))
    assert got == want


def test_spread_join_spreads_the_hot_key(spark, crowded):
    left, _ = crowded
    heavy = heavy_keys(left, ["k"])
    salt = F.pmod(F.xxhash64("v"), F.lit(16))
    sizes = left.join(F.broadcast(heavy), "k").groupBy(salt).count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 400


def test_spread_join_refuses_full():
    with pytest.raises(ValueError):
        spread_join(None, None, ["k"], "full")


@pytest.mark.parametrize("size, stored", [(100, False), (37, True), (600, False), (1_000_000, True)])
def test_running_totals_brute_force(spark, size, stored):
    rnd = random.Random(1)
    values = {g: {round(rnd.gauss(0, 10), 2): rnd.randrange(1, 9) for _ in range(300)} for g in ("a", "b")}
    rows = [(g, v, n) for g, vs in values.items() for v, n in vs.items()]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    got = {(r["g"], r["v"]): (r["before_n"], r["all_n"], r["previous"]) for r in running_totals(df, "v", ["n"], ["g"], size, stored).collect()}
    assert len(got) == len(rows)
    for g, vs in values.items():
        before, previous = 0, None
        for v in sorted(vs):
            assert got[g, v] == (before, sum(vs.values()), previous)
            before, previous = before + vs[v], v


def test_running_totals_read_their_input_once(spark, tmp_path):
    spark.range(5000).selectExpr("id % 997 AS v", "id % 3 AS g").write.parquet(str(tmp_path / "rows"))
    counts = spark.read.parquet(str(tmp_path / "rows")).groupBy("v").agg(F.count("*").alias("n"))
    for size in (100, 1_000_000):
        found = running_totals(counts, "v", ["n"], size=size)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert str(tmp_path / "rows") not in plan and found.agg(F.max(F.col("before_n") + F.col("n"))).first()[0] == 5000
        if size == 100:  # no range far above its size
            ranges = found.groupBy(F.floor((F.col("before_n")) / 5)).count()
            assert ranges.count() > 5


def test_quantiles_match_numpy(spark):
    rnd = random.Random(2)
    for data in ([rnd.gauss(0, 1) for _ in range(1001)], [rnd.randrange(4) * 1.0 for _ in range(500)], [3.0], [1.0, 2.0]):
        df = spark.createDataFrame([(x,) for x in data] + [(None,)], "x double")
        probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
        got = [r["value"] for r in quantiles(df, "x", probs).orderBy("prob").collect()]
        assert np.allclose(got, np.quantile(data, probs), rtol=0, atol=1e-12)


def test_quantiles_by_group(spark):
    counts = spark.sql("select 'a' g, 1D value, 3L n union all select 'a', 5D, 1L union all select 'b', 2D, 4L union all select 'b', null, 9L")
    got = {r["g"]: list(r["edges"]) for r in quantiles_by(counts, [0.5, 1.0], by=["g"]).collect()}
    assert got == {"a": [1.0, 5.0], "b": [2.0, 2.0]}
