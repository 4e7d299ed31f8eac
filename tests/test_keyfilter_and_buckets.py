"""The filter of keys ahead of the first exchange, and joins of bucketed tables."""

import re

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import trailing, weekly
from cohortlens.operators.keyfilter import key_filter, may_match
from cohortlens.session import cut_lineage, work_path
from cohortlens.sources import buckets_for, read_bucketed, store_bucketed


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("words", [1 << 20, 64])
def test_filter_keeps_every_key(spark, words):
    keys = spark.range(400).select((F.col("id") % 7).alias("a"), F.concat(F.lit("u"), "id").alias("b"))
    rows = spark.range(20_000).select((F.col("id") % 7).alias("a"), F.concat(F.lit("u"), "id").alias("b"), F.lit(1).alias("_word"))
    rows = rows.unionByName(rows.limit(3).withColumn("b", F.lit(None)))
    held = key_filter(keys, ["a", "b"], words)
    assert held.count() <= min(400, words)
    found = may_match(rows.drop("_word"), held, ["a", "b"], words)
    assert found.join(keys, ["a", "b"], "left_semi").count() == 400
    if words > 1000:
        assert found.count() < 420


def test_empty_filter_keeps_nothing(spark):
    rows = spark.range(10).select("id")
    assert may_match(rows, key_filter(rows.limit(0), ["id"]), ["id"]).count() == 0


def test_log_meets_the_filter_ahead_of_the_exchange(spark, world):
    places = cut_lineage(world.enrolment(), "enrolment")
    daily = weekly._daily(world.events(), "event_date", "event_count", F.col("event_id"), places)
    known = world.events().join(places.select("site_id", "user_id").distinct(), ["site_id", "user_id"], "left_semi")
    want = known.where("event_date IS NOT NULL").select("site_id", "user_id", F.col("event_date").cast("date"), "event_id").distinct()
    assert want.count() <= daily.count() <= want.count() * 1.05 + 5 < world.events().count()
    # from the scan upwards: the filter's join, the partial sum, then the exchange
    plan = plan_of(daily)
    assert plan.index("Exchange hashpartitioning(site_id") < plan.index("BroadcastHashJoin")


def test_buckets_follow_the_rows():
    assert [buckets_for(n) for n in (0, 1, 10_000, 10_001, 10**9)] == [1, 1, 1, 2, 100_000]


def test_bucketed_tables_join_without_exchange_or_sort(spark):
    left = spark.range(900).select(F.concat(F.lit("k"), F.col("id")).alias("key_id"), F.col("id").alias("tasignaturas"))
    right = spark.range(0, 1200, 2).select(F.concat(F.lit("k"), F.col("id")).alias("key_id"), (F.col("id") * 2).alias("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = [store_bucketed(t, "key_id", 5) for t in (left, right, right.withColumnRenamed("x", "y"), right.withColumnRenamed("x", "z"))]
        joined = trailing.assemble(*tables)
        plan = plan_of(joined)
        assert "Exchange" not in plan and not re.search(r"\bSort\b", plan) and plan.count("SortMergeJoin") >= 3
        got = {r["key_id"]: (r["x"], r["y"], r["z"]) for r in joined.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 900 and got["k4"] == (8, 8, 8) and got["k5"] == (None, None, None)


def test_placed_rows_and_named_again(spark):
    path = work_path(spark, "again")
    rows = spark.range(500).select(F.col("id").cast("string").alias("key_id"), "id")
    first = store_bucketed(rows.repartition(4, "key_id"), "key_id", 4, path=path, placed=True)
    second = read_bucketed(spark, path, "key_id", 4)
    assert first.count() == second.count() == 500
    assert second.groupBy("key_id").count().where("count > 1").count() == 0
    assert "Exchange" not in plan_of(first.join(second.hint("merge"), "key_id"))


def test_vectors_add_rows_of_one_week(spark):
    """Two rows of a student in one week count together; NULL adds nothing; old weeks keep the student."""
    panel = spark.createDataFrame(
        [("s", 5, 1, 2, None), ("s", 5, 1, 3, 4), ("s", 4, 1, None, None), ("s", 1, 2, 9, 9), ("s", 2, 3, 1, 1), ("s", 3, 3, 1, 1)],
        "site_uid string, periodo_week int, user_id int, a int, b int",
    )
    for parts in (None, 3):
        got = {r["key_id"]: r for r in trailing.trailing_features(panel, ("a", "b"), 5, parts=parts).collect()}
        assert len(got) == 3
        one = got["s_1"]
        assert (one["a_peranalisis"], one["b_peranalisis"], one["a_sum2s"], one["b_sum2s"]) == (5, 4, 5, 4)
        assert got["s_2"]["a_sum4s"] == 0 and got["s_3"]["a_sum4s"] == 2


def test_filter_sinks_below_distinct_rows_union_and_join(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 50).alias("order"), (F.col("id") % 20).alias("part"))
    rows.write.parquet(f"{tmp_path}/lines")
    spark.range(50).select(F.col("id").alias("no"), (F.col("id") * 7 % 9).alias("user")).write.parquet(f"{tmp_path}/orders")
    lines, orders = spark.read.parquet(f"{tmp_path}/lines"), spark.read.parquet(f"{tmp_path}/orders")
    sold = lines.join(orders.hint("merge"), F.col("order") == F.col("no")).select("user", "part")
    pairs = sold.union(spark.createDataFrame([(1, 3), (1, 99)], "user long, part long")).distinct()
    named = pairs.select("user", F.concat(F.lit("s"), F.col("part").cast("string")).alias("site"))
    keys = spark.createDataFrame([("s3",), ("s4",)], "site string")
    found = may_match(named, key_filter(keys, ["site"]), ["site"])
    text = plan_of(found)
    assert text.index("SortMergeJoin") < text.index("LeftSemi")
    wanted = {tuple(r) for r in named.where("site in ('s3', 's4')").collect()}
    assert {tuple(r) for r in found.join(keys, "site", "left_semi").select("user", "site").collect()} == wanted
