import re

from pyspark.sql import functions as F

from cohortlens import sources
from cohortlens.operators import enrolment, programmes
from cohortlens.plans import stages
from cohortlens.session import work_path

SOURCES = {
    "sakai_site": "site", "sakai_site_user": "site_user", "sakai_realm_rl_gr": "role_grant", "sakai_realm_role": "role",
    "gb_gradebook_t": "gradebook", "gb_gradable_object_t": "gradable_object", "gb_grade_record_t": "grade_record",
    "sst_events": "events", "sst_resources": "resources", "sst_userstats": "logins",
}


def test_prepare_to_wide(spark, world):
    source, out = work_path(spark, "source"), work_path(spark, "out")
    for table, view in SOURCES.items():
        getattr(world, view)().write.parquet(f"{source}/{table}")
    stored = stages.prepare(spark, source, out)
    assert stored["weekly_events"].count() == world.weekly_events().count() > 0
    for week in (4, 5, 5):
        stages.indicators(spark, out, week)
    weeks = spark.read.parquet(f"{out}/event_features").groupBy("periodo_week").count().collect()
    want = world.event_features().count()
    assert {r["periodo_week"]: r["count"] for r in weeks}[5] == want
    wide = stages.wide_rows(spark, out, 5, csv=True)
    assert wide.count() == stored["outcomes"].count()
    assert len(wide.columns) == 3 + (49 + 12 + 1) * 25
    assert wide.where(F.col("tt_login_peranalisis").isNotNull()).count() > 0
    plan = stages.read_wide_rows(spark, out, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(periodo_week" in plan
    csv = spark.read.option("header", True).csv(f"{out}/csv/roster")
    assert csv.count() == stored["roster"].count()


def test_declared_columns_are_checked(spark):
    path = work_path(spark, "bad")
    spark.range(3).write.parquet(f"{path}/sst_userstats")
    from cohortlens.plans import schemas

    try:
        sources.read_table(spark, path, "sst_userstats", schemas.schema("sst_userstats"))
    except ValueError as error:
        assert "login_date" in str(error)
    else:
        raise AssertionError("a missing column went unnoticed")


def test_wide_reader_drops_empty_columns(spark):
    path = work_path(spark, "wide")
    sources.export_csv(spark.sql("select 1 a, cast(null as double) b, 'x' c"), path)
    assert sources.read_wide(spark, path, "a int, b double, c string").columns == ["a", "c"]


def test_parquet_file_count_is_an_option(spark):
    path = work_path(spark, "files")
    sources.write_parquet(spark.range(100), path, files=3)
    assert len(spark.read.parquet(path).inputFiles()) == 3


def test_sites_of_one_small_file_are_many_tasks_and_cleaned_once(spark, tmp_path):
    from cohortlens.plans.registry.adapters import World

    parts = spark.range(400_000).selectExpr(
        "id AS p_partkey", "CAST(id * 7 % 50 + 1 AS int) AS p_size", "concat('Brand#', hash(id)) AS p_brand"
    )
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    world = World(spark, str(tmp_path))
    assert world.clean_site().rdd.getNumPartitions() > 1
    roster = world.roster()
    assert "Exchange" not in roster._jdf.queryExecution().executedPlan().toString()
    sites = world.clean_site()
    want = programmes.programme_roster(sites, programmes.select_programmes(sites))
    assert roster.count() > 0
    assert roster.exceptAll(want).isEmpty() and want.exceptAll(roster).isEmpty()


def test_rows_of_other_sites_meet_the_roster_before_any_exchange(spark, world):
    users = world.site_user()
    found = enrolment.enrol_students(users, world.roster(), world.role_grant(), world.role())
    assert "_word" in found._jdf.queryExecution().executedPlan().toString()
    # numbers, not texts of sites, are in the exchange of the pairs
    assert re.search(r"hashpartitioning\(user_id#\d+L?, number#", users._jdf.queryExecution().executedPlan().toString())
