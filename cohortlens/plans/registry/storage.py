"""Queries of sources and sinks: write to the shared folder, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import sources
from cohortlens.plans.registry.base import query
from cohortlens.session import cut_lineage, work_path

LOGIN_SCHEMA = "site_uid string, periodo_week int, user_id long, tt_login long"


@query("src1", "SELECT * FROM part")
def src1(w):
    return w.table("part")


@query("src2", "SELECT * FROM weekly_login")
def src2(w):
    path = work_path(w.spark, "logins")
    sources.export_csv(w.weekly_logins().select("site_uid", "periodo_week", "user_id", "tt_login"), path)
    return sources.read_csv(w.spark, path, LOGIN_SCHEMA)


@query("src3", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def src3(w):
    path = work_path(w.spark, "wide")
    rows = w.table("orders").select("o_orderkey", "o_custkey", F.lit(None).cast("double").alias("empty"), "o_totalprice")
    sources.export_csv(rows, path)
    return sources.read_wide(w.spark, path, "o_orderkey long, o_custkey long, empty double, o_totalprice double")


def _weeks(w, again=()):
    """Every week of the panel stored on its own; the weeks of ``again`` once more."""
    path = work_path(w.spark, "weeks")
    logins = cut_lineage(w.weekly_logins(), "logins")
    weeks = [r[0] for r in logins.select("periodo_week").distinct().orderBy("periodo_week").collect()]
    for week in [*weeks, *again]:
        sources.write_period(logins.where(F.col("periodo_week") == week).drop("periodo_week"), path, week)
    return path


@query("src4", "SELECT site_uid, user_id, tt_login FROM weekly_login WHERE periodo_week = 5")
def src4(w):
    return sources.read_period(w.spark, _weeks(w), 5)


@query("snk1", "SELECT * FROM weekly_resource")
def snk1(w):
    path = work_path(w.spark, "resources")
    sources.write_parquet(w.weekly_resources(), path)
    return sources.read_table(w.spark, path.rsplit("/", 1)[0], "resources")


@query("snk2", "SELECT site_uid, user_id, tt_login, periodo_week FROM weekly_login")
def snk2(w):
    # the second write of week 5 replaces the first
    return w.spark.read.parquet(_weeks(w, (5,)))


@query("snk3", "SELECT * FROM weekly_login")
def snk3(w):
    rows = w.weekly_logins().select("site_uid", "periodo_week", "user_id", "tt_login")
    return sources.read_csv(w.spark, sources.write_wide(rows, work_path(w.spark, "wide"), 5), LOGIN_SCHEMA)


@query("snk4", "SELECT site_id, title, type, published FROM lms_site")
def snk4(w):
    path = work_path(w.spark, "sites")
    sources.export_csv(w.site().select("site_id", "title", "type", "published"), path)
    return sources.read_csv(w.spark, path, "site_id string, title string, type string, published int")
