"""The batch stages: prepare, indicators of a week, wide rows of a week.

Every stage reads stored tables and writes stored tables, so each plan starts from files whose
size is known, a lost executor costs tasks rather than stages, and a stage can be run again on
its own. Running one again replaces its output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import enrolment as enrol
from cohortlens.operators import grades, programmes, trailing, weekly
from cohortlens.plans import schemas
from cohortlens.session import cut_lineage, tune
from cohortlens.sources import buckets_for, export_csv, read_period, read_table, store_bucketed, write_parquet, write_period

WEEK = "periodo_week"
FEATURES = ("event_features", "resource_features", "login_features")


def _store(df: DataFrame, out: str, name: str) -> DataFrame:
    write_parquet(df, f"{out}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{out}/{name}")


def prepare(spark: SparkSession, source: str, out: str, csv: bool = True) -> dict[str, DataFrame]:
    """Raw tables to roster, enrolment, outcomes and the three weekly tables."""
    tune(spark)

    def table(name: str) -> DataFrame:
        return read_table(spark, source, name, schemas.schema(name))

    # dealt, since a small file is one task, and stored before the filters, which would go into its scan
    dealt = cut_lineage(table("sakai_site").repartition("site_id"), "site")
    # the roster reads the cleaned sites three times
    sites = cut_lineage(programmes.clean_sites(dealt), "clean_site")
    stored = {"roster": _store(programmes.programme_roster(sites, programmes.select_programmes(sites)), out, "roster")}
    stored["enrolment"] = _store(
        enrol.enrol_students(
            table("sakai_site_user"), stored["roster"], table("sakai_realm_rl_gr"), table("sakai_realm_role")
        ),
        out, "enrolment",
    )
    stored["enrolment_pairs"] = _store(enrol.enrolment_pairs(stored["enrolment"]), out, "enrolment_pairs")
    stored["student_site_counts"] = _store(
        enrol.student_site_counts(stored["enrolment"]), out, "student_site_counts"
    )
    books = grades.gradebooks(table("gb_gradebook_t"), stored["roster"])
    items = grades.grade_items(table("gb_gradable_object_t"), books)
    flags = grades.outcome_flags(grades.grade_records(table("gb_grade_record_t"), items))
    stored["outcomes"] = _store(grades.student_outcomes(flags), out, "outcomes")
    places = stored["enrolment"]
    stored["weekly_events"] = _store(weekly.weekly_events(table("sst_events"), places), out, "weekly_events")
    stored["weekly_resources"] = _store(weekly.weekly_resources(table("sst_resources"), places), out, "weekly_resources")
    stored["weekly_logins"] = _store(weekly.weekly_logins(table("sst_userstats"), places), out, "weekly_logins")
    if csv:
        for name in ("roster", "enrolment_pairs", "student_site_counts", "outcomes"):
            export_csv(stored[name], f"{out}/csv/{name}")
    return stored


def indicators(spark: SparkSession, out: str, period: int, weeks: str = "observed") -> None:
    """Trailing statistics at one analysis week, written as that week's partition."""
    tune(spark)
    builders = (trailing.event_features, trailing.resource_features, trailing.login_features)
    panels = ("weekly_events", "weekly_resources", "weekly_logins")
    for name, panel, build in zip(FEATURES, panels, builders):
        features = build(read_table(spark, out, panel), period, weeks)
        write_period(features, f"{out}/{name}", period, WEEK)


def wide_rows(spark: SparkSession, out: str, period: int, csv: bool = False) -> DataFrame:
    """Labelled students with the features of one week."""
    tune(spark)
    labels = trailing.labelled_keys(read_table(spark, out, "outcomes"))
    parts = buckets_for(labels.count())
    tables = [labels, *[read_period(spark, f"{out}/{name}", period, WEEK) for name in FEATURES]]
    # the widest table is moved once, into buckets, and not again by each join
    wide = trailing.assemble(*[store_bucketed(t, "key_id", parts) for t in tables])
    write_period(wide, f"{out}/wide", period, WEEK)
    stored = read_period(spark, f"{out}/wide", period, WEEK)
    if csv:
        export_csv(stored, f"{out}/csv/wide_{period}")
    return stored


def read_wide_rows(spark: SparkSession, out: str, period: int) -> DataFrame:
    return spark.read.parquet(f"{out}/wide").where(F.col(WEEK) == period).drop(WEEK)
