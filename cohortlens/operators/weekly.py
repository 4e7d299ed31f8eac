"""Weekly roll-ups of the three activity logs to (programme, study week, student).

The enrolment is read twice, for the filter of the log and for the join: pass a stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.calendar import study_week
from cohortlens.functions.text import classify, repair_charset
from cohortlens.operators.columns import fill_cast_numeric
from cohortlens.operators.keyfilter import key_filter, may_match
from cohortlens.plans import catalogue as cat
from cohortlens.session import cut_lineage

GROUP = ("site_uid", "periodo_week", "user_id")


def _daily(log: DataFrame, day: str, amount: str, code: Column, enrolment: DataFrame | None = None) -> DataFrame:
    """Log of enrolled students compacted to one row per site, student, day and code.

    A filter of the enrolled (site, student) pairs, of fixed size, meets the log in its scan, so
    rows of other sites and users are in no exchange. The sums are combined before the exchange as
    well: a student or site with a huge share of the log shrinks to at most days x codes rows
    before any join sees it.
    """
    pair = ["site_id", "user_id"]
    rows = log.where(F.col(day).isNotNull()).select(
        *pair, F.col(day).cast("date").alias("day"), code.alias("code"), F.col(amount).alias("amount")
    )
    known = rows if enrolment is None else may_match(rows, key_filter(enrolment, pair), pair)
    return known.groupBy(*pair, "day", "code").agg(F.sum("amount").alias("amount"))


def _in_study_weeks(daily: DataFrame, enrolment: DataFrame) -> DataFrame:
    """Daily rows of enrolled students with their study week. An unknown start counts as week 0.

    The log, small by now, is stored: a filter of its pairs meets the enrolment in its scan, so students and
    sites without activity are in no exchange either.
    """
    pair = ["site_id", "user_id"]
    daily = cut_lineage(daily, "daily")
    active = may_match(enrolment, key_filter(daily, pair), pair)
    places = active.select("site_uid", "fecha_inicio", "site_id", "tipo_sitio", "user_id").distinct()
    return daily.join(places, pair).withColumn(
        "periodo_week", F.coalesce(study_week(F.col("day"), F.col("fecha_inicio")), F.lit(0))
    )


def weekly_events(
    events: DataFrame, enrolment: DataFrame, event_ids: tuple[str, ...] = cat.EVENT_IDS
) -> DataFrame:
    """Distinct sites and one filtered sum per catalogued event id.

    Events outside the catalogue add no count of their own but keep the week and the site alive;
    they share one code. NULL sums become 0 and every counter an int.
    """
    code = F.when(F.col("event_id").isin(*event_ids), F.col("event_id"))
    joined = _in_study_weeks(_daily(events, "event_date", "event_count", code, enrolment), enrolment)
    per_site = joined.groupBy(*GROUP, "site_id", "code").agg(F.sum("amount").alias("amount"))
    out = per_site.groupBy(*GROUP).agg(
        F.count_distinct("site_id").alias(cat.SITE_COUNT),
        *[F.sum(F.when(F.col("code") == e, F.col("amount"))).alias(cat.event_metric(e)) for e in event_ids],
    )
    return fill_cast_numeric(out, GROUP)


def resource_kind(ref: Column) -> Column:
    return classify({"ref": F.upper(ref)}, cat.RESOURCE_RULES, cat.RESOURCE_DEFAULT)


def weekly_resources(resources: DataFrame, enrolment: DataFrame) -> DataFrame:
    """Uploads and downloads per resource kind, NULL sums as 0, counters as int."""
    way = F.col("resource_action")
    counted = way.isin(*cat.RESOURCE_ACTIONS)
    kind = resource_kind(repair_charset(F.col("resource_ref")))
    code = F.when(counted, F.concat(kind, F.lit("/"), way))
    joined = _in_study_weeks(_daily(resources, "resource_date", "resource_count", code, enrolment), enrolment)
    sums = [
        F.sum(F.when(F.col("code") == f"{kind}/{action}", F.col("amount"))).alias(f"tres_{prefix}_{part}")
        for kind, part in cat.RESOURCE_KINDS.items()
        for action, prefix in cat.RESOURCE_ACTIONS.items()
    ]
    return fill_cast_numeric(joined.groupBy(*GROUP).agg(*sums), GROUP)


def weekly_logins(logins: DataFrame, enrolment: DataFrame) -> DataFrame:
    """Logins per week, from week 1 on. A login names no site, so it counts in every programme
    of the student. Logins of users who are enrolled nowhere are left out in the scan. Daily sums bound the login side to days per student; a student of very many
    programmes is on the side that the adaptive skew join can split."""
    rows = logins.where(F.col("login_date").isNotNull()).select(
        "user_id", F.col("login_date").cast("date").alias("day"), "login_count"
    )
    known = may_match(rows, key_filter(enrolment, ["user_id"]), ["user_id"])
    daily = cut_lineage(known.groupBy("user_id", "day").agg(F.sum("login_count").alias("amount")), "daily")
    active = may_match(enrolment, key_filter(daily, ["user_id"]), ["user_id"])
    places = active.select("site_uid", "fecha_inicio", "user_id").distinct()
    return (
        places.join(daily, "user_id")
        .withColumn("periodo_week", study_week(F.col("day"), F.col("fecha_inicio")))
        .where(F.col("periodo_week") >= 1)
        .groupBy(*GROUP)
        .agg(F.sum("amount").alias(cat.LOGIN_METRIC))
    )
