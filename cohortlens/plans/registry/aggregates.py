"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import columns as ops
from cohortlens.operators import scorecard
from cohortlens.operators.prefix import quantiles
from cohortlens.operators.selection import ks_bins, missing_rate
from cohortlens.plans.registry.base import query
from cohortlens.plans.registry.oracle import VARIABLES
from cohortlens.plans.registry.projections import MISSING, PIVOT
from cohortlens.plans.registry.selection import stored_counts


@query("agg1", "SELECT user_id, login_date, CAST(sum(login_count) AS BIGINT) AS logins FROM lms_login GROUP BY ALL")
def agg1(w):
    return w.logins().groupBy("user_id", "login_date").agg(F.sum("login_count").alias("logins"))


@query("agg2", """SELECT user_id, CAST(sum(event_count) FILTER (WHERE event_id = 'forums.read') AS BIGINT) AS forums_read,
    CAST(sum(event_count) FILTER (WHERE event_id = 'content.read') AS BIGINT) AS content_read FROM lms_event GROUP BY user_id""")
def agg2(w):
    count, event = F.col("event_count"), F.col("event_id")
    return w.events().groupBy("user_id").agg(
        ops.sum_if(count, event == "forums.read").alias("forums_read"),
        ops.sum_if(count, event == "content.read").alias("content_read"),
    )


@query("agg3", "SELECT o_custkey, count(*) FILTER (WHERE o_totalprice > 250000) AS large FROM orders GROUP BY o_custkey")
def agg3(w):
    return w.table("orders").groupBy("o_custkey").agg(ops.count_rows_if(F.col("o_totalprice") > 250000).alias("large"))


@query("agg4", "SELECT site_id, count(DISTINCT user_id) AS students FROM lms_event GROUP BY site_id")
def agg4(w):
    return w.events().groupBy("site_id").agg(F.count_distinct("user_id").alias("students"))


@query("agg5", """SELECT site_uid, student_id, max(marca_abandono) AS worst, min(marca_abandono) AS best, max(points_earned) AS top
    FROM flag GROUP BY site_uid, student_id""")
def agg5(w):
    from cohortlens.operators.grades import outcome_flags

    return outcome_flags(w.records()).groupBy("site_uid", "student_id").agg(
        F.max("marca_abandono").alias("worst"), F.min("marca_abandono").alias("best"), F.max("points_earned").alias("top")
    )


@query("agg6", """SELECT site_uid, user_id, quantile_cont(CAST(tt_login AS DOUBLE), 0.5) AS median FROM weekly_login
    GROUP BY site_uid, user_id""")
def agg6(w):
    # one group holds the weeks of one student
    return w.weekly_logins().groupBy("site_uid", "user_id").agg(F.percentile("tt_login", 0.5).alias("median"))


@query("agg7", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def agg7(w):
    return w.table("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("agg8", "SELECT DISTINCT user_id, 'Alumno' AS role_name FROM student")
def agg8(w):
    grants = w.role_grant().where("active = 1").join(w.role().where("role_name = 'Alumno'"), "role_key")
    return grants.select("user_id", "role_name").dropDuplicates(["user_id"])


@query("agg9", f"SELECT user_id, {PIVOT} FROM weekly_login GROUP BY user_id")
def agg9(w):
    return ops.pivot_weeks(w.weekly_logins(), "user_id", "periodo_week", "tt_login", range(1, 7))


@query("agg10", "SELECT label, count(*) AS n FROM ml_rows GROUP BY label")
def agg10(w):
    return scorecard.class_balance(w.ml_rows(), "label")


@query("agg11", f"SELECT variable, round(missing, 9) AS missing FROM ({MISSING})")
def agg11(w):
    return missing_rate(w.ml_rows().select(*VARIABLES)).select("variable", F.round("missing", 9).alias("missing"))


@query("agg12", "SELECT variable, bin, n1 AS dropout, n - n1 AS nodropout FROM ks_bin")
def agg12(w):
    return ks_bins(stored_counts(w)).select(
        "variable", "bin", F.col("n1").alias("dropout"), (F.col("n") - F.col("n1")).alias("nodropout")
    )


PROBS = (0.15, 0.25, 0.5, 0.6, 0.75, 0.9)


@query("agg13", " UNION ALL ".join(
    f"SELECT CAST({p} AS DOUBLE) AS prob, round(quantile_cont(l_extendedprice, {p}), 6) AS value FROM lineitem" for p in PROBS))
def agg13(w):
    return quantiles(w.table("lineitem"), "l_extendedprice", PROBS).select("prob", F.round("value", 6).alias("value"))


def _hist(width: int) -> str:
    return f"""SELECT floor(s / {width}) * {width} AS start, count(*) AS n FROM (SELECT round_even((1 - p) * 1000, 0) AS s FROM ml_rows)
        GROUP BY 1"""


@query("agg14", f"SELECT 100 AS width, CAST(start AS DOUBLE) AS start, n FROM ({_hist(100)}) UNION ALL SELECT 50, CAST(start AS DOUBLE), n FROM ({_hist(50)})")
def agg14(w):
    scored = w.ml_rows().select(scorecard.risk_score(F.col("p")).alias("s"))
    parts = [scorecard.histogram(scored, "s", width).select(F.lit(width).alias("width"), "start", "n") for width in (100, 50)]
    return parts[0].unionByName(parts[1])


@query("agg15", """SELECT label, n, round(sum(n) OVER () / (2.0::DOUBLE * n), 9) AS weight FROM (SELECT label, count(*) AS n FROM ml_rows GROUP BY label)""")
def agg15(w):
    from pyspark.sql import Window

    counts = scorecard.class_balance(w.ml_rows(), "label")
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select("label", "n", F.round(total / (2.0 * F.col("n")), 9).alias("weight"))
