"""Queries of the join forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import enrolment, trailing
from cohortlens.plans.registry.base import query


@query("jn1", """SELECT o.site_uid || '_' || CAST(o.student_id AS VARCHAR) AS key_id, o.tasignaturas, o.marca_abandono,
    l.tt_login_peranalisis, l.tt_login_sum4s FROM outcome o
    LEFT JOIN login_feature l ON l.key_id = o.site_uid || '_' || CAST(o.student_id AS VARCHAR)""")
def jn1(w):
    features = w.login_features().select("key_id", "tt_login_peranalisis", "tt_login_sum4s")
    return trailing.labelled_keys(w.outcomes()).join(features, "key_id", "left")


@query("jn2", """SELECT e.site_id, e.user_id, e.event_id, e.event_date, u.user_id IS NOT NULL AS enrolled FROM lms_event e
    LEFT JOIN (SELECT DISTINCT site_id, user_id FROM enrolment) u ON u.site_id = e.site_id AND u.user_id = e.user_id""")
def jn2(w):
    places = w.enrolment().select("site_id", "user_id", F.lit(True).alias("enrolled")).distinct()
    events = w.events().select("site_id", "user_id", "event_id", "event_date")
    joined = events.join(places, ["site_id", "user_id"], "left")
    return joined.withColumn("enrolled", F.coalesce("enrolled", F.lit(False)))


@query("jn3", """SELECT s.site_id, s.tipo_sitio, b.id AS gradebook_id, b.category_type FROM clean_site s
    LEFT JOIN lms_gradebook b ON b.gradebook_uid = s.site_id""")
def jn3(w):
    sites, books = w.clean_site(), w.gradebook()
    return sites.join(books, sites["site_id"] == books["gradebook_uid"], "left").select(
        sites["site_id"], "tipo_sitio", F.col("id").alias("gradebook_id"), "category_type"
    )


@query("jn4", """SELECT coalesce(e.key_id, l.key_id) AS key_id, e.tt_pres_begin_peranalisis, l.tt_login_peranalisis
    FROM event_feature e FULL JOIN login_feature l ON l.key_id = e.key_id""")
def jn4(w):
    w.places()
    events = w.event_features().select("key_id", "tt_pres_begin_peranalisis")
    return events.join(w.login_features().select("key_id", "tt_login_peranalisis"), "key_id", "full")


@query("jn5", "SELECT site_id, site_uid FROM clean_site WHERE site_uid IN (SELECT site_uid FROM selected)")
def jn5(w):
    from cohortlens.operators.programmes import select_programmes

    sites = w.clean_site()
    return sites.join(select_programmes(sites), "site_uid", "left_semi").select("site_id", "site_uid")


@query("jn6", "SELECT site_id, user_id FROM lms_site_user WHERE user_id IN (SELECT user_id FROM student)")
def jn6(w):
    students = enrolment.active_students(w.role_grant(), w.role())
    return w.site_user().join(students, "user_id", "left_semi").select("site_id", "user_id")


@query("jn7", """SELECT e.site_id, e.user_id, e.event_id, e.event_date, u.site_uid, u.fecha_inicio FROM lms_event e
    JOIN (SELECT DISTINCT * FROM enrolment) u ON u.site_id = e.site_id AND u.user_id = e.user_id""")
def jn7(w):
    places = w.enrolment().distinct().select("site_uid", "fecha_inicio", "site_id", "user_id")
    return w.events().select("site_id", "user_id", "event_id", "event_date").join(places, ["site_id", "user_id"])


@query("jn8", """SELECT user_id, role_key, active, role_name FROM lms_role_grant JOIN lms_role USING (role_key)""")
def jn8(w):
    # a dictionary of roles: its file size lets the planner broadcast it, no hint is needed
    return w.role_grant().join(w.role(), "role_key").select("user_id", "role_key", "active", "role_name")


@query("jn9", """SELECT u.site_uid, l.user_id, l.login_date, CAST(sum(l.login_count) AS BIGINT) AS logins FROM lms_login l
    JOIN (SELECT DISTINCT site_uid, user_id FROM enrolment) u ON u.user_id = l.user_id GROUP BY ALL""")
def jn9(w):
    daily = w.logins().groupBy("user_id", "login_date").agg(F.sum("login_count").alias("logins"))
    return enrolment.enrolment_pairs(w.enrolment()).join(daily, "user_id").select(
        "site_uid", "user_id", "login_date", "logins"
    )
