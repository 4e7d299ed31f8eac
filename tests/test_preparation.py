import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import enrolment, grades, programmes, weekly


def sites(spark, rows):
    return spark.createDataFrame(rows, "site_id string, title string, type string, published int, createdon date")


def programme(number, day=1, courses=5, thesis=1, period="PER9"):
    start = dt.date(2022, 1, day)
    out = [(f"PER1-{number}-000-01", f"Máster A {period}", "course", 1, start)]
    out += [(f"PER1-{number}-{i:03d}-01", f"Curso {i} {period}", "course", 1, dt.date(2021, 1, 1)) for i in range(1, courses + 1)]
    out += [(f"PER1-{number}-9{i:02d}-01", f"Trabajo Fin de Máster {period}", "course", 1, start) for i in range(thesis)]
    return out


def test_roster_keeps_viable_programmes(spark):
    rows = programme(1) + programme(2, courses=4) + programme(3, thesis=2) + programme(4, thesis=0)
    clean = programmes.clean_sites(sites(spark, rows))
    roster = programmes.programme_roster(clean, programmes.select_programmes(clean))
    assert {r["site_uid"] for r in roster.collect()} == {"PER1-1-01"}
    first = roster.first()
    assert (first["tregistros"], first["tprogramas"], first["tasignaturas"], first["ttfm"]) == (7, 1, 5, 1)
    assert first["fecha_inicio"] == dt.date(2022, 1, 1)


def test_unpublished_demo_and_broken_sites_go(spark):
    day = dt.date(2022, 1, 1)
    rows = [
        ("PER1-1-000-01", "Máster A PER9", "course", 0, day), ("PER1-1-001-01", "Demo A PER9", "course", 1, day),
        ("PER1-1-002-01", "Máster A PER9", "project", 1, day), ("PER1-1-003", "Máster A PER9", "course", 1, day),
        ("demo-PER1-1-004-01", "Máster A PER9", "course", 1, day), ("PER1-1-005-01", None, "course", 1, day),
        ("PER1-1-006-01", "MÃ¡ster A PER9", "course", 1, day),
    ]
    got = programmes.clean_sites(sites(spark, rows)).collect()
    assert [(r["site_id"], r["title"], r["periodo_escolar"], r["tipo_estudio"]) for r in got] == [
        ("PER1-1-006-01", "Máster A PER9", "PER9", "MAESTRIA")
    ]


def test_late_programmes_are_not_selected(spark):
    clean = programmes.clean_sites(sites(spark, programme(1)))
    assert programmes.select_programmes(clean, max_period=202112).count() == 0


def test_two_periods_give_two_starts(spark):
    rows = programme(1, day=1, period="PER8")
    rows += [(s.replace("-01", "-01"), t.replace("PER8", "PER9"), k, p, d + dt.timedelta(days=7)) for s, t, k, p, d in rows]
    clean = programmes.clean_sites(sites(spark, rows))
    roster = programmes.programme_roster(clean, programmes.select_programmes(clean))
    assert {r["fecha_inicio"] for r in roster.collect()} == {dt.date(2022, 1, 1), dt.date(2022, 1, 8)}


def enrolled(spark, site_user):
    clean = programmes.clean_sites(sites(spark, programme(1)))
    roster = programmes.programme_roster(clean, programmes.select_programmes(clean))
    users = spark.createDataFrame(site_user, "site_id string, user_id string")
    grants = spark.createDataFrame([("u1", 2, 1), ("u1", 2, 1), ("u2", 2, 0), ("u3", 1, 1), ("u4", 2, 1)], "user_id string, role_key int, active int")
    roles = spark.createDataFrame([(1, "Profesor"), (2, "Alumno")], "role_key int, role_name string")
    return enrolment.enrol_students(users, roster, grants, roles)


def test_enrolment_keeps_active_students_and_copies(spark):
    rows = [("PER1-1-000-01", u) for u in ("u1", "u2", "u3", "u5")] + [("PER1-1-001-01", "u1")] * 2 + [("PER1-7-000-01", "u4")]
    got = enrolled(spark, rows)
    assert sorted((r["site_id"], r["user_id"]) for r in got.collect()) == [
        ("PER1-1-000-01", "u1"), ("PER1-1-001-01", "u1"), ("PER1-1-001-01", "u1"),
    ]
    assert enrolment.enrolment_pairs(got).count() == 1
    counts = enrolment.student_site_counts(got).first()
    assert (counts["tsite_programas"], counts["tsite_asignaturas"], counts["tsite_tfms"], counts["tsite_otros"]) == (1, 2, 0, 0)


@pytest.mark.parametrize("first, extra, rule", [
    (None, None, "1"), (40.0, None, "2"), (None, 40.0, "3"), (20.0, 20.0, "4"), (40.0, 40.0, None), (60.0, None, None),
])
def test_dropout_rules(spark, first, extra, rule):
    schema = "site_uid string, site_id string, student_id string, tipo_nota string, category_type int, points_possible double, points_earned double, points_earned_extra double"
    row = spark.createDataFrame([("p", "s", "u", "NOTA_FINAL", 2, 100.0, first, extra)], schema)
    flags = grades.outcome_flags(row).first()
    assert flags["detalle_abandono"] == rule and flags["marca_abandono"] == (rule is not None)


@pytest.mark.parametrize("first, extra, failed", [(40.0, 40.0, 1), (40.0, 60.0, 0), (60.0, None, 0), (None, None, 1)])
def test_failed_flag(spark, first, extra, failed):
    schema = "site_uid string, site_id string, student_id string, tipo_nota string, category_type int, points_possible double, points_earned double, points_earned_extra double"
    rows = spark.createDataFrame(
        [("p", "s", "u", "NOTA_FINAL", 2, 100.0, first, extra), ("p", "s", "v", "NOTA_FINAL", None, 100.0, first, extra),
         ("p", "s", "w", "NOTA_FINAL", 1, 100.0, first, extra), ("p", "s", "x", "TEST", 2, 100.0, first, extra)], schema)
    got = grades.outcome_flags(rows).collect()
    assert [(r["student_id"], r["marca_reprobado"]) for r in got] == [("u", failed)]


def test_books_without_items_stay(spark):
    books = spark.createDataFrame([(1, "p", "s", "t", 2, 0), (2, "p", "s", "t", 2, 0)], "gradebook_id long, site_uid string, site_id string, tipo_sitio string, category_type int, selected_grade_mapping_id long")
    objects = spark.createDataFrame([(10, 1, 0, None, "Test", 5.0, 0), (11, 9, 0, None, "Test", 5.0, 0)], "id long, gradebook_id long, object_type_id int, due_date date, name string, points_possible double, category_id long")
    got = sorted((r["gradebook_id"], r["gradable_object_id"]) for r in grades.grade_items(objects, books).collect())
    assert got == [(1, 10), (2, None)]


def places(spark):
    return spark.createDataFrame(
        [("P-1-01", dt.date(2022, 1, 3), "P-1-001-01", "B", "u"), ("P-1-01", dt.date(2022, 1, 3), "P-1-002-01", "B", "u"),
         ("P-2-01", dt.date(2022, 1, 10), "P-2-001-01", "B", "u")],
        "site_uid string, fecha_inicio date, site_id string, tipo_sitio string, user_id string")


def test_weekly_events(spark):
    rows = [
        ("P-1-001-01", "u", "content.read", dt.date(2022, 1, 3), 2), ("P-1-001-01", "u", "content.read", dt.date(2022, 1, 9), 3),
        ("P-1-002-01", "u", "not.listed", dt.date(2022, 1, 4), 7), ("P-1-001-01", "u", "pres.begin", dt.date(2022, 1, 10), 1),
        ("P-1-001-01", "x", "pres.begin", dt.date(2022, 1, 10), 1), ("P-1-001-01", "u", "pres.begin", None, 1),
        ("P-1-001-01", "u", "pres.begin", dt.date(2022, 1, 1), 4),
    ]
    events = spark.createDataFrame(rows, "site_id string, user_id string, event_id string, event_date date, event_count int")
    got = {r["periodo_week"]: r for r in weekly.weekly_events(events, places(spark)).collect()}
    assert sorted(got) == [0, 1, 2]
    assert (got[1]["tcursos_events"], got[1]["tt_content_read"], got[1]["tt_pres_begin"]) == (2, 5, 0)
    assert (got[2]["tcursos_events"], got[2]["tt_pres_begin"]) == (1, 1)
    assert len(got[1]) == 3 + 49


def test_logins_count_in_every_programme(spark):
    rows = [("u", dt.date(2022, 1, 4), 1), ("u", dt.date(2022, 1, 12), 2), ("u", dt.date(2021, 12, 1), 9), ("z", dt.date(2022, 1, 4), 1)]
    logins = spark.createDataFrame(rows, "user_id string, login_date date, login_count int")
    got = sorted((r["site_uid"], r["periodo_week"], r["tt_login"]) for r in weekly.weekly_logins(logins, places(spark)).collect())
    assert got == [("P-1-01", 1, 1), ("P-1-01", 2, 2), ("P-2-01", 1, 2)]


def test_resource_actions(spark):
    rows = [("P-1-001-01", "u", "/foro/1", a, dt.date(2022, 1, 3), n) for a, n in (("new", 1), ("read", 2), ("delete", 4))]
    res = spark.createDataFrame(rows, "site_id string, user_id string, resource_ref string, resource_action string, resource_date date, resource_count int")
    row = weekly.weekly_resources(res, places(spark)).first()
    assert (row["tres_up_foros"], row["tres_down_foros"], row["tres_up_doc"]) == (1, 2, 0)


def test_hot_student_is_compacted(spark):
    """A third of the log under one student shrinks to days x codes before the join."""
    day = dt.date(2022, 1, 3)
    rows = spark.range(30000).select(
        F.lit("P-1-001-01").alias("site_id"), F.when(F.col("id") % 3 == 0, "u").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("user_id"),
        F.lit("content.read").alias("event_id"), F.date_add(F.lit(day), (F.col("id") % 14).cast("int")).alias("event_date"), F.lit(1).alias("event_count"))
    daily = weekly._daily(rows, "event_date", "event_count", F.col("event_id"))
    assert daily.where("user_id = 'u'").count() == 14
    got = {r["periodo_week"]: r["tt_content_read"] for r in weekly.weekly_events(rows, places(spark)).collect()}
    assert sum(got.values()) == 10000 and sorted(got) == [1, 2]


def test_user_list_and_log_are_read_once(spark, tmp_path):
    clean = programmes.clean_sites(sites(spark, programme(1)))
    roster = programmes.programme_roster(clean, programmes.select_programmes(clean))
    rows = [("PER1-1-000-01", f"u{i}") for i in range(50)] * 2 + [("PER1-1-001-01", "u1"), (None, "u1"), ("PER1-1-000-01", None)]
    spark.createDataFrame(rows, "site_id string, user_id string").write.parquet(f"{tmp_path}/users")
    grants = spark.createDataFrame([(f"u{i}", 2, i % 2) for i in range(50)], "user_id string, role_key int, active int")
    roles = spark.createDataFrame([(2, "Alumno")], "role_key int, role_name string")
    got = enrolment.enrol_students(spark.read.parquet(f"{tmp_path}/users"), roster, grants, roles)
    assert got.count() == 51
    assert not any("/users/" in f for f in got.inputFiles())
    log = spark.createDataFrame([("u1", dt.date(2022, 1, 9), 3), ("u2", dt.date(2022, 1, 9), 4)], "user_id string, login_date date, login_count int")
    log.write.parquet(f"{tmp_path}/log")
    weeks = weekly.weekly_logins(spark.read.parquet(f"{tmp_path}/log"), got)
    assert not any("/log/" in f for f in weeks.inputFiles())
    assert [(r["user_id"], r["tt_login"]) for r in weeks.collect()] == [("u1", 3)]


def test_enrolment_of_a_log_leaves_out_what_the_log_cannot_meet(spark):
    clean = programmes.clean_sites(sites(spark, programme(1)))
    roster = programmes.programme_roster(clean, programmes.select_programmes(clean))
    rows = [(s, f"u{i}") for i in range(400) for s in ("PER1-1-000-01", "PER1-1-001-01")]
    users = spark.createDataFrame([*rows, *rows[:20], (None, "u2"), ("PER1-1-000-01", None)], "site_id string, user_id string")
    grants = spark.createDataFrame([(f"u{i}", 2, i % 2) for i in range(400)], "user_id string, role_key int, active int")
    roles = spark.createDataFrame([(2, "Alumno")], "role_key int, role_name string")
    day = dt.date(2022, 1, 9)
    # an unknown site and user, a user who is no active student, gaps, and what counts
    seen = [("PER1-1-000-01", "u3"), ("PER1-1-001-01", "u5"), ("PER1-1-000-01", "u4"), ("PER9-9-000-01", "u7"), (None, "u9"), ("PER1-1-000-01", None)]
    log = spark.createDataFrame([(s, u, "content.read", day, 1) for s, u in seen * 2], "site_id string, user_id string, event_id string, event_date date, event_count int")
    whole = enrolment.enrol_students(users, roster, grants, roles)
    part = enrolment.enrol_students(users, roster, grants, roles, log)
    assert whole.count() == 410 and 3 <= part.count() < 10
    assert part.exceptAll(whole).count() == 0
    pair = ["site_id", "user_id"]
    assert sorted(tuple(r) for r in part.join(log, pair, "left_semi").select(*pair).collect()) == [
        ("PER1-1-000-01", "u3"), ("PER1-1-000-01", "u3"), ("PER1-1-001-01", "u5"), ("PER1-1-001-01", "u5"),
    ]
    both = [sorted(tuple(r) for r in weekly.weekly_events(log, places).collect()) for places in (whole, part)]
    assert both[0] == both[1] and len(both[0]) == 2
    logins = spark.createDataFrame([("u3", day, 2), ("u4", day, 1), (None, day, 1), ("u999", day, 1)], "user_id string, login_date date, login_count int")
    few = enrolment.enrol_students(users, roster, grants, roles, logins)
    assert few.select("user_id").distinct().count() < 10
    both = [sorted(tuple(r) for r in weekly.weekly_logins(logins, places).collect()) for places in (whole, few)]
    assert both[0] == both[1] == [(both[0][0][0], 2, "u3", 2)]
    assert enrolment.enrol_students(users, roster, grants, roles, log.limit(0)).count() == 0
