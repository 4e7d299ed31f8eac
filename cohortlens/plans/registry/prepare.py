"""Queries of the preparation stage."""

from __future__ import annotations

from cohortlens.operators import enrolment, grades, programmes
from cohortlens.plans.registry.base import query


@query("pre1", "SELECT * FROM clean_site")
def pre1(w):
    return w.clean_site()


@query("pre2", "SELECT * FROM selected")
def pre2(w):
    return programmes.select_programmes(w.clean_site())


@query("pre3", "SELECT * FROM roster")
def pre3(w):
    return w.roster()


@query("pre4", "SELECT * FROM enrolment")
def pre4(w):
    return w.enrolment()


@query("pre5", "SELECT DISTINCT site_uid, user_id FROM enrolment")
def pre5(w):
    return enrolment.enrolment_pairs(w.enrolment())


@query("pre6", """SELECT site_uid, user_id, count(*) FILTER (WHERE tipo_sitio = 'A. Programa') AS tsite_programas,
    count(*) FILTER (WHERE tipo_sitio = 'B. Asignatura') AS tsite_asignaturas,
    count(*) FILTER (WHERE tipo_sitio = 'C. TFM') AS tsite_tfms, count(*) FILTER (WHERE tipo_sitio = 'D. Otros') AS tsite_otros
    FROM enrolment GROUP BY site_uid, user_id""")
def pre6(w):
    return enrolment.student_site_counts(w.enrolment())


@query("pre7", "SELECT * FROM book")
def pre7(w):
    return w.books()


@query("pre8", "SELECT * FROM item")
def pre8(w):
    return w.items()


@query("pre9", "SELECT * FROM record")
def pre9(w):
    return w.records()


@query("pre10", "SELECT * FROM flag")
def pre10(w):
    return grades.outcome_flags(w.records())


@query("pre11", "SELECT * FROM outcome")
def pre11(w):
    return w.outcomes()


@query("pre12", "SELECT * FROM weekly_event")
def pre12(w):
    return w.weekly_events()


@query("pre13", "SELECT * FROM weekly_resource")
def pre13(w):
    return w.weekly_resources()


@query("pre14", "SELECT * FROM weekly_login")
def pre14(w):
    return w.weekly_logins()
