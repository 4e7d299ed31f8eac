"""Queries of the indicator and assembly stages."""

from __future__ import annotations

from cohortlens.operators import trailing
from cohortlens.plans import catalogue as cat
from cohortlens.plans.registry.adapters import PERIOD
from cohortlens.plans.registry.base import query
from cohortlens.plans.registry.oracle import EVENT_WHERE, features_select
from cohortlens.session import cut_lineage

# one query per statistic, over every event metric
STATISTICS = {
    "f1": r"peranalisis",
    "f2": r"sum\ds",
    "f3": r"prom\ds",
    "f4": r"diff\ds",
    "f5": r"var\ds",
    "f6": r"max\ds",
    "f7": r"min\ds",
    "f8": r"sem\d",
    "f9": r"median\ds",
}


def _statistic(name: str, pattern: str) -> None:
    @query(name, features_select(cat.EVENT_METRICS, "weekly_event", EVENT_WHERE, pattern))
    def run(w):
        import re

        table = w.event_features()
        wanted = [c for c in table.columns if re.fullmatch(pattern, c.rsplit("_", 1)[-1])]
        return table.select("key_id", *wanted)


for _name, _pattern in STATISTICS.items():
    _statistic(_name, _pattern)


@query("f10", features_select(("tt_pres_begin",), "weekly_event", EVENT_WHERE))
def f10(w):
    return trailing.trailing_features(cut_lineage(w.weekly_events()), ("tt_pres_begin",), PERIOD, min_week=1)


@query("f11", "SELECT * FROM event_feature")
def f11(w):
    return w.event_features()


@query("f12", "SELECT * FROM resource_feature")
def f12(w):
    return w.resource_features()


@query("f13", "SELECT * FROM login_feature")
def f13(w):
    return w.login_features()


@query("f14", f"SELECT * FROM weekly_login WHERE periodo_week <= {PERIOD}")
def f14(w):
    return trailing.history(w.weekly_logins(), PERIOD)


@query("f15", f"""SELECT DISTINCT site_uid || '_' || CAST(user_id AS VARCHAR) AS key_id FROM weekly_event WHERE {EVENT_WHERE}""")
def f15(w):
    return trailing.key_spine(w.weekly_events(), PERIOD, min_week=1)


@query("f16", """SELECT o.site_uid || '_' || CAST(o.student_id AS VARCHAR) AS key_id, o.tasignaturas, o.marca_abandono,
    e.* EXCLUDE (key_id), r.* EXCLUDE (key_id), l.* EXCLUDE (key_id)
    FROM outcome o
    LEFT JOIN event_feature e ON e.key_id = o.site_uid || '_' || CAST(o.student_id AS VARCHAR)
    LEFT JOIN resource_feature r ON r.key_id = o.site_uid || '_' || CAST(o.student_id AS VARCHAR)
    LEFT JOIN login_feature l ON l.key_id = o.site_uid || '_' || CAST(o.student_id AS VARCHAR)""")
def f16(w):
    # the feature tables of a week are stored in buckets of the key between the stages
    return w.wide_rows()
