"""Student enrolment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.keys import site_uid
from cohortlens.operators.keyfilter import key_filter, may_match
from cohortlens.operators.skew import heavy_keys, spread_join
from cohortlens.plans import catalogue as cat
from cohortlens.session import cut_lineage

#: Copies of a (site, user) pair that are written out from one array.
COPIES = 4096


def active_students(role_grants: DataFrame, roles: DataFrame, role: str = cat.STUDENT_ROLE) -> DataFrame:
    """Users with an active grant of the student role, each once.

    The role keys of one role name are few, and the grants that survive the join are combined
    map-side by ``distinct``; the size of ``roles`` decides between broadcast and shuffle join.
    """
    wanted = roles.where(F.col("role_name") == role).select("role_key").distinct()
    return (
        role_grants.where(F.col("active") == 1)
        .join(wanted, "role_key", "left_semi")
        .select("user_id")
        .distinct()
    )


def roster_sites(roster: DataFrame) -> DataFrame:
    return roster.select("site_uid", "fecha_inicio", "site_id", "tipo_sitio").distinct()


def _met(sites: DataFrame, students: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Sites and students that a log holds, its keys among them and their columns; all stored."""
    students = cut_lineage(students, "students")
    on = [c for c in ("site_id", "user_id") if c in seen.columns]
    keys = may_match(seen.select(*on), key_filter(students, ["user_id"]), ["user_id"])
    if "site_id" in on:
        keys = may_match(keys, key_filter(sites, ["site_id"]), ["site_id"])
    met = cut_lineage(keys.distinct(), "seen")
    if "site_id" in on:
        sites = cut_lineage(sites.join(met, "site_id", "left_semi"), "sites")
    return sites, cut_lineage(students.join(met, "user_id", "left_semi"), "students"), met, on


def enrol_students(
    site_user: DataFrame, roster: DataFrame, role_grants: DataFrame, roles: DataFrame, seen: DataFrame | None = None
) -> DataFrame:
    """Rows of ``site_user`` in rostered sites whose user is an active student.

    ``site_user`` is read once. A filter of the rostered sites, of fixed size, meets its rows in their scan, so rows of
    other sites are in no exchange. Repeated (site, user) rows are combined to a count before any exchange and
    written out again at the end. What is left is stored and filtered by the active students before it moves again: it
    tells the crowded sites, whose students are spread over tasks; a user of very many sites is left to the
    adaptive skew join.

    ``seen``, a log with ``user_id`` and perhaps ``site_id``, asks for the enrolment that a join with the log on these can
    meet: all rows in it stay, and only a few others. The log is read once for that, and students are filtered in the scan too.
    """
    # a site without programme edition has no rows
    sites = roster_sites(roster).where(site_uid(F.col("site_id")).isNotNull())
    students = active_students(role_grants, roles)
    named = site_user.select("site_id", "user_id").where(F.col("user_id").isNotNull())
    met, on = None, []
    if seen is not None:
        sites, students, met, on = _met(sites, students, seen)
    held = may_match(named, key_filter(sites, ["site_id"]), ["site_id"])
    if seen is not None:
        held = may_match(held, key_filter(students, ["user_id"]), ["user_id"])
    if len(on) > 1:
        # the last one, since it asks for both sides of what made the pairs and stays where it is
        held = may_match(held, key_filter(met, on), on)
    pairs = cut_lineage(held.groupBy("site_id", "user_id").agg(F.count(F.lit(1)).alias("_copies")), "pairs")
    of_students = pairs if seen is not None else may_match(pairs, key_filter(students, ["user_id"]), ["user_id"])
    crowded = heavy_keys(pairs, ["site_id"])
    in_roster = spread_join(of_students, sites, ["site_id"], "inner", ["user_id"], crowded)
    enrolled = in_roster.join(students, "user_id", "left_semi")
    columns = ["site_uid", "fecha_inicio", "site_id", "tipo_sitio", "user_id"]
    # copies are written out in blocks, so that no row holds an array as long as their number
    blocks = F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / COPIES))
    enrolled = enrolled.select(*columns, "_copies", F.explode(blocks).alias("_block"))
    rest = F.least(F.lit(COPIES), F.col("_copies") - F.col("_block") * COPIES)
    return enrolled.select(*columns, F.explode(F.sequence(F.lit(1), rest)).alias("_copy")).drop("_copy")


def enrolment_pairs(enrolment: DataFrame) -> DataFrame:
    """Programme-student pairs, each once."""
    return enrolment.select("site_uid", "user_id").distinct()


def student_site_counts(enrolment: DataFrame) -> DataFrame:
    """Number of sites of each kind per student and programme."""
    def kind(name: str):
        return F.count_if(F.col("tipo_sitio") == name)

    return enrolment.groupBy("site_uid", "user_id").agg(
        kind(cat.PROGRAMME).alias("tsite_programas"),
        kind(cat.COURSE).alias("tsite_asignaturas"),
        kind(cat.THESIS).alias("tsite_tfms"),
        kind(cat.OTHER_SITE).alias("tsite_otros"),
    )
