"""Site cleaning, programme selection and the programme roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.calendar import year_month
from cohortlens.functions.keys import with_site_parts
from cohortlens.functions.text import classify, repair_charset
from cohortlens.plans import catalogue as cat


def study_type(title: Column) -> Column:
    return classify({"title": F.upper(title)}, cat.STUDY_RULES, cat.STUDY_DEFAULT)


def site_type(title: Column, site_id: Column) -> Column:
    """Thesis sites first, then programme and course sites; case matters."""
    return classify({"title": title, "site_id": site_id}, cat.SITE_RULES, cat.OTHER_SITE)


def last_word(text: Column) -> Column:
    """School period: the last space-separated word of a title."""
    return F.try_element_at(F.split(text, " "), F.lit(-1))


def course_sites(sites: DataFrame) -> DataFrame:
    """Published course sites of real programmes; demo sites and broken codes are left out."""
    return sites.where(
        (F.col("published") == 1)
        & (F.col("type") == "course")
        & F.col("site_id").contains("PER")
        & ~F.col("title").rlike("^Demo*")
        & F.col("site_uid").isNotNull()
        & ~F.upper("site_id").rlike("^DEMO*")
    )


def clean_sites(sites: DataFrame) -> DataFrame:
    """Classified, publishable sites. The school period is read from the title before its repair."""
    parts = with_site_parts(
        sites.select(
            "site_id", "type", "published", "createdon",
            repair_charset(F.col("title")).alias("title"),
            last_word(F.col("title")).alias("periodo_escolar"),
        )
    )
    return course_sites(parts).select(
        study_type(F.col("title")).alias("tipo_estudio"),
        "site_uid",
        "periodo_escolar",
        "site_id",
        "idmaster",
        site_type(F.col("title"), F.col("site_id")).alias("tipo_sitio"),
        "title",
        "createdon",
        year_month(F.col("createdon")).alias("periodo"),
    )


def select_programmes(
    sites: DataFrame, kind: str = cat.STUDY_KIND, max_period: int = cat.LAST_START
) -> DataFrame:
    """Programme editions with a site of this study kind created up to ``max_period``."""
    return (
        sites.where((F.col("tipo_estudio") == kind) & (F.col("periodo") <= max_period))
        .select("site_uid")
        .distinct()
    )


def _kind_count(kind: str) -> Column:
    return F.count_if(F.col("tipo_sitio") == kind)


def programme_counts(sites: DataFrame) -> DataFrame:
    """Per school period and programme edition: row count, start, number of sites of each kind."""
    return sites.groupBy("periodo_escolar", "site_uid").agg(
        F.count(F.lit(1)).alias("tregistros"),
        F.min(F.when(F.col("tipo_sitio") == cat.PROGRAMME, F.col("createdon"))).alias("fecha_inicio"),
        _kind_count(cat.PROGRAMME).alias("tprogramas"),
        _kind_count(cat.COURSE).alias("tasignaturas"),
        _kind_count(cat.THESIS).alias("ttfm"),
    )


def viable_programmes(counts: DataFrame) -> DataFrame:
    """A programme site, more than four course sites and exactly one thesis site."""
    return counts.where((F.col("tprogramas") > 0) & (F.col("tasignaturas") > 4) & (F.col("ttfm") == 1))


def programme_roster(sites: DataFrame, selected: DataFrame) -> DataFrame:
    """Sites of the selected, viable programmes with the counts of their programme.

    The counts come from one map-side combined aggregate. Selection and viability are decided
    on one row per programme; only then do sites meet their programme, so no programme has to
    fit into one window partition, and a crowded one can be split by the adaptive skew join.
    Order the result where it is shown.
    """
    groups = viable_programmes(programme_counts(sites)).join(selected, "site_uid", "left_semi")
    return sites.join(groups, ["periodo_escolar", "site_uid"]).select(
        "site_uid", "periodo_escolar", "site_id", "idmaster", "tipo_sitio", "title", "createdon",
        "periodo", "tregistros", "fecha_inicio", "tprogramas", "tasignaturas", "ttfm",
    )
