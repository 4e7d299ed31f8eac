"""Keys taken from dash-separated site codes ``SID-IDMASTER-IDASIGNATURA-IDPARALELO``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("sid", "idmaster", "idasignatura", "idparalelo")


def site_parts(site_id: Column) -> list[Column]:
    """The four parts of a site code; a part that is missing is NULL."""
    pieces = F.split(site_id, "-")
    return [F.get(pieces, F.lit(i)).alias(name) for i, name in enumerate(PARTS)]


def site_uid(site_id: Column) -> Column:
    """Programme edition of a site: parts 1, 2 and 4. NULL when any of them is missing."""
    pieces = F.split(site_id, "-")
    dash = F.lit("-")
    return F.concat(
        F.get(pieces, F.lit(0)), dash, F.get(pieces, F.lit(1)), dash, F.get(pieces, F.lit(3))
    )


def key_id(uid: Column, user_id: Column) -> Column:
    """Key of one student in one programme edition."""
    return F.concat(uid, F.lit("_"), user_id.cast("string"))


def with_site_parts(df: DataFrame, column: str = "site_id") -> DataFrame:
    """Spread a site code into its parts; the programme number becomes an int."""
    sid, master, course, group = site_parts(F.col(column))
    return df.select(
        "*",
        sid,
        master.try_cast("int").alias("idmaster"),
        course,
        group,
        site_uid(F.col(column)).alias("site_uid"),
    )
