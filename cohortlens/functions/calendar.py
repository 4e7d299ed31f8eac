"""Calendar columns and the study-week number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_month(day: Column) -> Column:
    """``yyyyMM`` as an int."""
    return (F.year(day) * 100 + F.month(day)).cast("int")


def week_of_month(day: Column) -> Column:
    """Week of the month, weeks starting on Sunday, the first one possibly short."""
    first = F.dayofweek(F.trunc(day, "MM"))
    return F.ceil((F.dayofmonth(day) + first - 1) / F.lit(7.0)).cast("int")


def day_name(day: Column) -> Column:
    """Short English name of the day."""
    return F.date_format(day, "E")


def weekend_flag(day: Column) -> Column:
    """1 on Saturday and Sunday, else 0."""
    return F.when(F.dayofweek(day).isin(1, 7), 1).otherwise(0)


def study_week(day: Column, start: Column) -> Column:
    """Week since the start of the programme, counted from 1.

    The quotient is truncated towards zero, so week 0 covers the 13 days before the start.
    """
    return (F.datediff(day, start) / F.lit(7.0) + 1).cast("int")
