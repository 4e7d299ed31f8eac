"""Ratios, rounding and row-wise statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient as double; NULL on a zero base."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def row_sum(columns: Sequence[Column]) -> Column:
    total = columns[0]
    for column in columns[1:]:
        total = total + column
    return total


def row_mean(columns: Sequence[Column], digits: int = 3) -> Column:
    return F.round(row_sum(columns) / F.lit(float(len(columns))), digits)


def median_text(columns: Sequence[str]) -> str:
    """SQL text for the median of the non-NULL columns of a row; NULL if there is none.

    Two columns need a comparison only. Beyond that ``array_sort`` puts NULLs last, so the
    present values fill the first places and the middle one or two are read off.
    """
    doubles = [f"double({c})" for c in columns]
    if len(columns) == 2:
        a, b = doubles
        return f"coalesce(({a} + {b}) / 2D, {a}, {b})"
    ordered = f"array_sort(array({', '.join(doubles)}))"
    present = " + ".join(f"int({c} IS NOT NULL)" for c in columns)
    low = f"get({ordered}, int(floor(({present} - 1) / 2D)))"
    high = f"get({ordered}, int(floor(({present}) / 2D)))"
    return f"CASE WHEN {present} > 0 THEN ({low} + {high}) / 2D END"


def row_median(columns: Sequence[str]) -> Column:
    return F.expr(median_text([f"`{c}`" for c in columns]))
