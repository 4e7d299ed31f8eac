"""Column-list operators: selection by position, name pattern or type, renaming, NULL handling."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType


def last_weeks(df: DataFrame, count: int = 5) -> DataFrame:
    """Key (first column) and the last ``count`` week columns of a pivot."""
    weeks = df.columns[1:]
    return df.select(df.columns[0], *[f"`{c}`" for c in weeks[-count:]])


def select_like(df: DataFrame, part: str, keep: Iterable[str] = ()) -> DataFrame:
    """Columns whose name contains ``part``, after the ones always kept."""
    keep = list(keep)
    return df.select(*keep, *[c for c in df.columns if part in c and c not in keep])


def drop_like(df: DataFrame, parts: Iterable[str]) -> DataFrame:
    """Drop every column whose name contains one of ``parts``."""
    parts = list(parts)
    return df.select(*[c for c in df.columns if not any(p in c for p in parts)])


def numeric_columns(df: DataFrame, without: Iterable[str] = ()) -> list[str]:
    without = set(without)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in without]


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by a named map; names that are absent are left out."""
    return df.withColumnsRenamed(dict(names))


def business_names(columns: Iterable[str], metrics: Mapping[str, str]) -> dict[str, str]:
    """Map every ``<metric>_<statistic>`` column to its business name, longest metric first."""
    ordered = sorted(metrics, key=len, reverse=True)
    out = {}
    for column in columns:
        for metric in ordered:
            if column.startswith(metric + "_"):
                out[column] = metrics[metric] + column[len(metric):]
                break
    return out


def first_column(df: DataFrame, column: str) -> DataFrame:
    """Move one column to the front."""
    return df.select(column, *[c for c in df.columns if c != column])


def align(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Columns of another frame, in its order."""
    return df.select(*columns)


def fill_cast_numeric(df: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """NULL to 0 in every numeric column, the result as int; ``keys`` stay untouched."""
    numeric = set(numeric_columns(df, keys))
    return df.select(
        *[F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) if c in numeric else F.col(c) for c in df.columns]
    )


def impute_sentinel(df: DataFrame, value: int, without: Iterable[str] = ()) -> DataFrame:
    """Replace NULL (and NaN) by a sentinel in every numeric column."""
    skip = set(without)
    out: list[Column] = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, NumericType) and field.name not in skip:
            if isinstance(field.dataType, (DoubleType, FloatType)):
                column = F.nanvl(column, F.lit(None).cast(field.dataType))
            column = F.coalesce(column, F.lit(value).cast(field.dataType))
        out.append(column.alias(field.name))
    return df.select(*out)


def sum_if(value: Column, condition: Column) -> Column:
    """Sum over the rows that meet a condition; NULL when none does."""
    return F.sum(F.when(condition, value))


def count_rows_if(condition: Column) -> Column:
    return F.count_if(condition)


def pivot_weeks(df: DataFrame, key: str, week: str, metric: str, weeks: Iterable[int]) -> DataFrame:
    """Key x week table of sums. The weeks are given, so no job runs to find them."""
    return df.groupBy(key).agg(
        *[F.sum(F.when(F.col(week) == w, F.col(metric))).alias(str(w)) for w in weeks]
    )


def melt(df: DataFrame, ids: Iterable[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long: one row per remaining column, all as double."""
    ids = list(ids)
    values = [c for c in df.columns if c not in ids]
    doubles = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return doubles.unpivot(ids, values, variable, value)


def union_labelled(frames: Mapping[str, DataFrame], column: str = "dataset") -> DataFrame:
    """Stack frames of equal columns; ``column`` names the frame a row came from."""
    out = None
    for name, df in frames.items():
        part = df.select(F.lit(name).alias(column), "*")
        out = part if out is None else out.unionByName(part)
    return out
