"""Writes. The number of files is the number of partitions unless ``files`` asks otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, files: int | None = None) -> None:
    """Parquet, replacing what is there. ``files`` costs one shuffle, never a serial last stage."""
    (df if files is None else df.repartition(files)).write.mode("overwrite").parquet(path)


def write_period(
    df: DataFrame, path: str, week: int, column: str = "periodo_week", fmt: str = "parquet"
) -> None:
    """Write the rows of one week as a partition; a second run replaces that partition only."""
    writer = df.withColumn(column, F.lit(week).cast("int")).write.mode("overwrite")
    writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(column)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_wide(df: DataFrame, path: str, week: int) -> str:
    """CSV with a header; the folder name carries the week. Returns the folder."""
    target = f"{path.rstrip('/')}_{week}"
    df.write.mode("overwrite").option("header", True).csv(target)
    return target


def export_csv(df: DataFrame, path: str) -> None:
    """CSV written by the executors; no row passes through the driver."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
