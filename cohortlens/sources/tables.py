"""Scans: Parquet tables, CSV tables, one week of a partitioned dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, folder: str, name: str, schema: StructType | None = None) -> DataFrame:
    """Parquet table ``folder/name`` or ``folder/name.parquet``.

    With a ``schema`` every declared column must exist; a missing one is named in the error.
    """
    path = f"{folder.rstrip('/')}/{name}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
    df = spark.read.parquet(path if found else f"{path}.parquet")
    if schema is not None:
        present = {c.lower() for c in df.columns}
        missing = [f.name for f in schema.fields if f.name.lower() not in present]
        if missing:
            raise ValueError(f"table {name} lacks columns {missing}")
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return df


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header line. Give a schema: inference costs a second pass over the files."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_period(
    spark: SparkSession, path: str, week: int, column: str = "periodo_week", fmt: str = "parquet",
    schema: StructType | str | None = None,
) -> DataFrame:
    """Only one week of a dataset partitioned by week; the filter prunes the other folders."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path).where(F.col(column) == week).drop(column)


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop the columns that hold no value at all.

    One aggregate over the frame; the driver receives one row with one count per column.
    """
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c] > 0])


def read_wide(
    spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str = "csv"
) -> DataFrame:
    """Wide modelling table without its all-NULL columns."""
    df = read_csv(spark, path, schema) if fmt == "csv" else spark.read.parquet(path)
    return drop_all_null(df)
