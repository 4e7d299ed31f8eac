"""Parameters and metrics of model runs as rows of a Parquet table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "run_id string, kind string, name string, value string"


def log_run(spark: SparkSession, path: str, run_id: str, params: Mapping, metrics: Mapping) -> None:
    """Append one row per parameter and metric."""
    rows = [(run_id, "param", k, str(v)) for k, v in params.items()]
    rows += [(run_id, "metric", k, repr(float(v))) for k, v in metrics.items()]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
