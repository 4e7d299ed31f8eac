"""Registration of queries by inventory id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.plans.registry.adapters import World
from cohortlens.plans.registry.oracle import complete
from cohortlens.session import tune

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def run(fn: Callable[[World], DataFrame], spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return fn(World(spark, folder))


def query(name: str, sql: str | None = None):
    """Register ``fn(world) -> DataFrame`` under an inventory id, with its SQL where there is one."""

    def register(fn: Callable[[World], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, folder: run(fn, spark, folder)
        if sql is not None:
            ORACLES[name] = complete(sql)
        return fn

    return register
