"""Tables stored in sorted buckets of a key, so that joins on it need neither exchange nor sort."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from cohortlens.session import work_path

#: Rows of a bucket, on average. A wide row has some 1,550 numbers, so a bucket is about 100 MB.
BUCKET_ROWS = 10_000


def buckets_for(rows: int, size: int = BUCKET_ROWS) -> int:
    """Number of buckets for so many rows: it follows the data, not a setting of the session."""
    return max(1, -(-rows // size))


def store_bucketed(
    df: DataFrame, key: str, buckets: int, name: str = "bucketed", path: str | None = None, placed: bool = False
) -> DataFrame:
    """``df`` as a table of one sorted file per bucket, below the shared folder or at ``path``.

    ``placed`` says that the rows lie in ``buckets`` partitions by hash of ``key`` already, as after
    ``repartition(buckets, key)``; else they are moved there. The table's name lives as long as the
    session; ``read_bucketed`` gives the files a name in another one.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = path or work_path(spark, name)
    _trust_order(spark)
    ready = df if placed else df.repartition(buckets, key)
    ready.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(table)
    return spark.table(table)


def read_bucketed(spark, path: str, key: str, buckets: int, name: str = "bucketed") -> DataFrame:
    """The files of ``store_bucketed`` as a table of this session."""
    _trust_order(spark)
    table = f"{name}_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
        f"INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def _trust_order(spark) -> None:
    """A bucket is written by one task as one file, so its order holds for the whole bucket."""
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
