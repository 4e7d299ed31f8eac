"""Running totals and exact quantiles over ordered values without a one-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import cut_lineage

#: Rows of one range, on average. A range is ordered by one task.
RANGE = 1_000_000


def running_totals(
    df: DataFrame, order: str, totals: Sequence[str], by: Sequence[str] = (), size: int = RANGE, stored: bool = False
) -> DataFrame:
    """Add running totals of ``totals`` along ``order`` inside each ``by`` group.

    ``df`` holds one row per (``by``, ``order``) value; no group column is NULL. It is written once
    (``stored`` says that it is a stored table already), so what it is made from is read once however
    often the result is used, and its row count, which comes from the files, gives the number of
    ranges: one for every ``size`` rows. Up to ``size`` rows each group is one range. Beyond, a second
    table holds the rows partitioned by range with the number of the range, and the totals of the
    earlier ranges are added as an offset. Only these offsets are broadcast: one row per range and
    group that begins in it, a millionth of the rows.

    Adds ``before_<t>`` (total of smaller values), ``all_<t>`` (total of the group) and
    ``previous`` (the next smaller value, NULL for the smallest).
    """
    by = list(by)
    rows = df if stored else cut_lineage(df, "ordered")
    ranges = max(1, -(-rows.count() // size))
    if ranges == 1:
        group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        inside = group.orderBy(order)
        lower = inside.rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(
            *df.columns,
            *[F.coalesce(F.sum(t).over(lower), F.lit(0)).alias(f"before_{t}") for t in totals],
            *[F.sum(t).over(group).alias(f"all_{t}") for t in totals],
            F.lag(order).over(inside).alias("previous"),
        )
    ranged = rows.repartitionByRange(ranges, *by, order).withColumn("_range", F.spark_partition_id())
    ranged = cut_lineage(ranged, "ranges")
    per_range = ranged.groupBy(*by, "_range").agg(
        *[F.sum(t).alias(f"_sum_{t}") for t in totals], F.max(order).alias("_top")
    )
    # a group's ranges: a few numbers each
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_sum_{t}").over(earlier), F.lit(0)).alias(f"_off_{t}") for t in totals],
        *[F.sum(f"_sum_{t}").over(group).alias(f"all_{t}") for t in totals],
        F.lag("_top").over(group.orderBy("_range")).alias("_last"),
    )
    inside = Window.partitionBy(*by, "_range").orderBy(order)
    lower = inside.rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(offsets), [*by, "_range"]).select(
        *df.columns,
        *[(F.col(f"_off_{t}") + F.coalesce(F.sum(t).over(lower), F.lit(0))).alias(f"before_{t}") for t in totals],
        *[F.col(f"all_{t}") for t in totals],
        F.coalesce(F.lag(order).over(inside), F.col("_last")).alias("previous"),
    )


def quantiles_by(
    counts: DataFrame, probs: Sequence[float], value: str = "value", n: str = "n", by: Sequence[str] = (),
    stored: bool = False,
) -> DataFrame:
    """Exact quantiles with linear interpolation between the two nearest ranks.

    ``counts`` holds one row per (``by``, ``value``) with its multiplicity ``n``; ``stored`` as for
    ``running_totals``. Returns one row per group with the array ``edges``, in the order of ``probs``.
    """
    ranked = running_totals(counts.where(F.col(value).isNotNull()), value, [n], by, stored=stored)
    below, size = F.col(f"before_{n}"), F.col(f"all_{n}")
    picks = []
    for i, p in enumerate(probs):
        place = (size - 1) * F.lit(float(p))
        for name, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            held = (below <= rank) & (rank < below + F.col(n))
            picks.append(F.max(F.when(held, F.col(value))).alias(f"_{name}{i}"))
    picked = ranked.groupBy(*by).agg(*picks, F.max(size).alias("_size"))
    edges = []
    for i, p in enumerate(probs):
        place = (F.col("_size") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        edges.append(low + (high - low) * (place - F.floor(place)))
    return picked.select(*by, F.array(*edges).alias("edges"))


def quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of one column, one row per probability."""
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    names = F.array(*[F.lit(float(p)) for p in probs])
    return (
        quantiles_by(counts, probs)
        .select(F.explode(F.arrays_zip(names.alias("prob"), F.col("edges").alias("value"))).alias("q"))
        .select("q.prob", "q.value")
    )
