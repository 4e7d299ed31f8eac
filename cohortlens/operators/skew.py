"""Equi-join that stays balanced when a few keys hold a large share of the left side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 1 / 256
SALTS = 256


def heavy_keys(df: DataFrame, on: Sequence[str], share: float = SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of the rows.

    There are fewer than ``1 / share`` of them whatever the size of ``df``, so the result may
    always be broadcast. The counts are combined before the exchange; the total of a stored
    table comes from its file footers.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    limit = df.agg(F.count(F.lit(1)) * F.lit(share)).scalar()
    return (
        counts.where(F.col("_rows") > limit).where(~_without_key(on)).select(*on, F.lit(True).alias("_heavy"))
    )


def _without_key(on: Sequence[str]) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in on])


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = (),
    heavy: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """``left JOIN right`` for inner, left, left_semi and left_anti joins.

    Rows of ``left`` under a heavy key are spread over ``salts`` parts by a hash of the
    ``spread`` columns, and the matching rows of ``right`` are repeated once per part; every
    left row still meets each of its partners exactly once. Rows without a key, which have no
    partner, are spread in the same way. All other keys join as usual. The salt depends on column values only, so a recomputed task gives the same rows.

    Finding the heavy keys reads ``left`` once more. Where ``left`` is the result of long work,
    pass ``heavy`` from the table it started from, or store it first.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"spread_join cannot do a {how} join")
    on = list(on)
    heavy = heavy_keys(left, on) if heavy is None else heavy
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    salted = (
        left.join(F.broadcast(heavy), on, "left")
        .withColumn("_salt", F.when(F.col("_heavy") | _without_key(on), salt).otherwise(0))
        .drop("_heavy")
    )
    parts = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = (
        right.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.explode(parts)).drop("_heavy")
    )
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
