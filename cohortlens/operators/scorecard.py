"""Risk score from 0 to 1000, score bands and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.prefix import quantiles
from cohortlens.plans import catalogue as cat


def risk_score(probability: Column) -> Column:
    """0 (certain dropout) to 1000; halves go to the even neighbour."""
    return F.bround((1 - probability) * 1000, 0)


def clipped(score: Column) -> Column:
    """Scores of models that may leave the unit interval."""
    low, high = cat.SCORE_RANGE
    return F.least(F.greatest(score, F.lit(float(low))), F.lit(float(high)))


def band(score: Column, cuts: Sequence[float]) -> Column:
    """Number of the right-closed band, from 1; the lowest cut belongs to band 1, scores outside
    the cuts have no band."""
    column = F.when(score < cuts[0], None)
    for i, upper in enumerate(cuts[1:], 1):
        column = column.when(score <= upper, i)
    return column


def band_label(number: Column, cuts: Sequence[float]) -> Column:
    column = None
    for i, (low, high) in enumerate(zip(cuts, cuts[1:]), 1):
        text = f"{'[' if i == 1 else '('}{low:g},{high:g}]"
        column = F.when(number == i, text) if column is None else column.when(number == i, text)
    return column


def quantile_cuts(df: DataFrame, score: str, probs: Sequence[float] = cat.LINEAR_QUANTILES) -> list[float]:
    """Ends of the score range with exact score quantiles between them."""
    inner = [r["value"] for r in quantiles(df, score, probs).orderBy("prob").collect()]
    low, high = cat.SCORE_RANGE
    return [float(low), *inner, float(high)]


def band_table(
    df: DataFrame, label: str, score: str, cuts: Sequence[float], top_good: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Classes, dropout share and population share per band, plain and cumulative, in percent.

    One aggregate gives a handful of rows; the running totals go over those. ``top_good`` lists
    the best scores first.
    """
    y = F.col(label)
    bands = (
        df.groupBy(*by, band(F.col(score), cuts).alias("band"))
        .agg(
            F.count_if(y == 0).alias("nodropout"),
            F.count_if(y == 1).alias("dropout"),
            F.count(F.lit(1)).alias("nroestudiantes"),
        )
    )
    place = F.coalesce(F.col("band"), F.lit(len(cuts)))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ordered = group.orderBy(place.desc() if top_good else place.asc())
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("nroestudiantes").over(group)
    both = F.col("nodropout") + F.col("dropout")

    def percent(share: Column) -> Column:
        return F.bround(share * 100, 2)

    return bands.select(
        *by,
        band_label(F.col("band"), cuts).alias("grupos"),
        F.row_number().over(ordered).alias("orden"),
        "nodropout", "dropout", "nroestudiantes",
        percent(F.col("dropout") / F.col("nroestudiantes")).alias("porcdropout"),
        percent(F.sum("dropout").over(upto) / F.sum("nroestudiantes").over(upto)).alias("porc_dropout_acum"),
        percent(both / total).alias("porc_poblacion"),
        percent(F.sum(both).over(upto) / total).alias("porc_acum"),
    )


def histogram(df: DataFrame, column: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Row counts per interval of one width, from 0."""
    start = F.floor(F.col(column) / F.lit(float(width))) * F.lit(float(width))
    return df.where(F.col(column).isNotNull()).groupBy(*by, start.alias("start")).agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
