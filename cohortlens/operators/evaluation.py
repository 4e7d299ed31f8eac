"""ROC, cut-off, confusion and classification metrics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.columns import melt, union_labelled
from cohortlens.operators.prefix import running_totals


def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score with its positives and negatives."""
    y = F.col(label)
    return (
        df.where(F.col(score).isNotNull() & y.isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )


UP, DOWN, AUTO = "<", ">", "auto"


def _ranked(df: DataFrame, label: str, score: str, by: Sequence[str], direction: str) -> DataFrame:
    """Distinct scores with the class counts below them, and ``up``: whether higher scores mean class 1.

    ``auto`` decides that for each group by the class medians, which come from the same table: up
    unless class 0 has the higher one. A group with one class counts as up.
    """
    if direction not in (UP, DOWN, AUTO):
        raise ValueError(f"unknown direction {direction}")
    ranked = running_totals(score_counts(df, label, score, by), "score", ["pos", "neg"], by)
    if direction != AUTO:
        return ranked.withColumn("up", F.lit(direction == UP))

    def middle(n: str, round_: Callable[[Column], Column]) -> Column:
        rank = round_((F.col(f"all_{n}") - 1) / 2)
        held = (F.col(f"before_{n}") <= rank) & (rank < F.col(f"before_{n}") + F.col(n))
        return F.max(F.when(held, F.col("score")))

    pos, neg = ((middle(n, F.floor) + middle(n, F.ceil)) / 2 for n in ("pos", "neg"))
    up = F.coalesce(neg <= pos, F.lit(True)).alias("up")
    if not by:
        return ranked.withColumn("up", ranked.agg(up).scalar())
    # one row per group: data sets and models
    return ranked.join(F.broadcast(ranked.groupBy(*by).agg(up)), list(by))


def _shown(direction: str) -> list[Column]:
    return [F.when(F.col("up"), F.lit(UP)).otherwise(F.lit(DOWN)).alias("direction")] if direction == AUTO else []


def _threshold() -> Column:
    return F.coalesce((F.col("previous") + F.col("score")) / 2, F.lit(float("-inf")))


def roc_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = (), direction: str = UP) -> DataFrame:
    """Sensitivity and specificity at every threshold.

    Thresholds lie midway between neighbouring scores, with -inf below and +inf above them. The
    row of the largest score brings the +inf point along, so the scores are read once. Higher
    scores mean class 1, with ``direction`` ">" lower ones do; "auto" decides by group and adds
    the column ``direction``.
    """
    ranked = _ranked(df, label, score, by, direction)
    below1 = F.try_divide(F.col("before_pos"), F.col("all_pos"))
    below0 = F.try_divide(F.col("before_neg"), F.col("all_neg"))
    up = F.col("up")
    point = F.struct(
        _threshold().alias("threshold"),
        F.when(up, 1 - below1).otherwise(below1).alias("sensitivity"),
        F.when(up, below0).otherwise(1 - below0).alias("specificity"),
    )
    end = F.struct(
        F.lit(float("inf")).alias("threshold"),
        F.when(up, 0.0).otherwise(1.0).alias("sensitivity"),
        F.when(up, 1.0).otherwise(0.0).alias("specificity"),
    )
    seen = F.col("before_pos") + F.col("before_neg") + F.col("pos") + F.col("neg")
    points = F.when(seen == F.col("all_pos") + F.col("all_neg"), F.array(point, end)).otherwise(F.array(point))
    shown = _shown(direction)
    return ranked.select(*by, F.explode(points).alias("point"), *shown).select(
        *by, "point.*", *["direction" for _ in shown]
    )


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (), direction: str = UP) -> DataFrame:
    """Exact area under the curve, ties counting one half; one row per group."""
    area = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    pairs = F.max("all_pos").cast("double") * F.max("all_neg").cast("double")
    share = F.try_divide(area, pairs)
    return (
        _ranked(df, label, score, by, direction)
        .groupBy(*by)
        .agg(share.alias("auc"), F.max("up").alias("up"))
        .select(*by, F.when(F.col("up"), F.col("auc")).otherwise(1 - F.col("auc")).alias("auc"), *_shown(direction))
    )


def gini(df: DataFrame, label: str, score: str, by: Sequence[str] = (), direction: str = UP) -> DataFrame:
    return auc(df, label, score, by, direction).withColumn("gini", 2 * F.col("auc") - 1)


def optimal_threshold(df: DataFrame, label: str, score: str, by: Sequence[str] = (), direction: str = UP) -> DataFrame:
    """Threshold with the largest sensitivity + specificity - 1; on ties the one nearest class 0's end.

    Candidates are compared by whole numbers, so rounding makes no ties and breaks none. The
    end points, where the index is 0, can only win when no threshold separates at all.
    """
    def big(name: str) -> Column:
        return F.col(name).cast("decimal(19,0)")

    # index x positives x negatives
    index = big("before_neg") * big("all_pos") - big("before_pos") * big("all_neg")
    up = F.col("up")
    ranked = _ranked(df, label, score, by, direction).select(
        *by, F.when(up, index).otherwise(-index).alias("index"), _threshold().alias("threshold"), "all_pos", "all_neg", "up"
    )
    pairs = F.max("all_pos").cast("double") * F.max("all_neg").cast("double")
    near = F.when(up, -F.col("threshold")).otherwise(F.col("threshold"))
    best = F.max_by("threshold", F.struct("index", near))
    return ranked.groupBy(*by).agg(
        best.alias("threshold"), F.try_divide(F.max("index").cast("double"), pairs).alias("youden"), F.max("up").alias("up")
    ).select(*by, "threshold", "youden", *_shown(direction))


def classify(score: Column, threshold: Column | float, direction: Column | str = UP) -> Column:
    """1 above the threshold, else 0; where ``direction`` is ">" 1 below it."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    if isinstance(direction, str) and direction == UP:
        return F.when(score > limit, 1).otherwise(0)
    towards = direction if isinstance(direction, Column) else F.lit(direction)
    return F.when(F.when(towards == DOWN, score < limit).otherwise(score > limit), 1).otherwise(0)


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Row counts per predicted and actual class."""
    return df.groupBy(
        F.col(predicted).cast("int").alias("prediction"), F.col(label).cast("int").alias("reference")
    ).agg(F.count(F.lit(1)).alias("freq"))


def classification_metrics(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of a hard classification with class 1 as the positive one."""
    y, z = F.col(label), F.col(predicted)
    counts = df.groupBy(*by).agg(
        F.count_if((y == 1) & (z == 1)).cast("double").alias("tp"),
        F.count_if((y == 0) & (z == 1)).cast("double").alias("fp"),
        F.count_if((y == 1) & (z == 0)).cast("double").alias("fn"),
        F.count_if((y == 0) & (z == 0)).cast("double").alias("tn"),
    )
    return counted_metrics(counts, by)


def counted_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same metrics from the four counts tp, fp, fn, tn as doubles."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    agree = F.try_divide(tp + tn, n)
    chance = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    sensitivity, specificity = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return counts.select(
        *by,
        agree.alias("accuracy"),
        F.try_divide(agree - chance, 1 - chance).alias("kappa"),
        sensitivity.alias("sensitivity"),
        specificity.alias("specificity"),
        F.try_divide(tp, tp + fp).alias("pos_pred_value"),
        F.try_divide(tn, tn + fn).alias("neg_pred_value"),
        F.try_divide(tp + fn, n).alias("prevalence"),
        F.try_divide(tp, n).alias("detection_rate"),
        F.try_divide(tp + fp, n).alias("detection_prevalence"),
        ((sensitivity + specificity) / 2).alias("balanced_accuracy"),
    )


HEADLINE = ("accuracy", "kappa", "sensitivity", "specificity", "pos_pred_value", "neg_pred_value")


def compare_models(frames: Mapping[str, DataFrame], column: str = "dataset") -> DataFrame:
    """Metric tables of several data sets or models, stacked and melted."""
    chosen = {name: df.select(*HEADLINE) for name, df in frames.items()}
    return melt(union_labelled(chosen, column), [column])
