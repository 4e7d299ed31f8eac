"""Fitted models as tables, and a scorer that folds them in built-in functions.

A tree model is one row per node, a linear model one row per coefficient. Such a table can be stored,
read in another session or engine, and scored without the library that fitted it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import work_path

NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, weight double"
BOOSTING, FOREST, LINEAR = "boosting", "forest", "linear"


def tree_nodes(model) -> DataFrame:
    """Nodes of a fitted tree ensemble: tree, node, feature, threshold, left, right, value, weight.

    A row goes left if its feature is at most the threshold. Leaves have feature -1. ``weight`` is the
    weight of the tree in the sum. The rows are those that the library writes when it stores the model.
    """
    spark = SparkSession.getActiveSession()
    path = work_path(spark, "model")
    model.stages[-1].write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "_about", "weight")
    return nodes.join(weights, "treeID").select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("prediction").alias("value"),
        "weight",
    )


def coefficients(model, features: Sequence[str], spark) -> DataFrame:
    """Coefficients of a fitted linear model by feature number; the intercept has number -1."""
    fitted = model.stages[-1]
    rows = [(-1, float(fitted.intercept)), *enumerate(map(float, fitted.coefficients.toArray()))]
    return spark.createDataFrame(rows, "feature int, coefficient double")


def cut_points(model) -> dict[int, list[float]] | None:
    """Thresholds of a tree ensemble by feature, ascending; None for other models.

    Continuous features have at most ``maxBins`` - 1 thresholds each, however many rows or trees there
    are, and as often as there are parts in a bagged forest.
    """
    if isinstance(model, TableModel):
        nodes = [model.nodes]
    elif all(hasattr(part.stages[-1], "treeWeights") for part in getattr(model, "parts", [model])):
        nodes = [tree_nodes(part) for part in getattr(model, "parts", [model])]
    else:
        return None
    inner = reduce(DataFrame.unionByName, nodes).where(F.col("feature") >= 0)
    found = inner.groupBy("feature").agg(F.sort_array(F.collect_set("threshold")).alias("cuts"))
    return {r["feature"]: list(r["cuts"]) for r in found.collect()}


class TableModel:
    """A tree table that scores like a fitted model: ``transform`` adds ``prediction``."""

    def __init__(self, nodes: DataFrame, kind: str, depth: int):
        self.nodes, self.kind, self.depth, self.stages = nodes, kind, depth, [self]

    def transform(self, df: DataFrame) -> DataFrame:
        values = df.withColumn("_vector", vector_to_array("features"))
        return score_values(values, self.nodes, "_vector", self.kind, self.depth, "prediction").drop("_vector")


def packed(nodes: DataFrame) -> DataFrame:
    """One row with all trees: array of (weight, nodes in order)."""
    node = F.struct("node", "feature", "threshold", "left", "right", "value")
    trees = nodes.groupBy("tree", "weight").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    return trees.agg(F.sort_array(F.collect_list(F.struct("tree", "weight", "nodes"))).alias("trees"))


def _tree_sum(values: str, depth: int) -> Column:
    """Weighted sum of the leaves that the values reach; nodes are numbered 0, 1, ... within a tree."""
    return F.expr(
        f"""aggregate(trees, 0D, (total, t) -> total + t.weight * t.nodes[
            aggregate(sequence(1, {depth}), 0, (at, step) -> CASE WHEN t.nodes[at].feature < 0 THEN at
                WHEN {values}[t.nodes[at].feature] <= t.nodes[at].threshold THEN t.nodes[at].left
                ELSE t.nodes[at].right END)].value)"""
    )


def score_trees(df: DataFrame, nodes: DataFrame, features: Sequence[str], kind: str, depth: int, name: str = "p") -> DataFrame:
    """``df`` with the score of the ensemble.

    ``kind`` boosting: probability from twice the weighted sum, as for log loss on classes -1 and 1;
    forest: weighted mean. ``depth`` is the depth of the deepest tree. The table becomes one row that
    is broadcast; its size is that of the model.
    """
    values = F.array(*[F.col(f).cast("double") for f in features])
    return score_values(df.withColumn("_values", values), nodes, "_values", kind, depth, name).drop("_values")


def score_values(df: DataFrame, nodes: DataFrame, values: str, kind: str, depth: int, name: str = "p") -> DataFrame:
    """As ``score_trees``, over predictors that lie in an array column."""
    total = _tree_sum(values, depth)
    if kind == BOOSTING:
        score = 1 / (1 + F.exp(-2 * total))
    elif kind == FOREST:
        score = total / F.aggregate("trees", F.lit(0.0), lambda a, t: a + t["weight"])
    else:
        raise ValueError(f"unknown kind of ensemble {kind}")
    joined = df.withColumn("_one", F.lit(0)).join(
        F.broadcast(packed(nodes).withColumn("_one", F.lit(0))), "_one"
    )
    return joined.select(*df.columns, score.alias(name))


def score_linear(df: DataFrame, table: DataFrame, features: Sequence[str], name: str = "p") -> DataFrame:
    """``df`` with the class-1 probability of a logistic model; one coefficient per feature."""
    held = table.agg(F.map_from_entries(F.collect_list(F.struct("feature", "coefficient"))).alias("_terms"))
    total = F.element_at("_terms", F.lit(-1))
    for i, f in enumerate(features):
        total = total + F.coalesce(F.element_at("_terms", F.lit(i)), F.lit(0.0)) * F.col(f)
    joined = df.withColumn("_one", F.lit(0)).join(F.broadcast(held.withColumn("_one", F.lit(0))), "_one")
    return joined.select(*df.columns, (1 / (1 + F.exp(-total))).alias(name))
