"""Connected components by contraction of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import Stage


def roots(links: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): the root is the smallest node it can reach.

    In each round a node takes its smallest neighbour as parent, parents take their parents twice,
    and links between different parents go on. The smallest node of a component never changes, so
    it is the one that is left. Tables are stored each round; nothing comes to the driver but counts.
    """
    links = stage.store(links.select("a", "b").where("a <> b").distinct(), f"{name}-links")
    found: DataFrame | None = None
    turn = 0
    while True:
        if links.isEmpty():
            break
        both = links.union(links.select("b", "a"))
        parent = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        parent = stage.store(parent.withColumnRenamed("a", "node"), f"{name}-parent{turn}")
        for jump in range(2):
            above = parent.select(F.col("node").alias("p"), F.col("p").alias("q"))
            parent = parent.join(above, "p").select("node", F.col("q").alias("p"))
            parent = stage.store(parent, f"{name}-jump{turn}-{jump}")
        ends = parent.select(F.col("node").alias("a"), F.col("p").alias("x"))
        links = links.join(ends, "a").select("x", "b").join(ends.toDF("b", "y"), "b")
        links = links.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links = stage.store(links, f"{name}-links{turn}")
        if found is None:
            found = parent.toDF("node", "root")
        else:
            found = found.join(parent.toDF("root", "p"), "root", "left").select(
                "node", F.coalesce("p", "root").alias("root")
            )
            found = stage.store(found, f"{name}-roots{turn}")
        turn += 1
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
