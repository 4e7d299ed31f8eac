"""Operator 10: URL filter by rules and by a tree of path templates.

Rules judge the URLs they fit. All others are judged by the tree: per host, a path segment becomes a
wildcard unless enough judged URLs hold it and their share of blocked ones differs from that of its
siblings; siblings that are alike go on as one branch. A template is rejected when its smoothed
share of blocked URLs, learned from the URLs that rules judge, is above one half.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import Stage, read
from cohortlens.session import tune

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
RARE = 5  # judged URLs below which a segment is not told apart from its siblings
PRIOR = 8.0  # judged URLs that a parent's share counts for
ALIKE = 2.0  # standard errors within which siblings are merged
LIMIT = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for a url without ``://``."""
    shape = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, shape, 1), UPPER, LOWER), F.regexp_extract(url, shape, 2)


def judged(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host and path together; then the longer host, then the text) and its verdict."""
    rule = verdict = None
    for what, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    null = F.lit(None).cast("string")
    return (null, null) if rule is None else (rule, verdict)


def levels(path: Column) -> Column:
    """All segments; a run of digits becomes ``*`` and the extension stays, so ``/en/12.html`` gives [en, *.html]."""
    found = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(found, lambda s: F.regexp_replace(s, r"[0-9]+", "*"))


def _common(low: str, high: str) -> Column:
    """Number of leading elements that two different arrays share."""
    same = F.zip_with(low, high, lambda x, y: x.eqNullSafe(y))
    # the first place where they differ; zip_with pads the shorter one with NULL
    return F.array_position(same, False) - 1


def tree(counts: DataFrame, stage: Stage) -> DataFrame:
    """(host, shape, share): smoothed share of blocked URLs for every (host, shape) of ``counts``.

    ``counts`` has one row per host and shape with the numbers of blocked and allowed URLs. A node
    parts its shapes where they first differ, however deep that is; a shape that ends there is a child
    as well. A child with ``RARE`` judged URLs or more whose share lies outside ``ALIKE`` standard errors
    of all its siblings together is a branch of its own; the others are one branch, the wildcard.
    The share of a branch leans on its parent's with the weight of ``PRIOR`` URLs, the host's on that of
    all hosts; where all children are alike it stays the parent's. Rounds go on while a node holds
    different shapes, so there are as many as branchings on the way to a leaf.
    """
    whole = counts.agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
    base = whole.select(((F.col("b") + PRIOR / 2) / (F.col("a") + F.col("b") + PRIOR)).alias("share")).scalar()
    host = counts.groupBy("host").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
    shares = host.select("host", _lean(F.col("b"), F.col("a"), base).alias("share"))
    rows = counts.join(shares, "host").select(
        "host", "shape", "blocked", "allowed", "share", F.array().cast("array<string>").alias("node"), F.col("shape").alias("rest")
    )
    rows, done, turn = stage.store(rows, "level0"), [], 0
    by = ["host", "node"]
    while True:
        ends = rows.groupBy(*by).agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
        ends = stage.store(ends.select(*by, F.when(F.col("low") != F.col("high"), _common("low", "high")).alias("at")), f"ends{turn}")
        placed = stage.store(rows.join(ends, by), f"placed{turn}")
        done.append(placed.where(F.col("at").isNull()).select("host", "shape", "share"))
        deeper = placed.where(F.col("at").isNotNull())
        if deeper.isEmpty():
            break
        # an end is a child without name, as no segment is empty
        child = F.coalesce(F.get("rest", F.col("at").cast("int")), F.lit(""))
        deeper = deeper.withColumn("child", child)
        nodes = deeper.groupBy(*by, "child").agg(
            F.sum("blocked").alias("b"), F.sum("allowed").alias("a"), F.first("share").alias("up")
        )
        pools = nodes.groupBy(*by).agg(F.try_divide(F.sum("b"), F.sum(F.col("a") + F.col("b"))).alias("pool"))
        n = F.col("a") + F.col("b")
        gap = F.abs(F.try_divide(F.col("b"), n) - F.col("pool"))
        apart = (n >= RARE) & (gap > ALIKE * F.sqrt(F.try_divide(F.col("pool") * (1 - F.col("pool")), n)))
        nodes = nodes.join(pools, by).withColumn("name", F.when(F.coalesce(apart, F.lit(False)), F.col("child")).otherwise("*"))
        nodes = stage.store(nodes, f"nodes{turn}")
        branches = nodes.groupBy(*by, "name").agg(
            F.sum("b").alias("b"), F.sum("a").alias("a"), F.first("up").alias("up")
        )
        alone = F.count_if(F.col("name") != "*") == 0
        plain = nodes.groupBy(*by).agg(alone.alias("plain"))
        branches = branches.join(plain, by).select(
            *by, "name", F.when(F.col("plain"), F.col("up")).otherwise(_lean(F.col("b"), F.col("a"), F.col("up"))).alias("next")
        )
        known = nodes.select(*by, "child", "name").join(branches, [*by, "name"])
        rows = deeper.join(known, [*by, "child"]).select(
            "host", "shape", "blocked", "allowed", F.col("next").alias("share"), F.concat("node", F.array("name")).alias("node"),
            # behind the child; nothing where the shape ends
            F.slice("rest", (F.col("at") + 2).cast("int"), F.greatest(F.size("rest"), F.lit(1))).alias("rest"),
        )
        turn += 1
        rows = stage.store(rows, f"level{turn}")
    return reduce(DataFrame.unionByName, done)


def _lean(blocked: Column, allowed: Column, share) -> Column:
    return (blocked + PRIOR * share) / (blocked + allowed + PRIOR)


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url"
) -> DataFrame:
    """(key, host, path, rule, verdict, share) for every row of ``pages``.

    ``share`` is the smoothed share of blocked URLs of the template; a url without rule is blocked
    when it is above ``LIMIT``. Null urls and those without ``://`` have empty host and path, one
    template of their own. Repeated rows and null keys are judged like any other row; other columns
    are ignored. An empty table gives no rows. Without any judged url every share is one half, which
    allows.
    """
    spark = pages.sparkSession
    tune(spark)
    stage = Stage(spark, "urls")
    host, path = parts(pages[url])
    rows = pages.select(pages[key].alias("key"), host.alias("host"), path.alias("path"))
    rule, verdict = judged(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"), levels(F.col("path")).alias("shape"))
    blocked, allowed = F.count(F.when(F.col("by_rule") == "block", 1)), F.count(F.when(F.col("by_rule") == "allow", 1))
    counts = stage.store(rows.groupBy("host", "shape").agg(blocked.alias("blocked"), allowed.alias("allowed")), "counts")
    shares = tree(counts, stage)
    by_tree = F.when(F.col("share") > LIMIT, "block").otherwise("allow")
    return rows.join(shares, ["host", "shape"]).select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("by_rule", by_tree).alias("verdict"), "share"
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's url judged."""
    return judge(read(spark, folder, "pages"))
