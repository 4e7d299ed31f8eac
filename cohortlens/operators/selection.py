"""Predictor selection. All statistics come from one table of value counts per variable.

``value_counts`` turns the wide frame into (variable, value) counts in one scan and one
exchange; repeated values are combined before it moves. Missing rates, near-zero variance,
quantile edges, information value, KS and weight of evidence then read that table.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.prefix import quantiles_by

#: Groups of tasks whose pair sums are added first.
PARTS = 256

# relative size below which a variance is rounding only, that is, the variable is constant
_FLAT = 1e-12
DECILES = tuple(i / 10 for i in range(1, 11))


# --- missing values -------------------------------------------------------------------------


def missing_rate(df: DataFrame) -> DataFrame:
    """Share of NULLs per column as a long table; one aggregate over all columns."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return rates.unpivot([], list(df.columns), "variable", "missing")


def sparse_columns(df: DataFrame, limit: float = 0.30) -> DataFrame:
    """Columns kept by the missing test: strictly below the limit."""
    return missing_rate(df).where(F.col("missing") < limit)


def drop_sparse(df: DataFrame, limit: float = 0.30) -> DataFrame:
    """Keep columns with a missing share strictly below the limit (one name per column is read)."""
    kept = {r["variable"] for r in sparse_columns(df, limit).collect()}
    return df.select(*[c for c in df.columns if c in kept])


# --- value counts ---------------------------------------------------------------------------


def value_counts(df: DataFrame, label: str, variables: Sequence[str]) -> DataFrame:
    """(variable, value, n, n1): how often a value occurs and how often with label 1.

    NULL is a value of its own here.
    """
    doubles = df.select(label, *[F.col(v).cast("double").alias(v) for v in variables])
    return (
        doubles.unpivot([label], list(variables), "variable", "value")
        .groupBy("variable", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("n1"))
    )


def near_zero_variance(counts: DataFrame, freq_cut: float = 19, unique_cut: float = 10) -> DataFrame:
    """Variables with one value, or dominated by one value and poor in distinct ones.

    The two largest counts of a variable are read from the table of distinct counts: equal
    counts fall together, so it has at most about sqrt(2 * rows) rows per variable however many
    values there are.
    """
    per_count = (
        counts.groupBy("variable", F.when(F.col("value").isNotNull(), F.col("n")).alias("held"))
        .agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows"))
    )
    by = Window.partitionBy("variable").orderBy(F.desc_nulls_last("held"))
    ranked = per_count.withColumn("place", F.row_number().over(by))
    stats = ranked.groupBy("variable").agg(
        F.sum("rows").alias("rows"),
        F.sum(F.when(F.col("held").isNotNull(), F.col("values"))).alias("distinct"),
        F.max(F.when(F.col("place") == 1, F.col("held"))).alias("first"),
        F.max(
            F.when((F.col("place") == 1) & (F.col("values") > 1), F.col("held"))
            .when(F.col("place") == 2, F.col("held"))
        ).alias("second"),
    )
    top = stats.withColumn(
        "second", F.when(F.col("distinct") > 1, F.col("second"))
    )
    ratio = F.coalesce(F.try_divide(F.col("first").cast("double"), F.col("second").cast("double")), F.lit(0.0))
    share = F.coalesce(F.col("distinct"), F.lit(0)) * 100.0 / F.col("rows")
    constant = F.coalesce(F.col("distinct"), F.lit(0)) <= 1
    return top.select(
        "variable",
        ratio.alias("freq_ratio"),
        share.alias("percent_unique"),
        constant.alias("zero_var"),
        (constant | ((ratio > freq_cut) & (share <= unique_cut))).alias("nzv"),
    )


# --- bins -----------------------------------------------------------------------------------


def inner_cuts(counts: DataFrame, bins: int = 10) -> DataFrame:
    """Distinct inner quantile cuts per variable."""
    probs = [i / bins for i in range(1, bins)]
    return quantiles_by(counts, probs, by=["variable"], stored=True).select(
        "variable", F.array_distinct("edges").alias("cuts")
    )


def quantile_bins(counts: DataFrame, bins: int = 10) -> DataFrame:
    """Class counts per left-closed quantile bin; bin NULL holds the missing values.

    ``cut`` is the break point at which a bin begins; the lowest bin has none.

    The cuts, one short array per variable, are broadcast: as many rows as there are columns.
    """
    cuts = inner_cuts(counts, bins)
    value = F.col("value")
    place = F.size(F.filter("cuts", lambda c: c <= value))
    return (
        counts.join(F.broadcast(cuts), "variable", "left")
        .select(
            "variable", F.when(value.isNotNull(), place).alias("bin"), "value", "n", "n1",
            F.when(value.isNotNull() & (place > 0), F.get("cuts", place - 1)).alias("cut"),
        )
        .groupBy("variable", "bin")
        .agg(
            F.min("value").alias("low"), F.max("value").alias("high"), F.max("cut").alias("cut"),
            F.sum("n").alias("n"), F.sum("n1").alias("n1"),
        )
    )


def woe_table(binned: DataFrame) -> DataFrame:
    """Weight of evidence and its information value per bin.

    A bin without rows of one class gets weight 0. The window holds the few bins of a variable.
    """
    by = Window.partitionBy("variable")
    good = F.col("n") - F.col("n1")
    share1 = F.col("n1") / F.sum("n1").over(by)
    share0 = good / F.sum(good).over(by)
    woe = F.when((F.col("n1") > 0) & (good > 0), F.log(share1 / share0)).otherwise(F.lit(0.0))
    return binned.select(
        "variable", "bin", "low", "high", "n", good.alias("n0"), "n1",
        share1.alias("share1"), share0.alias("share0"), woe.alias("woe"), "cut",
    ).withColumn("iv", (F.col("share1") - F.col("share0")) * F.col("woe"))


def information_value(counts: DataFrame, bins: int = 10) -> DataFrame:
    """Information value per variable over quantile bins and a bin of missing values."""
    return woe_table(quantile_bins(counts, bins)).groupBy("variable").agg(F.sum("iv").alias("iv"))


def informative(iv: DataFrame, limit: float = 0.02) -> DataFrame:
    return iv.where(F.col("iv") >= limit)


# --- correlation ----------------------------------------------------------------------------


_MOMENTS = ("n", "x", "y", "xx", "yy", "xy")


def _partial_moments(variables: Sequence[str], shift: Mapping[str, float]):
    """Per partition: pairwise counts, sums and products over rows where both are present.

    One row per variable ``i``: the moments with all later variables, one array each. A partition
    without rows gives none.
    """
    size = len(variables)
    offset = np.array([shift[v] for v in variables])

    def run(frames: Iterable[pd.DataFrame]):
        total, some = np.zeros((5, size, size)), False
        for frame in frames:
            some = some or len(frame) > 0
            values = frame.to_numpy(dtype="float64", na_value=np.nan) - offset
            there = ~np.isnan(values)
            mask, values = there.astype("float64"), np.where(there, values, 0.0)
            squares = values * values
            total[0] += mask.T @ mask
            total[1] += values.T @ mask
            total[2] += mask.T @ values
            total[3] += squares.T @ mask
            total[4] += values.T @ values
        if not some:
            return
        # total[3] transposed gives the squares of the second variable
        tables = (total[0], total[1], total[2], total[3], total[3].T, total[4])
        part = TaskContext.get().partitionId() % PARTS
        yield pd.DataFrame({
            "i": np.arange(size - 1, dtype="int32"), "part": np.full(size - 1, part, "int32"),
            **{m: [t[i, i + 1:] for i in range(size - 1)] for m, t in zip(_MOMENTS, tables)},
        })

    return run


def _added(frames: Iterable[pd.DataFrame]) -> pd.DataFrame:
    """Sum of packed moments, one frame after the other."""
    total, i, part = None, 0, 0
    for frame in frames:
        for row in frame.itertuples(index=False):
            values = np.stack([np.asarray(getattr(row, m)) for m in _MOMENTS])
            total, i, part = values if total is None else total + values, row.i, row.part
    return pd.DataFrame({"i": [i], "part": [part], **{m: [v] for m, v in zip(_MOMENTS, total)}})


def correlation_pairs(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair over the rows where both are present.

    Each task turns its rows into pair sums with matrix products; what moves is one packed row per
    task and variable. They are added in two levels, first in ``PARTS`` groups of tasks, so no
    group holds a row of every task. Values are shifted by the column mean first, which keeps the
    sums well scaled.
    """
    doubles = df.select(*[F.col(v).cast("double").alias(v) for v in variables])
    means = doubles.agg(*[F.coalesce(F.avg(v), F.lit(0.0)).alias(v) for v in variables]).first().asDict()
    shape = "i int, part int, " + ", ".join(f"{m} array<double>" for m in _MOMENTS)
    partial = doubles.mapInPandas(_partial_moments(list(variables), means), shape)
    for level in (["i", "part"], ["i"]):
        partial = partial.groupBy(*level).applyInPandas(lambda rows: _added([rows]), shape)
    sums = partial.select("i", F.posexplode(F.arrays_zip(*_MOMENTS)).alias("k", "m"))
    sums = sums.select("i", (F.col("i") + F.col("k") + 1).alias("j"), "m.*")
    names = F.array(*[F.lit(v) for v in variables])
    cov = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    var_x = F.col("n") * F.col("xx") - F.col("x") * F.col("x")
    var_y = F.col("n") * F.col("yy") - F.col("y") * F.col("y")
    return sums.select(
        F.get(names, F.col("i")).alias("variable1"),
        F.get(names, F.col("j")).alias("variable2"),
        F.when(
            (var_x > _FLAT * F.col("n") * F.col("xx")) & (var_y > _FLAT * F.col("n") * F.col("yy")),
            cov / F.sqrt(var_x * var_y),
        ).alias("r"),
    )


def prune_correlated(
    pairs: Iterable[tuple[str, str, float]], iv: Mapping[str, float], limit: float = 0.8
) -> list[str]:
    """Names to drop: of two strongly correlated variables the one with less information.

    ``pairs`` are names, at most columns squared, never rows. The walk goes column by column
    over the variables by falling information value; a pair with a dropped member is skipped,
    and on equal information the variable of the column goes.
    """
    order = [v for v, _ in sorted(iv.items(), key=lambda item: (-item[1], item[0]))]
    strong = {frozenset(p[:2]) for p in pairs if p[2] is not None and abs(p[2]) > limit}
    dropped: list[str] = []
    for column in order:
        for row in order:
            if column == row or frozenset((row, column)) not in strong:
                continue
            if row in dropped or column in dropped:
                continue
            dropped.append(column if iv[row] >= iv[column] else row)
    return dropped


def drop_correlated(df: DataFrame, variables: Sequence[str], iv: DataFrame, limit: float = 0.8) -> list[str]:
    """Variables that survive the pruning."""
    values = {r["variable"]: r["iv"] for r in iv.collect() if r["variable"] in set(variables)}
    strong = correlation_pairs(df, variables).where(F.abs("r") > limit)
    gone = set(prune_correlated([tuple(r) for r in strong.collect()], values, limit))
    return [v for v in variables if v not in gone]


# --- KS -------------------------------------------------------------------------------------


def first_edge(value: Column, edges: Column) -> Column:
    """Number of the first edge that is not below the value, from 1."""
    return F.size(F.filter(edges, lambda e: e < value)) + 1


def ks_bins(counts: DataFrame) -> DataFrame:
    """Class counts per right-closed decile bin of the non-NULL values."""
    known = counts.where(F.col("value").isNotNull())
    edges = quantiles_by(known, DECILES, by=["variable"], stored=True)
    return (
        known.join(F.broadcast(edges), "variable")
        .groupBy("variable", first_edge(F.col("value"), F.col("edges")).alias("bin"))
        .agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    )


def ks_table(counts: DataFrame) -> DataFrame:
    """Largest distance between the cumulative class shares over the deciles, in percent with
    one decimal. Windows hold the at most ten bins of a variable."""
    whole = Window.partitionBy("variable")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n0 = F.col("n") - F.col("n1")
    share1 = F.sum("n1").over(upto) / F.sum("n1").over(whole)
    share0 = F.sum(n0).over(upto) / F.sum(n0).over(whole)
    gap = F.abs(F.bround((share1 - share0) * 100, 1))
    return (
        ks_bins(counts).select("variable", gap.alias("gap")).groupBy("variable").agg(F.max("gap").alias("ks"))
    )


def ks_selected(ks: DataFrame, limit: float = 9) -> DataFrame:
    return ks.where(F.col("ks") > limit).orderBy(F.desc("ks"), "variable")


# --- weight of evidence ---------------------------------------------------------------------


def woe_bins(counts: DataFrame, bins: int = 10) -> DataFrame:
    """Weight of evidence of quantile bins."""
    return woe_table(quantile_bins(counts, bins))


def _merge_fine_bins(limit: int, stop: float, smallest: float):
    """Supervised binning of one variable from its fine bins, at most a few dozen rows.

    The split that raises the information value most is added while it raises it by at least
    ``stop`` of the present value, no bin falls under the smallest share, and bins remain.
    """

    def value(n: np.ndarray, n1: np.ndarray, total: np.ndarray) -> float:
        share1, share0 = n1 / max(total[1], 1), (n - n1) / max(total[0] - total[1], 1)
        both = (n1 > 0) & (n - n1 > 0)
        safe1, safe0 = np.where(both, share1, 1.0), np.where(both, share0, 1.0)
        return float(np.sum(np.where(both, (share1 - share0) * np.log(safe1 / safe0), 0.0)))

    def run(fine: pd.DataFrame) -> pd.DataFrame:
        missing = fine[fine["bin"].isna()]
        known = fine[fine["bin"].notna()].sort_values("low")
        n, n1 = known["n"].to_numpy("float64"), known["n1"].to_numpy("float64")
        total = np.array([fine["n"].sum(), fine["n1"].sum()], dtype="float64")
        cuts: list[int] = []

        def groups(points: list[int]):
            edges = [0, *sorted(points), len(n)]
            spans = [(a, b) for a, b in zip(edges, edges[1:]) if b > a]
            return spans, np.array([n[a:b].sum() for a, b in spans]), np.array([n1[a:b].sum() for a, b in spans])

        best = 0.0
        while len(n) and len(cuts) + 1 < limit:
            trials = []
            for point in range(1, len(n)):
                if point in cuts:
                    continue
                _, size, hits = groups([*cuts, point])
                if size.min() >= smallest * total[0]:
                    trials.append((value(size, hits, total), -point))
            if not trials:
                break
            found, point = max(trials)
            if cuts and found < best * (1 + stop):
                break
            if not cuts and found <= 0:
                break
            cuts, best = [*cuts, -point], found
        spans, size, hits = groups(cuts) if len(n) else ([], [], [])
        low, high, cut = (known[c].to_numpy() for c in ("low", "high", "cut"))
        rows = [
            (fine["variable"].iloc[0], i, low[a], high[b - 1], cut[a], int(size[i]), int(hits[i]))
            for i, (a, b) in enumerate(spans)
        ]
        rows += [(r.variable, None, None, None, None, int(r.n), int(r.n1)) for r in missing.itertuples()]
        out = pd.DataFrame(rows, columns=["variable", "bin", "low", "high", "cut", "n", "n1"])
        return out.astype({"bin": "Int32"})

    return run


def woe_bins_supervised(
    counts: DataFrame, fine: int = 50, limit: int = 8, stop: float = 0.1, smallest: float = 0.05
) -> DataFrame:
    """Weight of evidence of bins chosen by information value.

    Spark makes up to ``fine`` quantile bins per variable; the choice among them runs per
    variable on those few rows.
    """
    merged = (
        quantile_bins(counts, fine)
        .groupBy("variable")
        .applyInPandas(
            _merge_fine_bins(limit, stop, smallest),
            "variable string, bin int, low double, high double, cut double, n long, n1 long",
        )
    )
    return woe_table(merged)


def woe_apply(df: DataFrame, bins: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Replace every variable by the weight of its bin, named ``<variable>_woe``.

    The bin table, a few rows per variable, is read once and becomes one CASE per variable, so
    a frame of any size is mapped in a single projection. Bins begin at their break points, so
    a value that was never seen falls where ``quantile_bins`` would put it.
    """
    by_variable: dict[str, list] = {v: [] for v in variables}
    for row in bins.where(F.col("variable").isin(*variables)).collect():
        by_variable[row["variable"]].append(row)
    out = []
    for variable in variables:
        rows = by_variable[variable]
        known = sorted((r for r in rows if r["bin"] is not None), key=lambda r: r["low"])
        missing = next((r["woe"] for r in rows if r["bin"] is None), 0.0)
        column = F.col(variable).cast("double")
        chain = F.when(column.isNull(), F.lit(missing))
        for row, following in zip(known, known[1:]):
            chain = chain.when(column < F.lit(following["cut"]), F.lit(row["woe"]))
        chain = chain.otherwise(F.lit(known[-1]["woe"] if known else 0.0))
        out.append(chain.alias(f"{variable}_woe"))
    return df.select(*[c for c in df.columns if c not in by_variable], *out)


def woe_report(bins: DataFrame) -> DataFrame:
    """Readable bin table: interval, size, class counts, share of label 1, weight, value."""
    bracket = F.when(F.col("bin").isNull(), F.lit("missing")).otherwise(
        F.concat(F.lit("["), F.round("low", 2).cast("string"), F.lit(", "), F.round("high", 2).cast("string"), F.lit("]"))
    )
    by = Window.partitionBy("variable")
    return bins.select(
        "variable", "bin", bracket.alias("interval"), "n", "n0", "n1",
        (F.col("n") / F.sum("n").over(by)).alias("count_share"),
        (F.col("n1") / F.col("n")).alias("positive_share"),
        "woe", "iv", F.sum("iv").over(by).alias("total_iv"),
    )


