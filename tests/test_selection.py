import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import selection as sel


@pytest.fixture(scope="module")
def frame(spark):
    rnd = np.random.default_rng(4)
    n = 1500
    y = (rnd.random(n) < 0.3).astype(int)
    pdf = pd.DataFrame({
        "label": y, "a": rnd.normal(size=n) + y, "b": rnd.integers(0, 5, n).astype(float),
        "c": np.where(rnd.random(n) < 0.4, np.nan, rnd.normal(size=n)), "flat": np.zeros(n), "near": (rnd.random(n) < 0.01).astype(float),
    })
    pdf["d"] = pdf["a"] * 2 + rnd.normal(size=n) * 0.1
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    schema = "label int, " + ", ".join(f"{c} double" for c in pdf.columns[1:])
    rows = [(int(r[0]), *map(lambda v: None if v is None else float(v), r[1:])) for r in rows]
    return spark.createDataFrame(rows, schema).cache(), pdf


NAMES = ["a", "b", "c", "flat", "near", "d"]


def test_missing_limit_is_strict(spark):
    df = spark.createDataFrame([(1.0, None)] * 3 + [(1.0, 2.0)] * 7, "x double, y double")
    assert sel.drop_sparse(df, 0.30).columns == ["x"]
    assert sel.drop_sparse(df, 0.31).columns == ["x", "y"]


def test_near_zero_variance(frame):
    df, pdf = frame
    got = {r["variable"]: r for r in sel.near_zero_variance(sel.value_counts(df, "label", NAMES)).collect()}
    for name in NAMES:
        counts = pdf[name].value_counts().to_numpy()
        ratio = counts[0] / counts[1] if len(counts) > 1 else 0.0
        assert got[name]["freq_ratio"] == pytest.approx(ratio)
        assert got[name]["percent_unique"] == pytest.approx(100 * len(counts) / len(pdf))
    assert {n for n in NAMES if got[n]["nzv"]} == {"flat", "near"} and got["flat"]["zero_var"]


def test_nzv_of_an_empty_variable(spark):
    df = spark.createDataFrame([(1, None), (0, None)], "label int, x double")
    row = sel.near_zero_variance(sel.value_counts(df, "label", ["x"])).first()
    assert row["zero_var"] and row["nzv"]


def brute_iv(pdf, name, bins=10):
    x, y = pdf[name], pdf["label"]
    cuts = np.unique(np.quantile(x.dropna(), [i / bins for i in range(1, bins)]))
    group = np.where(x.isna(), -1, np.searchsorted(cuts, x.fillna(0), side="right"))
    total = 0.0
    for g in np.unique(group):
        n1, n0 = (y[group == g] == 1).sum(), (y[group == g] == 0).sum()
        if n1 and n0:
            p1, p0 = n1 / (y == 1).sum(), n0 / (y == 0).sum()
            total += (p1 - p0) * math.log(p1 / p0)
    return total


def test_information_value(frame):
    df, pdf = frame
    got = {r["variable"]: r["iv"] for r in sel.information_value(sel.value_counts(df, "label", NAMES)).collect()}
    for name in NAMES:
        assert got[name] == pytest.approx(brute_iv(pdf, name), abs=1e-9)


def brute_ks(pdf, name):
    known = pdf[pdf[name].notna()]
    edges = np.quantile(known[name], [i / 10 for i in range(1, 11)])
    group = np.searchsorted(edges, known[name], side="left")
    best = 0.0
    for g in range(10):
        upto = known[group <= g]["label"]
        share1 = (upto == 1).sum() / (known["label"] == 1).sum()
        share0 = (upto == 0).sum() / (known["label"] == 0).sum()
        best = max(best, abs(round(100 * (share1 - share0), 1)))
    return best


def test_ks(frame):
    df, pdf = frame
    got = {r["variable"]: r["ks"] for r in sel.ks_table(sel.value_counts(df, "label", NAMES)).collect()}
    for name in NAMES:
        assert got[name] == pytest.approx(brute_ks(pdf, name), abs=0.1001)
    assert got["flat"] == 0.0


def test_correlation_is_pairwise_complete(frame):
    df, pdf = frame
    got = {(r["variable1"], r["variable2"]): r["r"] for r in sel.correlation_pairs(df, NAMES).collect()}
    want = pdf[NAMES].corr()
    for (a, b), r in got.items():
        if math.isnan(want.loc[a, b]):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)
    assert len(got) == 15


def test_correlation_with_a_constant_is_null(spark):
    # y is constant wherever x is there
    rows = [(float(i) if i % 5 else None, 1.0 if i % 40 == 0 else 0.0) for i in range(4000)]
    pair = sel.correlation_pairs(spark.createDataFrame(rows, "x double, y double"), ["x", "y"]).first()
    assert pair["r"] is None


def brute_prune(pairs, iv, limit):
    """The walk written as nested loops over the full symmetric matrix."""
    order = sorted(iv, key=lambda v: (-iv[v], v))
    matrix = {(a, b): r for a, b, r in pairs} | {(b, a): r for a, b, r in pairs}
    removed = []
    for j in order:
        for i in order:
            if i != j and abs(matrix.get((i, j), 0)) > limit and i not in removed and j not in removed:
                removed.append(j if iv[i] >= iv[j] else i)
    return removed


def test_prune_walk():
    rnd = random.Random(8)
    for _ in range(30):
        names = [f"v{i}" for i in range(8)]
        iv = {n: rnd.choice([0.1, 0.2, 0.3, 0.4]) for n in names}
        pairs = [(a, b, rnd.uniform(-1, 1)) for i, a in enumerate(names) for b in names[i + 1:]]
        dropped = sel.prune_correlated(pairs, iv, 0.6)
        assert dropped == brute_prune(pairs, iv, 0.6)
        left = set(names) - set(dropped)
        assert not any(abs(r) > 0.6 and a in left and b in left for a, b, r in pairs)
    assert sel.prune_correlated([], {"a": 1.0}) == []


def test_drop_correlated(frame):
    df, _ = frame
    counts = sel.value_counts(df, "label", NAMES)
    kept = sel.drop_correlated(df, ["a", "b", "d"], sel.information_value(counts))
    assert "b" in kept and len({"a", "d"} & set(kept)) == 1


def test_woe_apply_matches_bins(frame):
    df, _ = frame
    bins = sel.woe_bins(sel.value_counts(df, "label", ["a", "c"]))
    out = sel.woe_apply(df, bins, ["a", "c"])
    table = {(r["variable"], r["bin"]): r for r in bins.collect()}
    per = out.groupBy("c_woe").agg(F.count(F.lit(1)).alias("n")).collect()
    want = {}
    for row in (r for (v, _), r in table.items() if v == "c"):
        want[row["woe"]] = want.get(row["woe"], 0) + row["n"]
    assert {r["c_woe"]: r["n"] for r in per} == want and sum(want.values()) == 1500
    weight = table["c", None]["woe"]
    assert out.where(F.abs(F.col("c_woe") - weight) < 1e-12).count() == table["c", None]["n"]


def test_supervised_bins(frame):
    df, _ = frame
    counts = sel.value_counts(df, "label", ["a", "flat"])
    bins = sel.woe_bins_supervised(counts)
    a = sorted((r for r in bins.collect() if r["variable"] == "a"), key=lambda r: r["bin"])
    assert 2 <= len(a) <= 8 and sum(r["n"] for r in a) == 1500 and all(r["n"] >= 75 for r in a)
    assert [r["woe"] for r in a] == sorted(r["woe"] for r in a)
    assert bins.where("variable = 'flat'").count() == 1


def test_unseen_values_fall_where_the_breaks_put_them(spark):
    seen = spark.createDataFrame([(float(i), int(i > 9)) for i in (*range(5), *range(15, 20))], "x double, label int")
    bins = sel.woe_table(sel.quantile_bins(sel.value_counts(seen, "label", ["x"]), 2))
    weight = {r["bin"]: r["woe"] for r in bins.collect()}
    cut = bins.agg({"cut": "max"}).first()[0]
    assert 4 < cut <= 15
    new = spark.createDataFrame([(v,) for v in (-5.0, cut - 0.01, cut, cut + 0.01, 99.0)], "x double")
    found = [r["x_woe"] for r in sel.woe_apply(new, bins, ["x"]).collect()]
    assert found == [weight[0], weight[0], weight[1], weight[1], weight[1]]
