"""Queries of predictor selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import columns as ops
from cohortlens.operators import selection as sel
from cohortlens.plans import catalogue as cat
from cohortlens.plans.registry.adapters import PERIOD
from cohortlens.plans.registry.base import query
from cohortlens.plans.registry.oracle import VARIABLES
from cohortlens.session import cut_lineage


def stored_counts(w):
    """Value counts of the modelling frame, stored since several steps read them."""
    return cut_lineage(sel.value_counts(w.ml_rows(), "label", VARIABLES), "value_counts")


def _rounded(df, *columns, digits=9):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


@query("sel1", "SELECT row_id, label, p, x1, x2, x3, x4, x6 FROM ml_rows")
def sel1(w):
    return sel.drop_sparse(w.ml_rows(), 0.30)


@query("sel2", """SELECT * EXCLUDE (tres_up_doc, tres_up_prog) FROM weekly_resource""")
def sel2(w):
    return ops.drop_like(w.weekly_resources(), cat.REDUNDANT)


@query("sel3", """SELECT variable, round(freq_ratio, 9) AS freq_ratio, round(percent_unique, 9) AS percent_unique, one AS zero_var,
    one OR (freq_ratio > 19 AND percent_unique <= 10) AS nzv FROM (SELECT variable, coalesce(CAST(l[1] AS DOUBLE) / l[2], 0) AS freq_ratio,
    CAST(d AS DOUBLE) * 100 / r AS percent_unique, d <= 1 AS one FROM (SELECT variable, list(n ORDER BY n DESC) FILTER (WHERE value IS NOT NULL) AS l,
    count(value) AS d, sum(n) AS r FROM (SELECT variable, value, count(*) AS n FROM ml_long GROUP BY variable, value) GROUP BY variable))""")
def sel3(w):
    return _rounded(sel.near_zero_variance(stored_counts(w)), "freq_ratio", "percent_unique")


@query("sel4", "SELECT variable, round(iv, 9) AS iv FROM iv_table")
def sel4(w):
    return _rounded(sel.information_value(stored_counts(w)), "iv")


@query("sel5", "SELECT variable, round(iv, 9) AS iv FROM iv_table WHERE iv >= 0.1")
def sel5(w):
    return _rounded(sel.informative(sel.information_value(stored_counts(w)), 0.1), "iv")


# DuckDB gives NaN where a variable is constant
CORR = "SELECT variable1, variable2, CASE WHEN isnan(c) THEN NULL ELSE c END AS r FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS variable1, '{b}' AS variable2, corr({a}, {b}) AS c FROM ml_rows"
    for i, a in enumerate(VARIABLES) for b in VARIABLES[i + 1:]
) + ")"


@query("sel6", f"SELECT variable1, variable2, round(r, 6) + 0.0 AS r FROM ({CORR})")
def sel6(w):
    pairs = sel.correlation_pairs(w.ml_rows(), VARIABLES)
    return pairs.select("variable1", "variable2", (F.round("r", 6) + F.lit(0.0)).alias("r"))


@query("sel7", f"""WITH strong AS (SELECT variable1 AS a, variable2 AS b FROM ({CORR}) WHERE abs(r) > 0.8)
    SELECT variable, round(iv, 9) AS iv FROM iv_table v WHERE NOT EXISTS (SELECT 1 FROM strong s, iv_table o
    WHERE ((s.a = v.variable AND s.b = o.variable) OR (s.b = v.variable AND s.a = o.variable)) AND o.iv > v.iv)""")
def sel7(w):
    iv = cut_lineage(sel.information_value(stored_counts(w)), "iv")
    kept = sel.drop_correlated(w.ml_rows(), VARIABLES, iv, 0.8)
    return _rounded(iv.where(F.col("variable").isin(kept)), "iv")


@query("sel8", "SELECT variable, ks FROM ks_result")
def sel8(w):
    return sel.ks_table(stored_counts(w))


@query("sel9", "SELECT variable, ks FROM ks_result WHERE ks > 9 ORDER BY ks DESC, variable")
def sel9(w):
    return sel.ks_selected(sel.ks_table(stored_counts(w)))


@query("sel10", """SELECT variable, bin, low, high, n, n0, n1, round(share1, 9) AS share1, round(share0, 9) AS share0,
    round(woe, 9) AS woe, round(iv, 9) AS iv FROM woe""")
def sel10(w):
    return _rounded(sel.woe_bins(stored_counts(w)).drop("cut"), "share1", "share0", "woe", "iv")


@query("sel10_supervised")
def sel10_supervised(w):
    return sel.woe_bins_supervised(stored_counts(w))


def _applied(v: str) -> str:
    return f"""(SELECT b.value AS value, round(t.woe, 9) AS woe FROM (SELECT l.variable, l.value, CASE WHEN l.value IS NOT NULL
        THEN CAST(len(list_filter(c.cuts, lambda e: e <= l.value)) AS INTEGER) END AS bin
        FROM (SELECT DISTINCT variable, value FROM ml_long WHERE variable = '{v}') l LEFT JOIN iv_cut c ON c.variable = l.variable) b
        JOIN woe t ON t.variable = b.variable AND t.bin IS NOT DISTINCT FROM b.bin)"""


@query("sel11", "SELECT m.row_id, m.label, " + ", ".join(f"{v}t.woe AS {v}_woe" for v in ("x1", "x2", "x5")) + " FROM ml_rows m "
       + " ".join(f"JOIN {_applied(v)} {v}t ON {v}t.value IS NOT DISTINCT FROM m.{v}" for v in ("x1", "x2", "x5")))
def sel11(w):
    rows = w.ml_rows().select("row_id", "label", "x1", "x2", "x5")
    bins = cut_lineage(sel.woe_bins(stored_counts(w)), "woe")
    return _rounded(sel.woe_apply(rows, bins, ("x1", "x2", "x5")), "x1_woe", "x2_woe", "x5_woe")


@query("sel12", """SELECT variable, bin, n, n0, n1, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY variable), 9) AS count_share,
    round(CAST(n1 AS DOUBLE) / n, 9) AS positive_share, round(woe, 9) AS woe, round(iv, 9) AS iv,
    round(sum(iv) OVER (PARTITION BY variable), 9) AS total_iv FROM woe""")
def sel12(w):
    report = sel.woe_report(sel.woe_bins(stored_counts(w))).drop("interval")
    return _rounded(report, "count_share", "positive_share", "woe", "iv", "total_iv")


@query("sel13", "SELECT row_id, label, p, x1, x2, x3, x4, x5, x6 FROM ml_filled")
def sel13(w):
    return ops.impute_sentinel(w.ml_rows(), cat.SENTINEL, ["label"])


@query("sel14", "SELECT label, x6, x1 FROM ml_rows")
def sel14(w):
    return ops.align(w.ml_rows(), ["label", "x6", "x1"])


@query("sel15", f"""SELECT site_uid || '_' || CAST(user_id AS VARCHAR) AS key_id, CAST(sum(tt_pres_begin) AS BIGINT) AS tt_visita_sitio_peranalisis,
    CAST(sum(tt_forums_read) AS BIGINT) AS tt_lee_msg_foros_peranalisis, CAST(sum(tt_annc_new) AS BIGINT) AS tt_annc_new_peranalisis
    FROM weekly_event WHERE periodo_week = {PERIOD} GROUP BY 1""")
def sel15(w):
    key = F.concat("site_uid", F.lit("_"), F.col("user_id").cast("string")).alias("key_id")
    metrics = ("tt_pres_begin", "tt_forums_read", "tt_annc_new")
    level = w.weekly_events().where(F.col("periodo_week") == PERIOD).groupBy(key).agg(
        *[F.sum(m).alias(f"{m}_peranalisis") for m in metrics]
    )
    return ops.rename(level, ops.business_names(level.columns, cat.BUSINESS_NAMES))
