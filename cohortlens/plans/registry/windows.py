"""Queries of windows, ordering, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators import columns as ops
from cohortlens.operators import trailing
from cohortlens.operators.explain import top_k
from cohortlens.operators.prefix import quantiles, running_totals
from cohortlens.operators.programmes import programme_counts
from cohortlens.operators.selection import DECILES, first_edge, ks_bins
from cohortlens.plans.registry.adapters import PERIOD
from cohortlens.plans.registry.base import query
from cohortlens.plans.registry.oracle import EVENT_WHERE, VARIABLES, features_select
from cohortlens.plans.registry.selection import stored_counts
from cohortlens.session import cut_lineage


@query("win1", """SELECT site_id, periodo_escolar, site_uid, count(*) OVER g AS tregistros,
    min(CASE WHEN tipo_sitio = 'A. Programa' THEN createdon END) OVER g AS fecha_inicio,
    count(*) FILTER (WHERE tipo_sitio = 'A. Programa') OVER g AS tprogramas,
    count(*) FILTER (WHERE tipo_sitio = 'B. Asignatura') OVER g AS tasignaturas,
    count(*) FILTER (WHERE tipo_sitio = 'C. TFM') OVER g AS ttfm
    FROM clean_site WINDOW g AS (PARTITION BY periodo_escolar, site_uid)""")
def win1(w):
    # group totals are joined back, so a group is never held by one window task
    sites = w.clean_site()
    return sites.select("site_id", "periodo_escolar", "site_uid").join(
        programme_counts(sites), ["periodo_escolar", "site_uid"]
    )


@query("win2", """SELECT price, n, CAST(sum(n) OVER w AS BIGINT) AS running,
    round(CAST(sum(n) OVER w AS DOUBLE) / sum(n) OVER (), 9) AS share
    FROM (SELECT l_extendedprice AS price, count(*) AS n FROM lineitem GROUP BY 1) WINDOW w AS (ORDER BY price)""")
def win2(w):
    counts = w.table("lineitem").groupBy(F.col("l_extendedprice").alias("price")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.col("before_n") + F.col("n")
    return running_totals(counts, "price", ["n"]).select(
        "price", "n", upto.alias("running"), F.round(upto / F.col("all_n"), 9).alias("share")
    )


@query("win3", "SELECT variable, bin, n, row_number() OVER (PARTITION BY variable ORDER BY bin) AS orden FROM ks_bin")
def win3(w):
    place = F.row_number().over(Window.partitionBy("variable").orderBy("bin")).cast("long")
    return ks_bins(stored_counts(w)).select("variable", "bin", "n", place.alias("orden"))


@query("win4", """SELECT row_id, CAST(len(list_filter(edges, lambda e: e < x1)) AS INTEGER) + 1 AS bin FROM ml_rows,
    (SELECT edges FROM ks_edge WHERE variable = 'x1')""")
def win4(w):
    rows = w.ml_rows().select("row_id", "x1")
    # ten numbers come to the driver and go back as a literal
    edges = sorted(r["value"] for r in quantiles(rows, "x1", DECILES).collect())
    return rows.select("row_id", first_edge(F.col("x1"), F.array(*map(F.lit, edges))).alias("bin"))


@query("win5", features_select(("tcursos_events", "tt_forums_read"), "weekly_event", EVENT_WHERE))
def win5(w):
    panel = cut_lineage(w.weekly_events())
    return trailing.trailing_features(panel, ("tcursos_events", "tt_forums_read"), PERIOD, min_week=1)


@query("srt1", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def srt1(w):
    return w.table("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("srt2", """SELECT o_custkey, sum(o_totalprice) AS total FROM (SELECT o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS o_totalprice FROM orders)
    GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 30""")
def srt2(w):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    spent = w.table("orders").groupBy("o_custkey").agg(F.sum(cents).alias("total"))
    return top_k(spent, "total", 30)


@query("srt3", "SELECT o_custkey, arg_max(o_orderkey, [o_totalprice, -o_orderkey]) AS best FROM orders GROUP BY o_custkey")
def srt3(w):
    order = F.struct("o_totalprice", -F.col("o_orderkey"))
    return w.table("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", order).alias("best"))


@query("set1", """SELECT 'customer' AS dataset, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2
    UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2""")
def set1(w):
    def per_nation(table: str, column: str):
        return w.table(table).groupBy(F.col(column).alias("nation")).agg(F.count(F.lit(1)).alias("n"))

    return ops.union_labelled({"customer": per_nation("customer", "c_nationkey"), "supplier": per_nation("supplier", "s_nationkey")})


@query("set2", "SELECT variable, value, count(*) AS n FROM ml_long GROUP BY variable, value")
def set2(w):
    long = ops.melt(w.ml_rows().select("row_id", *VARIABLES), ["row_id"])
    return long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
