"""Queries of projections, filters and conditionals."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import columns as ops
from cohortlens.operators import programmes
from cohortlens.operators.selection import missing_rate
from cohortlens.plans.registry.base import query
from cohortlens.plans.registry.oracle import SITE_CASE, VARIABLES


@query("prj1", "SELECT p_partkey, p_name, p_brand FROM part")
def prj1(w):
    return w.table("part").select("p_partkey", "p_name", "p_brand")


@query("prj2", "SELECT * EXCLUDE (props, value) FROM events")
def prj2(w):
    return w.table("events").drop("props", "value")


PIVOT = ", ".join(f"CAST(sum(CASE WHEN periodo_week = {i} THEN tt_login END) AS BIGINT) AS \"{i}\"" for i in range(1, 7))


@query("prj3", f"""SELECT user_id, "2", "3", "4", "5", "6" FROM (SELECT user_id, {PIVOT} FROM weekly_login GROUP BY user_id)""")
def prj3(w):
    return ops.last_weeks(ops.pivot_weeks(w.weekly_logins(), "user_id", "periodo_week", "tt_login", range(1, 7)), 5)


@query("prj4", """SELECT site_uid, periodo_week, user_id, tres_down_foros, tres_down_doc, tres_down_msg, tres_down_tareas,
    tres_down_prog, tres_down_otros FROM weekly_resource""")
def prj4(w):
    return ops.select_like(w.weekly_resources(), "tres_down", keep=("site_uid", "periodo_week", "user_id"))


@query("prj5", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def prj5(w):
    lines = w.table("lineitem")
    return lines.select(*ops.numeric_columns(lines))


@query("prj6", "SELECT p_partkey AS number, p_name AS label, p_size FROM part")
def prj6(w):
    rows = w.table("part").select("p_partkey", "p_name", "p_size")
    return ops.rename(rows, {"p_partkey": "number", "p_name": "label", "absent": "other"})


@query("prj7", "SELECT label, row_id, x1, p FROM ml_rows")
def prj7(w):
    return ops.first_column(w.ml_rows().select("row_id", "x1", "label", "p"), "label")


@query("prj8", "SELECT site_id, user_id, CAST(5 AS INTEGER) AS periodo_week FROM lms_site_user")
def prj8(w):
    return w.site_user().select("site_id", "user_id", F.lit(5).alias("periodo_week"))


@query("prj9", """SELECT row_id, CAST(coalesce(trunc(x2), 0) AS INTEGER) AS x2, CAST(coalesce(trunc(x5), 0) AS INTEGER) AS x5,
    CAST(label AS INTEGER) AS label FROM ml_rows""")
def prj9(w):
    return ops.fill_cast_numeric(w.ml_rows().select("row_id", "x2", "x5", "label"))


@query("prj10", "SELECT row_id, coalesce(x1, 0) + coalesce(x2, 0) + coalesce(x5, 0) AS total FROM ml_rows")
def prj10(w):
    text = " + ".join(f"coalesce({c}, 0)" for c in ("x1", "x2", "x5"))
    return w.ml_rows().select("row_id", F.expr(text).alias("total"))


@query("flt1", """SELECT p_partkey, p_size, p_brand FROM part WHERE p_size > 10 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')
    AND NOT p_name = 'red widget'""")
def flt1(w):
    rows = w.table("part").where(
        (F.col("p_size") > 10) & F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3") & ~(F.col("p_name") == "red widget")
    )
    return rows.select("p_partkey", "p_size", "p_brand")


@query("flt2", """SELECT s.site_id, u.user_id FROM lms_site s LEFT JOIN lms_site_user u ON u.site_id = s.site_id
    WHERE u.user_id IS NOT NULL""")
def flt2(w):
    return w.site().select("site_id").join(w.site_user(), "site_id")


@query("flt3", "SELECT site_id, site_uid, title FROM clean_site")
def flt3(w):
    return programmes.clean_sites(w.site()).select("site_id", "site_uid", "title")


@query("flt4", "SELECT DISTINCT periodo_escolar, site_uid, tprogramas, tasignaturas, ttfm FROM roster")
def flt4(w):
    sites = w.clean_site()
    counts = programmes.programme_counts(sites).join(programmes.select_programmes(sites), "site_uid", "left_semi")
    return programmes.viable_programmes(counts).select("periodo_escolar", "site_uid", "tprogramas", "tasignaturas", "ttfm")


MISSING = " UNION ALL ".join(f"SELECT '{v}' AS variable, avg(CASE WHEN {v} IS NULL THEN 1.0 ELSE 0.0 END) AS missing FROM ml_rows" for v in VARIABLES)


@query("flt5", f"SELECT variable, round(missing, 9) AS missing FROM ({MISSING}) WHERE missing < 0.3")
def flt5(w):
    rates = missing_rate(w.ml_rows().select(*VARIABLES))
    return rates.where(F.col("missing") < 0.3).select("variable", F.round("missing", 9).alias("missing"))


@query("cnd1", f"SELECT site_id, {SITE_CASE} AS tipo_sitio FROM (SELECT site_id, replace(title, 'Ã¡', 'á') AS title FROM lms_site)")
def cnd1(w):
    from cohortlens.functions.text import repair_charset

    kind = programmes.site_type(repair_charset(F.col("title")), F.col("site_id"))
    return w.site().select("site_id", kind.alias("tipo_sitio"))


@query("cnd2", "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS large FROM orders")
def cnd2(w):
    return w.table("orders").select("o_orderkey", F.when(F.col("o_totalprice") > 250000, 1).otherwise(0).alias("large"))


