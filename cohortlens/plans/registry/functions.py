"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import calendar, keys, numeric, text
from cohortlens.operators import columns as ops
from cohortlens.operators import grades, programmes, weekly
from cohortlens.plans.registry.base import query
from cohortlens.plans.registry.oracle import ITEM_CASE, RESOURCE_CASE, SITE_CASE, STUDY_CASE

REPAIR_TITLE = "replace(title, 'Ã¡', 'á')"


@query("str1", """SELECT site_id, CAST(pos AS INTEGER) AS pos, string_split(site_id, '-')[pos] AS part
    FROM (SELECT site_id, unnest(range(1, len(string_split(site_id, '-')) + 1)) AS pos FROM lms_site)""")
def str1(w):
    pieces = F.posexplode(F.split("site_id", "-")).alias("pos", "part")
    return w.site().select("site_id", pieces).withColumn("pos", F.col("pos") + 1)


@query("str2", """SELECT site_id, p[1] AS sid, TRY_CAST(p[2] AS INTEGER) AS idmaster, p[3] AS idasignatura, p[4] AS idparalelo
    FROM (SELECT site_id, string_split(site_id, '-') AS p FROM lms_site)""")
def str2(w):
    return keys.with_site_parts(w.site()).select("site_id", "sid", "idmaster", "idasignatura", "idparalelo")


@query("str3", "SELECT site_id, p[1] || '-' || p[2] || '-' || p[4] AS site_uid FROM (SELECT site_id, string_split(site_id, '-') AS p FROM lms_site)")
def str3(w):
    return w.site().select("site_id", keys.site_uid(F.col("site_id")).alias("site_uid"))


@query("str4", f"SELECT site_id, upper({REPAIR_TITLE}) AS title FROM lms_site")
def str4(w):
    return w.site().select("site_id", F.upper(text.repair_charset(F.col("title"))).alias("title"))


@query("str5", f"SELECT site_id, regexp_matches(upper({REPAIR_TITLE}), 'MÁSTER|GRADO') AS hit FROM lms_site")
def str5(w):
    return w.site().select("site_id", F.upper(text.repair_charset(F.col("title"))).rlike("MÁSTER|GRADO").alias("hit"))


@query("str6", "SELECT site_id, contains(site_id, '-000') AS hit FROM lms_site")
def str6(w):
    return w.site().select("site_id", F.col("site_id").contains("-000").alias("hit"))


@query("str7", f"SELECT site_id, {REPAIR_TITLE} AS title FROM lms_site")
def str7(w):
    return w.site().select("site_id", text.repair_charset(F.col("title")).alias("title"))


@query("str8", f"SELECT id, {ITEM_CASE} AS tipo_nota FROM (SELECT id, replace(name, 'Ã³', 'ó') AS name FROM lms_gradable_object)")
def str8(w):
    return w.gradable_object().select("id", grades.item_type(text.repair_charset(F.col("name"))).alias("tipo_nota"))


@query("str9", f"SELECT resource_ref, {RESOURCE_CASE} AS tipo, count(*) AS n FROM (SELECT replace(resource_ref, 'Ã³', 'ó') AS resource_ref FROM lms_resource) GROUP BY ALL")
def str9(w):
    ref = text.repair_charset(F.col("resource_ref"))
    rows = w.resources().select(ref.alias("resource_ref"), weekly.resource_kind(ref).alias("tipo"))
    return rows.groupBy("resource_ref", "tipo").agg(F.count(F.lit(1)).alias("n"))


@query("str10", f"SELECT site_id, {STUDY_CASE} AS tipo_estudio, {SITE_CASE} AS tipo_sitio FROM (SELECT site_id, {REPAIR_TITLE} AS title FROM lms_site)")
def str10(w):
    title = text.repair_charset(F.col("title"))
    return w.site().select(
        "site_id", programmes.study_type(title).alias("tipo_estudio"),
        programmes.site_type(title, F.col("site_id")).alias("tipo_sitio"),
    )


@query("arr1", "SELECT site_id, CAST(len(string_split(title, ' ')) AS INTEGER) AS words FROM lms_site")
def arr1(w):
    return w.site().select("site_id", F.array_size(F.split("title", " ")).alias("words"))


@query("arr2", "SELECT site_id, string_split(title, ' ')[-1] AS periodo_escolar FROM lms_site")
def arr2(w):
    return w.site().select("site_id", programmes.last_word(F.col("title")).alias("periodo_escolar"))


@query("dat1", "SELECT event_id, CAST(year(ts) * 100 + month(ts) AS INTEGER) AS periodo FROM events")
def dat1(w):
    return w.table("events").select("event_id", calendar.year_month(F.col("ts")).alias("periodo"))


@query("dat2", """SELECT o_orderkey, CAST(ceil((day(o_orderdate) + dayofweek(date_trunc('month', o_orderdate))) / 7.0::DOUBLE) AS INTEGER) AS nweek
    FROM orders""")
def dat2(w):
    return w.table("orders").select("o_orderkey", calendar.week_of_month(F.col("o_orderdate")).alias("nweek"))


@query("dat3", "SELECT event_id, strftime(ts, '%a') AS dweek FROM events")
def dat3(w):
    return w.table("events").select("event_id", calendar.day_name(F.col("ts")).alias("dweek"))


@query("dat4", "SELECT event_id, CASE WHEN strftime(ts, '%a') IN ('Sun', 'Sat') THEN 1 ELSE 0 END AS fds FROM events")
def dat4(w):
    return w.table("events").select("event_id", calendar.weekend_flag(F.col("ts")).alias("fds"))


@query("dat5", "SELECT event_id, CAST(datediff('day', DATE '2024-01-10', CAST(ts AS DATE)) AS INTEGER) AS days FROM events")
def dat5(w):
    return w.table("events").select("event_id", F.datediff("ts", F.lit("2024-01-10").cast("date")).alias("days"))


@query("dat6", "SELECT event_id, CAST(trunc(datediff('day', DATE '2024-01-16', CAST(ts AS DATE)) / 7.0::DOUBLE + 1) AS INTEGER) AS periodo_week FROM events")
def dat6(w):
    start = F.lit("2024-01-16").cast("date")
    return w.table("events").select("event_id", calendar.study_week(F.col("ts"), start).alias("periodo_week"))


@query("mth1", "SELECT row_id, round(x2, 1) AS x2 FROM ml_rows WHERE x2 IS NOT NULL")
def mth1(w):
    return w.ml_rows().where("x2 IS NOT NULL").select("row_id", F.round("x2", 1).alias("x2"))


@query("mth2", "SELECT row_id, round_even(x1 / 2, 0) AS half, round_even((1 - p) * 1000, 0) AS score FROM ml_rows")
def mth2(w):
    return w.ml_rows().select("row_id", F.bround(F.col("x1") / 2, 0).alias("half"), F.bround((1 - F.col("p")) * 1000, 0).alias("score"))


@query("mth3", "SELECT row_id, x1 / nullif(x3, 0) AS ratio FROM ml_rows")
def mth3(w):
    return w.ml_rows().select("row_id", numeric.ratio(F.col("x1"), F.col("x3")).alias("ratio"))


@query("mth4", """SELECT row_id, greatest(x1, x3, x6) AS high, least(x1, x3, x6) AS low, x1 + x3 + x6 AS total,
    round((x1 + x3 + x4) / 3, 3) AS mean, quantile_cont(v, 0.5) AS median FROM
    (SELECT row_id, x1, x3, x4, x6, rn, unnest([x1, x3, x5]) AS v FROM (SELECT *, row_number() OVER () AS rn FROM ml_rows)) GROUP BY rn, row_id, x1, x3, x4, x6""")
def mth4(w):
    three = [F.col(c) for c in ("x1", "x3", "x6")]
    return w.ml_rows().select(
        "row_id", F.greatest(*three).alias("high"), F.least(*three).alias("low"),
        numeric.row_sum(three).alias("total"), numeric.row_mean([F.col(c) for c in ("x1", "x3", "x4")]).alias("mean"),
        numeric.row_median(["x1", "x3", "x5"]).alias("median"),
    )


@query("mth5", "SELECT c_custkey, abs(c_acctbal) AS balance FROM customer")
def mth5(w):
    return w.table("customer").select("c_custkey", F.abs("c_acctbal").alias("balance"))


@query("nul1", "SELECT row_id, coalesce(x2, x5, 0) AS value FROM ml_rows")
def nul1(w):
    return w.ml_rows().select("row_id", F.coalesce("x2", "x5", F.lit(0.0)).alias("value"))


@query("nul2", "SELECT row_id, coalesce(x2, 0) AS x2, coalesce(x5, 0) AS x5 FROM ml_rows")
def nul2(w):
    return w.ml_rows().select("row_id", "x2", "x5").na.fill(0)


@query("nul3", "SELECT row_id, x2 IS NULL AS no_x2, x5 IS NOT NULL AND x2 IS NOT NULL AS both FROM ml_rows")
def nul3(w):
    x2, x5 = F.col("x2"), F.col("x5")
    return w.ml_rows().select("row_id", x2.isNull().alias("no_x2"), (x5.isNotNull() & x2.isNotNull()).alias("both"))


@query("nul4", "SELECT row_id, label, coalesce(x2, -9999) AS x2, coalesce(x5, -9999) AS x5 FROM ml_rows")
def nul4(w):
    return ops.impute_sentinel(w.ml_rows().select("row_id", "label", "x2", "x5"), -9999)


@query("cst1", """SELECT site_id, TRY_CAST(string_split(site_id, '-')[4] AS INTEGER) AS paralelo, CAST(published = 1 AS INTEGER) AS flag,
    CAST(trunc(size) AS INTEGER) AS size FROM (SELECT *, len(title) / 3.0::DOUBLE AS size FROM lms_site)""")
def cst1(w):
    part = F.get(F.split("site_id", "-"), F.lit(3)).try_cast("int")
    return w.site().select(
        "site_id", part.alias("paralelo"), (F.col("published") == 1).cast("int").alias("flag"),
        (F.length("title") / F.lit(3.0)).cast("int").alias("size"),
    )
