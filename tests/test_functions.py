import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import calendar, keys, numeric, text
from cohortlens.operators import columns, grades, programmes, weekly
from cohortlens.plans import catalogue as cat


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", dt.date: "date"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'double')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("days, week", [(-14, -1), (-13, 0), (-1, 0), (0, 1), (6, 1), (7, 2)])
def test_study_week(spark, days, week):
    start = dt.date(2022, 3, 1)
    day = start + dt.timedelta(days=days)
    assert one(spark, calendar.study_week(F.col("d"), F.col("s")), d=day, s=start) == week


def test_site_parts(spark):
    rows = spark.createDataFrame([("PER1-5-000-01",), ("PER1-5",), ("PER1-x-000-01",)], "site_id string")
    got = [tuple(r)[1:] for r in keys.with_site_parts(rows).collect()]
    assert got == [
        ("PER1", 5, "000", "01", "PER1-5-01"),
        ("PER1", 5, None, None, None),
        ("PER1", None, "000", "01", "PER1-x-01"),
    ]


@pytest.mark.parametrize("raw, fixed", [
    ("MÃ¡ster", "Máster"),
    ("Máster", "Máster"),
    ("plain", "plain"),
    ("SesiÃ³n â€œunoâ€\u009d", "Sesión “uno”"),
    ("日本", "日本"),
    ("MÃ\u0081STER", "MÁSTER"),
])
def test_repair_charset(spark, raw, fixed):
    assert one(spark, text.repair_charset(F.col("t")), t=raw) == fixed


def test_repair_keeps_null(spark):
    assert spark.sql("select cast(null as string) t").select(text.repair_charset(F.col("t"))).first()[0] is None


@pytest.mark.parametrize("title, site, kind", [
    ("Trabajo Fin de Máster PER1", "PER1-5-000-01", cat.THESIS),
    ("Máster", "PER1-5-000-01", cat.PROGRAMME),
    ("Máster", "PER1-5-001-01", cat.COURSE),
    ("Máster", "X1-5-001-01", cat.OTHER_SITE),
])
def test_site_type_order(spark, title, site, kind):
    assert one(spark, programmes.site_type(F.col("t"), F.col("s")), t=title, s=site) == kind


@pytest.mark.parametrize("title, kind", [("máster x", "MAESTRIA"), ("Mástel", "MAESTRIA"), ("Grado", "GRADO"), ("x", "OTROS")])
def test_study_type(spark, title, kind):
    # the star of the pattern belongs to its last letter
    assert one(spark, programmes.study_type(F.col("t")), t=title) == kind


@pytest.mark.parametrize("name, kind", [
    ("Laboratorio test", "ACTIVIDADES"), ("Test 1", "TEST"), ("prácticas", "PRACTICAS"), ("sesión 1", "ASISTENCIA"),
    ("Examen", "EXAMEN"), ("Course Grade", "NOTA_FINAL"), ("zzz", "OTROS"),
])
def test_item_type(spark, name, kind):
    assert one(spark, grades.item_type(F.col("n")), n=name) == kind


@pytest.mark.parametrize("ref, kind", [
    ("/x/foro/1", "Foros"), ("/documentación/a", "Documentacion"), ("/Mensajes Privados/", "Mensajes"),
    ("/tareas/", "Actividades"), ("/a.PSPDF", "Programacion"), ("/zzz", "Otros"),
])
def test_resource_kind(spark, ref, kind):
    assert one(spark, weekly.resource_kind(F.col("r")), r=ref) == kind


def test_ratio_of_zero_is_null(spark):
    assert one(spark, numeric.ratio(F.col("a"), F.col("b")), a=3.0, b=0.0) is None


def test_row_median(spark):
    rows = spark.createDataFrame([(4.0, None, 8.0), (None, None, None), (1.0, 9.0, 2.0), (None, 5.0, None)], "a double, b double, c double")
    assert [r[0] for r in rows.select(numeric.row_median(["a", "b", "c"])).collect()] == [6.0, None, 2.0, 5.0]
    assert [r[0] for r in rows.select(numeric.row_median(["a", "b"])).collect()] == [4.0, None, 5.0, 5.0]


def test_week_of_month_and_weekend(spark):
    # 1 October 2022 was a Saturday, so the 2nd opens the second week
    for day, week, flag, name in ((1, 1, 1, "Sat"), (2, 2, 1, "Sun"), (3, 2, 0, "Mon"), (31, 6, 0, "Mon")):
        d = dt.date(2022, 10, day)
        assert one(spark, calendar.week_of_month(F.col("d")), d=d) == week
        assert one(spark, calendar.weekend_flag(F.col("d")), d=d) == flag
        assert one(spark, calendar.day_name(F.col("d")), d=d) == name
    assert one(spark, calendar.year_month(F.col("d")), d=dt.date(2022, 2, 1)) == 202202


def test_business_names():
    names = columns.business_names(
        ["tt_content_read_min3s", "tres_down_foros_sem2", "tt_login_min4s", "tasignaturas", "tt_sam_assessment_take_via_url_sum2s"],
        cat.BUSINESS_NAMES,
    )
    assert names["tt_content_read_min3s"] == "tt_descarga_recursos_min3s"
    assert names["tres_down_foros_sem2"] == "tt_descarga_recursos_foros_sem2"
    assert "tt_login_min4s" not in names and "tasignaturas" not in names


def test_impute_sentinel_covers_nan(spark):
    rows = spark.sql("select 1 label, cast('NaN' as double) a, cast(null as int) b, 'x' t")
    assert tuple(columns.impute_sentinel(rows, -9999, ["label"]).first()) == (1, -9999.0, -9999, "x")


def test_catalogue_sizes():
    assert len(cat.EVENT_METRICS) == 49 and len(cat.RESOURCE_METRICS) == 12
    assert len(set(cat.EVENT_METRICS)) == 49
