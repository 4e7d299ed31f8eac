import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import trailing
from cohortlens.plans import catalogue as cat

PANEL = "site_uid string, periodo_week int, user_id string, m int"


def features(spark, rows, period, **kw):
    panel = spark.createDataFrame([("P", w, u, m) for u, w, m in rows], PANEL)
    return {r["key_id"]: r.asDict() for r in trailing.trailing_features(panel, ["m"], period, **kw).collect()}


def test_three_week_window(spark):
    rows = [("u", 3, 2), ("u", 4, 0), ("u", 5, 5), ("v", 1, 1), ("v", 2, 1)]
    got = features(spark, rows, 5)["P_u"]
    assert [got[f"m_{s}"] for s in ("sum3s", "prom3s", "diff3s", "var3s", "max3s", "min3s", "sem3", "peranalisis")] == [
        7, 2.333, 3, 1.5, 5, 0, 2, 5]
    assert len(got) == 26


def test_growth_from_zero_is_null(spark):
    got = features(spark, [("u", 5, 3), ("v", 4, 1)], 5)["P_u"]
    assert got["m_var2s"] is None and got["m_sem2"] == 0


def test_median_reads_present_weeks_only(spark):
    got = features(spark, [("u", 3, 4), ("u", 5, 8), ("v", 4, 1)], 5)["P_u"]
    assert got["m_median3s"] == 6.0 and got["m_median2s"] == 8.0


def test_inactive_student_stays(spark):
    rows = [("u", 1, 9)] + [("v", w, 1) for w in range(1, 7)]
    got = features(spark, rows, 6)["P_u"]
    assert got["m_sum4s"] == 0 and got["m_median4s"] is None and got["m_peranalisis"] == 0


def test_observed_and_calendar_weeks(spark):
    rows = [("u", 1, 1), ("u", 2, 2), ("u", 5, 5), ("u", 9, 99)]
    assert features(spark, rows, 6)["P_u"]["m_sum3s"] == 8
    assert features(spark, rows, 6, weeks="calendar")["P_u"]["m_sum3s"] == 5
    with pytest.raises(ValueError):
        features(spark, rows, 6, weeks="other")


def test_short_history_counts_as_zero(spark):
    got = features(spark, [("u", 1, 4), ("u", 2, 6)], 6)["P_u"]
    assert (got["m_sum4s"], got["m_min3s"], got["m_sem4"]) == (10, 0, 0)


def test_one_pass_equals_literal_formulation(spark):
    """Pivot per metric, every statistic on its own, in plain Python."""
    rnd = random.Random(3)
    rows = [(f"u{u}", w, rnd.randrange(0, 6)) for u in range(40) for w in range(-2, 9) if rnd.random() < 0.6]
    got = features(spark, rows, 6, min_week=1)
    kept = [(u, w, m) for u, w, m in rows if 1 <= w <= 6]
    weeks = sorted({w for _, w, _ in kept})[-5:]
    assert set(got) == {f"P_{u}" for u, _, _ in kept}
    for user in {u for u, _, _ in kept}:
        cells = {w: m for u, w, m in kept if u == user}
        row = got[f"P_{user}"]
        for k in (2, 3, 4):
            span = weeks[-k:]
            values = [cells.get(w, 0) for w in span]
            present = [cells[w] for w in span if w in cells]
            assert row[f"m_sum{k}s"] == sum(values)
            assert row[f"m_prom{k}s"] == pytest.approx(sum(values) / k, abs=6e-4)
            assert row[f"m_diff{k}s"] == values[-1] - values[0]
            assert row[f"m_max{k}s"] == max(values) and row[f"m_min{k}s"] == min(values) and row[f"m_sem{k}"] == values[0]
            assert row[f"m_median{k}s"] == (median(present) if present else None)
            growth = values[-1] / values[0] - 1 if values[0] else None
            assert row[f"m_var{k}s"] == (pytest.approx(growth, abs=6e-4) if growth is not None else None)
        assert row["m_sum2s"] <= row["m_sum3s"] <= row["m_sum4s"]


def test_key_spine_and_history(spark):
    panel = spark.createDataFrame([("P", 0, "a", 1), ("P", 3, "b", 1), ("P", 9, "c", 1)], PANEL)
    assert {r[0] for r in trailing.key_spine(panel, 5).collect()} == {"P_a", "P_b"}
    assert {r[0] for r in trailing.key_spine(panel, 5, min_week=1).collect()} == {"P_b"}


def test_features_need_one_exchange_on_the_key(spark):
    panel = spark.createDataFrame([("P", 1, "a", 1)], PANEL)
    plan = trailing.trailing_features(panel, ["m"], 5, weeks="calendar")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(key_id") == 1 and "Join" not in plan


def test_assemble_keeps_labelled_students(spark):
    outcomes = spark.createDataFrame([("P", "a", 1, 6, 1, 0, 0), ("P", "z", 1, 5, 0, 0, 0)], "site_uid string, student_id string, tprogramas long, tasignaturas long, marca_abandono int, marca_extraordinaria int, marca_reprobado int")
    one = spark.createDataFrame([("P_a", 3)], "key_id string, e int")
    wide = trailing.assemble(outcomes, one, one.withColumnRenamed("e", "r"), one.withColumnRenamed("e", "l"))
    assert wide.columns == ["key_id", "tasignaturas", "marca_abandono", "l", "r", "e"]
    assert {tuple(r) for r in wide.collect()} == {("P_a", 6, 1, 3, 3, 3), ("P_z", 5, 0, None, None, None)}
    assert wide.where(F.col("e").isNull()).count() == 1


def test_packed_rows_give_the_same_wide_rows(spark):
    """Sums that are stored and joined in place of the columns: same values, NULL for students without a row."""
    def weekly(metrics, skip):
        rows = [
            (f"s{u % 2}", u, week, *[None if (u + week + i) % 5 == 0 else (u * 7 + week * 3 + i) % 11 for i in range(len(metrics))])
            for u in range(8) for week in range(-1, 6) if (u + week) % 3 and u != skip
        ]
        shape = "site_uid string, user_id long, periodo_week int, " + ", ".join(f"`{m}` long" for m in metrics)
        return spark.createDataFrame([*rows, *rows[:2]], shape)

    panels = (weekly(cat.EVENT_METRICS, 1), weekly(cat.RESOURCE_METRICS, 2), weekly((cat.LOGIN_METRIC,), 3))
    outcomes = spark.createDataFrame(
        [(f"s{u % 2}", u, 3, u % 2) for u in (0, 1, 2, 3, 3, 5, 20)], "site_uid string, student_id long, tasignaturas int, marca_abandono int"
    )
    builders = (trailing.event_features, trailing.resource_features, trailing.login_features)
    plain = trailing.assemble(outcomes, *[b(p, 5) for b, p in zip(builders, panels, strict=True)])
    small = [b(p, 5, packed=True) for b, p in zip(builders, panels, strict=True)]
    assert all(t.columns == ["key_id", "_ages"] for t in small)
    packed = trailing.assemble(outcomes, *small)
    assert packed.columns == plain.columns and [f.dataType for f in packed.schema] == [f.dataType for f in plain.schema]
    one, other = (sorted(map(tuple, d.collect()), key=repr) for d in (packed, plain))
    assert one == other and len(one) == 7 and any(None in r for r in one)
