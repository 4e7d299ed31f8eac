"""Trailing-window statistics over weekly panels, all metrics in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.keys import key_id
from cohortlens.functions.numeric import median_text
from cohortlens.plans import catalogue as cat

WIDTHS = (2, 3, 4)
KEPT_WEEKS = 5
#: Column of packed rows: the sums of the last four weeks, each a vector of all metrics or NULL.
AGES = "_ages"


def history(panel: DataFrame, period: int, min_week: int | None = None) -> DataFrame:
    """Rows up to the analysis week, optionally from ``min_week`` on."""
    rows = panel.where(F.col("periodo_week") <= period)
    return rows if min_week is None else rows.where(F.col("periodo_week") >= min_week)


def with_key(panel: DataFrame) -> DataFrame:
    """Panel keyed by ``key_id`` instead of programme and student."""
    rest = [c for c in panel.columns if c not in ("site_uid", "user_id")]
    return panel.select(key_id(F.col("site_uid"), F.col("user_id")).alias("key_id"), *rest)


def key_spine(panel: DataFrame, period: int, min_week: int | None = None) -> DataFrame:
    """Every student with history up to the analysis week, inactive ones included."""
    return with_key(history(panel, period, min_week)).select("key_id").distinct()


def recent_weeks(rows: DataFrame, period: int, weeks: str = "observed") -> Column:
    """The last weeks, newest first, as an array column.

    ``observed`` takes weeks that occur in the data, found by a scalar subquery of at most five
    values; ``calendar`` counts back from the analysis week.
    """
    if weeks == "calendar":
        return F.array(*[F.lit(period - i) for i in range(KEPT_WEEKS)])
    if weeks != "observed":
        raise ValueError(f"unknown week rule {weeks}")
    seen = rows.select("periodo_week").distinct().orderBy(F.desc("periodo_week")).limit(KEPT_WEEKS)
    return seen.agg(F.sort_array(F.collect_list("periodo_week"), asc=False)).scalar()


def _block(metric: str, widths: Sequence[int]) -> list[str]:
    """Statistics of one metric from its columns ``_<metric>_<age>``; age 1 is the last week.

    SQL texts, since some 1,200 column objects would take longer to build than the job to run.
    """
    raw = {age: f"`_{metric}_{age}`" for age in range(1, max(widths) + 1)}
    filled = {age: f"coalesce({c}, 0)" for age, c in raw.items()}
    last = filled[1]
    out = [f"{last} AS `{metric}_peranalisis`"]
    for k in widths:
        ages = range(k, 0, -1)
        first, span = filled[k], [filled[a] for a in ages]
        total, listed = " + ".join(span), ", ".join(span)
        out += [
            f"{total} AS `{metric}_sum{k}s`",
            f"round(({total}) / {k}D, 3) AS `{metric}_prom{k}s`",
            f"{last} - {first} AS `{metric}_diff{k}s`",
            f"round(try_divide(double({last}), double({first})) - 1, 3) AS `{metric}_var{k}s`",
            f"greatest({listed}) AS `{metric}_max{k}s`",
            f"least({listed}) AS `{metric}_min{k}s`",
            f"{first} AS `{metric}_sem{k}`",
            f"{median_text([raw[a] for a in ages])} AS `{metric}_median{k}s`",
        ]
    return out


def _added(age: int) -> Column:
    """Sum of the vectors of one age, NULL where there is none; a NULL element adds nothing."""
    return F.expr(
        f"aggregate(filter(_weeks, x -> x.age = {age}), CAST(NULL AS array<bigint>), (s, x) -> CASE WHEN s IS NULL THEN x.v "
        "ELSE zip_with(s, x.v, (a, b) -> coalesce(a + b, a, b)) END)"
    )


def trailing_features(
    panel: DataFrame,
    metrics: Sequence[str],
    period: int,
    min_week: int | None = None,
    weeks: str = "observed",
    widths: Sequence[int] = WIDTHS,
    parts: int | None = None,
    packed: bool = False,
) -> DataFrame:
    """One row per student with 25 columns per metric, or ``packed``, with the sums that these follow from.

    ``panel`` has one row per (programme, week, student). One exchange on the key moves the rows as
    they are (a student has few weeks, so sums ahead of it would only be wider), into ``parts``
    partitions if given. The last weeks of a student become one list of (age, vector of all
    metrics); vectors of one age are added element by element, and the statistics are a projection over
    the four sums. A week without a row counts as 0 except in the median, which reads existing rows only.
    ``assemble`` takes packed rows and makes the same columns of them behind its joins.
    """
    rows = with_key(history(panel, period, min_week)).select("key_id", "periodo_week", *metrics)
    recent = recent_weeks(rows, period, weeks)
    vector = F.array(*[F.col(m).cast("long") for m in metrics])
    aged = rows.select(
        "key_id", F.array_position(recent, F.col("periodo_week")).cast("int").alias("_age"), vector.alias("_values")
    )
    aged = aged.repartition(parts, "key_id") if parts else aged.repartition("key_id")
    # older weeks leave the student's row, but not their values
    kept = F.when(F.col("_age").between(1, max(widths)), F.struct(F.col("_age").alias("age"), F.col("_values").alias("v")))
    ages = range(1, max(widths) + 1)
    sums = aged.groupBy("key_id").agg(F.collect_list(kept).alias("_weeks")).select(
        "key_id", *[_added(age).alias(f"_age_{age}") for age in ages]
    )
    if packed:
        return sums.select("key_id", F.array(*[F.col(f"_age_{age}") for age in ages]).alias(AGES))
    wide = sums.selectExpr(
        "key_id", *[f"_age_{age}[{i}] AS `_{m}_{age}`" for i, m in enumerate(metrics) for age in ages]
    )
    return wide.selectExpr("key_id", *[text for m in metrics for text in _block(m, widths)])


def event_features(
    weekly: DataFrame, period: int, weeks: str = "observed", parts: int | None = None, packed: bool = False
) -> DataFrame:
    """Features of the 49 event metrics; weeks before the start are left out."""
    return trailing_features(weekly, cat.EVENT_METRICS, period, min_week=1, weeks=weeks, parts=parts, packed=packed)


def resource_features(
    weekly: DataFrame, period: int, weeks: str = "observed", parts: int | None = None, packed: bool = False
) -> DataFrame:
    """Features of the 12 resource metrics; weeks before the start take part."""
    return trailing_features(weekly, cat.RESOURCE_METRICS, period, weeks=weeks, parts=parts, packed=packed)


def login_features(
    weekly: DataFrame, period: int, weeks: str = "observed", parts: int | None = None, packed: bool = False
) -> DataFrame:
    """Features of the login count."""
    return trailing_features(weekly, (cat.LOGIN_METRIC,), period, weeks=weeks, parts=parts, packed=packed)


def labelled_keys(outcomes: DataFrame) -> DataFrame:
    """Label and course count per key."""
    return outcomes.select(
        key_id(F.col("site_uid"), F.col("student_id")).alias("key_id"), "tasignaturas", cat.LABEL
    )


def assemble(outcomes: DataFrame, events: DataFrame, resources: DataFrame, logins: DataFrame) -> DataFrame:
    """Wide analytic row: every labelled student with whatever features exist.

    The tables are joined as they lie where all are stored in the same number of buckets of
    ``key_id`` (``sources.buckets``): no exchange and no sort, so no join copies a row of some 1,550
    columns to another machine. Tables stored otherwise are joined by an exchange each. Of packed
    tables the joins move four sums a metric, and the 25 columns of each are made in the end, of labelled students only.
    """
    found = labelled_keys(outcomes) if "key_id" not in outcomes.columns else outcomes
    # name of the packed column, flag of a student with a row, metrics
    packed: list[tuple[str, str, Sequence[str]]] = []
    shown = [f"`{c}`" for c in found.columns]
    for table, name, metrics in (
        (logins, "logins", (cat.LOGIN_METRIC,)), (resources, "resources", cat.RESOURCE_METRICS), (events, "events", cat.EVENT_METRICS),
    ):
        if AGES in table.columns:
            packed.append((f"{AGES}_{name}", f"_has_{name}", metrics))
            # mostly zeros, so files say little of the size in memory: never a broadcast by their size
            table = table.select("key_id", F.col(AGES).alias(f"{AGES}_{name}")).hint("merge")
            for text in (t for m in metrics for t in _block(m, WIDTHS)):
                value, alias = text.rsplit(" AS ", 1)
                shown.append(f"IF(_has_{name}, {value}, NULL) AS {alias}")
        else:
            shown += [f"`{c}`" for c in table.columns if c != "key_id"]
        found = found.join(table, "key_id", "left")
    if not packed:
        return found
    ages = range(1, max(WIDTHS) + 1)
    sums = [
        f"{column}[{age - 1}][{i}] AS `_{m}_{age}`" for column, _, metrics in packed for i, m in enumerate(metrics) for age in ages
    ]
    rest = [f"`{c}`" for c in found.columns if c not in {column for column, _, _ in packed}]
    return found.selectExpr(*rest, *[f"{column} IS NOT NULL AS {flag}" for column, flag, _ in packed], *sums).selectExpr(*shown)
