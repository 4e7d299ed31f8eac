"""Grade books, grade records and the outcome label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numeric import ratio
from cohortlens.functions.text import classify, repair_charset
from cohortlens.plans import catalogue as cat


def gradebooks(books: DataFrame, roster: DataFrame) -> DataFrame:
    """Grade books of rostered sites."""
    sites = roster.select("site_uid", "site_id", "tipo_sitio").distinct()
    renamed = books.where(F.col("id").isNotNull()).select(
        F.col("id").alias("gradebook_id"),
        F.col("gradebook_uid").alias("site_id"),
        "category_type",
        "selected_grade_mapping_id",
    )
    return renamed.join(sites, "site_id").select(
        "gradebook_id", "site_uid", "site_id", "tipo_sitio", "category_type", "selected_grade_mapping_id"
    )


def _items(objects: DataFrame) -> DataFrame:
    return objects.select(
        F.col("id").alias("gradable_object_id"), "gradebook_id", "object_type_id", "due_date",
        repair_charset(F.col("name")).alias("name"), "points_possible", "category_id",
    )


def grade_items(objects: DataFrame, books: DataFrame) -> DataFrame:
    """Grade books with their items; a book without items stays, its item columns NULL.

    Written as an inner join plus the unused books: a crowded book is then on the side that the
    adaptive skew join can split.
    """
    items = _items(objects)
    matched = items.join(books, "gradebook_id")
    used = items.select("gradebook_id").distinct()
    empty = books.join(used, "gradebook_id", "left_anti")
    return matched.unionByName(empty, allowMissingColumns=True).select(
        *books.columns, *[c for c in items.columns if c != "gradebook_id"]
    )


def item_type(name: Column) -> Column:
    return classify({"name": F.upper(name)}, cat.GRADE_RULES, cat.GRADE_DEFAULT)


def grade_records(records: DataFrame, items: DataFrame) -> DataFrame:
    """Grades of students with their classified item and the share of points earned."""
    own = records.where(F.col("student_id").isNotNull()).select(
        "gradable_object_id", "student_id", "grader_id", "points_earned", "date_recorded",
        "points_earned_extra",
    )
    return own.join(items, "gradable_object_id").select(
        *items.columns,
        *[c for c in own.columns if c != "gradable_object_id"],
        item_type(F.col("name")).alias("tipo_nota"),
        F.round(ratio(F.col("points_earned"), F.col("points_possible")), 2).alias("ratio_points_earned"),
    )


def _low(points: Column, limit: int = 50) -> Column:
    """Below the limit or not graded."""
    return (points < limit) | points.isNull()


def dropout_rule(first: Column, extra: Column) -> Column:
    """Number of the first dropout rule that holds, NULL when none does."""
    return (
        F.when(first.isNull() & extra.isNull(), 1)
        .when((first < 50) & extra.isNull(), 2)
        .when(first.isNull() & (extra < 50), 3)
        .when((first < 25) & (extra < 25), 4)
    )


def outcome_flags(records: DataFrame) -> DataFrame:
    """Flags of every final grade outside category type 1 (an unknown type is left out too)."""
    first, extra = F.col("points_earned"), F.col("points_earned_extra")
    rule = dropout_rule(first, extra)
    return records.where((F.col("tipo_nota") == cat.FINAL_GRADE) & (F.col("category_type") != 1)).select(
        "site_uid", "site_id", "student_id", "tipo_nota", "points_possible", "points_earned",
        "points_earned_extra",
        F.when(_low(first), 1).otherwise(0).alias("marca_extraordinaria"),
        F.when(_low(first) & _low(extra), 1).otherwise(0).alias("marca_reprobado"),
        F.when(rule.isNotNull(), 1).otherwise(0).alias("marca_abandono"),
        rule.cast("string").alias("detalle_abandono"),
    )


def student_outcomes(flags: DataFrame) -> DataFrame:
    """One row per student and programme: worst flags and the number of graded courses.

    A first aggregate per course removes repeated sittings before the exchange, the second
    counts courses; neither ever holds the rows of a student in memory.
    """
    marks = ("marca_abandono", "marca_extraordinaria", "marca_reprobado")
    per_course = flags.groupBy("site_uid", "student_id", "site_id").agg(*[F.max(m).alias(m) for m in marks])
    return per_course.groupBy("site_uid", "student_id").agg(
        F.max(F.when(F.col("site_uid").isNotNull(), 1).otherwise(0)).cast("long").alias("tprogramas"),
        F.count("site_id").alias("tasignaturas"),
        *[F.max(m).alias(m) for m in marks],
    )
