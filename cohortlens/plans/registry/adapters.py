"""The learning-platform source tables as views over the generated star schema.

Every view maps whole tables: parts are sites, line items and events are enrolments, events are
the activity logs, line items and events are grades.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import enrolment, grades, programmes, trailing, weekly
from cohortlens.plans import catalogue as cat
from cohortlens.session import cut_lineage
from cohortlens.sources import buckets_for, read_table, store_bucketed

PERIOD = 5
EVENT_NAMES = (*cat.EVENT_IDS, "site.add", "user.login")


def _site_code(number: Column) -> Column:
    """Site code of a part number: ten sites per programme, number 0 the programme itself."""
    master = F.floor(number / 10).cast("long")
    return F.concat(
        F.lit("PER"), (master % 50 + 1000).cast("string"),
        F.lit("-"), master.cast("string"),
        F.lit("-"), F.lpad((number % 10).cast("string"), 3, "0"),
    )


def _site_id(number: Column) -> Column:
    return F.concat(_site_code(number), F.lit("-01"))


def _damaged(text: Column) -> Column:
    """UTF-8 text as it looks after being read as windows-1252."""
    return F.replace(F.replace(text, F.lit("á"), F.lit("Ã¡")), F.lit("ó"), F.lit("Ã³"))


def _event_site() -> Column:
    return F.floor(F.col("user_id") / 3).cast("long") * 10 + F.col("event_id") % 10


class World:
    """Views over one folder of generated tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}
        self._places: DataFrame | None = None
        self._roster: DataFrame | None = None
        self._parts: DataFrame | None = None
        self._sites: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = read_table(self.spark, self.folder, name)
        return self._tables[name]

    def parts(self) -> DataFrame:
        """Parts dealt over tasks. The file is small, so its scan is one task, but the rows of the sites
        take long: texts and regular expressions. Stored, since a filter would go into the scan again."""
        if self._parts is None:
            rows = self.table("part").select("p_partkey", "p_size", "p_brand")
            self._parts = cut_lineage(rows.repartition("p_partkey"), "part")
        return self._parts

    def site(self) -> DataFrame:
        """Stored: filters over it would else repeat the making of its texts, in code too long to be compiled."""
        if self._sites is None:
            self._sites = cut_lineage(self._made_sites(), "site")
        return self._sites

    def _made_sites(self) -> DataFrame:
        number, size = F.col("p_partkey"), F.col("p_size")
        master = F.floor(number / 10).cast("long")
        broken = (size == 47) & (number % 10).between(1, 8)
        kind = (
            F.when(size == 48, "Demo")
            .when(number % 10 == 9, "Trabajo Fin de Máster")
            .when(master % 7 == 3, "Grado")
            .otherwise("Máster")
        )
        title = F.concat(kind, F.lit(" "), F.col("p_brand"), F.lit(" PER"), (master % 50).cast("string"))
        late = F.when(master % 6 == 5, 365).otherwise(0)
        return self.parts().select(
            F.when(broken, _site_code(number)).otherwise(_site_id(number)).alias("site_id"),
            _damaged(title).alias("title"),
            F.when(size == 49, "project").otherwise("course").alias("type"),
            F.when(size == 50, 0).otherwise(1).alias("published"),
            F.date_add(F.lit("2021-06-01").cast("date"), size + late).alias("createdon"),
        )

    def sales(self) -> DataFrame:
        lines, orders = self.table("lineitem"), self.table("orders")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def site_user(self) -> DataFrame:
        """Site numbers become texts after the exchange; different numbers have different texts."""
        bought = self.sales().select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("number"))
        active = self.table("events").select("user_id", _event_site().alias("number"))
        return bought.unionByName(active).distinct().select("user_id", _site_id(F.col("number")).alias("site_id"))

    def role_grant(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.when(F.col("c_nationkey") % 5 == 0, 1).otherwise(2).alias("role_key"),
            F.when(F.col("c_custkey") % 7 == 0, 0).otherwise(1).alias("active"),
        )

    def role(self) -> DataFrame:
        key = F.col("r_regionkey")
        return self.table("region").select(
            key.alias("role_key"),
            F.when(key == 1, "Profesor").when(key == 2, "Alumno").otherwise(F.col("r_name")).alias("role_name"),
        )

    def _log(self) -> DataFrame:
        return self.table("events").select(
            "*",
            _site_id(_event_site()).alias("site_id"),
            F.date_sub(F.col("ts").cast("date"), 930).alias("day"),
        )

    def events(self) -> DataFrame:
        names = F.array(*[F.lit(n) for n in EVENT_NAMES])
        place = ((F.col("event_id") * 7 + F.col("user_id")) % len(EVENT_NAMES)).cast("int")
        return self._log().select(
            "user_id", "site_id", F.get(names, place).alias("event_name"),
            F.col("day").alias("event_date"),
            (F.col("event_id") % 3 + 1).cast("int").alias("event_count"),
        ).withColumnRenamed("event_name", "event_id")

    def resources(self) -> DataFrame:
        kind, number = F.col("event_type"), F.col("event_id")
        ref = (
            F.when(kind == "click", "/foro/a")
            .when(kind == "view", "/Documentación/b")
            .when(kind == "purchase", "/assignments/c")
            .when(kind == "signup", "/pspdf/d")
            .when(number % 2 == 0, "/Mensajes Privados/e")
            .otherwise("/f")
        )
        action = F.when(number % 3 == 0, "new").when(number % 3 == 1, "read").otherwise("delete")
        return self._log().select(
            "user_id", "site_id", _damaged(ref).alias("resource_ref"), action.alias("resource_action"),
            F.col("day").alias("resource_date"), (number % 2 + 1).cast("int").alias("resource_count"),
        )

    def logins(self) -> DataFrame:
        return self._log().select(
            "user_id", F.col("day").alias("login_date"), (F.col("event_id") % 2 + 1).cast("int").alias("login_count")
        )

    def gradebook(self) -> DataFrame:
        number = F.col("p_partkey")
        return self.parts().select(
            number.alias("id"),
            _site_id(number).alias("gradebook_uid"),
            F.when(number % 11 == 0, F.lit(None).cast("int")).when(number % 11 == 1, 1).otherwise(2).alias("category_type"),
            (number % 4).alias("selected_grade_mapping_id"),
        )

    def gradable_object(self) -> DataFrame:
        number, kind = F.col("p_partkey"), F.col("kind")
        other = (
            F.when(number % 5 == 0, "Actividad 1").when(number % 5 == 1, "Examen final")
            .when(number % 5 == 2, "Memoria").when(number % 5 == 3, "Sesión en directo").otherwise("Foro")
        )
        name = F.when(kind == 0, "Course Grade").when(kind == 1, "Test 1").otherwise(other)
        possible = F.when(kind == 0, 100.0).when(kind == 1, 10.0).when(number % 2 == 1, 0.0).otherwise(20.0)
        kinds = F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("kind")
        return self.parts().select("p_partkey", "p_size", kinds).select(
            (number * 3 + kind).alias("id"),
            F.when(F.col("p_size") == 46, -1 - number).otherwise(number).alias("gradebook_id"),
            kind.alias("object_type_id"),
            F.date_add(F.lit("2021-07-01").cast("date"), F.col("p_size")).alias("due_date"),
            _damaged(name).alias("name"),
            possible.alias("points_possible"),
            (number % 3).alias("category_id"),
        )

    def grade_record(self) -> DataFrame:
        order, event = F.col("l_orderkey"), F.col("event_id")
        kind = F.when(order % 10 < 6, 0).when(order % 10 < 8, 1).otherwise(2)
        nothing = F.lit(None)
        sold = self.sales().select(
            (F.col("l_partkey") * 3 + kind).alias("gradable_object_id"),
            F.when(F.col("l_linenumber") == 7, nothing).otherwise(F.col("o_custkey")).alias("student_id"),
            F.col("l_suppkey").alias("grader_id"),
            F.when(F.col("l_returnflag") == "R", nothing).otherwise(F.col("l_quantity") * 2).alias("points_earned"),
            F.col("l_shipdate").cast("date").alias("date_recorded"),
            F.when(order % 3 == 0, nothing).otherwise((order % 100).cast("double")).alias("points_earned_extra"),
        )
        kind = F.col("event_type")
        active = self.table("events").select(
            (_event_site() * 3).alias("gradable_object_id"),
            F.col("user_id").alias("student_id"),
            (event % 10).alias("grader_id"),
            F.when(kind == "error", nothing).otherwise((event * 13 % 101).cast("double")).alias("points_earned"),
            F.col("ts").cast("date").alias("date_recorded"),
            F.when(kind.isin("error", "view"), nothing).otherwise((event % 90).cast("double")).alias("points_earned_extra"),
        )
        return sold.unionByName(active)

    # derived tables

    def clean_site(self) -> DataFrame:
        return programmes.clean_sites(self.site())

    def roster(self) -> DataFrame:
        """Stored once, and cleaned once for its three readings of the sites."""
        if self._roster is None:
            sites = cut_lineage(self.clean_site(), "clean_site")
            self._roster = cut_lineage(programmes.programme_roster(sites, programmes.select_programmes(sites)), "roster")
        return self._roster

    def enrolment(self, seen: DataFrame | None = None) -> DataFrame:
        return enrolment.enrol_students(self.site_user(), self.roster(), self.role_grant(), self.role(), seen)

    def places(self) -> DataFrame:
        """Enrolment as the roll-ups of one query read it: stored once, of known size."""
        if self._places is None:
            self._places = cut_lineage(self.enrolment(), "enrolment")
        return self._places

    def places_of(self, log: DataFrame) -> DataFrame:
        """Enrolment as the roll-up of one log reads it, stored: the whole one where it is there, else what the log meets."""
        return cut_lineage(self.enrolment(log), "enrolment") if self._places is None else self._places

    def books(self) -> DataFrame:
        return grades.gradebooks(self.gradebook(), self.roster())

    def items(self) -> DataFrame:
        return grades.grade_items(self.gradable_object(), self.books())

    def records(self) -> DataFrame:
        return grades.grade_records(self.grade_record(), self.items())

    def outcomes(self) -> DataFrame:
        return grades.student_outcomes(grades.outcome_flags(self.records()))

    def weekly_events(self) -> DataFrame:
        return weekly.weekly_events(self.events(), self.places_of(self.events().select("site_id", "user_id")))

    def weekly_resources(self) -> DataFrame:
        return weekly.weekly_resources(self.resources(), self.places_of(self.resources().select("site_id", "user_id")))

    def weekly_logins(self) -> DataFrame:
        return weekly.weekly_logins(self.logins(), self.places_of(self.logins().select("user_id")))

    # the weekly tables are stored between the stages, as the indicators read them twice

    def event_features(self) -> DataFrame:
        return trailing.event_features(cut_lineage(self.weekly_events()), PERIOD)

    def resource_features(self) -> DataFrame:
        return trailing.resource_features(cut_lineage(self.weekly_resources()), PERIOD)

    def login_features(self) -> DataFrame:
        return trailing.login_features(cut_lineage(self.weekly_logins()), PERIOD)

    def wide_rows(self) -> DataFrame:
        """Labelled students with all features, from tables in the same buckets of ``key_id``.

        The tables hold the sums that the features follow from; ``assemble`` makes the columns.
        """
        self.places()
        panels = [cut_lineage(p) for p in (self.weekly_events(), self.weekly_resources(), self.weekly_logins())]
        labels = cut_lineage(trailing.labelled_keys(self.outcomes()), "labels")
        parts = buckets_for(labels.count())
        builders = (trailing.event_features, trailing.resource_features, trailing.login_features)
        features = [build(panel, PERIOD, parts=parts, packed=True) for build, panel in zip(builders, panels, strict=True)]
        stored = [store_bucketed(f, "key_id", parts, placed=True) for f in features]
        return trailing.assemble(store_bucketed(labels, "key_id", parts), *stored)

    def ml_rows(self) -> DataFrame:
        """Modelling frame: x2 and x5 with gaps, x4 nearly constant, x6 close to twice x1."""
        order, quantity = F.col("l_orderkey"), F.col("l_quantity")
        returned = (F.col("l_returnflag") == "R") & (quantity > 20)
        cheap = (F.col("l_discount") >= 0.07) & (quantity > 35)
        nothing = F.lit(None)
        key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
        return self.table("lineitem").select(
            key.alias("row_id"),
            F.when(returned | cheap, 1).otherwise(0).alias("label"),
            quantity.alias("x1"),
            F.when(order % 5 == 0, nothing).otherwise(F.col("l_extendedprice")).alias("x2"),
            F.col("l_discount").alias("x3"),
            F.when((F.col("l_linenumber") == 1) & (order % 40 == 0), 1.0).otherwise(0.0).alias("x4"),
            F.when(order % 3 != 0, nothing).otherwise(F.col("l_tax")).alias("x5"),
            (quantity * 2 + F.col("l_tax")).alias("x6"),
            ((quantity % 20) / 20).alias("p"),
        )
