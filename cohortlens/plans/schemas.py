"""Declared columns of the source tables; a table may hold more."""

from __future__ import annotations

from pyspark.sql.types import StructType

TABLES = {
    "sakai_site": "site_id string, title string, type string, published int, createdon timestamp",
    "sakai_site_user": "site_id string, user_id string",
    "sakai_realm_rl_gr": "user_id string, role_key int, active int",
    "sakai_realm_role": "role_key int, role_name string",
    "gb_gradebook_t": "id long, gradebook_uid string, category_type int, selected_grade_mapping_id long",
    "gb_gradable_object_t": (
        "id long, gradebook_id long, object_type_id int, due_date timestamp, name string, "
        "points_possible double, category_id long"
    ),
    "gb_grade_record_t": (
        "gradable_object_id long, student_id string, grader_id string, points_earned double, "
        "date_recorded timestamp, points_earned_extra double"
    ),
    "sst_events": "site_id string, user_id string, event_id string, event_date date, event_count int",
    "sst_resources": (
        "site_id string, user_id string, resource_ref string, resource_action string, "
        "resource_date date, resource_count int"
    ),
    "sst_userstats": "user_id string, login_date date, login_count int",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])
