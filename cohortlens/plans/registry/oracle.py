"""SQL text for checking: the adapter views and their derived tables as common table expressions."""

from __future__ import annotations

import re

from cohortlens.plans import catalogue as cat
from cohortlens.plans.registry.adapters import EVENT_NAMES, PERIOD


def _code(number: str) -> str:
    return (
        f"'PER' || CAST(1000 + ({number}) // 10 % 50 AS VARCHAR) || '-' || CAST(({number}) // 10 AS VARCHAR)"
        f" || '-' || lpad(CAST(({number}) % 10 AS VARCHAR), 3, '0')"
    )


def _site(number: str) -> str:
    return f"{_code(number)} || '-01'"


def _damaged(text: str) -> str:
    return f"replace(replace({text}, 'á', 'Ã¡'), 'ó', 'Ã³')"


def _repaired(text: str) -> str:
    return f"replace(replace({text}, 'Ã¡', 'á'), 'Ã³', 'ó')"


def _uid(site: str) -> str:
    p = f"string_split({site}, '-')"
    return f"({p}[1] || '-' || {p}[2] || '-' || {p}[4])"


def _cases(column: str, rules, default: str) -> str:
    out = []
    for _, test, label in rules:
        hit = f"regexp_matches({column}, '{test[1:]}')" if test[0] == "~" else f"contains({column}, '{test}')"
        out.append(f"WHEN {hit} THEN '{label}'")
    return f"CASE {' '.join(out)} ELSE '{default}' END"


ITEM_CASE = _cases("upper(name)", cat.GRADE_RULES, cat.GRADE_DEFAULT)
RESOURCE_CASE = _cases("upper(resource_ref)", cat.RESOURCE_RULES, cat.RESOURCE_DEFAULT)
STUDY_CASE = _cases("upper(title)", cat.STUDY_RULES, cat.STUDY_DEFAULT)
EVENT_SITE = "(user_id // 3) * 10 + event_id % 10"
NAMES = "[" + ", ".join(f"'{n}'" for n in EVENT_NAMES) + "]"
SITE_CASE = (
    f"CASE WHEN contains(title, 'Trabajo Fin de Máster') THEN '{cat.THESIS}' "
    f"WHEN contains(site_id, '-000') THEN '{cat.PROGRAMME}' "
    f"WHEN contains(site_id, 'PER') THEN '{cat.COURSE}' ELSE '{cat.OTHER_SITE}' END"
)


def week(day: str, start: str) -> str:
    return f"CAST(trunc(datediff('day', {start}, {day}) / 7.0::DOUBLE + 1) AS INTEGER)"


_EVENT_SUMS = ", ".join(
    f"CAST(coalesce(sum(event_count) FILTER (WHERE event_id = '{e}'), 0) AS INTEGER) AS {cat.event_metric(e)}"
    for e in cat.EVENT_IDS
)
_RESOURCE_SUMS = ", ".join(
    f"CAST(coalesce(sum(resource_count) FILTER (WHERE kind = '{k}' AND resource_action = '{a}'), 0) AS INTEGER)"
    f" AS tres_{p}_{part}"
    for k, part in cat.RESOURCE_KINDS.items()
    for a, p in cat.RESOURCE_ACTIONS.items()
)


def features_select(metrics, source: str, where: str, suffixes: str | None = None) -> str:
    """Literal form of the trailing statistics: pivot cells, then every formula written out."""
    def cell(m: str, age: int) -> str:
        return f"coalesce(sum({m}) FILTER (WHERE age = {age}), 0)"

    columns = []
    for m in metrics:
        columns.append(("peranalisis", m, f"CAST({cell(m, 1)} AS BIGINT)"))
        for k in (2, 3, 4):
            span = [cell(m, a) for a in range(k, 0, -1)]
            total, first, last = " + ".join(span), cell(m, k), cell(m, 1)
            columns += [
                (f"sum{k}s", m, f"CAST({total} AS BIGINT)"),
                (f"prom{k}s", m, f"round(CAST({total} AS DOUBLE) / {k}, 3)"),
                (f"diff{k}s", m, f"CAST({last} - {first} AS BIGINT)"),
                (f"var{k}s", m, f"round(CAST({last} AS DOUBLE) / nullif(CAST({first} AS DOUBLE), 0) - 1, 3)"),
                (f"max{k}s", m, f"CAST(greatest({', '.join(span)}) AS BIGINT)"),
                (f"min{k}s", m, f"CAST(least({', '.join(span)}) AS BIGINT)"),
                (f"sem{k}", m, f"CAST({first} AS BIGINT)"),
                (f"median{k}s", m, f"quantile_cont(CAST({m} AS DOUBLE), 0.5) FILTER (WHERE age <= {k})"),
            ]
    wanted = [c for c in columns if suffixes is None or re.fullmatch(suffixes, c[0])]
    body = ", ".join(f"{sql} AS {m}_{s}" for s, m, sql in wanted)
    return (
        f"SELECT key_id, {body} FROM (SELECT site_uid || '_' || CAST(user_id AS VARCHAR) AS key_id, *, "
        f"dense_rank() OVER (ORDER BY periodo_week DESC) AS age FROM {source} WHERE {where}) GROUP BY key_id"
    )


VARIABLES = ("x1", "x2", "x3", "x4", "x5", "x6")
EVENT_WHERE = f"periodo_week <= {PERIOD} AND periodo_week > 0"
PLAIN_WHERE = f"periodo_week <= {PERIOD}"

VIEWS: dict[str, str] = {
    "lms_site": f"""SELECT CASE WHEN p_size = 47 AND p_partkey % 10 BETWEEN 1 AND 8 THEN {_code('p_partkey')}
        ELSE {_site('p_partkey')} END AS site_id,
        {_damaged("CASE WHEN p_size = 48 THEN 'Demo' WHEN p_partkey % 10 = 9 THEN 'Trabajo Fin de Máster' WHEN p_partkey // 10 % 7 = 3 THEN 'Grado' ELSE 'Máster' END || ' ' || p_brand || ' PER' || CAST(p_partkey // 10 % 50 AS VARCHAR)")} AS title,
        CASE WHEN p_size = 49 THEN 'project' ELSE 'course' END AS type,
        CASE WHEN p_size = 50 THEN 0 ELSE 1 END AS published,
        CAST(DATE '2021-06-01' + p_size + CASE WHEN p_partkey // 10 % 6 = 5 THEN 365 ELSE 0 END AS DATE) AS createdon
        FROM part""",
    "lms_site_user": f"""SELECT o_custkey AS user_id, {_site('l_partkey')} AS site_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION SELECT user_id, {_site(EVENT_SITE)} FROM events""",
    "lms_role_grant": """SELECT c_custkey AS user_id, CASE WHEN c_nationkey % 5 = 0 THEN 1 ELSE 2 END AS role_key,
        CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 END AS active FROM customer""",
    "lms_role": """SELECT r_regionkey AS role_key, CASE r_regionkey WHEN 1 THEN 'Profesor' WHEN 2 THEN 'Alumno'
        ELSE r_name END AS role_name FROM region""",
    "lms_event": f"""SELECT user_id, {_site(EVENT_SITE)} AS site_id,
        list_extract({NAMES}, CAST((event_id * 7 + user_id) % {len(EVENT_NAMES)} AS INTEGER) + 1) AS event_id,
        CAST(CAST(ts AS DATE) - 930 AS DATE) AS event_date, CAST(1 + event_id % 3 AS INTEGER) AS event_count FROM events""",
    "lms_resource": f"""SELECT user_id, {_site(EVENT_SITE)} AS site_id,
        {_damaged("CASE WHEN event_type = 'click' THEN '/foro/a' WHEN event_type = 'view' THEN '/Documentación/b' WHEN event_type = 'purchase' THEN '/assignments/c' WHEN event_type = 'signup' THEN '/pspdf/d' WHEN event_id % 2 = 0 THEN '/Mensajes Privados/e' ELSE '/f' END")} AS resource_ref,
        CASE event_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'read' ELSE 'delete' END AS resource_action,
        CAST(CAST(ts AS DATE) - 930 AS DATE) AS resource_date, CAST(1 + event_id % 2 AS INTEGER) AS resource_count FROM events""",
    "lms_login": """SELECT user_id, CAST(CAST(ts AS DATE) - 930 AS DATE) AS login_date,
        CAST(1 + event_id % 2 AS INTEGER) AS login_count FROM events""",
    "lms_gradebook": f"""SELECT p_partkey AS id, {_site('p_partkey')} AS gradebook_uid,
        CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 2 END AS category_type,
        p_partkey % 4 AS selected_grade_mapping_id FROM part""",
    "lms_gradable_object": f"""SELECT p_partkey * 3 + kind AS id,
        CASE WHEN p_size = 46 THEN -1 - p_partkey ELSE p_partkey END AS gradebook_id, CAST(kind AS INTEGER) AS object_type_id,
        CAST(DATE '2021-07-01' + p_size AS DATE) AS due_date,
        {_damaged("CASE WHEN kind = 0 THEN 'Course Grade' WHEN kind = 1 THEN 'Test 1' WHEN p_partkey % 5 = 0 THEN 'Actividad 1' WHEN p_partkey % 5 = 1 THEN 'Examen final' WHEN p_partkey % 5 = 2 THEN 'Memoria' WHEN p_partkey % 5 = 3 THEN 'Sesión en directo' ELSE 'Foro' END")} AS name,
        CAST(CASE WHEN kind = 0 THEN 100 WHEN kind = 1 THEN 10 WHEN p_partkey % 2 = 1 THEN 0 ELSE 20 END AS DOUBLE) AS points_possible,
        p_partkey % 3 AS category_id FROM part, (SELECT unnest([0, 1, 2]) AS kind)""",
    "lms_grade_record": f"""SELECT l_partkey * 3 + CASE WHEN l_orderkey % 10 < 6 THEN 0 WHEN l_orderkey % 10 < 8 THEN 1 ELSE 2 END AS gradable_object_id,
        CASE WHEN l_linenumber = 7 THEN NULL ELSE o_custkey END AS student_id, l_suppkey AS grader_id,
        CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity * 2 END AS points_earned, CAST(l_shipdate AS DATE) AS date_recorded,
        CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(l_orderkey % 100 AS DOUBLE) END AS points_earned_extra
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL SELECT ({EVENT_SITE}) * 3, user_id, event_id % 10,
        CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id * 13 % 101 AS DOUBLE) END, CAST(ts AS DATE),
        CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE CAST(event_id % 90 AS DOUBLE) END FROM events""",
    "ml_rows": """SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR)
        || '-' || CAST(l_suppkey AS VARCHAR) AS row_id, CASE WHEN (l_returnflag = 'R' AND l_quantity > 20) OR (l_discount >= 0.07 AND l_quantity > 35) THEN 1 ELSE 0 END AS label, l_quantity AS x1,
        CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS x2, l_discount AS x3,
        CAST(CASE WHEN l_linenumber = 1 AND l_orderkey % 40 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS x4,
        CASE WHEN l_orderkey % 3 <> 0 THEN NULL ELSE l_tax END AS x5, l_quantity * 2 + l_tax AS x6,
        (l_quantity % 20) / 20 AS p FROM lineitem""",
    "ml_long": " UNION ALL ".join(
        f"SELECT '{v}' AS variable, CAST({v} AS DOUBLE) AS value, label FROM ml_rows" for v in VARIABLES
    ),
    "ml_filled": "SELECT row_id, label, p, " + ", ".join(f"coalesce({v}, -9999) AS {v}" for v in VARIABLES) + " FROM ml_rows",
    "score_count": """SELECT p AS score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
        FROM ml_rows GROUP BY p""",
    "score_rank": """SELECT score, pos, neg, coalesce(sum(pos) OVER w, 0) AS before_pos, coalesce(sum(neg) OVER w, 0) AS before_neg,
        sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg, lag(score) OVER (ORDER BY score) AS previous
        FROM score_count WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "iv_cut": "SELECT variable, list_distinct([" + ", ".join(f"quantile_cont(value, {i / 10})" for i in range(1, 10))
        + "]) AS cuts FROM ml_long WHERE value IS NOT NULL GROUP BY variable",
    "iv_bin": """SELECT variable, bin, min(value) AS low, max(value) AS high, count(*) AS n, CAST(sum(label) AS BIGINT) AS n1
        FROM (SELECT l.variable, l.value, l.label, CASE WHEN l.value IS NOT NULL
              THEN CAST(len(list_filter(c.cuts, lambda e: e <= l.value)) AS INTEGER) END AS bin
              FROM ml_long l LEFT JOIN iv_cut c ON c.variable = l.variable) GROUP BY variable, bin""",
    "woe": """SELECT *, (share1 - share0) * woe AS iv FROM (SELECT *, CASE WHEN n1 > 0 AND n0 > 0 THEN ln(share1 / share0) ELSE 0 END AS woe
        FROM (SELECT variable, bin, low, high, n, n - n1 AS n0, n1, CAST(n1 AS DOUBLE) / sum(n1) OVER (PARTITION BY variable) AS share1,
              CAST(n - n1 AS DOUBLE) / sum(n - n1) OVER (PARTITION BY variable) AS share0 FROM iv_bin))""",
    "iv_table": "SELECT variable, sum(iv) AS iv FROM woe GROUP BY variable",
    "ks_edge": "SELECT variable, [" + ", ".join(f"quantile_cont(value, {i / 10})" for i in range(1, 11))
        + "] AS edges FROM ml_long WHERE value IS NOT NULL GROUP BY variable",
    "ks_bin": """SELECT variable, bin, count(*) AS n, CAST(sum(label) AS BIGINT) AS n1 FROM (SELECT l.variable, l.label,
        CAST(len(list_filter(k.edges, lambda e: e < l.value)) AS INTEGER) + 1 AS bin
        FROM ml_long l JOIN ks_edge k ON k.variable = l.variable WHERE l.value IS NOT NULL) GROUP BY variable, bin""",
    "ks_result": """SELECT variable, max(gap) AS ks FROM (SELECT variable, abs(round_even(100 * (
        CAST(sum(n1) OVER w AS DOUBLE) / sum(n1) OVER (PARTITION BY variable)
        - CAST(sum(n - n1) OVER w AS DOUBLE) / sum(n - n1) OVER (PARTITION BY variable)), 1)) AS gap FROM ks_bin
        WINDOW w AS (PARTITION BY variable ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY variable""",
    "hashed": """SELECT *, CAST('0x' || substr(md5(row_id || '|1234'), 1, 15) AS BIGINT) AS h FROM ml_rows""",
    "clean_site": f"""SELECT {STUDY_CASE} AS tipo_estudio, site_uid, periodo_escolar, site_id, idmaster,
        {SITE_CASE} AS tipo_sitio, title, createdon, periodo
        FROM (SELECT site_id, {_uid('site_id')} AS site_uid, TRY_CAST(string_split(site_id, '-')[2] AS INTEGER) AS idmaster,
              string_split(title, ' ')[-1] AS periodo_escolar, {_repaired('title')} AS title, type, published, createdon,
              CAST(year(createdon) * 100 + month(createdon) AS INTEGER) AS periodo FROM lms_site)
        WHERE published = 1 AND type = 'course' AND contains(site_id, 'PER') AND NOT regexp_matches(title, '^Demo*')
          AND site_uid IS NOT NULL AND NOT regexp_matches(upper(site_id), '^DEMO*')""",
    "selected": """SELECT DISTINCT site_uid FROM clean_site WHERE tipo_estudio = 'MAESTRIA' AND periodo <= 202202""",
    "roster": f"""SELECT * FROM (SELECT site_uid, periodo_escolar, site_id, idmaster, tipo_sitio, title, createdon, periodo,
        CAST(count(*) OVER g AS BIGINT) AS tregistros,
        min(CASE WHEN tipo_sitio = '{cat.PROGRAMME}' THEN createdon END) OVER g AS fecha_inicio,
        CAST(sum(CASE WHEN tipo_sitio = '{cat.PROGRAMME}' THEN 1 ELSE 0 END) OVER g AS BIGINT) AS tprogramas,
        CAST(sum(CASE WHEN tipo_sitio = '{cat.COURSE}' THEN 1 ELSE 0 END) OVER g AS BIGINT) AS tasignaturas,
        CAST(sum(CASE WHEN tipo_sitio = '{cat.THESIS}' THEN 1 ELSE 0 END) OVER g AS BIGINT) AS ttfm
        FROM clean_site WHERE site_uid IN (SELECT site_uid FROM selected)
        WINDOW g AS (PARTITION BY periodo_escolar, site_uid))
        WHERE tprogramas > 0 AND tasignaturas > 4 AND ttfm = 1""",
    "student": """SELECT DISTINCT user_id FROM lms_role_grant JOIN lms_role USING (role_key)
        WHERE active = 1 AND role_name = 'Alumno'""",
    "enrolment": """SELECT r.site_uid, r.fecha_inicio, r.site_id, r.tipo_sitio, u.user_id
        FROM (SELECT DISTINCT site_uid, fecha_inicio, site_id, tipo_sitio FROM roster) r
        JOIN lms_site_user u ON r.site_id = u.site_id JOIN student s ON s.user_id = u.user_id""",
    "book": """SELECT b.id AS gradebook_id, r.site_uid, r.site_id, r.tipo_sitio, b.category_type, b.selected_grade_mapping_id
        FROM (SELECT DISTINCT site_uid, site_id, tipo_sitio FROM roster) r JOIN lms_gradebook b ON b.gradebook_uid = r.site_id""",
    "item": f"""SELECT b.*, o.id AS gradable_object_id, o.object_type_id, o.due_date, {_repaired('o.name')} AS name,
        o.points_possible, o.category_id FROM book b LEFT JOIN lms_gradable_object o ON o.gradebook_id = b.gradebook_id""",
    "record": f"""SELECT i.*, g.student_id, g.grader_id, g.points_earned, g.date_recorded, g.points_earned_extra,
        {ITEM_CASE} AS tipo_nota, round(points_earned / nullif(points_possible, 0), 2) AS ratio_points_earned
        FROM item i JOIN lms_grade_record g ON g.gradable_object_id = i.gradable_object_id WHERE g.student_id IS NOT NULL""",
    "flag": """SELECT site_uid, site_id, student_id, tipo_nota, points_possible, points_earned, points_earned_extra,
        CASE WHEN points_earned < 50 OR points_earned IS NULL THEN 1 ELSE 0 END AS marca_extraordinaria,
        CASE WHEN (points_earned < 50 OR points_earned IS NULL)
              AND (points_earned_extra < 50 OR points_earned_extra IS NULL) THEN 1 ELSE 0 END AS marca_reprobado,
        CASE WHEN points_earned IS NULL AND points_earned_extra IS NULL THEN 1 WHEN points_earned < 50 AND points_earned_extra IS NULL THEN 1
             WHEN points_earned IS NULL AND points_earned_extra < 50 THEN 1 WHEN points_earned < 25 AND points_earned_extra < 25 THEN 1
             ELSE 0 END AS marca_abandono,
        CASE WHEN points_earned IS NULL AND points_earned_extra IS NULL THEN '1' WHEN points_earned < 50 AND points_earned_extra IS NULL THEN '2'
             WHEN points_earned IS NULL AND points_earned_extra < 50 THEN '3' WHEN points_earned < 25 AND points_earned_extra < 25 THEN '4'
             END AS detalle_abandono
        FROM record WHERE tipo_nota = 'NOTA_FINAL' AND category_type <> 1""",
    "outcome": """SELECT site_uid, student_id, count(DISTINCT site_uid) AS tprogramas, count(DISTINCT site_id) AS tasignaturas,
        max(marca_abandono) AS marca_abandono, max(marca_extraordinaria) AS marca_extraordinaria,
        max(marca_reprobado) AS marca_reprobado FROM flag GROUP BY site_uid, student_id""",
    "weekly_event": f"""SELECT site_uid, periodo_week, user_id, CAST(count(DISTINCT site_id) AS INTEGER) AS tcursos_events, {_EVENT_SUMS}
        FROM (SELECT e.*, n.site_uid, {week('event_date', 'fecha_inicio')} AS periodo_week FROM lms_event e
              JOIN (SELECT DISTINCT * FROM enrolment) n ON e.site_id = n.site_id AND e.user_id = n.user_id)
        GROUP BY site_uid, periodo_week, user_id""",
    "weekly_resource": f"""SELECT site_uid, periodo_week, user_id, {_RESOURCE_SUMS}
        FROM (SELECT *, {RESOURCE_CASE} AS kind FROM
              (SELECT e.user_id, e.resource_action, e.resource_count, n.site_uid, {_repaired('e.resource_ref')} AS resource_ref,
               {week('resource_date', 'fecha_inicio')} AS periodo_week FROM lms_resource e
               JOIN (SELECT DISTINCT * FROM enrolment) n ON e.site_id = n.site_id AND e.user_id = n.user_id))
        GROUP BY site_uid, periodo_week, user_id""",
    "weekly_login": f"""SELECT site_uid, periodo_week, user_id, CAST(sum(login_count) AS BIGINT) AS tt_login
        FROM (SELECT n.site_uid, l.user_id, l.login_count, {week('login_date', 'fecha_inicio')} AS periodo_week FROM lms_login l
              JOIN (SELECT DISTINCT site_uid, fecha_inicio, user_id FROM enrolment) n ON l.user_id = n.user_id)
        WHERE periodo_week >= 1 GROUP BY site_uid, periodo_week, user_id""",
    "event_feature": features_select(cat.EVENT_METRICS, "weekly_event", EVENT_WHERE),
    "resource_feature": features_select(cat.RESOURCE_METRICS, "weekly_resource", PLAIN_WHERE),
    "login_feature": features_select((cat.LOGIN_METRIC,), "weekly_login", PLAIN_WHERE),
}


def complete(sql: str) -> str:
    """``sql`` with the views it needs, and theirs, as common table expressions."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in ordered and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\b(?=\s|$)", text):
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    head = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in ordered)
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {head},\n{sql.lstrip()[5:]}"
    return f"WITH {head}\n{sql}"
