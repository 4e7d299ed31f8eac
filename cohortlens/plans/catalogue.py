"""Names, word lists and constants that results depend on."""

from __future__ import annotations

# Activity event ids, in the order of the output columns.
EVENT_IDS = (
    "pres.begin",
    "basiclti.launch",
    "lessonbuilder.read",
    "content.read",
    "forums.read",
    "messages.read",
    "content.new",
    "sam.assessment.take",
    "sam.assessment.submit",
    "asn.submit.submission",
    "webcontent.read",
    "messages.reply",
    "messages.newfolder",
    "messages.new",
    "forums.new",
    "forums.response",
    "messages.forward",
    "asn.save.submission",
    "calendar.revise",
    "asn.grade.submission",
    "annc.new",
    "lessonbuilder.update",
    "site.upd",
    "calendar.new",
    "sam.assessment.take.via_url",
    "content.delete",
    "sam.assessment.submit.via_url",
    "annc.revise.own",
    "forums.newtopic",
    "annc.revise.any",
    "asn.revise.assignment",
    "messages.delete",
    "lessonbuilder.delete",
    "forums.revisetopic",
    "content.revise",
    "lessonbuilder.create",
    "sitestats.view",
    "forums.delete",
    "forums.deleteforum",
    "forums.deletetopic",
    "annc.delete.own",
    "sitestats.report.new",
    "sitestats.report.view",
    "asn.delete.assignment",
    "webcontent.revise",
    "asn.new.assignment",
    "sam.total.score.update",
    "sam.pubassessment.confirm_edit",
)


def event_metric(event_id: str) -> str:
    """Column that counts an event id."""
    return "tt_" + event_id.replace(".", "_")


SITE_COUNT = "tcursos_events"
EVENT_METRICS = (SITE_COUNT, *map(event_metric, EVENT_IDS))

# Resource kind -> part of the column name.
RESOURCE_KINDS = {
    "Foros": "foros",
    "Documentacion": "doc",
    "Mensajes": "msg",
    "Actividades": "tareas",
    "Programacion": "prog",
    "Otros": "otros",
}
# Resource action -> direction. Other actions are not counted.
RESOURCE_ACTIONS = {"new": "up", "read": "down"}
RESOURCE_METRICS = tuple(
    f"tres_{way}_{part}" for part in RESOURCE_KINDS.values() for way in RESOURCE_ACTIONS.values()
)
LOGIN_METRIC = "tt_login"

# Ordered classification rules (column, test, class). "~" marks a regular expression.
STUDY_RULES = (("title", "~^MÁSTER*", "MAESTRIA"), ("title", "~^GRADO*", "GRADO"))
STUDY_DEFAULT = "OTROS"

PROGRAMME, COURSE, THESIS, OTHER_SITE = "A. Programa", "B. Asignatura", "C. TFM", "D. Otros"
SITE_RULES = (
    ("title", "Trabajo Fin de Máster", THESIS),
    ("site_id", "-000", PROGRAMME),
    ("site_id", "PER", COURSE),
)

GRADE_RULES = (
    ("name", "~ACTIVIDAD|TRABAJO|LABORATORIO", "ACTIVIDADES"),
    ("name", "~TEST", "TEST"),
    ("name", "~MEMORIA|INFORME|PRÁCTICAS", "PRACTICAS"),
    ("name", "~ASISTENCIA|CLASE|SESIÓN|DIRECTO", "ASISTENCIA"),
    ("name", "~EXAMEN", "EXAMEN"),
    ("name", "~COURSE GRADE", "NOTA_FINAL"),
)
GRADE_DEFAULT = "OTROS"
FINAL_GRADE = "NOTA_FINAL"

RESOURCE_RULES = (
    ("ref", "~FORO", "Foros"),
    ("ref", "~DOCUMENTACIÓN", "Documentacion"),
    ("ref", "~MENSAJES PRIVADOS", "Mensajes"),
    ("ref", "~ASSIGNMENTS|ACTIVIDADES|TAREAS", "Actividades"),
    ("ref", "PSPDF", "Programacion"),
)
RESOURCE_DEFAULT = "Otros"

STUDENT_ROLE = "Alumno"
STUDY_KIND = "MAESTRIA"
LAST_START = 202202
LABEL = "marca_abandono"

# Column families that repeat others and are dropped before selection.
REDUNDANT = ("tres_up_doc", "tres_up_prog")
SENTINEL = -9999

# Technical metric name -> business name.
BUSINESS_NAMES = {
    "tt_sam_assessment_take": "tt_empieza_evaluacion",
    "tt_sam_assessment_submit": "tt_envia_evaluacion",
    "tt_forums_read": "tt_lee_msg_foros",
    "tt_pres_begin": "tt_visita_sitio",
    "tcursos_events": "tcursos_eventos",
    "tt_lessonbuilder_read": "tt_lee_temas",
    "tt_content_read": "tt_descarga_recursos",
    "tt_basiclti_launch": "tt_inicia_clases",
    "tt_forums_new": "tt_crea_msg_foros",
    "tres_down_foros": "tt_descarga_recursos_foros",
    "tt_messages_read": "tt_lee_correo_interno",
    "tt_content_new": "tt_carga_recurso",
    "tt_forums_response": "tt_responde_msg_foro",
    "tt_asn_submit_submission": "tt_envia_tarea",
    "tres_down_tareas": "tt_descarga_recursos_tareas",
    "tres_down_doc": "tt_descarga_recursos_doc",
}

# Score cuts per model and the quantiles that give the cuts of the linear model.
BOOSTING_CUTS = (0, 749, 860, 960, 1000)
FOREST_CUTS = (0, 649, 749, 875, 1000)
LINEAR_QUANTILES = (0.15, 0.25, 0.60, 0.90)
SCORE_RANGE = (0, 1000)

# Tuning grids and the parameters of the final boosting fit.
BOOSTING_GRID = {
    "nrounds": (40, 60, 80, 100, 120, 150),
    "colsample": (0.5, 1.0),
    "eta": (0.1, 0.3, 0.4, 0.5),
    "gamma": (0.25, 0.5),
    "subsample": (0.5, 0.75, 1.0),
    "max_depth": (3, 4, 5),
}
BOOSTING_FINAL = {
    "max_depth": 5,
    "eta": 0.45,
    "gamma": 0.25,
    "nrounds": 45,
    "colsample": 1.0,
    "subsample": 1.0,
}
FOREST_TREES = 500
KERNEL_GRID = {"C": tuple(2.0**e for e in range(-2, 3)), "sigma": tuple(2.0**e for e in range(-2, 3))}
LINEAR_GRID = {
    "alpha": tuple(i / 9 for i in range(10)),
    "lambda": tuple(10 ** (-3 + 6 * i / 99) for i in range(100)),
}
POSITIVE_WEIGHT = 1.5
FOLDS = 5
TRAIN_SHARE = 0.75
SEED = 1234
