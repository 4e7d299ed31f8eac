"""Queries of evaluation and the score-card."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import columns as ops
from cohortlens.operators import evaluation as ev
from cohortlens.operators import scorecard as sc
from cohortlens.plans import catalogue as cat
from cohortlens.plans.registry.base import query

THRESHOLD = 0.5
CURVE = """SELECT coalesce((previous + score) / 2, '-inf'::DOUBLE) AS threshold, 1 - CAST(before_pos AS DOUBLE) / all_pos AS sensitivity,
    CAST(before_neg AS DOUBLE) / all_neg AS specificity FROM score_rank UNION ALL SELECT 'inf'::DOUBLE, 0.0, 1.0"""
AUC = "SELECT sum(pos * (before_neg + neg / 2.0::DOUBLE)) / (CAST(max(all_pos) AS DOUBLE) * max(all_neg)) AS auc FROM score_rank"
METRICS = """SELECT (tp + tn) / n AS accuracy, ((tp + tn) / n - c) / (1 - c) AS kappa, tp / (tp + fn) AS sensitivity, tn / (tn + fp) AS specificity,
    tp / nullif(tp + fp, 0) AS pos_pred_value, tn / nullif(tn + fn, 0) AS neg_pred_value, (tp + fn) / n AS prevalence, tp / n AS detection_rate,
    (tp + fp) / n AS detection_prevalence, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy
    FROM (SELECT *, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS c FROM (SELECT CAST(count(*) AS DOUBLE) AS n,
    CAST(count(*) FILTER (WHERE label = 1 AND p > {t}) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE label = 0 AND p > {t}) AS DOUBLE) AS fp,
    CAST(count(*) FILTER (WHERE label = 1 AND p <= {t}) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE label = 0 AND p <= {t}) AS DOUBLE) AS tn FROM ml_rows))"""
NAMES = (*ev.HEADLINE, "prevalence", "detection_rate", "detection_prevalence", "balanced_accuracy")


def _hard(w, threshold: float = THRESHOLD):
    return w.ml_rows().select("row_id", "label", ev.classify(F.col("p"), threshold).alias("predicted"))


@query("eva1", f"SELECT threshold, round(sensitivity, 9) AS sensitivity, round(specificity, 9) AS specificity FROM ({CURVE})")
def eva1(w):
    return ev.roc_curve(w.ml_rows(), "label", "p").select(
        "threshold", F.round("sensitivity", 9).alias("sensitivity"), F.round("specificity", 9).alias("specificity")
    )


@query("eva2", f"SELECT round(auc, 9) AS auc FROM ({AUC})")
def eva2(w):
    return ev.auc(w.ml_rows(), "label", "p").select(F.round("auc", 9).alias("auc"))


@query("eva3", f"SELECT round(auc, 9) AS auc, round(2 * auc - 1, 9) AS gini FROM ({AUC})")
def eva3(w):
    return ev.gini(w.ml_rows(), "label", "p").select(F.round("auc", 9).alias("auc"), F.round("gini", 9).alias("gini"))


@query("eva4", """SELECT threshold, round(j / (CAST(all_pos AS DOUBLE) * all_neg), 9) AS youden FROM (SELECT before_neg * all_pos - before_pos * all_neg AS j,
    coalesce((previous + score) / 2, '-inf'::DOUBLE) AS threshold, all_pos, all_neg FROM score_rank) ORDER BY j DESC, threshold LIMIT 1""")
def eva4(w):
    return ev.optimal_threshold(w.ml_rows(), "label", "p").select("threshold", F.round("youden", 9).alias("youden"))


# scores as they are, and turned round, which the automatic direction must undo
BOTH = "(SELECT 'plain' AS dataset, label, p AS score FROM ml_rows UNION ALL SELECT 'reversed', label, 1 - p FROM ml_rows)"
RANKED = f"""(SELECT *, median0 <= median1 AS up, coalesce((lag(score) OVER w + score) / 2, '-inf'::DOUBLE) AS threshold,
    CAST(coalesce(sum(pos) OVER b, 0) AS DOUBLE) AS before_pos, CAST(coalesce(sum(neg) OVER b, 0) AS DOUBLE) AS before_neg,
    CAST(sum(pos) OVER (PARTITION BY dataset) AS DOUBLE) AS all_pos, CAST(sum(neg) OVER (PARTITION BY dataset) AS DOUBLE) AS all_neg
    FROM (SELECT dataset, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM {BOTH} GROUP BY ALL)
    JOIN (SELECT dataset, median(score) FILTER (WHERE label = 0) AS median0, median(score) FILTER (WHERE label = 1) AS median1
    FROM {BOTH} GROUP BY dataset) USING (dataset)
    WINDOW w AS (PARTITION BY dataset ORDER BY score),
    b AS (PARTITION BY dataset ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
TOWARDS = "CASE WHEN up THEN '<' ELSE '>' END AS direction"


def _both(w):
    rows = w.ml_rows()
    return ops.union_labelled({
        "plain": rows.select("label", F.col("p").alias("score")), "reversed": rows.select("label", (1 - F.col("p")).alias("score")),
    })


@query("eva1_auto", f"""SELECT dataset, threshold, round(sensitivity, 9) AS sensitivity, round(specificity, 9) AS specificity, direction FROM (
    SELECT dataset, threshold, CASE WHEN up THEN 1 - before_pos / all_pos ELSE before_pos / all_pos END AS sensitivity,
    CASE WHEN up THEN before_neg / all_neg ELSE 1 - before_neg / all_neg END AS specificity, {TOWARDS} FROM {RANKED}
    UNION ALL SELECT DISTINCT dataset, 'inf'::DOUBLE, CASE WHEN up THEN 0.0 ELSE 1.0 END, CASE WHEN up THEN 1.0 ELSE 0.0 END, {TOWARDS} FROM {RANKED})""")
def eva1_auto(w):
    return ev.roc_curve(_both(w), "label", "score", ["dataset"], ev.AUTO).withColumns(
        {c: F.round(c, 9) for c in ("sensitivity", "specificity")}
    )


@query("eva3_auto", f"""SELECT dataset, round(a, 9) AS auc, round(2 * a - 1, 9) AS gini, direction FROM (SELECT dataset, {TOWARDS},
    CASE WHEN up THEN a ELSE 1 - a END AS a FROM (SELECT dataset, up, sum(pos * (before_neg + neg / 2.0::DOUBLE)) / (max(all_pos) * max(all_neg)) AS a
    FROM {RANKED} GROUP BY dataset, up))""")
def eva3_auto(w):
    return ev.gini(_both(w), "label", "score", ["dataset"], ev.AUTO).withColumns({c: F.round(c, 9) for c in ("auc", "gini")})


@query("eva4_auto", f"""SELECT dataset, threshold, round(j / (all_pos * all_neg), 9) AS youden, direction FROM (SELECT *, {TOWARDS},
    row_number() OVER (PARTITION BY dataset ORDER BY j DESC, CASE WHEN up THEN threshold ELSE -threshold END) AS place FROM (SELECT *,
    (before_neg * all_pos - before_pos * all_neg) * CASE WHEN up THEN 1 ELSE -1 END AS j FROM {RANKED})) WHERE place = 1""")
def eva4_auto(w):
    return ev.optimal_threshold(_both(w), "label", "score", ["dataset"], ev.AUTO).withColumn("youden", F.round("youden", 9))


@query("eva5", f"SELECT row_id, label, CASE WHEN p > {THRESHOLD} THEN 1 ELSE 0 END AS predicted FROM ml_rows")
def eva5(w):
    return _hard(w)


@query("eva6", f"SELECT CASE WHEN p > {THRESHOLD} THEN 1 ELSE 0 END AS prediction, label AS reference, count(*) AS freq FROM ml_rows GROUP BY 1, 2")
def eva6(w):
    return ev.confusion(_hard(w), "label", "predicted")


@query("eva7", f"SELECT {', '.join(f'round({c}, 9) AS {c}' for c in NAMES)} FROM ({METRICS.format(t=THRESHOLD)})")
def eva7(w):
    metrics = ev.classification_metrics(_hard(w), "label", "predicted")
    return metrics.select(*[F.round(c, 9).alias(c) for c in NAMES])


def _melted(name: str, threshold: float) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS dataset, '{c}' AS variable, round({c}, 9) AS value FROM ({METRICS.format(t=threshold)})" for c in ev.HEADLINE
    )


@query("eva8", " UNION ALL ".join(_melted(f"cut_{t}", t) for t in (0.25, 0.5, 0.75)))
def eva8(w):
    frames = {f"cut_{t}": ev.classification_metrics(_hard(w, t), "label", "predicted") for t in (0.25, 0.5, 0.75)}
    return ev.compare_models(frames).withColumn("value", F.round("value", 9))


@query("eva9", "SELECT row_id, round_even((1 - p) * 1000, 0) AS score FROM ml_rows")
def eva9(w):
    return w.ml_rows().select("row_id", sc.risk_score(F.col("p")).alias("score"))


def _band_case(cuts) -> str:
    whens = " ".join(f"WHEN s <= {c} THEN {i}" for i, c in enumerate(cuts[1:], 1))
    return f"CASE WHEN s < {cuts[0]} THEN NULL {whens} END"


SCORED = "(SELECT row_id, label, round_even((1 - p) * 1000, 0) AS s FROM ml_rows)"
CUTS = "[" + ", ".join(f"quantile_cont(s, {q})" for q in cat.LINEAR_QUANTILES) + "]"


@query("eva10", f"""SELECT row_id, {_band_case(cat.BOOSTING_CUTS)} AS boosting, {_band_case(cat.FOREST_CUTS)} AS forest,
    CASE WHEN s < 0 OR s > 1000 THEN NULL WHEN s <= c[1] THEN 1 WHEN s <= c[2] THEN 2 WHEN s <= c[3] THEN 3 WHEN s <= c[4] THEN 4 ELSE 5 END AS linear
    FROM {SCORED}, (SELECT {CUTS} AS c FROM {SCORED})""")
def eva10(w):
    scored = w.ml_rows().select("row_id", sc.risk_score(F.col("p")).alias("s"))
    cuts = sc.quantile_cuts(scored, "s")
    score = F.col("s")
    return scored.select(
        "row_id", sc.band(score, cat.BOOSTING_CUTS).alias("boosting"), sc.band(score, cat.FOREST_CUTS).alias("forest"),
        sc.band(score, cuts).alias("linear"),
    )


LABELS = "CASE band " + " ".join(
    f"WHEN {i} THEN '{'[' if i == 1 else '('}{a},{b}]'" for i, (a, b) in enumerate(zip(cat.BOOSTING_CUTS, cat.BOOSTING_CUTS[1:]), 1)
) + " END"


@query("eva11", f"""SELECT {LABELS} AS grupos, CAST(row_number() OVER (ORDER BY band DESC) AS INTEGER) AS orden, nodropout, dropout, nroestudiantes,
    round_even(dropout * 100.0::DOUBLE / nroestudiantes, 2) AS porcdropout,
    round_even(sum(dropout) OVER w / CAST(sum(nroestudiantes) OVER w AS DOUBLE) * 100, 2) AS porc_dropout_acum,
    round_even((nodropout + dropout) / CAST(sum(nroestudiantes) OVER () AS DOUBLE) * 100, 2) AS porc_poblacion,
    round_even(sum(nodropout + dropout) OVER w / CAST(sum(nroestudiantes) OVER () AS DOUBLE) * 100, 2) AS porc_acum
    FROM (SELECT {_band_case(cat.BOOSTING_CUTS)} AS band, count(*) FILTER (WHERE label = 0) AS nodropout,
    count(*) FILTER (WHERE label = 1) AS dropout, count(*) AS nroestudiantes FROM {SCORED} GROUP BY 1)
    WINDOW w AS (ORDER BY band DESC)""")
def eva11(w):
    scored = w.ml_rows().select("label", sc.risk_score(F.col("p")).alias("s"))
    return sc.band_table(scored, "label", "s", cat.BOOSTING_CUTS)
