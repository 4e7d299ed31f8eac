"""Select predictors, fit the four models, evaluate them on four data sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import columns as ops
from cohortlens.operators import evaluation as ev
from cohortlens.operators import explain, models, runlog, scorecard, split, tuning
from cohortlens.operators import selection as sel
from cohortlens.plans import catalogue as cat
from cohortlens.session import cut_lineage, tune
from cohortlens.sources import drop_all_null, write_parquet


@dataclass
class Limits:
    """Limits of the selection steps."""

    missing: float = 0.30
    information: float = 0.1
    correlation: float = 0.8
    ks: float = 9.0


def select_predictors(
    df: DataFrame, label: str = cat.LABEL, keys: Sequence[str] = ("key_id",), limits: Limits | None = None
) -> list[str]:
    """Names of the predictors that pass every step, strongest KS first.

    The value counts are stored once and serve all steps; what reaches the driver is one row
    per variable or per strong pair.
    """
    limits = limits or Limits()
    kept = ops.drop_like(sel.drop_sparse(drop_all_null(df), limits.missing), cat.REDUNDANT)
    names = ops.numeric_columns(kept, [label, *keys])
    counts = cut_lineage(sel.value_counts(kept, label, names), "value_counts")
    flat = {r["variable"] for r in sel.near_zero_variance(counts).where("nzv").select("variable").collect()}
    counts = counts.where(~F.col("variable").isin(sorted(flat)))
    iv = cut_lineage(sel.informative(sel.information_value(counts), limits.information), "information")
    strong = [r["variable"] for r in iv.orderBy(F.desc("iv"), "variable").collect()]
    if not strong:
        return []
    strong = sel.drop_correlated(kept, strong, iv, limits.correlation)
    ranked = sel.ks_selected(sel.ks_table(counts.where(F.col("variable").isin(strong))), limits.ks)
    return [r["variable"] for r in ranked.collect()]


def model_frame(df: DataFrame, predictors: Sequence[str], label: str, keys: Sequence[str]) -> DataFrame:
    """Key, label and predictors with gaps filled, under their business names."""
    frame = ops.impute_sentinel(
        ops.align(df, [*keys, label, *predictors]).withColumn(label, F.col(label).cast("int")),
        cat.SENTINEL, [label, *keys],
    )
    return ops.rename(frame, ops.business_names(predictors, cat.BUSINESS_NAMES))


@dataclass
class Report:
    """Result tables, all small, and the fitted models."""

    predictors: list[str]
    models: dict = field(default_factory=dict)
    chosen: dict[str, dict] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def write(self, out: str) -> None:
        for name, table in self.tables.items():
            write_parquet(table, f"{out}/{name}")


def fit_all(
    train: DataFrame, predictors: Sequence[str], label: str, trees: int, boosting: dict, rounds: int = 100,
    chosen: Mapping[str, Mapping] | None = None,
) -> dict:
    """The four models, with the parameters that the tuning chose where there was one."""
    points = {
        "boosting": boosting, "forest": {"mtry": "onethird"}, "elastic_net": {"alpha": 0.0, "lambda": 0.001},
        "kernel_svm": {"C": 1.0, "sigma": 0.25}, **(chosen or {}),
    }
    return {
        family: tuning.fit_point(family, point, train, predictors, label, trees=trees, rounds=rounds)
        for family, point in points.items()
    }


def score_all(fitted: dict, flagged: DataFrame, later: DataFrame | None, keys: Sequence[str], label: str) -> DataFrame:
    """Scores of every model on every data set, one long stored frame.

    A row is scored once per model; training or test set and the set of all rows share it.
    """
    parts = []
    for name, model in fitted.items():
        own = F.when(F.col("train"), "Train").otherwise("Test")
        rows = models.score(model, flagged).select(
            F.lit(name).alias("model"), F.explode(F.array(F.lit("Toda"), own)).alias("dataset"), *keys, label, "p"
        )
        parts.append(rows)
        if later is not None:
            parts.append(models.score(model, later).select(
                F.lit(name).alias("model"), F.lit("Back").alias("dataset"), *keys, label, "p"
            ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return cut_lineage(out, "scored")


def run(
    wide: DataFrame, back: DataFrame | None = None, label: str = cat.LABEL, keys: Sequence[str] = ("key_id",),
    limits: Limits | None = None, trees: int = cat.FOREST_TREES, boosting: dict = cat.BOOSTING_FINAL,
    rounds: int = 100, log: str | None = None, tune_in: str | None = None,
    grids: Mapping[str, Sequence[Mapping]] | None = None,
) -> Report:
    """The whole modelling stage on the wide rows of one week; ``back`` is a later week.

    All models and data sets are evaluated together, grouped by two columns, so curve, metrics
    and bands cost one pass each however many of them there are. With ``tune_in`` the parameters are
    searched first (``grids``, or the whole grids); the ledger of the search lies in that folder, and a
    run that was stopped goes on from it.
    """
    spark = wide.sparkSession
    tune(spark)
    names = select_predictors(wide, label, keys, limits)
    if not names:
        raise ValueError("no predictor passed the selection")
    frame = model_frame(wide, names, label, keys)
    predictors = [c for c in frame.columns if c not in {label, *keys}]
    flagged = cut_lineage(split.stratified_split(frame, label, keys, cat.TRAIN_SHARE, cat.SEED), "model_rows")
    later = None if back is None else cut_lineage(model_frame(back, names, label, keys), "back_rows")
    train = split.four_sets(flagged)["Train"]
    chosen = None
    if tune_in:
        chosen = tuning.tune_all(train, predictors, label, keys, tune_in, grids, trees=trees, rounds=rounds)
    report = Report(predictors, fit_all(train, predictors, label, trees, boosting, rounds, chosen), chosen=chosen or {})

    tag = ["model", "dataset"]
    scored = score_all(report.models, flagged, later, keys, label)
    best = ev.optimal_threshold(scored.where("dataset = 'Train'"), label, "p", ["model"], ev.AUTO).collect()
    report.thresholds = {r["model"]: r["threshold"] for r in best}

    def by_model(values: dict) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("model"))

    limit, towards = by_model(report.thresholds), by_model({r["model"]: r["direction"] for r in best})
    ready = scored.select(
        *tag, label, "p",
        ev.classify(F.col("p"), limit, towards).alias("predicted"),
        scorecard.risk_score(F.col("p")).alias("score"),
    )
    bands = None
    for name in report.models:
        mine = ready.where(F.col("model") == name)
        cuts = {"boosting": cat.BOOSTING_CUTS, "forest": cat.FOREST_CUTS}.get(name)
        cuts = cuts or scorecard.quantile_cuts(mine.where("dataset = 'Train'"), "score")
        part = scorecard.band_table(mine, label, "score", cuts, by=tag)
        bands = part if bands is None else bands.unionByName(part)
    gini = cut_lineage(ev.gini(ready, label, "p", tag, ev.AUTO), "gini")
    if log:
        areas = gini.collect()
        for name, threshold in report.thresholds.items():
            result = {f"{k}_{r['dataset'].lower()}": r[k] for r in areas if r["model"] == name for k in ("auc", "gini")}
            runlog.log_run(spark, log, name, {"optimal_threshold": threshold}, result)

    report.tables = {
        "metrics": ev.classification_metrics(ready, label, "predicted", tag),
        "roc": ev.roc_curve(ready, label, "p", tag, ev.AUTO),
        "gini": gini,
        "bands": bands,
        "histogram": scorecard.histogram(ready, "score", 50, tag),
        "balance": scorecard.class_balance(wide, label),
        "importance": ops.union_labelled({
            "boosting": explain.tree_importance(report.models["boosting"], predictors, wide),
            "forest": explain.permutation_importance(
                report.models["forest"], train, predictors, label, keys
            ).select("predictor", F.col("inc_mse_percent").alias("importance")),
            "elastic_net": explain.linear_coefficients(report.models["elastic_net"], predictors, wide).toDF(
                "predictor", "importance"
            ),
        }, "model"),
    }
    return report
