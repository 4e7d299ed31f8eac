import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from cohortlens.operators import hinge, models

NAMES = ["a", "b", "flat"]


@pytest.fixture(scope="module")
def scaled(spark):
    rnd = np.random.default_rng(4)
    rows = []
    for _ in range(1500):
        a, b, noise = rnd.normal(size=3)
        rows.append((int(a * a + 0.5 * b + 0.5 * noise > 0.8), 30 * float(a) + 500, float(b), 7.3, float(rnd.integers(1, 4))))
    frame = spark.createDataFrame(rows, "label int, a double, b double, flat double, w double").coalesce(3).cache()
    return Pipeline(stages=[models.assembler(NAMES), models.scaler()]).fit(frame).transform(frame)


@pytest.mark.parametrize("weight", [None, "w"])
def test_margins_are_those_of_the_library(scaled, weight):
    project = models.fourier_projection(3, 0.5, 40)
    ready = models.fourier_features(scaled, 3, 0.5, 40)
    for rounds in (1, 60):
        wanted = models.kernel_svm("label", 2.0, 1500, weight, rounds).fit(ready)
        line, offset = hinge.fit(hinge.packed(scaled, models.SCALED, "label", weight), project, 40, 1 / 3000, rounds)
        assert line == pytest.approx(wanted.coefficients.toArray(), abs=1e-8) and offset == pytest.approx(wanted.intercept, abs=1e-8)


def test_losses_and_their_end_are_those_of_the_library(scaled):
    # a strong penalty, so that the fit ends before its last round
    project, ready = models.fourier_projection(3, 0.5, 8), models.fourier_features(scaled, 3, 0.5, 8)
    wanted = models.kernel_svm("label", 0.002, 1500, rounds=400).fit(ready).summary().objectiveHistory
    blocks, asked = hinge.packed(scaled, models.SCALED, "label"), []
    loss = hinge._loss(blocks, project, hinge.spread(blocks, project, 8), 1 / 3)
    _, losses = hinge.least(lambda at: asked.append(1) or loss(at), np.zeros(9), 400)
    assert len(wanted) < 400 and losses == pytest.approx(wanted, abs=1e-9)


def test_a_fit_holds_no_features(spark, scaled):
    """Rows are stored as their predictors; nothing of the size of the kernel features is kept, in memory or on disk."""
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    blocks = hinge.packed(scaled, models.SCALED, "label")
    sizes = blocks.select("rows", F.octet_length("block").alias("bytes")).collect()
    assert sum(r["rows"] for r in sizes) == 1500 and all(r["bytes"] == r["rows"] * 8 * (3 + 2) for r in sizes)
    hinge.fit(blocks, models.fourier_projection(3, 0.5, 40), 40, 0.1, 3)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_fourier_projection_is_the_cosine():
    x = np.random.default_rng(1).normal(size=(700, 3)) * 5
    rnd = np.random.default_rng(9)
    weights, phase = rnd.normal(0.0, 1.0, (3, 20)), rnd.uniform(0.0, 2 * np.pi, 20)
    wanted = np.sqrt(0.1) * np.cos(x @ weights + phase)
    assert np.abs(models.fourier_projection(3, 0.5, 20, 9)(x) - wanted).max() < 1e-14


def test_labels_and_weights_are_checked(spark):
    shape = "label int, x double, w double"
    for row in ((2, 1.0, 1.0), (None, 1.0, 1.0), (1, 1.0, None), (1, 1.0, -1.0)):
        rows = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 1.0), row], shape)
        with pytest.raises(Exception, match="label is other|weight is missing"):
            models.fit_kernel_svm(rows, ["x"], "label", dimensions=4, rounds=2, weight="w")
    with pytest.raises(ValueError):
        models.fit_kernel_svm(spark.createDataFrame([(0, 1.0, 1.0)], shape), ["x"], "label", dimensions=4)
