"""All labels in one fit against single fits, gradients, and odd labels."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lanternpost.operators import learners


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6))
    true = rng.normal(size=(3, 6))
    y = (x @ true.T + rng.normal(size=(400, 3)) * 0.8 > [0.0, 1.5, -0.5]).astype(int)
    made = [(a.tolist(), [*b.tolist(), 0, 1]) for a, b in zip(x, y)]
    return spark.createDataFrame(made, "v array<double>, truth array<int>").repartition(5)


LABELS = ["a", "b", "c", "never", "always"]


@pytest.mark.parametrize("balanced, c", [(True, 1.0), (False, 0.1)])
def test_weights_equal_those_of_single_fits(spark, rows, balanced, c):
    models = learners.fit_per_label(rows, "v", "truth", LABELS, balanced=balanced, c=c)
    assert models[3] is None and models[4] is None
    n = rows.count()
    for i in range(3):
        m = models[i]
        assert m.gradient_norm < 1e-9 and m.loss < np.log(2) and m.passes < 15
        pos = m.support
        y = F.element_at("truth", i + 1).cast("double")
        w = F.when(y > 0, n / (2 * pos)).otherwise(n / (2 * (n - pos))) if balanced else F.lit(1.0)
        one = rows.select(array_to_vector("v").alias("features"), y.alias("y"), w.alias("w"))
        fit = LogisticRegression(labelCol="y", weightCol="w", regParam=1.0 / (c * n), maxIter=500, tol=1e-14, standardization=False).fit(one)
        np.testing.assert_allclose(m.coefficients, fit.coefficients.toArray(), atol=1e-6)
        assert m.intercept == pytest.approx(fit.intercept, abs=1e-6)


def test_one_pass_a_round(spark, rows, monkeypatch):
    passes = []
    sums = learners._label_sums
    monkeypatch.setattr(learners, "_label_sums", lambda *a: passes.append(1) or sums(*a))
    models = learners.fit_per_label(rows, "v", "truth", LABELS)
    assert len(passes) == models[0].passes == models[2].passes


def test_separable_classes_stay_finite(spark):
    df = spark.createDataFrame([([float(i), 1.0], [int(i > 5)]) for i in range(11)], "v array<double>, truth array<int>")
    m = learners.fit_per_label(df, "v", "truth", ["x"])[0]
    assert np.isfinite(m.coefficients).all() and m.gradient_norm < 1e-9
    probs = learners.predict_per_label([m, None], df, "v").collect()
    assert all((r["prob"][0] > 0.5) == bool(r["truth"][0]) and r["prob"][1] == 0.0 for r in probs)


def test_only_one_class_everywhere(spark):
    df = spark.createDataFrame([([1.0], [1, 0])], "v array<double>, truth array<int>")
    assert learners.fit_per_label(df, "v", "truth", ["x", "y"]) == [None, None]


def test_a_column_with_very_many_classes_is_refused(spark):
    df = spark.range(1200).select(F.array(F.col("id").cast("double")).alias("v"), "id")
    with pytest.raises(ValueError):
        learners.fit_multinomial(df, "v", "id")
