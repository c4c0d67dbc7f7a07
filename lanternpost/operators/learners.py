"""Logistic regression on embeddings: one model per label, or one multinomial model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import discard, stored
from .scoring import list_matrix

FIT_BLOCK = 2048
MOST_CLASSES = 1000


def with_features(df: DataFrame, vector: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(vector).cast("array<double>")))


def _estimator(rows: int, c: float, max_iter: int, **options) -> LogisticRegression:
    """An inverse strength C weighs the summed loss; Spark averages it, hence 1 / (C * rows)."""
    return LogisticRegression(
        featuresCol="features", labelCol="y", weightCol="w", regParam=1.0 / (c * rows), maxIter=max_iter,
        standardization=False, **options,
    )


def _balanced(counts: dict, rows: int) -> dict:
    return {k: rows / (len(counts) * n) for k, n in counts.items() if n}


def _by_class(weights: dict, y: Column) -> Column:
    chain = F
    for value, weight in weights.items():
        chain = chain.when(y == float(value), weight)
    return chain.otherwise(1.0)


@dataclass(frozen=True)
class LabelModel:
    """A binary logistic model of one label.

    ``loss`` is the weighted mean loss with the penalty at the fitted weights and ``gradient_norm`` the
    length of its gradient there; a model that knows nothing has a loss of log 2.
    """

    coefficients: list[float]
    intercept: float
    support: int
    loss: float
    gradient_norm: float
    passes: int


def _label_sums(rows: DataFrame, beta: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row per label: loss, gradient and the upper half of the Hessian, summed over all rows in one pass.

    Each task adds up its blocks for all labels together; sums of tasks are added by Spark slot by slot.
    """
    labels, width = beta.shape
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((labels, 1 + width + len(upper[0])))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = list_matrix(batch.column("vec"))
            x = np.hstack([x, np.ones((len(x), 1))])
            y = list_matrix(batch.column("truth"))
            for a in range(0, len(x), FIT_BLOCK):
                part, truth = x[a : a + FIT_BLOCK], y[a : a + FIT_BLOCK]
                logit = part @ beta.T
                p = 1.0 / (1.0 + np.exp(-np.clip(logit, -700, 700)))
                w = np.where(truth > 0, weights[:, 1], weights[:, 0])
                total[:, 0] += (w * (np.logaddexp(0.0, logit) - truth * logit)).sum(axis=0)
                total[:, 1 : 1 + width] += (w * (p - truth)).T @ part
                curve = w * p * (1.0 - p)
                for k in range(labels):
                    total[k, 1 + width :] += (part.T @ (part * curve[:, k : k + 1]))[upper]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(labels, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["label", "sums"])

    parts = rows.mapInArrow(run, "label int, sums array<double>").select("label", F.posexplode("sums").alias("slot", "x"))
    added = parts.groupBy("label", "slot").agg(F.sum("x").alias("x")).toArrow()
    sums = np.zeros((labels, 1 + width + len(upper[0])))
    sums[added.column("label").to_numpy(), added.column("slot").to_numpy()] = added.column("x").to_numpy()
    return sums


def _newton_step(sums: np.ndarray, beta: np.ndarray, rows: int, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss with the penalty, its gradient, and the step to take, for one label; the intercept bears no penalty."""
    width = len(beta)
    ridge = np.r_[np.full(width - 1, penalty), 0.0]
    loss = sums[0] / rows + 0.5 * (ridge * beta * beta).sum()
    gradient = sums[1 : 1 + width] / rows + ridge * beta
    hessian = np.zeros((width, width))
    hessian[np.triu_indices(width)] = sums[1 + width :] / rows
    hessian = hessian + np.triu(hessian, 1).T + np.diag(ridge + 1e-12)
    return loss, gradient, np.linalg.solve(hessian, gradient)


def fit_per_label(
    train: DataFrame, vector: str, truth: str, labels: list, *, c: float = 1.0, max_iter: int = 200, balanced: bool = True, tolerance: float = 1e-9
) -> list[LabelModel | None]:
    """One binary model per label of a 0/1 array; None for a label with a single class.

    All labels are fitted together: each round is one pass over the rows that gives loss, gradient and
    curvature of every label, and each label takes its own Newton step, halved while its loss grows.
    What the driver receives grows with labels and the square of the dimension, not with rows.
    """
    ready = stored(train.select(F.col(vector).cast("array<double>").alias("vec"), F.col(truth).cast("array<double>").alias("truth")), "features")
    first = ready.agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size("vec")).alias("dim"), *[F.sum(F.element_at("truth", i + 1)).alias(f"p{i}") for i in range(len(labels))]
    ).first()
    rows = first["rows"]
    positive = [int(first[f"p{i}"] or 0) for i in range(len(labels))]
    live = [i for i, n in enumerate(positive) if 0 < n < rows]
    if not live:
        return [None] * len(labels)
    own = ready.select("vec", F.array(*[F.element_at("truth", i + 1) for i in live]).alias("truth"))
    weights = np.ones((len(live), 2))
    if balanced:
        weights = np.array([[rows / (2 * (rows - positive[i])), rows / (2 * positive[i])] for i in live])
    penalty = 1.0 / (c * rows)
    beta, step = np.zeros((len(live), first["dim"] + 1)), np.zeros((len(live), first["dim"] + 1))
    best: list = [None] * len(live)
    passes = 0
    while passes < max_iter:
        sums = _label_sums(own, beta - step, weights)
        passes += 1
        for k in range(len(live)):
            loss, gradient, onward = _newton_step(sums[k], beta[k] - step[k], rows, penalty)
            if best[k] is not None and loss > best[k][0] + 1e-12:
                step[k] /= 2
                continue
            beta[k] -= step[k]
            best[k] = (loss, float(np.linalg.norm(gradient)))
            step[k] = onward if best[k][1] > tolerance else 0.0
        if all(b[1] <= tolerance for b in best) or not np.abs(step).max() > 1e-15:
            break
    discard(ready)
    models: list[LabelModel | None] = [None] * len(labels)
    for k, i in enumerate(live):
        models[i] = LabelModel(beta[k, :-1].tolist(), float(beta[k, -1]), positive[i], float(best[k][0]), best[k][1], passes)
    return models


def predict_per_label(models: list, df: DataFrame, vector: str, name: str = "prob") -> DataFrame:
    """Add ``array<double>`` of label probabilities; the models' coefficients are literals in one projection."""

    def probability(model) -> Column:
        if model is None:
            return F.lit(0.0)
        weights = F.array(*[F.lit(float(x)) for x in model.coefficients])
        products = F.zip_with(F.col(vector).cast("array<double>"), weights, lambda a, b: a * b)
        logit = F.aggregate(products, F.lit(float(model.intercept)), lambda acc, x: acc + x)
        return 1.0 / (1.0 + F.exp(-logit))

    return df.withColumn(name, F.array(*[probability(m) for m in models]))


def fit_multinomial(
    train: DataFrame, vector: str, label: str, *, c: float = 1.0, max_iter: int = 200, balanced: bool = True
) -> LogisticRegressionModel:
    """One multinomial model for an integer class column."""
    ready = with_features(train, vector).select("features", F.col(label).cast("double").alias("y"))
    ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = ready.groupBy("y").agg(F.count(F.lit(1)).alias("n")).limit(MOST_CLASSES + 1).collect()
        if len(found) > MOST_CLASSES:
            raise ValueError(f"{label} has more than {MOST_CLASSES} classes")
        counts = {r["y"]: r["n"] for r in found}
        rows = sum(counts.values())
        weights = _balanced(counts, rows) if balanced else {}
        weighted = ready.withColumn("w", _by_class(weights, F.col("y")) if weights else F.lit(1.0))
        return _estimator(rows, c, max_iter, family="multinomial").fit(weighted)
    finally:
        ready.unpersist()


def predict_class(model: LogisticRegressionModel, df: DataFrame, vector: str, name: str = "pred") -> DataFrame:
    scored = model.transform(with_features(df, vector))
    return scored.select(
        *df.columns, F.col("prediction").cast("int").alias(name), vector_to_array("probability").alias("prob")
    )
