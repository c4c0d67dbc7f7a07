"""Plug-in points for models: encoder, label scorer, reply generator.

A factory is called once per Python worker and returns a function over a batch, so a
model is loaded once and not per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Predict = Callable[[np.ndarray], np.ndarray]


def encode_with(
    df: DataFrame, text: str, factory: Callable[[], Predict], *, name: str = "embedding", batch_size: int = 64,
    normalise: bool = True,
) -> DataFrame:
    """Texts to vectors with a user's encoder; vectors are scaled to length one by default."""

    def make() -> Predict:
        encode = factory()

        def predict(texts: np.ndarray) -> np.ndarray:
            vectors = np.asarray(encode(texts), dtype=np.float32)
            if normalise:
                length = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
            return vectors

        return predict

    udf = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(name, udf(F.col(text)))


def score_with(
    df: DataFrame, text: str, factory: Callable[[], Predict], *, name: str = "prob", batch_size: int = 16
) -> DataFrame:
    """Texts to one score per label, in label order."""
    udf = predict_batch_udf(factory, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return df.withColumn(name, udf(F.col(text)))


def generate_with(
    df: DataFrame,
    prompt: str,
    factory: Callable[[], Callable[[list[str]], list[str]]],
    *,
    name: str = "reply",
    error: str = "error",
    batch_size: int = 16,
) -> DataFrame:
    """Prompts to replies by a function over batches.

    Where a batch fails its rows are tried one by one: a failing row gets its error text and
    the others go on.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType()), T.StructField(error, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = factory()

        def attempt(texts: list[str]) -> list[tuple[str | None, str | None]]:
            try:
                return [(reply, None) for reply in generate(texts)]
            except Exception as problem:  # a row's failure is data here
                if len(texts) == 1:
                    return [(None, f"{type(problem).__name__}: {problem}")]
                return [pair for text in texts for pair in attempt([text])]

        for batch in batches:
            texts = list(batch[prompt])
            done = [pair for at in range(0, len(texts), batch_size) for pair in attempt(texts[at : at + batch_size])]
            yield batch.assign(**{name: [r for r, _ in done], error: [e for _, e in done]})

    return df.mapInPandas(run, schema)
