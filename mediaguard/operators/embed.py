"""Model inference as a column: the user brings the model, Spark brings the batches."""
from __future__ import annotations

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, functions as F, types as T


def projection(dim_in: int, dim_out: int, seed: int = 0):
    """Loader of a seeded random projection to unit vectors; stands in for a real model."""
    def make():
        m = np.random.default_rng(seed).standard_normal((dim_in, dim_out))

        def predict(x: np.ndarray) -> np.ndarray:
            v = x.reshape(len(x), -1) @ m
            return v / np.linalg.norm(v, axis=1, keepdims=True)
        return predict
    return make


def embed(df: DataFrame, make_predict, dim_in: int, x: str = "x", out: str = "vector", batch: int = 64) -> DataFrame:
    """Adds the model's vector.  The model is loaded once per worker and called per batch."""
    fn = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch, input_tensor_shapes=[[dim_in]])
    return df.withColumn(out, fn(F.col(x)))


def run_detectors(df: DataFrame, detectors: dict, dim_in: int, keys: list[str], x: str = "x") -> DataFrame:
    """Every registered detector on every row, long form: keys, detector, score.

    ``detectors`` maps a name to a loader whose model turns a batch into P(AI).
    """
    cols = []
    for name, make in detectors.items():
        fn = predict_batch_udf(make, return_type=T.DoubleType(), batch_size=256, input_tensor_shapes=[[dim_in]])
        cols.append(fn(F.col(x)).alias(name))
    wide = df.select(*keys, *cols)
    stack = f"stack({len(detectors)}, " + ", ".join(f"'{n}', `{n}`" for n in detectors) + ") AS (detector, score)"
    return wide.selectExpr(*keys, stack)
