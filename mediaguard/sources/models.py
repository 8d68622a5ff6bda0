"""The models table: one row per branch and version."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediaguard.operators.vector_jobs import Linear, Models

SCHEMA = "branch STRING, version STRING, w ARRAY<DOUBLE>, b DOUBLE, stats MAP<STRING, DOUBLE>"


def models_table(spark: SparkSession, models: Models, version: str = "v1", stats: dict | None = None) -> DataFrame:
    stats = stats or {}
    rows = [(n, version, [float(v) for v in p.w], float(p.b), stats.get(n, {})) for n, p in models.probes.items()]
    return spark.createDataFrame(rows, SCHEMA)


def write(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).where(f"version = '{version}'")


def load(spark: SparkSession, path: str, version: str) -> Models:
    """Probes of one version; a handful of rows."""
    return Models({r.branch: Linear(tuple(r.w), r.b) for r in read(spark, path, version).collect()})
