"""Parallelism of small inputs."""
from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores when it has fewer splits than cores.

    A single small file is one split however costly the work on its rows; a large table has
    more splits than cores already and is left alone, so no shuffle is added there.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
