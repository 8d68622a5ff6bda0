"""Tables laid out for joins that move nothing."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from mediaguard.sources import scratch


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Write the rows once, in buckets by ``keys`` and sorted by them, and read the table back.

    Tables with the same keys and number of buckets join on them without a shuffle, whichever of their columns or rows are
    read.  By default there are as many buckets as shuffle partitions; take one number for all tables that meet.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    (df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", scratch.folder(spark, name)).saveAsTable(table))
    return spark.table(table)
