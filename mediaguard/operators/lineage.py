"""Where a lineage must be cut, it is cut in a reliable store."""
from __future__ import annotations

from pyspark.sql import DataFrame

from mediaguard.sources import scratch


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to a new table in the session's shared folder and read them back.

    One pass, and every later use reads the same rows, whichever executors are lost.
    """
    path = scratch.folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
