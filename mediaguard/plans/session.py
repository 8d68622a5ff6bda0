"""Session settings the jobs are designed for."""
from __future__ import annotations

from pyspark.sql import SparkSession

# What a cluster session should carry.  AQE coalesces small shuffles and splits skewed joins;
# sessions merge in the task before the shuffle; Arrow batches are kept small enough for
# tables that carry vectors or rasters; column call sites are not recorded.
CLUSTER = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int = 8, partitions: int | None = None) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cpus}]").appName("mediaguard")
    for k, v in CLUSTER.items():
        b = b.config(k, v)
    spark = (b.config("spark.sql.shuffle.partitions", str(partitions or cpus)).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
