"""The vector cache: one Parquet table partitioned by source, metadata and vector in one row."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def append(df: DataFrame, path: str, max_records: int = 500_000) -> None:
    """Append in bounded files.  Rows are spread by source and a hash of the id, so one large
    source is written by many tasks."""
    salt = F.pmod(F.xxhash64("image_id"), F.lit(16))
    (df.repartition("source", salt).write.mode("append").partitionBy("source")
     .option("maxRecordsPerFile", max_records).parquet(path))


def load(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Rows of exactly one source; the equality prunes to its partition."""
    return spark.read.parquet(path).where(F.col("source") == source)


def manifest_rows(rows: DataFrame, file: str = "file") -> DataFrame:
    """Row files of the spine: branch caches and smoke sources are left out."""
    return rows.where(~F.col(file).rlike("^rows_(face|spec)_") & ~F.col("source").contains("smoke"))


def read_row_files(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All row files below ``root`` with an explicit schema and their file name."""
    df = spark.read.schema(schema).option("header", True).csv(root).select("*", F.col("_metadata.file_name").alias("file"))
    return manifest_rows(df)


def write_manifest(rows: DataFrame, path: str) -> None:
    """Write the resolved manifest; a failing gate raises before anything is written."""
    from mediaguard.operators.governance import require_green
    from mediaguard.operators.lineage import cut_lineage
    rows = cut_lineage(rows)                    # the gates and the write read the same resolved rows
    require_green(rows)
    rows.repartition("split", "source", F.pmod(F.xxhash64("image_id"), F.lit(16))).write.mode("overwrite").partitionBy("split", "source").parquet(path)
