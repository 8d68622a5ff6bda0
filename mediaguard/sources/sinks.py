"""Outputs: predictions, resumable caches, result files and score dumps."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RESULTS = "map<string, map<string, map<string, struct<auroc:double, acc:double>>>>"


def posix(path) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def predictions(df: DataFrame, path: str = "path", pred: str = "pred") -> DataFrame:
    """The required record: two fields, posix paths, four decimals rounded half to even."""
    return df.select(posix(path).alias("image_path"), F.bround(pred, 4).alias("pred"))


def variants_map(df: DataFrame, by: list[str], name: str, value: Column, out: str) -> DataFrame:
    """Map of setting to value per image; the settings bound its size."""
    return df.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name), value)))).alias(out))


def todo(wanted: DataFrame, spark: SparkSession, path: str, key: str) -> DataFrame:
    """Work the cache at ``path`` does not hold yet; everything when there is no cache."""
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:  # noqa: BLE001 - a missing path is an empty cache
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return wanted
    return wanted.join(done, key, "left_anti")


def commit(rows: DataFrame, path: str, key: str, max_records: int = 500) -> None:
    """Append one result per key in bounded files."""
    rows.dropDuplicates([key]).write.mode("append").option("maxRecordsPerFile", max_records).parquet(path)


def write_results(table: DataFrame, path: str) -> None:
    """(population, detector, setting, auroc, acc) rows as one nested JSON object.

    The file is as large as the report, which its dimensions bound.
    """
    inner = table.groupBy("population", "detector").agg(F.map_from_entries(F.collect_list(
        F.struct("setting", F.struct("auroc", "acc").alias("m")))).alias("s"))
    pops = inner.groupBy("population").agg(F.map_from_entries(F.collect_list(F.struct("detector", "s"))).alias("d"))
    one = pops.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("population", "d")))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The nested result object as (population, detector, setting, auroc, acc) rows."""
    doc = spark.read.option("wholetext", True).text(path).select(F.from_json("value", RESULTS).alias("r"))
    a = doc.select(F.explode("r").alias("population", "d"))
    b = a.select("population", F.explode("d").alias("detector", "s"))
    return b.select("population", "detector", F.explode("s").alias("setting", "m")).select(
        "population", "detector", "setting", "m.auroc", "m.acc")
