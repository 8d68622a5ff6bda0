"""What several operators of this subpackage share."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaguard.sources import scratch

_CUT = r".*/[a-z_]+-[0-9a-f]{32}"
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once to the session's shared folder and read them back: lost executors cost
    a reread, never another result."""
    path = scratch.folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the table behind ``df``, which ``cut`` wrote, once what was made of it has been written too.  Other files stay."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.fullmatch(_CUT, folder):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def words(text: Column) -> Column:
    """The maximal runs outside space and tab to carriage return; null gives no words."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def ordered(df: DataFrame, *order: str) -> DataFrame:
    """Add ``rank``, the zero-based place of each row under ``order``, without a single-task sort.

    Rows are dealt out by range and numbered inside their partition; each partition then adds
    the row counts of those before it.  ``order`` should tell all rows apart.  Nulls come first.
    """
    place = F.monotonically_increasing_id()
    held = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", place), "ordered")
    part = F.shiftright("_at", 33)
    before = _before(held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")), ["_n"])
    return (held.withColumn("_part", part).join(before, "_part")
            .withColumn("rank", F.col("_at") - F.shiftleft("_part", 33) + F.col("_n")).drop("_at", "_part", "_n"))


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add running sums (this row included) of columns under ``order``: ``sums`` maps new names to columns."""
    held = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)
               .withColumn("_at", F.monotonically_increasing_id()), "running").withColumn("_part", F.shiftright("_at", 33))
    before = _before(held.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()]), [f"_{n}" for n in sums])
    w = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    own = held.withColumns({n: F.sum(c).over(w) for n, c in sums.items()}).join(before, "_part")
    return own.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_at", "_part", *[f"_{n}" for n in sums])


def _before(parts: DataFrame, cols: list[str]) -> DataFrame:
    """Sums over the partitions before each; one row a partition, so one task suffices."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumns({c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in cols})
