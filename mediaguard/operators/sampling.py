"""Ranked picks and deterministic samples."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mediaguard.operators.lineage import cut_lineage


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group.  A rank filter is pushed below the shuffle as a group limit,
    so a hot group sends at most ``n`` rows per task."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n).drop("_rk")


def largest(df: DataFrame, by: list[str], size: Column, tie: Column) -> DataFrame:
    """Row with the greatest size per group; the least ``tie`` wins."""
    return top_n(df, by, [size.desc_nulls_last(), tie.asc()], 1)


def global_rank(df: DataFrame, order: str, out: str) -> DataFrame:
    """0-based position in a total order without a single-task sort.

    Rows are range-partitioned and sorted in place; a count per range, of which there are as
    many as partitions, gives each range its offset.
    """
    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    # the low 33 bits of the generated id are the position in the partition, the rest its number
    mid = ranged.withColumn("_m", F.monotonically_increasing_id())
    mid = mid.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    # both uses below must read the same partitioning, so it is cut here when a cluster folder is set
    mid = cut_lineage(mid)
    sizes = mid.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    off = sizes.select("_p", F.coalesce(F.sum("_n").over(
        W.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return mid.join(off, "_p").withColumn(out, F.col("_o") + F.col("_i")).drop("_m", "_p", "_i", "_o")


def stride_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """Every (N div n)-th row of the sorted listing, then the first n of those."""
    total = df.count()
    if total <= n:
        return df
    step = max(1, total // n)
    ranked = global_rank(df, order, "_pos")
    return ranked.where((F.col("_pos") % step == 0) & (F.col("_pos") < step * n)).drop("_pos")
