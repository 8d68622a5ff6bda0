"""Verdict over the metadata fields of each file."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediaguard.functions import provenance as pv
from mediaguard.operators.sampling import top_n


def file_verdicts(fields: DataFrame, by: list[str], c2pa: str, key: str = "key", value: str = "value", order: str = "ord") -> DataFrame:
    """One row per file from its classified fields.

    Only flags and counts are aggregated, so a file with very many fields combines map-side
    like any other; the sentence quotes the two first AI claims, found by a rank limit.  A
    field with a null value marks a file without fields and is not counted.
    """
    real = F.col(value).isNotNull()
    ai = F.col("kind") == "ai"
    flags = fields.groupBy(*by).agg(
        F.array_compact(F.array(*[F.when(F.bool_or(F.col("kind") == k), k) for k in ("ai", "camera", "editor")])).alias("kinds"),
        F.bool_or(c2pa).alias("c2pa"), F.count_if(real).alias("n_fields"), F.count_if(ai).alias("n_ai"),
        F.coalesce(F.bool_or(ai & F.lower(value).contains("trainedalgorithmicmedia")), F.lit(False)).alias("iptc"))
    quoted = (top_n(fields.where(ai), by, [F.asc(order)], 2).groupBy(*by)
              .agg(F.array_sort(F.collect_list(F.struct(order, F.concat_ws("=", key, value).alias("c")))).alias("q"))
              .select(*by, F.array_join(F.transform("q", lambda e: e["c"]), "; ").alias("claims")))
    out = flags.join(quoted, by, "left").withColumn("verdict", pv.verdict("kinds", "c2pa", "n_fields"))
    return out.withColumn("declares_ai", F.array_contains("kinds", "ai")).withColumn(
        "summary", pv.summary("verdict", "iptc", "claims")).drop("claims")
