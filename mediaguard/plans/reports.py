"""Reports that read scores."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediaguard.operators import metrics as mt

# Cumulative probabilities of a Poisson(1) count.
POISSON1 = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]


def matched_cut(reals: DataFrame, score: str, fpr: float) -> float:
    """Threshold at which a pool of reals shows the given false-positive rate."""
    return mt.quantiles(reals, [], score, {"t": 1 - fpr}).first()["t"]


def bootstrap_difference(rows: DataFrame, replicates: int = 40) -> DataFrame:
    """Interval of AUROC(a) - AUROC(b) under Poisson(1) weights drawn from each image's id.

    ``rows`` has image_id, label, a, b.  A row is repeated once per replicate; rows of weight 0 stay behind.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "image_id", F.col("rep").cast("string"))), 1, 8), 16, 10).cast("long") / 4294967296.0
    weight = F.lit(0)
    for t in POISSON1:
        weight = weight + (F.col("u") >= t).cast("int")
    reps = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("u", u).withColumn("w", weight)
    long = reps.where("w > 0").selectExpr("rep", "label", "w", "stack(2, 'a', a, 'b', b) AS (which, s)")
    auc = mt.auroc(long, ["rep", "which"], "s", weight="w").groupBy("rep").pivot("which", ["a", "b"]).agg(F.max("auroc"))
    d = F.col("a") - F.col("b")
    q = F.percentile(d, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return auc.agg(q.alias("q"), F.count(F.lit(1)).alias("replicates")).selectExpr(
        "round(q[0], 6) AS lo", "round(q[1], 6) AS mid", "round(q[2], 6) AS hi", "replicates")
