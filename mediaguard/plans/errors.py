"""Representative errors."""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from mediaguard.functions import vectors as vx


def stable_errors(per_image: DataFrame, vectors: DataFrame, n: int = 5, threshold: float = 0.95) -> DataFrame:
    """The ``n`` worst images of each label that are not near copies of one another.

    The greedy rule takes the worst remaining image and drops everything like it.  Each round
    is one filtered top-1 per label over the whole table, so a group of copies of any size is
    passed over exactly and never collected; what comes back is two rows a round.
    ``per_image`` has image_id, p, label; ``vectors`` has image_id, x.
    """
    table = per_image.join(vectors.select("image_id", vx.l2norm("x").alias("x")), "image_id").persist(StorageLevel.DISK_ONLY)
    wrong = F.round(F.when(F.col("label") == 0, -F.col("p")).otherwise(F.col("p")), 9)
    picked: dict[int, list] = {0: [], 1: []}
    try:
        for _ in range(n):
            rest = table
            for label, rows in picked.items():
                for r in rows:
                    like = vx.dot("x", F.array(*[F.lit(float(v)) for v in r.x])) > threshold
                    rest = rest.where((F.col("label") != label) | ~like)
            found = rest.groupBy("label").agg(
                F.min_by(F.struct("image_id", "p", "label", "x"), F.struct(wrong.alias("w"), "image_id")).alias("r")).select("r.*").collect()
            for r in found:
                picked[r.label].append(r)
            if not found:
                break
    finally:
        table.unpersist()
    rows = [(label, k, r.image_id, round(r.p, 6)) for label, rs in picked.items() for k, r in enumerate(rs)]
    return per_image.sparkSession.createDataFrame(rows, "label INT, rank INT, image_id STRING, p DOUBLE")
