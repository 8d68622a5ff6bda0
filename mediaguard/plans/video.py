"""Verdict of a video from its frames."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediaguard import fixed
from mediaguard.functions import scores


def aggregate(frames: DataFrame, by=("video_id",)) -> DataFrame:
    """Median confidence and signals per video.

    Confidences and signals carry four decimals, so the exact median keeps at most 10,001
    counters per video however many frames it has, and combines them map-side.
    """
    ai = F.col("confidence") >= fixed.AI_CUT
    per = frames.groupBy(*by).agg(
        F.median("confidence").alias("confidence"), F.median("s_general").alias("s_general"),
        F.median("s_face").alias("s_face"), F.count(F.lit(1)).alias("n_frames"), F.count_if(ai).alias("n_ai"))
    v = scores.verdict3("confidence")
    return per.withColumn("verdict", v).withColumn(
        "n_returned", F.when(F.col("verdict") == "likely_ai", F.col("n_frames")).otherwise(0))


def returned_frames(frames: DataFrame) -> DataFrame:
    """Frames of the videos whose aggregate verdict is AI."""
    keep = aggregate(frames).where("verdict = 'likely_ai'").select("video_id")
    return frames.join(keep, "video_id", "left_semi")
