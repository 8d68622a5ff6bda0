"""Event-time verdicts of videos, for append mode: a window or session is emitted once, when the watermark has passed it, and its state goes."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediaguard import fixed


def _verdict(grouped) -> DataFrame:
    ai = F.col("confidence") >= fixed.AI_CUT
    return grouped.agg(F.median("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_frames"), F.count_if(ai).alias("n_ai"))


def windowed(frames: DataFrame, ts: str = "ts", delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Median confidence and AI frames per video and window; frames later than ``delay`` drop.

    Confidences carry four decimals, so the state of a group is at most 10,001 counters.
    """
    return _verdict(frames.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), "video_id"))


def sessions(frames: DataFrame, ts: str = "ts", delay: str = "1 hour", gap: str = "6 hours") -> DataFrame:
    """The same per session: a run of frames without a gap is one video."""
    return _verdict(frames.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), "video_id"))
