"""Table functions for SQL: rows in, rows out, with state along a partition."""
from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from mediaguard import fixed


class GridSettings:
    """One row per degradation setting of a row with the wanted label; called laterally."""

    def eval(self, label: int, wanted: int):
        if label == wanted:
            for kind, param in fixed.GRID:
                yield kind, float(param), f"{kind}{param}".replace(".", "")


class VerdictRuns:
    """Runs of frames with one verdict along a video: its partition, in order of time.

    A run is emitted when the verdict changes or a frame comes ``gap`` seconds or more after the one before, the last one
    at the end of the partition; what is kept is one run, whatever the length of the video.
    """

    def __init__(self):
        self.run = None

    def eval(self, row, gap: float):
        p = row["confidence"]
        verdict = "likely_ai" if p >= fixed.AI_CUT else "likely_real" if p <= fixed.REAL_CUT else "uncertain"
        if self.run is not None and verdict == self.run[1] and row["t"] - self.run[3] < gap:
            self.run = [*self.run[:3], row["t"], self.run[4] + 1]
        else:
            if self.run is not None:
                yield tuple(self.run)
            self.run = [row["video_id"], verdict, row["t"], row["t"], 1]

    def terminate(self):
        if self.run is not None:
            yield tuple(self.run)


def register(spark: SparkSession) -> None:
    """``grid_settings(label, wanted)`` and ``verdict_runs(TABLE(...) PARTITION BY video_id ORDER BY (t), gap)``.

    Both take and give single rows, which travel pickled: with Arrow, every call of ``eval`` would be a data frame of its own.
    """
    spark.udtf.register("grid_settings", F.udtf(GridSettings, returnType="kind STRING, param DOUBLE, variant STRING", useArrow=False))
    spark.udtf.register("verdict_runs", F.udtf(VerdictRuns, returnType="video_id INT, verdict STRING, first DOUBLE, last DOUBLE, n INT", useArrow=False))
