"""Frame sampling policy."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from mediaguard import fixed


def sampling_rate(duration) -> Column:
    d = duration if isinstance(duration, Column) else F.col(duration)
    (first, rate), *more = fixed.SAMPLING_RATES
    out = F.when(d <= first, rate)
    for limit, rate in more:
        out = out.when(d <= limit, rate)
    return out.otherwise(fixed.SAMPLING_RATE_LONG)


def frame_indices(frame_count: Column, fps: Column, sample_fps: Column) -> Column:
    """Source frame of every sampling instant, half-even rounded, capped, repeats removed.

    Instants are 0, 1/s, 2/s ... strictly before the end of the clip.
    """
    n = F.greatest(F.ceil(frame_count / fps * sample_fps).cast("long"), F.lit(1))
    return F.array_distinct(F.transform(
        F.sequence(F.lit(0).cast("long"), n - 1),
        lambda i: F.least(F.rint(i * (1.0 / sample_fps) * fps).cast("long"),
                          frame_count.cast("long") - 1)))
