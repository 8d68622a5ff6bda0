"""The six text features of a document or image from its recognised regions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mediaguard import fixed
from mediaguard.functions import text as tx


def text_features(regions: DataFrame, by: str) -> DataFrame:
    """One row per ``by`` from regions with token, conf, w, h; a single grouped pass.

    An id without regions has no row; callers keep ``text_present`` by a left join.
    """
    ar = F.when(F.col("h") > 1e-3, F.col("w") / F.greatest(F.length("token"), F.lit(1)) / F.col("h"))
    plain = F.length(F.regexp_replace("token", r"[\x00-\x7F]", ""))
    df = regions.select(by, "conf", ar.alias("ar"), tx.token_is_plausible("token").cast("int").alias("ok"),
                        plain.alias("wide"), F.length("token").alias("len"))
    m = F.avg("ar")
    return df.groupBy(by).agg(
        F.avg("conf").alias("conf_mean"), F.stddev_pop("conf").alias("conf_std"), F.avg("ok").alias("token_plausibility"),
        F.when((F.count("ar") < 2) | (m <= 1e-6), 1.0).otherwise(1.0 / (1.0 + F.stddev_pop("ar") / m)).alias("glyph_consistency"),
        (F.sum("wide") / F.sum("len")).alias("frac_nonascii"), F.log1p(F.count(F.lit(1))).alias("n_regions"))


def standardised(df: DataFrame, stats: dict[str, tuple[float, float]]) -> Column:
    return F.array(*[(F.col(n) - stats[n][0]) / stats[n][1] for n in fixed.TEXT_FEATURES])


def feature_stats(df: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and deviation of every feature; six pairs come back."""
    r = df.agg(*[F.avg(n).alias(f"m_{n}") for n in fixed.TEXT_FEATURES],
               *[F.stddev_pop(n).alias(f"s_{n}") for n in fixed.TEXT_FEATURES]).first()
    return {n: (r[f"m_{n}"], r[f"s_{n}"] + 1e-6) for n in fixed.TEXT_FEATURES}
