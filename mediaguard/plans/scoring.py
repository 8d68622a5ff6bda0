"""Scores of whole images from the rows of their branches."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediaguard import fixed
from mediaguard.functions import scores
from mediaguard.operators.sampling import top_n


def top_faces(faces: DataFrame, w: str = "fw", h: str = "fh", tie: str = "face_no") -> DataFrame:
    """Faces of usable size, at most eight per image, largest first."""
    usable = faces.where(F.least(w, h) >= fixed.MIN_FACE_PX)
    return top_n(usable, ["image_id"], [F.desc(F.col(w) * F.col(h)), F.asc(tie)], fixed.MAX_FACES)


def image_report(rows: DataFrame, cal_face=(0.9, 0.1), cal_tampered=(1.1, -0.2), cal_spectral=(0.5, 0.0)) -> DataFrame:
    """One nested report per image; a signal that was not measured is null, never 0.

    ``rows`` carries the branch logits of the image as given, its emitted score and content.
    """
    s = rows.select(
        "image_id", "content", "has_face", "face_px", F.col("pred").alias("c"), scores.sigmoid("general").alias("g"),
        scores.platt("tampered", *cal_tampered).alias("t"), scores.platt("face", *cal_face).alias("f"),
        scores.platt("spectral", *cal_spectral).alias("s"))
    region = F.struct(F.lit("face").alias("type"),
                      F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("face_px").cast("int").alias("width"),
                               F.col("face_px").cast("int").alias("height")).alias("bbox"),
                      F.bround("f", 4).alias("score"), scores.verdict3("f").alias("verdict"))
    v = s.withColumn("verdict", scores.verdict3("c"))
    return v.select(
        "image_id", F.struct(
            "verdict", F.bround("c", 4).alias("confidence"),
            F.struct(F.bround("g", 4).alias("general"), F.bround("f", 4).alias("face"), F.bround("t", 4).alias("tampered"),
                     F.lit(None).cast("double").alias("text"), F.bround("s", 4).alias("regularity")).alias("signals"),
            F.col("content").alias("content_type"),
            scores.explanation("verdict", "g", "t", "f", "content").alias("explanation"),
            scores.reliability("c", "g", "f").alias("reliability"),
            F.when(F.col("has_face"), F.array(region)).otherwise(F.array().cast(
                "array<struct<type:string,bbox:struct<x:int,y:int,width:int,height:int>,score:double,verdict:string>>")).alias("regions")
        ).alias("report"))


def subset_score(names: list[str]):
    """Raw (unshifted) score of chosen branches, the edit branch at its shipped loudness."""
    parts = [scores.sigmoid((fixed.TAMPERED_SCALE if n == "tampered" else 1.0) * F.col(n)) for n in names]
    return F.greatest(*parts) if len(parts) > 1 else parts[0]
