"""Joins between the spine of scored rows and its side tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mediaguard import fixed
from mediaguard.functions import ids
from mediaguard.operators.sampling import top_n

KEY = ["image_id", "variant"]


def settings_array(with_clean: bool = True) -> Column:
    """The degradation grid as a literal array; exploding it replaces a cross join."""
    rows = ([(0, "clean", "0", "clean")] if with_clean else []) + [
        (i + 1, k, p, f"{k}{p}".replace(".", "")) for i, (k, p) in enumerate(fixed.GRID)]
    return F.expr("array(" + ", ".join(
        f"named_struct('idx', {i}, 'kind', '{k}', 'param', {float(p)}D, 'variant', '{v}')" for i, k, p, v in rows) + ")")


def expand_settings(df: DataFrame, with_clean: bool = True) -> DataFrame:
    """One output row per (image, setting); narrow, no shuffle."""
    return df.withColumn("_set", F.explode(settings_array(with_clean))).select("*", "_set.*").drop("_set")


def expand_chains(df: DataFrame) -> DataFrame:
    """Ordered pairs of settings, the diagonal included, with the seed of the second stage."""
    n = len(fixed.GRID)
    first = df.withColumn("_f", F.explode(settings_array(False)))
    both = first.withColumn("_g", F.explode(settings_array(False)))
    return both.select(*df.columns, F.col("_f.idx").alias("first_idx"), F.col("_f.variant").alias("first"),
                       F.col("_f.kind").alias("first_kind"), F.col("_f.param").alias("first_param"),
                       F.col("_g.idx").alias("second_idx"), F.col("_g.variant").alias("second"),
                       F.col("_g.kind").alias("second_kind"), F.col("_g.param").alias("second_param"),
                       (100 + n * (F.col("_f.idx") - 1) + F.col("_g.idx") - 1).alias("stage_seed"))


def sampled_settings(image_id, k: int = 3) -> Column:
    """``k`` settings per image by hash order, as an array; per row, so no shuffle."""
    keyed = F.transform(settings_array(False), lambda s: F.struct(
        F.md5(F.concat_ws(":", image_id, s["idx"].cast("string"))).alias("k"), s["idx"].alias("idx"),
        s["variant"].alias("variant")))
    return F.slice(F.array_sort(keyed), 1, k)


def branches_left(general: DataFrame, spectral: DataFrame, face: DataFrame) -> DataFrame:
    """Spectral and face results beside every general row; an absent branch stays null."""
    return general.join(spectral, KEY, "left").join(face, KEY, "left")


def base_source(col) -> Column:
    return F.regexp_replace(col, "^(face|spec)_", "")


def manifest_owner(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Keep rows whose image is unseen or owned by their own source; adopt its split."""
    owner = top_n(manifest.select("image_id", F.col("source").alias("own_source"), F.col("split").alias("own_split")).distinct(),
                  ["image_id"], [F.asc("own_source"), F.asc("own_split")], 1)
    j = rows.join(owner, "image_id", "left")
    keep = F.col("own_source").isNull() | (F.col("own_source") == base_source(F.col("source")))
    return (j.where(keep).withColumn("split", F.coalesce("own_split", "split"))
            .drop("own_source", "own_split"))


def face_zero_fill(rows: DataFrame, faces: DataFrame, group: str) -> DataFrame:
    """Face score per key, 0 where absent, and 0 for a whole group if any of its sources has none."""
    has = rows.select("source", group).distinct().join(
        faces.select("source").distinct().withColumn("_has", F.lit(True)), "source", "left")
    ok = has.groupBy(group).agg(F.bool_and(F.coalesce("_has", F.lit(False))).alias("_ok"))
    f = faces.select(*KEY, F.col("face").alias("_face"))
    return (rows.join(f, KEY, "left").join(ok, group, "left")
            .withColumn("face", F.when(F.col("_ok"), F.coalesce("_face", F.lit(0.0))).otherwise(0.0))
            .drop("_face", "_ok"))


def nearest_in_time(probes: DataFrame, frames: DataFrame, by: str, t: str, ts: str, payload: str,
                    chunk_seconds: int = 6 * 3600) -> DataFrame:
    """Frame nearest to each probe time within its video; the earlier frame wins a tie.

    Probes and frames are stacked and each probe looks at the last frame before it and the
    first after it.  Time is cut into chunks so that one long video spreads over tasks; a
    summary row per chunk carries the edge frames across, so no chunk needs another's rows.
    Looking ahead is looking back in descending order: a running frame costs one step a row.
    """
    a = probes.select(by, F.col(t).cast("double").alias("_t"), F.struct(*probes.columns).alias("_p"),
                      F.lit(None).cast(frames.schema[payload].dataType).alias("_v"))
    b = frames.select(by, F.col(ts).cast("double").alias("_t"),
                      F.lit(None).cast(probes.select(F.struct(*probes.columns).alias("s")).schema["s"].dataType).alias("_p"),
                      F.col(payload).alias("_v"))
    # equal instants: keep the least payload so the answer does not depend on arrival order
    b = b.groupBy(by, "_t").agg(F.min("_v").alias("_v"), F.first("_p").alias("_p")).select(by, "_t", "_p", "_v")
    chunk = F.floor(F.col("_t") / chunk_seconds).cast("long")
    both = a.unionByName(b).withColumn("_c", chunk)
    frame = F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))
    edges = (both.where(F.col("_v").isNotNull()).groupBy(by, "_c")
             .agg(F.min(F.struct("_t", "_v")).alias("_lo"), F.max(F.struct("_t", "_v")).alias("_hi")))
    chunks = both.select(by, "_c").distinct().join(edges, [by, "_c"], "left")
    up, down = W.partitionBy(by).orderBy("_c"), W.partitionBy(by).orderBy(F.desc("_c"))
    past = (W.unboundedPreceding, -1)
    carry = chunks.select(
        by, "_c",
        F.last("_hi", ignorenulls=True).over(up.rowsBetween(*past)).alias("_prev"),
        F.last("_lo", ignorenulls=True).over(down.rowsBetween(*past)).alias("_next"))
    upto = (W.unboundedPreceding, W.currentRow)
    rise, fall = (W.partitionBy(by, "_c").orderBy(o).rangeBetween(*upto) for o in (F.asc("_t"), F.desc("_t")))
    seen = (both.withColumn("_b", F.last(frame, ignorenulls=True).over(rise))
            .withColumn("_a", F.last(frame, ignorenulls=True).over(fall)))
    hit = seen.where(F.col("_p").isNotNull()).join(carry, [by, "_c"])
    before, after = F.coalesce("_b", "_prev"), F.coalesce("_a", "_next")
    best = F.when(after.isNull(), before).when(before.isNull(), after).when(
        (after["_t"] - F.col("_t")) < (F.col("_t") - before["_t"]), after).otherwise(before)
    return hit.select("_p.*", best["_v"].alias(payload), best["_t"].alias("frame_t"))
