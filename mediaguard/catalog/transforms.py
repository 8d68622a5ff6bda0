"""Vector, raster and metadata transforms, and the plug-in surface."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from mediaguard import fixed
from mediaguard.catalog.aggregations import EVAL, evalset
from mediaguard.catalog.base import auc_sql, kind_sql, query, sig
from mediaguard.catalog.io import rasters
from mediaguard.functions import scores, vectors as vx
from mediaguard.sources.spread import spread
from mediaguard.operators import embed as em, file_metadata as fm, metrics as mt, raster as ra, table_functions as tf, vector_jobs as vj

r6 = lambda c: F.round(c, 6)


def grey(c, where=None):
    df = rasters(c, ("label", "split"))
    df = spread(df.where(where) if where else df)
    return df.select("image_id", "label", "split", F.struct(
        F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), "data").alias("raster"))


@query("ras_degrade", "SELECT variant, count(*) AS n_images, count(*) * 64 AS n_bytes, count(DISTINCT image_id) AS n_ids FROM items CROSS JOIN settings GROUP BY variant")
def ras_degrade(c):
    df = ra.degrade_table(grey(c))
    return df.groupBy("variant").agg(F.count(F.lit(1)).alias("n_images"), F.sum(F.length("raster.data")).cast("long").alias("n_bytes"),
                                     F.countDistinct("image_id").alias("n_ids"))


SPECTRUM = """(SELECT image_id, u, v, ln(1 + sqrt(re * re + im * im)) AS f, sqrt((u - 4) * (u - 4) + (v - 4) * (v - 4)) / 4.0::DOUBLE AS r FROM (
    SELECT image_id, u, v, sum(d * cos(2 * pi() * ((u - 4) * y + (v - 4) * x) / 8)) AS re, sum(d * sin(2 * pi() * ((u - 4) * y + (v - 4) * x) / 8)) AS im FROM resid,
      (SELECT unnest(range(0, 8)) AS u), (SELECT unnest(range(0, 8)) AS v) GROUP BY 1, 2, 3))"""


@query("ras_spectral", f"""WITH px AS MATERIALIZED (SELECT image_id, (k - 1) // 8 AS y, (k - 1) % 8 AS x, greatest(least(round_even((e + 0.5) * 255, 0), 255), 0) AS g
      FROM (SELECT image_id, unnest(x) AS e, unnest(range(1, 65)) AS k FROM items)),
    resid AS MATERIALIZED (SELECT p.image_id, p.y, p.x, any_value(p.g) - median(q.g) AS d FROM px p CROSS JOIN (SELECT unnest(range(-1, 2)) AS dy) CROSS JOIN (SELECT unnest(range(-1, 2)) AS dx)
      JOIN px q ON q.image_id = p.image_id AND q.y = greatest(least(p.y + dy, 7), 0) AND q.x = greatest(least(p.x + dx, 7), 0) GROUP BY 1, 2, 3),
    fr AS MATERIALIZED {SPECTRUM}, m AS (SELECT image_id, CASE WHEN median(f) = 0 THEN 1e-6 ELSE median(f) END AS mid FROM fr GROUP BY image_id),
    b AS (SELECT image_id, {', '.join(f"avg(f) FILTER (least(floor(r * 5), 4) = {k}) AS b{k}" for k in range(5))}, max(f) FILTER (r > 0.25) AS top,
          avg(f) FILTER (u IN (4, 6) AND v IN (4, 6)) AS lat FROM fr GROUP BY image_id)
    SELECT image_id, {', '.join(f"round(b{k}, 6) AS band_{k}" for k in range(5))}, round(top / mid, 6) AS peak, round(lat / mid, 6) AS lattice,
           round((-2 * b0 - b1 + b3 + 2 * b4) / 10, 6) AS slope FROM b JOIN m USING (image_id)""")
def ras_spectral(c):
    df = ra.spectral_table(grey(c), n=8)
    return df.select("image_id", *[r6(F.col("spectral")[i]).alias(n) for i, n in enumerate(
        ["band_0", "band_1", "band_2", "band_3", "band_4", "peak", "lattice", "slope"])])


@query("ras_patch_stats", """SELECT image_id, round(max(s), 6) AS max_cell, arg_max(cell, (round(s, 9), -cell))::INT AS arg_cell, round(max(s) - min(s), 6) AS spread, round(abs(max(s) - sum(s)), 6) AS to_global FROM (
    SELECT image_id, ((i // 8) * 3 // 8) * 3 + ((i % 8) * 3 // 8) AS cell, sum(12 * x[i + 1] * (SELECT w FROM probes WHERE code = 1)[i + 1]) AS s
    FROM (SELECT image_id, x, unnest(range(0, 64)) AS i FROM items) GROUP BY 1, 2) GROUP BY image_id""")
def ras_patch_stats(c):
    df = ra.cell_scores(c.items().select("image_id", "x"), c.models().probes["general"])
    return df.select("image_id", r6("max_cell").alias("max_cell"), "arg_cell", r6("spread").alias("spread"), r6("to_global").alias("to_global"))


@query("vec_embed", "SELECT label, count(*) AS n, count(*) AS n_unit, 16 AS dim FROM items GROUP BY label")
def vec_embed(c):
    df = em.embed(c.items().select("label", "x"), em.projection(64, 16), 64)
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(vx.norm("vector") - 1) < 1e-9).alias("n_unit"), F.max(F.size("vector")).alias("dim"))


@query("vec_blend", f"""SELECT image_id, round(avg(pred) FILTER (variant IN ('clean', 'jpeg90', 'blur05')), 6) AS variant_mean,
    round(max(0.7 * p_general + 0.3 * p_tampered) FILTER (variant = 'clean'), 6) AS branch_blend FROM {EVAL} GROUP BY image_id""")
def vec_blend(c):
    return evalset(c, ["clean", "jpeg90", "blur05"]).groupBy("image_id").agg(
        r6(F.avg("pred")).alias("variant_mean"),
        r6(F.max(F.when(F.col("variant") == "clean", 0.7 * F.col("p_general") + 0.3 * F.col("p_tampered")))).alias("branch_blend"))


@query("vec_prototype", "SELECT family, i, round(v, 6) AS v FROM (SELECT family, unnest(range(0, 64)) AS i, unnest(p) AS v FROM protos)")
def vec_prototype(c):
    means = vj.group_means(c.items(), ["family"])
    return means.select("family", F.posexplode(vx.l2norm("mean")).alias("i", "v")).select("family", "i", r6("v").alias("v"))


KEYS = "['parameters', 'Software', 'Prompt', 'Comment', 'workflow', 'Title', 'dream']"
TITLE = "(SELECT page_id, url, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages)"
CLIP = "CASE WHEN length({0}) <= 400 THEN {0} ELSE substr({0}, 1, 399) || '…' END"
PNG_FIELDS = f"""(SELECT page_id, key, {CLIP.format("v")} AS value, kind FROM (
    SELECT page_id, key, CASE lower(key) WHEN 'parameters' THEN 'Stable Diffusion WebUI (AUTOMATIC1111) — ' WHEN 'prompt' THEN 'ComfyUI — ' WHEN 'workflow' THEN 'ComfyUI — '
             WHEN 'dream' THEN 'InvokeAI (legacy) — ' ELSE '' END || {CLIP.format("title")} AS v,
           CASE WHEN lower(key) IN ('parameters', 'prompt', 'workflow', 'dream') THEN 'ai' ELSE {kind_sql(CLIP.format("title"))} END AS kind
    FROM (SELECT page_id, title, {KEYS}[page_id % 7 + 1] AS key FROM {TITLE} WHERE page_id % 5 <> 0)))"""


def png_files(c):
    """Each page as a PNG file that carries its title in a text chunk; one in five carries none."""
    def chunk(kind, body):
        packed = f"concat(cast('{kind}' AS binary), {body})"
        return f"unhex(lpad(hex(length({body})), 8, '0')), {packed}, unhex(lpad(hex(crc32({packed})), 8, '0'))"
    head, end = chunk("IHDR", "unhex('00000001000000010800000000')"), chunk("IEND", "unhex('')")
    text = chunk("iTXt", "body")
    return (c.texts("pages")
            .selectExpr("page_id", "regexp_extract(html, '<title>([^<]*)</title>', 1) AS title", f"element_at(array({KEYS[1:-1]}), cast(page_id % 7 + 1 AS int)) AS key")
            .selectExpr("page_id", "concat(cast(key AS binary), unhex('0000000000'), cast(title AS binary)) AS body")
            .selectExpr("page_id AS path", f"IF(page_id % 5 = 0, concat(unhex('89504E470D0A1A0A'), {head}, {end}), concat(unhex('89504E470D0A1A0A'), {head}, {text}, {end})) AS content"))


@query("met_extract", f"SELECT page_id AS path, 'png:' || key AS place, key, value, kind FROM {PNG_FIELDS} WHERE length(trim(value)) > 0")
def met_extract(c):
    return fm.classified(png_files(c)).where("value IS NOT NULL").select("path", F.col("where").alias("place"), "key", "value", "kind")


@query("met_report", f"""SELECT p.page_id AS path, CASE WHEN f.kind = 'ai' THEN 'ai_declared' WHEN f.kind = 'camera' THEN 'camera_declared' WHEN f.kind = 'editor' THEN 'editor_declared'
      WHEN f.key IS NOT NULL THEN 'metadata_only' ELSE 'none' END AS verdict, coalesce(f.kind = 'ai', false) AS declares_ai,
      sum(coalesce(f.kind = 'ai', false)::INT) OVER ()::BIGINT AS total_ai FROM pages p LEFT JOIN {PNG_FIELDS} f ON f.page_id = p.page_id""")
def met_report(c):
    rep = fm.report(png_files(c)).select("path", "verdict", "declares_ai")
    total = rep.select(F.count_if("declares_ai").alias("n")).scalar()
    return rep.select("*", total.alias("total_ai"))


# ---------------------------------------------------------------- plug-in surface

def _linear_detector(w, b):
    """Loader of a detector: a batch of inputs to P(AI)."""
    def make():
        weights = np.array(w)

        def predict(x):
            return 1.0 / (1.0 + np.exp(-(x.reshape(len(x), -1) @ weights + b)))
        return predict
    return make


@query("udf_detector_plugin", f"""SELECT image_id, detector, round(score, 6) AS score FROM (SELECT image_id, unnest(['general', 'tampered']) AS detector,
    unnest([{sig('general')}, {sig('tampered')}]) AS score FROM shipped WHERE variant = 'clean')""")
def udf_detector_plugin(c):
    found = {n: _linear_detector(p.w, p.b) for n, p in c.models().probes.items()}
    return em.run_detectors(c.items().select("image_id", "x"), found, 64, ["image_id"]).select("image_id", "detector", r6("score").alias("score"))


SWAP = "(SELECT variant, label, unnest(['v1', 'v2']) AS version, unnest([greatest(general, 1.25 * tampered), greatest(0.5 * general + 0.5, 1.25 * tampered)]) AS z FROM shipped WHERE starts_with(split, 'test'))"


@query("udf_candidate_swap", f"SELECT version, variant, round(auroc, 6) AS auroc FROM ({auc_sql(SWAP, ['version', 'variant'], 'z')})")
def udf_candidate_swap(c):
    """Two versions of one branch under the same combination; everything else is shared."""
    versions = {"v1": (1.0, 0.0), "v2": (0.5, 0.5)}
    cols = ", ".join(f"'{v}', greatest({a}D * general + {b}D, {fixed.TAMPERED_SCALE}D * tampered)" for v, (a, b) in versions.items())
    rows = evalset(c).selectExpr("variant", "label", f"stack({len(versions)}, {cols}) AS (version, z)")
    return mt.auroc(rows, ["version", "variant"], "z").select("version", "variant", r6("auroc").alias("auroc"))


@query("udf_branch_subset", f"""SELECT image_id, variant, round(greatest({sig('general')}, {sig('1.25 * tampered')}), 6) AS both, round({sig('general')}, 6) AS general_only FROM shipped""")
def udf_branch_subset(c):
    from mediaguard.plans.scoring import subset_score
    rows = c.shipped()
    return rows.select("image_id", "variant", r6(subset_score(["general", "tampered"])).alias("both"), r6(subset_score(["general"])).alias("general_only"))


@query("udf_udaf_metric", f"""SELECT generator, source, count(*) AS n, round(avg(((pred >= 0.5) = (label = 1))::INT), 6) AS acc FROM {EVAL} GROUP BY 1, 2""")
def udf_udaf_metric(c):
    return mt.confusion(evalset(c), ["generator", "source"], "pred").selectExpr("generator", "source", "tp + fp + tn + fn AS n", "round(acc, 6) AS acc")


@query("udf_udtf", "SELECT image_id, s.kind, s.param, s.variant FROM items CROSS JOIN settings s WHERE s.idx > 0 AND label = 1")
def udf_udtf(c):
    """A table function called laterally."""
    tf.register(c.spark)
    return c.spark.sql("SELECT i.image_id, s.kind, s.param, s.variant FROM {items} i, LATERAL grid_settings(i.label, 1) s", items=c.items().select("image_id", "label"))


@query("udf_udtf_table", """SELECT video_id::INT AS video_id, verdict, round(min(t), 3) AS first, round(max(t), 3) AS last, count(*)::INT AS n FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY t, frame_id) AS run FROM (
      SELECT *, CASE WHEN verdict = lag(verdict) OVER w AND t - lag(t) OVER w < 21600 THEN 0 ELSE 1 END AS fresh FROM frame_scores WINDOW w AS (PARTITION BY video_id ORDER BY t, frame_id)))
    GROUP BY video_id, verdict, run""")
def udf_udtf_table(c):
    """A table function over a table argument, one instance per video."""
    tf.register(c.spark)
    frames = c.frames().select(F.col("video_id").cast("int").alias("video_id"), "frame_id", "t", "confidence")
    runs = c.spark.sql("SELECT * FROM verdict_runs(TABLE(SELECT * FROM {frames}) PARTITION BY video_id ORDER BY (t, frame_id), 21600.0D)", frames=frames)
    return runs.select("video_id", "verdict", F.round("first", 3).alias("first"), F.round("last", 3).alias("last"), "n")
