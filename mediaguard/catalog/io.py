"""Sources and sinks, each written and read back where it writes."""
from __future__ import annotations

from pyspark.sql import functions as F

from mediaguard import fixed
from mediaguard.catalog.base import confusion_key, query, sig
from mediaguard.functions.ids import content_id
from mediaguard.operators import file_metadata as fm, metrics as mt
from mediaguard.operators.lineage import cut_lineage
from mediaguard.sources.spread import spread
from mediaguard.sources import images, listing, models as md, scratch, sinks, vectors as vec

r6 = lambda c: F.round(c, 6)

EXT_SQL = "['jpg', 'JPEG', 'txt', 'Png', 'gif', 'webp', 'BMP'][page_id % 7 + 1]"
PATHS = f"(SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') || '.' || {EXT_SQL} AS path FROM pages)"


def paths(c):
    ext = "element_at(array('jpg', 'JPEG', 'txt', 'Png', 'gif', 'webp', 'BMP'), cast(page_id % 7 + 1 AS int))"
    return c.table("pages").selectExpr("page_id", f"concat(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', ''), '.', {ext}) AS path")


U8 = "greatest(least(round_even((e + 0.5) * 255, 0), 255), 0)::INT"
RASTERS = f"(SELECT image_id, h8, unhex(array_to_string(list_transform(x, lambda e: printf('%02x', {U8})), '')) AS data FROM items)"


def rasters(c, extra=()):
    """Each vector as an 8 x 8 grey raster of raw bytes."""
    u8 = "transform(x, e -> lpad(hex(cast(greatest(least(rint((e + 0.5D) * 255), 255), 0) AS int)), 2, '0'))"
    return c.items().selectExpr("image_id", "h8", *extra, f"unhex(array_join({u8}, '')) AS data")


FILE_EXT = "['png', 'PNG', 'txt', 'Png', 'gif'][vec_id % 5 + 1]"
NAMED = f"(SELECT r.image_id || '.' || {FILE_EXT} AS name, r.data, r.h8 FROM {RASTERS} r JOIN items i USING (image_id))"


def image_files(c) -> str:
    """Every vector as a PNG file in a folder; one in 17 cut short, two in five not named as an image."""
    raster = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), "data").alias("raster")
    ext = "element_at(array('png', 'PNG', 'txt', 'Png', 'gif'), cast(vec_id % 5 + 1 AS int))"
    files = images.encoded(spread(rasters(c, ("vec_id",))).select("h8", F.expr(f"concat(image_id, '.', {ext}) AS name"), raster))
    out = scratch.folder(c.spark, "images")
    images.write_files(files.selectExpr("name", "IF(h8 % 17 = 0, substring(content, 1, 40), content) AS content"), out)
    return out


@query("src_images", f"SELECT name FROM {NAMED} WHERE lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'webp', 'bmp')")
def src_images(c):
    return listing.named(c.spark, image_files(c)).select("name").orderBy("name")


@query("src_decode", f"""SELECT name, substr(sha256(data), 1, 16) AS content_id, (SELECT count(*) FROM {NAMED} WHERE lower(name) LIKE '%.png' AND h8 % 17 = 0) AS corrupt
    FROM {NAMED} WHERE lower(name) LIKE '%.png' AND h8 % 17 <> 0""")
def src_decode(c):
    """The files are read and decoded; the corrupt ones are counted by the job that does so."""
    found, seen = images.decode_named(c.spark, image_files(c))
    kept = cut_lineage(found.select("name", content_id(F.col("raster.data")).alias("content_id")))
    return kept.withColumn("corrupt", F.lit(seen.get["corrupt"]))


@query("ras_normalise", f"SELECT image_id, substr(sha256(data), 1, 16) AS content_id FROM {RASTERS}")
def ras_normalise(c):
    return rasters(c).select("image_id", content_id(F.col("data")).alias("content_id"))


@query("src_shards", """SELECT f AS path, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT lang || '-' || source AS f, n_chars FROM documents)
    WHERE f IN (SELECT f FROM (SELECT DISTINCT lang || '-' || source AS f FROM documents) WHERE contains(f, 'en-') ORDER BY md5('42:' || f || '.parquet'), f LIMIT 7) GROUP BY f""")
def src_shards(c):
    """Seven shards of one split in seeded order; only the picked ones are opened."""
    out = scratch.folder(c.spark, "shards")
    docs = c.table("documents").select(F.concat("lang", F.lit("-"), "source").alias("shard"), "n_chars")
    docs.repartition("shard").write.partitionBy("shard").parquet(out)
    names = c.spark.read.parquet(out).select(F.concat("shard", F.lit(".parquet")).alias("path")).distinct()
    picked = [r.path[:-8] for r in listing.pick_shards(names, "path", "en-", 42, 7).collect()]
    return c.spark.read.parquet(out).where(F.col("shard").isin(picked)).groupBy(F.col("shard").alias("path")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("long").alias("chars"))


def vector_cache(c) -> str:
    """All vectors in a cache, and those of one source once more under a name that only continues it."""
    out = scratch.folder(c.spark, "vectors")
    vec.append(c.items().select("image_id", "label", "split", "source", "x"), out)
    vec.append(c.items("source = 'edited_eval'").select("image_id", "label", "split", F.lit("edited_eval_ext").alias("source"), "x"), out)
    return out


@query("src_vectors", "SELECT image_id, label, split, round(list_sum(x), 6) AS total FROM items WHERE source = 'edited_eval'")
def src_vectors(c):
    """One source of the cache: only its files are read."""
    rows = vec.load(c.spark, vector_cache(c), "edited_eval")
    return rows.select("image_id", "label", "split", r6(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query("sink_vectors", "SELECT source, count(*) AS n, count(DISTINCT image_id) AS images, round(sum(list_dot_product(x, x)), 4) AS energy FROM items GROUP BY source")
def sink_vectors(c):
    from mediaguard.functions import vectors as vx
    out = scratch.folder(c.spark, "vectors")
    vec.append(c.items().select("image_id", "label", "split", "source", "x"), out)
    back = c.spark.read.parquet(out)
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("image_id").alias("images"),
                                      F.round(F.sum(vx.dot("x", "x")), 4).alias("energy"))


@query("src_manifest_rows", """SELECT source, split, count(*) AS n FROM (SELECT *, 'rows_' || CASE file_ord % 3 WHEN 0 THEN '' WHEN 1 THEN 'face_' ELSE 'spec_' END || source AS file FROM raw_rows)
    WHERE NOT regexp_matches(file, '^rows_(face|spec)_') AND NOT contains(source, 'smoke') GROUP BY 1, 2""")
def src_manifest_rows(c):
    rows = c.raw_rows().withColumn("file", F.expr("concat('rows_', CASE file_ord % 3 WHEN 0 THEN '' WHEN 1 THEN 'face_' ELSE 'spec_' END, source)"))
    return vec.manifest_rows(rows).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


@query("sink_manifest", "SELECT split, source, count(*) AS n, count(DISTINCT image_id) AS images FROM manifest GROUP BY 1, 2")
def sink_manifest(c):
    out = scratch.folder(c.spark, "manifest")
    vec.write_manifest(c.manifest(), out)
    return c.spark.read.parquet(out).groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("image_id").alias("images"))


SPLITS = ["calib", "calib_ood", "test_edited", "test_holdout", "test_ood", "test_organizer", "train"]


@query("sink_stats", "SELECT source, " + ", ".join(f"count(*) FILTER (split = '{s}') AS {s}" for s in SPLITS) + " FROM manifest WHERE variant = 'clean' GROUP BY source")
def sink_stats(c):
    return c.manifest().where("variant = 'clean'").groupBy("source").pivot("split", SPLITS).count().na.fill(0)


@query("sink_preds", "SELECT 'in/' || source || '/' || image_id || '.png' AS image_path, round_even(pred, 4) AS pred FROM shipped WHERE variant = 'clean'")
def sink_preds(c):
    rows = c.shipped(variants=["clean"]).select("pred", F.concat(F.lit("in\\"), "source", F.lit("\\"), "image_id", F.lit(".png")).alias("path"))
    out = scratch.folder(c.spark, "preds")
    sinks.predictions(rows).write.json(out)
    return c.spark.read.schema("image_path STRING, pred DOUBLE").json(out)


RICH = ", ".join(f"round_even(max({e}) FILTER (variant = 'clean'), 4) AS {n}" for n, e in (
    ("general", "p_general"), ("tampered", "p_tampered"), ("face", "p_face"), ("spectral", "spectral"), ("degradation", "degradation_estimate")))


@query("sink_preds_rich", f"""SELECT r.*, CASE WHEN v.kind = 2 THEN 'ai_declared' WHEN v.kind = 1 THEN 'metadata_only' ELSE 'none' END AS provenance FROM (
    SELECT image_id, round_even(max(pred) FILTER (variant = 'clean'), 4) AS pred, CASE WHEN max(pred) FILTER (variant = 'clean') >= 0.5 THEN 'AI' ELSE 'real' END AS verdict,
      {RICH}, round_even(max(pred) FILTER (variant = 'blur20'), 4) AS blur20, count(*)::INT AS n_variants FROM shipped GROUP BY image_id) r
    JOIN (SELECT image_id, h8 % 3 AS kind FROM items) v USING (image_id)""")
def sink_preds_rich(c):
    """The record of an image: score and verdict, a struct of all branches, a map of its variants, and what its file declares."""
    rows = c.shipped()
    branches = F.struct(*[F.bround(e, 4).alias(n) for n, e in (("general", "p_general"), ("tampered", "p_tampered"), ("face", "p_face"), ("spectral", "spectral"), ("degradation", "degradation_estimate"))])
    value = F.struct(F.bround("pred", 4).alias("pred"), F.when(F.col("pred") >= 0.5, "AI").otherwise("real").alias("verdict"), branches.alias("branches")).alias("v")
    scored = sinks.variants_map(rows, ["image_id"], "variant", value, "variants")
    # an image file of each: a third carries a generator's name, a third a plain comment
    text = ("CASE h8 % 3 WHEN 2 THEN concat(cast('Software' AS binary), unhex('00'), cast('Midjourney v6' AS binary)) "
            "WHEN 1 THEN concat(cast('Comment' AS binary), unhex('00'), cast('made with a potato' AS binary)) END")
    chunk = lambda kind, body: f"unhex(lpad(hex(length({body})), 8, '0')), cast('{kind}' AS binary), {body}, unhex('00000000')"
    files = c.items().selectExpr("image_id AS path", f"{text} AS body").selectExpr(
        "path", f"IF(body IS NULL, unhex('89504E470D0A1A0A'), concat(unhex('89504E470D0A1A0A'), {chunk('tEXt', 'body')}, {chunk('IEND', 'unhex(\'\')')})) AS content")
    declared = fm.report(files).select(F.col("path").alias("image_id"), F.struct("verdict", "declares_ai", "summary").alias("provenance"))
    out = scratch.folder(c.spark, "rich")
    scored.join(declared, "image_id", "left").write.json(out)
    inner = "STRUCT<pred: DOUBLE, verdict: STRING, branches: STRUCT<general: DOUBLE, tampered: DOUBLE, face: DOUBLE, spectral: DOUBLE, degradation: DOUBLE>>"
    back = c.spark.read.schema(f"image_id STRING, variants MAP<STRING, {inner}>, provenance STRUCT<verdict: STRING, declares_ai: BOOLEAN, summary: STRING>").json(out)
    clean = F.col("variants")["clean"]
    return back.select("image_id", clean["pred"].alias("pred"), clean["verdict"].alias("verdict"),
                       *[clean["branches"][n].alias(n) for n in ("general", "tampered", "face", "spectral", "degradation")],
                       F.col("variants")["blur20"]["pred"].alias("blur20"), F.size("variants").alias("n_variants"), F.col("provenance.verdict").alias("provenance"))


@query("src_ocr_rows", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def src_ocr_rows(c):
    cache = scratch.folder(c.spark, "ocr")
    sinks.commit(c.table("labels").select("doc_id"), cache, "doc_id")
    return sinks.todo(c.table("documents").select("doc_id", "n_chars"), c.spark, cache, "doc_id")


@query("sink_ocr", "SELECT d.doc_id, round(t.p, 6) AS conf FROM documents d JOIN (SELECT doc_id, avg(conf) AS p FROM tokens GROUP BY doc_id) t USING (doc_id)")
def sink_ocr(c):
    """Two interrupted runs over one cache leave one row per id."""
    cache = scratch.folder(c.spark, "ocr")
    stats = c.tokens().groupBy("doc_id").agg(r6(F.avg("conf")).alias("conf"))
    first = c.table("labels").select("doc_id")
    sinks.commit(stats.join(first, "doc_id", "left_semi"), cache, "doc_id")
    sinks.commit(sinks.todo(stats, c.spark, cache, "doc_id"), cache, "doc_id")
    return c.spark.read.parquet(cache)


MODEL_SQL = "SELECT CASE code WHEN 1 THEN 'general' ELSE 'tampered' END AS branch, len(w) AS dim, round(12 * b, 6) AS b, round(12 * list_sum(w), 6) AS w_sum FROM probes"


def _model_rows(df):
    return df.select("branch", F.size("w").cast("long").alias("dim"), r6("b").alias("b"),
                     r6(F.aggregate("w", F.lit(0.0), lambda a, v: a + v)).alias("w_sum"))


@query("sink_models", MODEL_SQL)
def sink_models(c):
    out = scratch.folder(c.spark, "models")
    md.write(c.model_rows(), out)
    return _model_rows(c.spark.read.schema(md.SCHEMA).parquet(out))


@query("src_models", MODEL_SQL)
def src_models(c):
    out = scratch.folder(c.spark, "models")
    for v in ("v1", "v2"):
        md.write(c.model_rows(v), out)
    return _model_rows(md.read(c.spark, out, "v2"))


@query("src_results_json", f"""SELECT population, detector, setting, round(auroc, 4) AS auroc, round(acc, 4) AS acc FROM ({confusion_key('auc')}) JOIN ({confusion_key('acc')}) USING (population, detector, setting)""")
def src_results_json(c):
    rows = c.shipped("split LIKE 'test%'").selectExpr("source AS population", "variant AS setting", "label",
                                                       "stack(2, 'general', p_general, 'shipped', pred) AS (detector, score)")
    by = ["population", "detector", "setting"]
    table = mt.auroc(rows, by, "score", cut=0.5).select(
        *by, F.round("auroc", 4).alias("auroc"), F.round("acc", 4).alias("acc"))
    out = scratch.folder(c.spark, "results")
    sinks.write_results(table, out)
    return sinks.read_results(c.spark, out)


@query("sink_scores", "SELECT first, count(*) AS n, round(avg(score), 6) AS mean_score FROM chains GROUP BY first")
def sink_scores(c):
    out = scratch.folder(c.spark, "chains")
    c.chains().write.parquet(out)
    return c.spark.read.parquet(out).groupBy("first").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score")).alias("mean_score"))


@query("src_catalog", f"""SELECT dir, count(*) AS members FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS dir FROM (
    SELECT path, row_number() OVER (PARTITION BY regexp_extract(path, '([^/]*)$', 1) ORDER BY page_id) AS k FROM {PATHS} WHERE starts_with(path, 'http')) WHERE k = 1) GROUP BY dir""")
def src_catalog(c):
    m = listing.members(paths(c), "path", "page_id", "http")
    return m.groupBy(listing.dirname(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("members"))


@query("src_fetch_plan", f"""SELECT name FROM (SELECT name FROM (SELECT DISTINCT regexp_extract(path, '([^/]*)$', 1) AS name FROM {PATHS}) ORDER BY md5('0:' || name), name LIMIT 120)
    WHERE name NOT IN (SELECT regexp_extract(path, '([^/]*)$', 1) FROM {PATHS} WHERE page_id % 3 = 0)""")
def src_fetch_plan(c):
    named = paths(c).select("page_id", listing.basename(F.col("path")).alias("name"))
    return listing.fetch_plan(named.select("name").distinct(), named.where("page_id % 3 = 0").select("name"), "name", 0, 120)
