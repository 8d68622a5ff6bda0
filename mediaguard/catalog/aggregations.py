"""Aggregate reports over scored rows."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from mediaguard.catalog.base import auc_sql, query, sig
from mediaguard.functions import scores, vectors as vx
from mediaguard.operators import metrics as mt
from mediaguard.operators.lineage import cut_lineage

r6 = lambda c: F.round(c, 6)


def evalset(c, variants=None, keep_x=False):
    """Scored rows of the reporting splits; the calibration carve and training are left out."""
    return c.shipped("split LIKE 'test%'", keep_x, variants)


EVAL = "(SELECT * FROM shipped WHERE starts_with(split, 'test'))"


@query("agg_auroc", f"SELECT 'all' AS scope, round(auroc, 6) AS auroc, n_pos, n_neg FROM ({auc_sql(EVAL, [], 'pred')})")
def agg_auroc(c):
    return mt.auroc(evalset(c), [], "pred").select(F.lit("all").alias("scope"), r6("auroc").alias("auroc"), "n_pos", "n_neg")


@query("agg_auroc_by_variant", f"SELECT variant, round(auroc, 6) AS auroc, n_pos, n_neg FROM ({auc_sql(EVAL, ['variant'], 'pred')}) WHERE auroc IS NOT NULL")
def agg_auroc_by_variant(c):
    return (mt.auroc(evalset(c), "variant", "pred").where("auroc is not null")
            .select("variant", r6("auroc").alias("auroc"), "n_pos", "n_neg").orderBy("auroc", "variant"))


RATES = "tp, fp, tn, fn, round(acc, 6) AS acc, round(prec, 6) AS prec, round(rec, 6) AS rec, round(f1, 6) AS f1, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr"


def confusion_sql(table, by, score="pred", cut="0.5"):
    g = ", ".join(by)
    return f"""SELECT {g}, tp, fp, tn, fn, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS acc, tp / nullif(tp + fp, 0)::DOUBLE AS prec,
        tp / nullif(tp + fn, 0)::DOUBLE AS rec, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1,
        fp / nullif(fp + tn, 0)::DOUBLE AS fpr, fn / nullif(fn + tp, 0)::DOUBLE AS fnr
      FROM (SELECT {g}, count(*) FILTER (label = 1 AND {score} >= {cut}) AS tp, count(*) FILTER (label = 0 AND {score} >= {cut}) AS fp,
                   count(*) FILTER (label = 0 AND {score} < {cut}) AS tn, count(*) FILTER (label = 1 AND {score} < {cut}) AS fn
            FROM {table} WHERE {score} IS NOT NULL GROUP BY {g})"""


@query("agg_confusion", f"SELECT source, variant, {RATES} FROM ({confusion_sql(EVAL, ['source', 'variant'])})")
def agg_confusion(c):
    return mt.confusion(evalset(c), ["source", "variant"], "pred").selectExpr("source", "variant", *_rates())


def _rates():
    return ["tp", "fp", "tn", "fn"] + [f"round({m}, 6) AS {m}" for m in ("acc", "prec", "rec", "f1", "fpr", "fnr")]


SCOPED = """(SELECT *, 'all' AS scope FROM shipped WHERE starts_with(split, 'test')
             UNION ALL SELECT *, 'clean' AS scope FROM shipped WHERE starts_with(split, 'test') AND variant = 'clean')"""


def scoped(df):
    """Each row under 'all', clean rows also under 'clean'; one pass serves both tables."""
    return df.withColumn("scope", F.explode(F.expr(
        "IF(variant = 'clean', array('all', 'clean'), array('all'))")))


@query("agg_scorecard", f"""SELECT source, scope, round(auroc, 6) AS auroc, n_pos, n_neg, {RATES}
    FROM ({auc_sql(SCOPED, ['source', 'scope'], 'pred')}) JOIN ({confusion_sql(SCOPED, ['source', 'scope'])}) USING (source, scope)""")
def agg_scorecard(c):
    rows = scoped(evalset(c).select("source", "variant", "label", "pred"))
    by = ["source", "scope"]
    return mt.auroc(rows, by, "pred", cut=0.5).selectExpr(
        *by, "round(auroc, 6) AS auroc", "n_pos", "n_neg", *_rates())


BRANCH_ROWS = """(SELECT b.branch, s.variant, s.label, CASE b.branch WHEN 'general' THEN general WHEN 'face' THEN face
        WHEN 'spectral' THEN spectral ELSE tampered END AS score
    FROM shipped s CROSS JOIN (VALUES ('general'), ('face'), ('spectral'), ('tampered')) AS b(branch)
    WHERE (s.split = 'test_ood' AND (b.branch <> 'tampered' OR s.label = 0)) OR (s.split = 'test_edited' AND b.branch = 'tampered'))"""
GRID_LONG = f"(SELECT branch, variant, auroc FROM ({auc_sql(BRANCH_ROWS, ['branch', 'variant'], 'score')}) WHERE auroc IS NOT NULL)"


def branch_rows(c):
    """(branch, variant, label, score): each branch on its own task.

    The edited set has no negatives, so the edit branch borrows the reals of the unseen set.
    """
    df = c.branches("split IN ('test_ood', 'test_edited')")
    return (df.selectExpr("split", "variant", "label",
                          "stack(4, 'general', general, 'face', face, 'spectral', spectral, 'tampered', tampered) AS (branch, score)")
            .where("score IS NOT NULL AND IF(branch = 'tampered', split = 'test_edited' OR label = 0, split = 'test_ood')"))


def grid_long(c):
    return mt.auroc(branch_rows(c), ["branch", "variant"], "score").where("auroc is not null").select("branch", "variant", "auroc")


@query("agg_grid", f"""SELECT variant, round(max(auroc) FILTER (branch = 'face'), 6) AS face, round(max(auroc) FILTER (branch = 'general'), 6) AS general,
    round(max(auroc) FILTER (branch = 'spectral'), 6) AS spectral, round(max(auroc) FILTER (branch = 'tampered'), 6) AS tampered
    FROM {GRID_LONG} GROUP BY variant""")
def agg_grid(c):
    wide = grid_long(c).groupBy("variant").pivot("branch", ["face", "general", "spectral", "tampered"]).agg(r6(F.max("auroc")))
    return wide.orderBy(F.col("variant") != "clean", "variant")


@query("agg_summary", f"""SELECT branch, round(max(auroc) FILTER (variant = 'clean'), 6) AS clean, round(min(auroc), 6) AS worst,
    arg_min(variant, (round(auroc, 9), variant)) AS worst_variant, round(max(auroc) FILTER (variant = 'clean') - min(auroc), 6) AS drop_from_clean
    FROM {GRID_LONG} GROUP BY branch""")
def agg_summary(c):
    clean = F.max(F.when(F.col("variant") == "clean", F.col("auroc")))
    return grid_long(c).groupBy("branch").agg(
        r6(clean).alias("clean"), r6(F.min("auroc")).alias("worst"),
        F.min_by("variant", F.struct(F.round("auroc", 9), "variant")).alias("worst_variant"),
        r6(clean - F.min("auroc")).alias("drop_from_clean"))


def newton3(table: str, c: float, steps: int = 12) -> str:
    """Logistic regression of two scores by unrolled Newton steps over ``table`` (u, v, y), solved by Cramer's rule."""
    prev = "(SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS k)"
    det = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"
    h = ["haa", "hab", "hak", "hab", "hbb", "hbk", "hak", "hbk", "hkk"]
    put = lambda col: det.format(*[("ga", "gb", "gk")[i // 3] if i % 3 == col else x for i, x in enumerate(h)])
    for _ in range(steps):
        prev = f"""(SELECT a - {put(0)} / {det.format(*h)} AS a, b - {put(1)} / {det.format(*h)} AS b, k - {put(2)} / {det.format(*h)} AS k FROM (
          SELECT any_value(a) AS a, any_value(b) AS b, any_value(k) AS k, sum((p - y) * u) + any_value(a) / {c} AS ga, sum((p - y) * v) + any_value(b) / {c} AS gb, sum(p - y) AS gk,
                 sum(q * u * u) + 1.0 / {c} AS haa, sum(q * u * v) AS hab, sum(q * u) AS hak, sum(q * v * v) + 1.0 / {c} AS hbb, sum(q * v) AS hbk, sum(q) AS hkk
          FROM (SELECT *, p * (1 - p) AS q FROM (SELECT u, v, y, a, b, k, 1 / (1 + exp(-(a * u + b * v + k))) AS p FROM {table}, {prev}))))"""
    return prev


CALIB2 = "(SELECT general AS u, tampered AS v, label AS y FROM shipped WHERE split = 'calib_ood')"
COMBINED = """(SELECT k.combiner, variant, label, CASE k.combiner WHEN 'general' THEN general WHEN 'max' THEN greatest(general, tampered)
      ELSE round(fit.a, 6) * general + round(fit.b, 6) * tampered END AS score
    FROM shipped CROSS JOIN (VALUES ('general'), ('max'), ('fitted')) AS k(combiner), fit WHERE split IN ('test_ood', 'test_edited'))"""


@query("agg_combiners", f"""WITH fit AS MATERIALIZED {newton3(CALIB2, 1.0)} SELECT combiner, round(avg(auroc), 6) AS mean_auroc, round(min(auroc), 6) AS worst_auroc,
    round(max(auroc) FILTER (variant = 'clean'), 6) AS clean_auroc FROM ({auc_sql(COMBINED, ['combiner', 'variant'], 'score')})
    WHERE auroc IS NOT NULL GROUP BY combiner""")
def agg_combiners(c):
    """General alone, the larger logit, and a combiner fitted on the calibration carve."""
    from mediaguard.operators import newton
    calib = c.shipped("split = 'calib_ood'").select(F.array("general", "tampered").alias("x"), "label", F.array(F.lit(1.0)).alias("in_models"))
    a, b = newton.logistic_many(cut_lineage(calib), 1)[0].w
    rows = c.shipped("split IN ('test_ood', 'test_edited')").selectExpr(
        "variant", "label", f"stack(3, 'general', general, 'max', greatest(general, tampered), 'fitted', {round(a, 6)}D * general + {round(b, 6)}D * tampered) AS (combiner, score)")
    return (mt.auroc(rows, ["combiner", "variant"], "score").where("auroc is not null").groupBy("combiner")
            .agg(r6(F.avg("auroc")).alias("mean_auroc"), r6(F.min("auroc")).alias("worst_auroc"),
                 r6(F.max(F.when(F.col("variant") == "clean", F.col("auroc")))).alias("clean_auroc")))


RELIABILITY = """(SELECT f.source, f.bin, coalesce(n, 0) AS n, coalesce(cs, 0) / greatest(coalesce(n, 0), 1) AS conf,
      coalesce(fs, 0)::DOUBLE / greatest(coalesce(n, 0), 1) AS freq
    FROM (SELECT DISTINCT source, unnest(range(0, 10)) AS bin FROM shipped WHERE starts_with(split, 'test')) f
    LEFT JOIN (SELECT source, (p >= 0.1)::INT + (p >= 0.2)::INT + (p >= 0.3)::INT + (p >= 0.4)::INT + (p >= 0.5)::INT + (p >= 0.6)::INT
                 + (p >= 0.7)::INT + (p >= 0.8)::INT + (p >= 0.9)::INT AS bin, count(*) AS n, sum(p) AS cs, sum(label) AS fs
               FROM (SELECT *, 1.0 / (1.0 + exp(-general)) AS p FROM shipped WHERE starts_with(split, 'test')) GROUP BY 1, 2) b USING (source, bin))"""


def _with_p(c):
    return evalset(c).withColumn("p", scores.sigmoid("general"))


@query("agg_reliability", f"SELECT source, bin::INT AS bin, n, round(conf, 6) AS conf, round(freq, 6) AS freq FROM {RELIABILITY}")
def agg_reliability(c):
    return mt.reliability(_with_p(c), "source", "p").select("source", "bin", "n", r6("conf").alias("conf"), r6("freq").alias("freq"))


@query("agg_ece", f"SELECT source, round(sum(n * abs(conf - freq)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM {RELIABILITY} GROUP BY source")
def agg_ece(c):
    return mt.ece(_with_p(c), "source", "p").select("source", r6("ece").alias("ece"), "n")


COVER = """(SELECT variant, count(DISTINCT image_id) FILTER (has_face) AS faces, count(DISTINCT image_id) AS images FROM branches GROUP BY variant)"""


@query("agg_coverage", f"""SELECT variant, faces, images, round(faces / images::DOUBLE, 6) AS cover,
    round(faces / images::DOUBLE / (SELECT faces / images::DOUBLE FROM {COVER} WHERE variant = 'clean'), 6) AS retain FROM {COVER}""")
def agg_coverage(c):
    per_image = c.branches().groupBy("variant", "image_id").agg(F.bool_or("has_face").alias("f"))
    per = per_image.groupBy("variant").agg(F.count_if("f").alias("faces"), F.count(F.lit(1)).alias("images"))
    cover = F.col("faces") / F.col("images")
    # fifteen rows: the clean one is spread by a window over all of them
    clean = F.max(F.when(F.col("variant") == "clean", cover)).over(W.partitionBy(F.lit(0)))
    return per.select("variant", "faces", "images", r6(cover).alias("cover"), r6(cover / clean).alias("retain"))


DETECTED = """(SELECT b.* FROM shipped b WHERE image_id IN (SELECT image_id FROM shipped WHERE variant = 'clean' AND has_face))"""


@query("agg_detection_rate", f"""SELECT d.variant, d.detected, round(d.detected / (SELECT count(*) FROM {DETECTED} WHERE variant = 'clean')::DOUBLE, 6) AS rate,
    round(a.auroc, 6) AS auroc, d.n_ai, d.n_real
    FROM (SELECT variant, count(*) FILTER (has_face) AS detected, count(*) FILTER (has_face AND label = 1) AS n_ai,
          count(*) FILTER (has_face AND label = 0) AS n_real FROM {DETECTED} GROUP BY variant) d
    LEFT JOIN ({auc_sql('(SELECT * FROM ' + DETECTED + ' WHERE has_face)', ['variant'], 'face')}) a USING (variant)""")
def agg_detection_rate(c):
    rows = c.branches().select("image_id", "variant", "label", "has_face", "face")
    base = rows.where("variant = 'clean' AND has_face").select("image_id")
    seen = rows.join(base, "image_id", "left_semi")
    per = seen.groupBy("variant").agg(
        F.count_if("has_face").alias("detected"), F.count_if(F.expr("has_face AND label = 1")).alias("n_ai"),
        F.count_if(F.expr("has_face AND label = 0")).alias("n_real"))
    clean = F.max(F.when(F.col("variant") == "clean", F.col("detected"))).over(W.partitionBy(F.lit(0)))
    auc = mt.auroc(seen.where("has_face"), "variant", "face").select("variant", r6("auroc").alias("auroc"))
    return per.withColumn("rate", r6(F.col("detected") / clean)).join(auc, "variant", "left").select(
        "variant", "detected", "rate", "auroc", "n_ai", "n_real")


@query("agg_missingness_bias", """SELECT variant, round(ai, 6) AS kept_ai, round(re, 6) AS kept_real, round(ai / nullif(re, 0), 6) AS ratio FROM (
    SELECT variant, avg(has_face::INT) FILTER (label = 1) AS ai, avg(has_face::INT) FILTER (label = 0) AS re FROM branches GROUP BY variant)""")
def agg_missingness_bias(c):
    kept = F.col("has_face").cast("int")
    ai, re = F.avg(F.when(F.col("label") == 1, kept)), F.avg(F.when(F.col("label") == 0, kept))
    return c.branches().groupBy("variant").agg(r6(ai).alias("kept_ai"), r6(re).alias("kept_real"),
                                               r6(mt.safe_div(ai, re)).alias("ratio"))


@query("agg_flag_rate", "SELECT source, label, count(*) AS n, round(avg((pred >= 0.5)::INT), 6) AS flag_rate FROM shipped GROUP BY source, label")
def agg_flag_rate(c):
    return c.shipped().groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("pred") >= 0.5).cast("int"))).alias("flag_rate"))


@query("agg_crosstab", """SELECT split, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1
    FROM manifest WHERE variant = 'clean' GROUP BY split""")
def agg_crosstab(c):
    t = c.manifest().where("variant = 'clean'").groupBy("split").pivot("label", [0, 1]).count().na.fill(0)
    return t.toDF("split", "label_0", "label_1")


@query("agg_class_balance", """SELECT round(avg(label), 6) AS mean_label, count(*) AS n, avg(label) > 0.35 AND avg(label) < 0.65 AS ok
    FROM manifest WHERE split = 'train' AND variant = 'clean'""")
def agg_class_balance(c):
    m = F.avg("label")
    return c.manifest().where("split = 'train' AND variant = 'clean'").agg(
        r6(m).alias("mean_label"), F.count(F.lit(1)).alias("n"), ((m > 0.35) & (m < 0.65)).alias("ok"))


@query("agg_variants_per_image", "SELECT image_id, count(DISTINCT variant) AS n_variants FROM manifest GROUP BY image_id")
def agg_variants_per_image(c):
    from mediaguard.operators.governance import variants_per_image
    return variants_per_image(c.manifest())


@query("agg_split_spans", """SELECT image_id, min(split) AS lo, max(split) AS hi FROM raw_rows WHERE NOT contains(source, 'smoke')
    GROUP BY image_id HAVING count(DISTINCT split) > 1""")
def agg_split_spans(c):
    from mediaguard.operators.governance import split_spans
    return split_spans(c.manifest_input())


@query("agg_per_image_mean", """SELECT image_id, round(avg(pred), 6) AS pred, max(label) AS label, round(avg(general), 6) AS general,
    round(avg(tampered), 6) AS tampered FROM shipped WHERE split = 'test_organizer' GROUP BY image_id""")
def agg_per_image_mean(c):
    return per_image_mean(c.shipped("split = 'test_organizer'")).select(
        "image_id", r6("pred").alias("pred"), "label", r6("general").alias("general"), r6("tampered").alias("tampered"))


def per_image_mean(df):
    return df.groupBy("image_id").agg(F.avg("pred").alias("pred"), F.max("label").alias("label"),
                                      F.avg("general").alias("general"), F.avg("tampered").alias("tampered"))


@query("agg_face_max", f"""SELECT i.image_id, round(coalesce(max({sig('k.logit - ln(0.8092 / 0.1908)')}), 0), 6) AS face_score, count(k.logit) AS n_faces
    FROM items i LEFT JOIN kept_faces k USING (image_id) GROUP BY i.image_id""")
def agg_face_max(c):
    from mediaguard.plans.scoring import top_faces
    best = top_faces(c.faces()).groupBy("image_id").agg(
        F.max(scores.shifted("logit")).alias("s"), F.count(F.lit(1)).alias("n"))
    return c.items().select("image_id").join(best, "image_id", "left").select(
        "image_id", r6(F.coalesce("s", F.lit(0.0))).alias("face_score"), F.coalesce("n", F.lit(0)).alias("n_faces"))


TILES = "(SELECT image_id, x0, xv FROM scored WHERE variant IN ('jpeg90', 'resize05', 'crop08'))"


@query("agg_tile_mean", f"""SELECT image_id, n_tiles, round(list_dot_product(v, x0) / (sqrt(list_dot_product(v, v)) + 1e-9), 6) AS cos_to_clean FROM (
    SELECT image_id, list(a ORDER BY i) AS v, max(n) AS n_tiles FROM (
      SELECT image_id, i, avg(xv[i]) AS a, count(*) AS n FROM (SELECT image_id, xv, unnest(range(1, 65)) AS i FROM {TILES}) GROUP BY 1, 2) GROUP BY image_id)
    JOIN (SELECT image_id, x AS x0 FROM items) USING (image_id)""")
def agg_tile_mean(c):
    from mediaguard.operators import vector_jobs as vj
    tiles = c.scored(keep_x=True, variants=["jpeg90", "resize05", "crop08"])
    pooled = vj.mean_pool(tiles, ["image_id"]).withColumnRenamed("n", "n_tiles")
    return pooled.join(c.items().select("image_id", "x"), "image_id").select(
        "image_id", "n_tiles", r6(vx.dot("v", "x")).alias("cos_to_clean"))


@query("agg_ocr_stats", """SELECT doc_id, round(avg(conf), 6) AS conf_mean, round(stddev_pop(conf), 6) AS conf_std, round(ln(1 + count(*)), 6) AS n_regions
    FROM tokens GROUP BY doc_id""")
def agg_ocr_stats(c):
    return c.tokens().groupBy("doc_id").agg(
        r6(F.avg("conf")).alias("conf_mean"), r6(F.stddev_pop("conf")).alias("conf_std"),
        r6(F.log1p(F.count(F.lit(1)))).alias("n_regions"))


@query("agg_px_stats", """SELECT label, round(avg(log2(face_px)), 6) AS px_mu, round(CASE WHEN stddev_pop(log2(face_px)) = 0 THEN 1 ELSE stddev_pop(log2(face_px)) END, 6) AS px_sd
    FROM branches WHERE has_face AND split = 'train' GROUP BY label""")
def agg_px_stats(c):
    return mt.log2_stats(c.branches("split = 'train'").where("has_face"), "label", "face_px").select(
        "label", r6("px_mu").alias("px_mu"), r6("px_sd").alias("px_sd"))


@query("agg_std_stats", r"""SELECT f AS feature, round(avg(v), 6) AS mean, round(stddev_pop(v) + 1e-6, 6) AS sd FROM (
    SELECT unnest(['conf_mean', 'conf_std', 'token_plausibility', 'glyph_consistency', 'frac_nonascii', 'n_regions']) AS f, unnest([a, s, k, g, w, n]) AS v FROM (
      SELECT doc_id, avg(conf) AS a, stddev_pop(conf) AS s, avg((length(trim(token)) >= 2 AND regexp_full_match(token, '[\p{L}\p{N}\s]+'))::INT) AS k,
             CASE WHEN count(ar) < 2 OR avg(ar) <= 1e-6 THEN 1 ELSE 1 / (1 + stddev_pop(ar) / avg(ar)) END AS g,
             sum(length(regexp_replace(token, '[\x00-\x7F]', '', 'g'))) / sum(length(token))::DOUBLE AS w, ln(1 + count(*)) AS n
      FROM (SELECT *, CASE WHEN h > 1e-3 THEN w / greatest(length(token), 1) / h END AS ar FROM tokens) GROUP BY doc_id)) GROUP BY f""")
def agg_std_stats(c):
    from mediaguard import fixed
    from mediaguard.plans import text_branch as tb
    per = tb.text_features(c.tokens(), "doc_id")
    parts = ", ".join(f"'{n}', cast({n} AS double)" for n in fixed.TEXT_FEATURES)
    return (per.selectExpr(f"stack({len(fixed.TEXT_FEATURES)}, {parts}) AS (feature, v)").groupBy("feature")
            .agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v") + 1e-6).alias("sd")))


@query("agg_video", """SELECT video_id, round(c, 6) AS confidence, CASE WHEN c >= 0.6 THEN 'likely_ai' WHEN c <= 0.4 THEN 'likely_real' ELSE 'uncertain' END AS verdict,
      round(g, 6) AS s_general, round(f, 6) AS s_face, n_frames, n_ai, CASE WHEN c >= 0.6 THEN n_frames ELSE 0 END AS n_returned
    FROM (SELECT video_id, median(confidence) AS c, median(s_general) AS g, median(s_face) AS f, count(*) AS n_frames,
          count(*) FILTER (verdict = 'likely_ai') AS n_ai FROM frame_scores GROUP BY video_id)""")
def agg_video(c):
    from mediaguard.plans.video import aggregate
    return aggregate(c.frames()).select("video_id", r6("confidence").alias("confidence"), "verdict", r6("s_general").alias("s_general"),
                                        r6("s_face").alias("s_face"), "n_frames", "n_ai", "n_returned")


@query("agg_video_frames", """SELECT video_id, frame_id, confidence, verdict FROM frame_scores
    WHERE video_id IN (SELECT video_id FROM frames GROUP BY video_id HAVING median(confidence) >= 0.6)""")
def agg_video_frames(c):
    from mediaguard.plans.video import returned_frames
    return returned_frames(c.frames()).select("video_id", "frame_id", "confidence", scores.verdict3("confidence").alias("verdict"))


SHARED = """SELECT {by} g.generator, CASE WHEN count(*) FILTER (s.label = 0) > 0 THEN
      sum(CASE WHEN s.label = 0 THEN CASE WHEN g.{score} > s.{score} THEN 1.0 WHEN g.{score} = s.{score} THEN 0.5 ELSE 0 END END) / count(*) FILTER (s.label = 0) END AS auroc
    FROM {t} g JOIN {t} s ON s.label = 0 AND g.label = 1 {on} GROUP BY {by} g.generator"""


def shared_sql(table, by, score):
    return SHARED.format(t=table, score=score, by="".join(f"g.{b}, " for b in by), on="".join(f" AND g.{b} = s.{b}" for b in by))


CLEAN_OOD = "(SELECT * FROM shipped WHERE split IN ('test_ood', 'calib_ood') AND variant = 'clean')"


@query("agg_by_generator", f"""SELECT generator, round(auroc, 6) AS auroc, n, round(recall, 6) AS recall FROM ({shared_sql(CLEAN_OOD, [], 'pred')})
    JOIN (SELECT generator, count(*) AS n, avg((pred >= 0.5)::INT) AS recall FROM {CLEAN_OOD} WHERE label = 1 GROUP BY generator) USING (generator)""")
def agg_by_generator(c):
    rows = c.shipped("split IN ('test_ood', 'calib_ood')", variants=["clean"])
    rec = rows.where("label = 1").groupBy("generator").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("pred") >= 0.5).cast("int"))).alias("recall"))
    return mt.auroc_shared(rows, [], "generator", "pred").join(rec, "generator").select(
        "generator", r6("auroc").alias("auroc"), "n", "recall")


CONTENT_ROWS = "(SELECT * FROM shipped JOIN contents USING (image_id) WHERE starts_with(split, 'test'))"


@query("agg_by_content", f"""SELECT content, round(auroc, 6) AS auroc, n_pos, n_neg, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr
    FROM ({auc_sql(CONTENT_ROWS, ['content'], 'pred')}) JOIN ({confusion_sql(CONTENT_ROWS, ['content'])}) USING (content)""")
def agg_by_content(c):
    rows = evalset(c)
    return mt.auroc(rows, "content", "pred", cut=0.5).selectExpr(
        "content", "round(auroc, 6) AS auroc", "n_pos", "n_neg", "round(fpr, 6) AS fpr", "round(fnr, 6) AS fnr")


@query("agg_trained_vs_unseen", f"""SELECT CASE WHEN generator IN ('g6', 'g7') THEN 'trained' ELSE 'unseen' END AS exposure, count(*) AS n_generators,
    round(avg(auroc), 6) AS mean_auroc, round(min(auroc), 6) AS worst_auroc FROM ({shared_sql(CLEAN_OOD, [], 'pred')}) GROUP BY 1""")
def agg_trained_vs_unseen(c):
    per = mt.auroc_shared(c.shipped("split IN ('test_ood', 'calib_ood')", variants=["clean"]), [], "generator", "pred")
    return per.groupBy(F.when(F.col("generator").isin("g6", "g7"), "trained").otherwise("unseen").alias("exposure")).agg(
        F.count(F.lit(1)).alias("n_generators"), r6(F.avg("auroc")).alias("mean_auroc"), r6(F.min("auroc")).alias("worst_auroc"))


TWO = sig("greatest(general, 1.25 * tampered) - ln(0.8092 / 0.1908)")


@query("agg_rescue_break", f"""SELECT variant, count(*) FILTER (label = 1 AND two < 0.5 AND pred >= 0.5) AS rescued,
    count(*) FILTER (label = 0 AND two < 0.5 AND pred >= 0.5) AS broken FROM (SELECT *, {TWO} AS two FROM {EVAL}) GROUP BY variant""")
def agg_rescue_break(c):
    df = evalset(c).withColumn("two", scores.shipped("general", "tampered"))
    newly = (F.col("two") < 0.5) & (F.col("pred") >= 0.5)
    return df.groupBy("variant").agg(F.count_if(newly & (F.col("label") == 1)).alias("rescued"),
                                     F.count_if(newly & (F.col("label") == 0)).alias("broken"))


@query("agg_matched_fpr", f"""WITH t AS (SELECT quantile_cont(pred, 0.95) AS t FROM shipped WHERE split = 'test_ood' AND label = 0)
    SELECT source, round(max(t.t), 6) AS t, round(avg((pred >= t.t)::INT), 6) AS recall, count(*) AS n
    FROM shipped, t WHERE label = 1 AND starts_with(split, 'test') GROUP BY source""")
def agg_matched_fpr(c):
    from mediaguard.plans.reports import matched_cut
    rows = evalset(c)
    cut = matched_cut(rows.where("split = 'test_ood' AND label = 0"), "pred", 0.05)
    return rows.where("label = 1").groupBy("source").agg(
        r6(F.lit(cut)).alias("t"), r6(F.avg((F.col("pred") >= cut).cast("int"))).alias("recall"), F.count(F.lit(1)).alias("n"))


@query("agg_tpr_at_fpr", f"""SELECT source, round(coalesce(max(tpr) FILTER (fpr <= 0.01), 0), 6) AS tpr FROM (
    SELECT source, sum(p) OVER w / sum(p) OVER (PARTITION BY source)::DOUBLE AS tpr, sum(n) OVER w / sum(n) OVER (PARTITION BY source)::DOUBLE AS fpr FROM (
      SELECT source, pred, sum(label) AS p, sum(1 - label) AS n FROM shipped WHERE starts_with(split, 'test') GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY source ORDER BY pred DESC)) GROUP BY source""")
def agg_tpr_at_fpr(c):
    return mt.tpr_at_fpr(evalset(c), "source", "pred").select("source", r6("tpr").alias("tpr"))


@query("agg_prod_precision", f"""SELECT variant, round(0.01 * rec / nullif(0.01 * rec + 0.99 * fpr, 0), 6) AS precision_at_1pct, round(rec, 6) AS tpr, round(fpr, 6) AS fpr
    FROM ({confusion_sql(EVAL, ['variant'])})""")
def agg_prod_precision(c):
    return mt.confusion(evalset(c), "variant", "pred").selectExpr(
        "variant", "round(0.01D * rec / nullif(0.01D * rec + 0.99D * fpr, 0), 6) AS precision_at_1pct", "round(rec, 6) AS tpr", "round(fpr, 6) AS fpr")


@query("agg_branch_attribution", f"""SELECT source, count(*) AS flagged, round(avg((p_face IS NOT NULL AND p_face >= greatest(p_general, {sig('1.25 * tampered - ln(0.8092 / 0.1908)')}))::INT), 6) AS face_share,
    round(avg((1.25 * tampered > general AND coalesce(p_face, 0) < greatest(p_general, {sig('1.25 * tampered - ln(0.8092 / 0.1908)')}))::INT), 6) AS tampered_share
    FROM {EVAL} WHERE pred >= 0.5 GROUP BY source""")
def agg_branch_attribution(c):
    two = F.greatest("p_general", scores.shifted(1.25 * F.col("tampered")))
    face = F.coalesce("p_face", F.lit(0.0))
    df = evalset(c).where("pred >= 0.5")
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("flagged"), r6(F.avg((F.col("p_face").isNotNull() & (face >= two)).cast("int"))).alias("face_share"),
        r6(F.avg(((1.25 * F.col("tampered") > F.col("general")) & (face < two)).cast("int"))).alias("tampered_share"))


BANDS = """(SELECT *, CASE WHEN face_px <= (SELECT quantile_cont(face_px, 1.0 / 3) FROM shipped WHERE has_face) THEN 'small'
      WHEN face_px <= (SELECT quantile_cont(face_px, 2.0 / 3) FROM shipped WHERE has_face) THEN 'medium' ELSE 'large' END AS band FROM shipped WHERE has_face)"""


@query("agg_size_bands", f"""SELECT band, round(a.auroc, 6) AS auroc, round(a.auroc - b.auroc, 6) AS gain, a.n_pos, a.n_neg
    FROM ({auc_sql(BANDS, ['band'], 'pred')}) a JOIN ({auc_sql(BANDS, ['band'], 'general')}) b USING (band)""")
def agg_size_bands(c):
    rows = c.shipped().where("has_face")
    # widths are whole pixels, so the exact percentile keeps one counter per distinct width
    cut = rows.select(F.percentile("face_px", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q")).scalar()
    banded = rows.select("label", "pred", "general", "face_px", cut.alias("q")).withColumn(
        "band", F.expr("CASE WHEN face_px <= q[0] THEN 'small' WHEN face_px <= q[1] THEN 'medium' ELSE 'large' END"))
    a = mt.auroc(banded, "band", "pred")
    b = mt.auroc(banded, "band", "general", out="base").select("band", "base")
    return a.join(b, "band").selectExpr("band", "round(auroc, 6) AS auroc", "round(auroc - base, 6) AS gain", "n_pos", "n_neg")


OOD2 = "(SELECT * FROM shipped WHERE split IN ('test_ood', 'calib_ood') AND variant IN ('clean', 'blur20'))"


@query("agg_correlation", f"""SELECT round(corr(c, b - c), 6) AS r, count(*) AS n_generators FROM (
    SELECT generator, max(auroc) FILTER (variant = 'clean') AS c, max(auroc) FILTER (variant = 'blur20') AS b FROM ({shared_sql(OOD2, ['variant'], 'pred')}) GROUP BY generator)""")
def agg_correlation(c):
    rows = c.shipped("split IN ('test_ood', 'calib_ood')", variants=["clean", "blur20"])
    per = mt.auroc_shared(rows, ["variant"], "generator", "pred").groupBy("generator").pivot("variant", ["clean", "blur20"]).agg(F.max("auroc"))
    return per.agg(r6(F.corr("clean", F.col("blur20") - F.col("clean"))).alias("r"), F.count(F.lit(1)).alias("n_generators"))


@query("agg_fisher_ratio", f"""SELECT variant, round(pow(avg(general) FILTER (label = 1) - avg(general) FILTER (label = 0), 2)
    / (var_pop(general) FILTER (label = 1) + var_pop(general) FILTER (label = 0)), 6) AS fisher FROM {EVAL} GROUP BY variant""")
def agg_fisher_ratio(c):
    return evalset(c).groupBy("variant").agg(F.expr(
        "round(pow(avg(general) FILTER (WHERE label = 1) - avg(general) FILTER (WHERE label = 0), 2) / (var_pop(general) FILTER (WHERE label = 1) + var_pop(general) FILTER (WHERE label = 0)), 6)").alias("fisher"))


@query("agg_histogram", f"SELECT label, least(floor(pred * 45)::INT, 44) AS bin, count(*) AS n FROM {EVAL} GROUP BY 1, 2")
def agg_histogram(c):
    return mt.histogram(evalset(c), "label", "pred")


BASE_SET = ["clean", "jpeg30", "blur20", "resize025", "noise005"]
BASE_ROWS = """(SELECT source, generator, variant, label, d.detector, CASE d.detector WHEN 'general' THEN general WHEN 'tampered' THEN tampered ELSE pred END AS score
    FROM shipped CROSS JOIN (VALUES ('general'), ('tampered'), ('shipped')) AS d(detector)
    WHERE source IN ('ood_eval', 'organizer_val', 'web_holdout') AND variant IN ('clean', 'jpeg30', 'blur20', 'resize025', 'noise005'))"""


@query("agg_baseline_table", f"""SELECT source, detector, generator, {', '.join(f"round(max(auroc) FILTER (variant = '{v}'), 6) AS {v}" for v in BASE_SET)},
    round(avg(auroc), 6) AS mean, round(max(auroc) FILTER (variant = 'clean') - min(auroc), 6) AS drop_from_first
    FROM ({shared_sql(BASE_ROWS, ['source', 'detector', 'variant'], 'score')}) GROUP BY source, detector, generator""")
def agg_baseline_table(c):
    rows = c.shipped("source IN ('ood_eval', 'organizer_val', 'web_holdout')", variants=BASE_SET).selectExpr(
        "source", "generator", "variant", "label", "stack(3, 'general', general, 'tampered', tampered, 'shipped', pred) AS (detector, score)")
    per = mt.auroc_shared(rows, ["source", "detector", "variant"], "generator", "score")
    wide = per.groupBy("source", "detector", "generator").pivot("variant", BASE_SET).agg(F.max("auroc"))
    cells = [F.col(v) for v in BASE_SET]
    mean = sum(cells[1:], cells[0]) / len(cells)
    return wide.select("source", "detector", "generator", *[r6(v).alias(n) for v, n in zip(cells, BASE_SET)],
                       r6(mean).alias("mean"), r6(cells[0] - F.least(*cells)).alias("drop_from_first"))


@query("agg_shortcut_risk", """WITH tr AS (SELECT *, CASE WHEN ('0x' || substr(image_id, 1, 8))::BIGINT % 5 = 0 THEN 'png' ELSE 'jpg' END AS fmt FROM manifest WHERE split = 'train'),
    src AS (SELECT source, count(*) AS n, min(label) AS lo, max(label) AS hi FROM tr GROUP BY source),
    f AS (SELECT fmt, count(*) AS n, greatest(sum(label), sum(1 - label)) / count(*)::DOUBLE AS top FROM tr GROUP BY fmt)
    SELECT 'source' AS scope, source AS name, n, round(n / (SELECT sum(n) FROM src)::DOUBLE, 6) AS share, lo = hi AND n / (SELECT sum(n) FROM src)::DOUBLE > 0.3 AS risk FROM src
    UNION ALL SELECT 'format', fmt, n, round(top, 6), top >= 0.75 FROM f""")
def agg_shortcut_risk(c):
    from mediaguard.operators.governance import shortcut_risk
    rows = c.manifest().withColumn("fmt", F.expr("IF(cast(conv(substring(image_id, 1, 8), 16, 10) AS bigint) % 5 = 0, 'png', 'jpg')"))
    return shortcut_risk(rows, "fmt").withColumn("share", r6("share"))


POPS = f"""(SELECT CASE WHEN variant = 'clean' THEN 'clean' ELSE 'singles' END AS pop, variant AS name, label, {TWO} AS score FROM shipped WHERE split = 'test_ood'
    UNION ALL SELECT 'chains', first || '>' || second, label, score FROM chains)"""


def populations(c):
    """Clean, single-setting and chained scores of the unseen set in one long table."""
    one = c.shipped("split = 'test_ood'").select(
        F.expr("IF(variant = 'clean', 'clean', 'singles')").alias("pop"), F.col("variant").alias("name"), "label",
        scores.shipped("general", "tampered").alias("score"))
    two = c.chains().select(F.lit("chains").alias("pop"), F.concat("first", F.lit(">"), "second").alias("name"), "label", "score")
    return one.unionByName(two)


@query("agg_chain_report", f"""WITH pops AS {POPS},
    pooled AS (SELECT pop, auroc, acc, prec, rec, n_pos + n_neg AS n FROM ({auc_sql('pops', ['pop'], 'score')}) JOIN ({confusion_sql('pops', ['pop'], 'score')}) USING (pop)),
    worst AS (SELECT pop, arg_min(name, (round(auroc, 9), name)) AS worst_name, min(auroc) AS worst_auroc FROM ({auc_sql('pops', ['pop', 'name'], 'score')}) GROUP BY pop)
    SELECT pop, n, round(auroc, 6) AS auroc, round(acc, 6) AS acc, round(prec, 6) AS prec, round(rec, 6) AS rec, worst_name, round(worst_auroc, 6) AS worst_auroc,
           round(auroc - (SELECT auroc FROM pooled WHERE pop = 'clean'), 6) AS auroc_vs_clean FROM pooled JOIN worst USING (pop)""")
def agg_chain_report(c):
    rows = cut_lineage(populations(c))          # the score dump, written once and read for both reports
    pooled = mt.auroc(rows, "pop", "score", cut=0.5)
    each = mt.auroc(rows, ["pop", "name"], "score").groupBy("pop").agg(
        F.min_by("name", F.struct(F.round("auroc", 9), "name")).alias("worst_name"), F.min("auroc").alias("worst_auroc"))
    clean = F.max(F.when(F.col("pop") == "clean", F.col("auroc"))).over(W.partitionBy(F.lit(0)))
    return pooled.join(each, "pop").select(
        "pop", (F.col("n_pos") + F.col("n_neg")).alias("n"), r6("auroc").alias("auroc"), r6("acc").alias("acc"), r6("prec").alias("prec"),
        r6("rec").alias("rec"), "worst_name", r6("worst_auroc").alias("worst_auroc"), r6(F.col("auroc") - clean).alias("auroc_vs_clean"))


@query("agg_image_robustness", f"""SELECT image_id, round(clean, 6) AS clean, round(ws, 6) AS worst_single, round(wc, 6) AS worst_chain, worst_chain_name,
      round(mc, 6) AS mean_chain, round(hi - wc, 6) AS spread, below
    FROM (SELECT image_id, max({TWO}) FILTER (variant = 'clean') AS clean, min({TWO}) FILTER (variant <> 'clean') AS ws FROM shipped WHERE split = 'test_ood' GROUP BY image_id)
    JOIN (SELECT image_id, min(score) AS wc, arg_min(first || '>' || second, (round(score, 9), first || '>' || second)) AS worst_chain_name, avg(score) AS mc, max(score) AS hi,
          count(*) FILTER (score < 0.5) AS below FROM chains GROUP BY image_id) USING (image_id)""")
def agg_image_robustness(c):
    two = scores.shipped("general", "tampered")
    one = c.shipped("split = 'test_ood'").groupBy("image_id").agg(
        F.max(F.when(F.col("variant") == "clean", two)).alias("clean"), F.min(F.when(F.col("variant") != "clean", two)).alias("ws"))
    name = F.concat("first", F.lit(">"), "second")
    ch = c.chains().groupBy("image_id").agg(
        F.min("score").alias("wc"), F.min_by(name, F.struct(F.round("score", 9), name)).alias("worst_chain_name"),
        F.avg("score").alias("mc"), F.max("score").alias("hi"), F.count_if(F.col("score") < 0.5).alias("below"))
    return one.join(ch, "image_id").select(
        "image_id", r6("clean").alias("clean"), r6("ws").alias("worst_single"), r6("wc").alias("worst_chain"), "worst_chain_name",
        r6("mc").alias("mean_chain"), r6(F.col("hi") - F.col("wc")).alias("spread"), "below")


@query("agg_score_medians", """SELECT branch, round(real_med, 6) AS real_median, round(edit_med, 6) AS edited_median, round(edit_med - real_med, 6) AS shift FROM (
    SELECT branch, median(v) FILTER (label = 0) AS real_med, median(v) FILTER (subclass = 'tampered') AS edit_med FROM (
      SELECT unnest(['general', 'tampered']) AS branch, unnest([p_general, p_tampered]) AS v, label, subclass
      FROM shipped WHERE variant = 'clean') GROUP BY branch)""")
def agg_score_medians(c):
    rows = c.shipped(variants=["clean"]).selectExpr(
        "CASE WHEN label = 0 THEN 'real' WHEN subclass = 'tampered' THEN 'edit' END AS kind", "stack(2, 'general', p_general, 'tampered', p_tampered) AS (branch, v)")
    mid = mt.quantiles(rows.where("kind IS NOT NULL"), ["branch", "kind"], "v", {"m": 0.5})
    wide = mid.groupBy("branch").pivot("kind", ["real", "edit"]).agg(F.max("m"))
    return wide.select("branch", r6("real").alias("real_median"), r6("edit").alias("edited_median"), r6(F.col("edit") - F.col("real")).alias("shift"))


@query("agg_content_mix", """SELECT source, content, n, round(n / sum(n) OVER (PARTITION BY source)::DOUBLE, 6) AS share FROM (
    SELECT source, content, count(*) AS n FROM items JOIN contents USING (image_id) WHERE label = 1 GROUP BY 1, 2)""")
def agg_content_mix(c):
    from mediaguard.operators import vector_jobs as vj
    rows = vj.classify(c.items("label = 1").select("source", "x"), c.models())
    n = rows.groupBy("source", "content").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", "content", "n", r6(F.col("n") / F.sum("n").over(W.partitionBy("source"))).alias("share"))


OOD_ALL = "(SELECT * FROM shipped WHERE split IN ('test_ood', 'calib_ood'))"


@query("agg_era_means", f"""SELECT era, variant, round(avg(auroc), 6) AS mean_auroc, count(*) AS n_generators FROM (
    SELECT *, CASE WHEN generator IN ('g5', 'g6') THEN 'early' WHEN generator = 'g7' THEN 'middle' ELSE 'late' END AS era
    FROM ({shared_sql(OOD_ALL, ['variant'], 'pred')})) GROUP BY era, variant""")
def agg_era_means(c):
    rows = c.shipped("split IN ('test_ood', 'calib_ood')")
    era = F.when(F.col("generator").isin("g5", "g6"), "early").when(F.col("generator") == "g7", "middle").otherwise("late")
    return mt.auroc_shared(rows, ["variant"], "generator", "pred").groupBy(era.alias("era"), "variant").agg(
        r6(F.avg("auroc")).alias("mean_auroc"), F.count(F.lit(1)).alias("n_generators"))


POISSON = "(" + " + ".join(f"(u >= {t})::INT" for t in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)) + ")"


@query("agg_bootstrap_ci", f"""WITH reps AS (SELECT label, branch, s, rep, {POISSON} AS w FROM (
      SELECT label, branch, s, rep, ('0x' || substr(md5(image_id || ':' || rep::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM (
        SELECT image_id, label, unnest(['pred', 'general']) AS branch, unnest([pred, p_general]) AS s FROM {EVAL} WHERE variant = 'clean')
      CROSS JOIN (SELECT unnest(range(0, 40)) AS rep))),
    cnt AS (SELECT rep, branch, s, sum(w * label)::DOUBLE AS p, sum(w * (1 - label))::DOUBLE AS n FROM reps GROUP BY 1, 2, 3),
    aucs AS (SELECT rep, branch, sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS auroc FROM (
      SELECT *, coalesce(sum(n) OVER (PARTITION BY rep, branch ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM cnt) GROUP BY 1, 2)
    SELECT round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.5), 6) AS mid, round(quantile_cont(d, 0.975), 6) AS hi, count(*) AS replicates FROM (
      SELECT a.rep, a.auroc - b.auroc AS d FROM aucs a JOIN aucs b ON a.rep = b.rep AND a.branch = 'pred' AND b.branch = 'general')""")
def agg_bootstrap_ci(c):
    from mediaguard.plans.reports import bootstrap_difference
    rows = evalset(c, ["clean"]).select("image_id", "label", F.col("pred").alias("a"), F.col("p_general").alias("b"))
    return bootstrap_difference(rows, replicates=40)


@query("agg_source_facts", """SELECT source, count(DISTINCT image_id) FILTER (variant = 'clean') AS images, count(*) AS n_rows, count(*) FILTER (variant = 'clean' AND label = 1) AS ai,
    count(*) FILTER (variant = 'clean' AND label = 0) AS reals, count(DISTINCT variant) AS variants, count(DISTINCT image_id) FILTER (variant = 'clean') * 131 AS raw_bytes FROM manifest GROUP BY source""")
def agg_source_facts(c):
    """Rows from the manifest, raw bytes from the sizes of the image files in the listing."""
    from mediaguard.sources import listing, scratch
    from mediaguard.sources.images import write_files
    rows = cut_lineage(c.manifest().select("image_id", "source", "variant", "label"))
    per = rows.groupBy("source", "variant").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("ai"))
    clean = F.col("variant") == "clean"
    facts = per.groupBy("source").agg(
        F.sum(F.when(clean, F.col("n")).otherwise(0)).alias("images"), F.sum("n").alias("n_rows"),
        F.sum(F.when(clean, F.col("ai")).otherwise(0)).alias("ai"),
        F.sum(F.when(clean, F.col("n") - F.col("ai")).otherwise(0)).alias("reals"), F.count(F.lit(1)).alias("variants"))
    # the files hold 64 pixels in hexadecimal with a dot between source and content, and the writer's line feed
    u8 = "transform(x, e -> lpad(hex(cast(greatest(least(rint((e + 0.5D) * 255), 255), 0) AS int)), 2, '0'))"
    pixels = c.items().selectExpr("image_id", f"concat('..', array_join({u8}, '')) AS content")
    folder = scratch.folder(c.spark, "raw")
    write_files(rows.where(clean).select("image_id", "source").join(pixels, "image_id").select(F.concat("source", F.lit("."), "image_id").alias("name"), "content"), folder)
    files = listing.stored(c.spark, folder).select(F.element_at(F.split("name", "[.]"), 1).alias("source"), F.col("length").alias("file_size"))
    return facts.join(files.groupBy("source").agg(F.sum("file_size").alias("raw_bytes")), "source", "left")


@query("agg_model_size", """SELECT CASE code WHEN 1 THEN 'general' ELSE 'tampered' END AS branch, len(w) + 1 AS stored_numbers, (SELECT sum(len(w) + 1)::BIGINT FROM probes) AS total FROM probes""")
def agg_model_size(c):
    t = c.model_rows()
    size = F.size("w") + 1 + F.size("stats")
    return t.select("branch", size.cast("long").alias("stored_numbers"), F.sum(size).over(W.partitionBy(F.lit(0))).alias("total"))


@query("agg_anomaly_flag", f"""SELECT g.branch, g.variant, g.auroc > k.auroc AS rises, round(g.auroc - k.auroc, 6) AS delta FROM {GRID_LONG} g
    JOIN (SELECT branch, auroc FROM {GRID_LONG} WHERE variant = 'clean') k USING (branch) WHERE g.variant <> 'clean'""")
def agg_anomaly_flag(c):
    g = grid_long(c)
    clean = F.max(F.when(F.col("variant") == "clean", F.col("auroc"))).over(W.partitionBy("branch"))
    return g.withColumn("k", clean).where("variant <> 'clean'").select(
        "branch", "variant", (F.col("auroc") > F.col("k")).alias("rises"), r6(F.col("auroc") - F.col("k")).alias("delta"))
