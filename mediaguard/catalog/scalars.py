"""Projections, scalar functions and predicates."""
from __future__ import annotations

from pyspark.sql import functions as F

from mediaguard import fixed
from mediaguard.catalog.base import dot_sql, hit_sql, kind_sql, norm_sql, query, sig
from mediaguard.functions import geometry as geo, ids, labels, provenance as pv, scores, text as tx, vectors as vx, video
from mediaguard.operators import vector_jobs as vj

r6 = lambda c: F.round(c, 6)
CLEAN = "(SELECT * FROM shipped WHERE variant = 'clean')"


def clean(c, where=None):
    return c.shipped(where, variants=["clean"])


@query("fn_content_id", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_id FROM documents")
def fn_content_id(c):
    return c.table("documents").select("doc_id", ids.content_id(F.col("text")).alias("content_id"))


@query("fn_variant_name", "SELECT variant, count(*) AS n_images FROM items CROSS JOIN settings WHERE idx > 0 GROUP BY variant")
def fn_variant_name(c):
    pairs = F.expr("array(" + ", ".join(f"named_struct('kind', '{k}', 'param', '{p}')" for k, p in fixed.GRID) + ")")
    return (c.items().select(F.explode(pairs).alias("s"))
            .groupBy(ids.variant_name(F.col("s.kind"), F.col("s.param")).alias("variant")).agg(F.count(F.lit(1)).alias("n_images")))


@query("fn_seed", "SELECT image_id, h8 AS seed FROM items")
def fn_seed(c):
    return c.items().select("image_id", ids.seed("image_id").alias("seed"))


@query("fn_half", """SELECT image_id, CASE WHEN h8 % 2 = 0 THEN 'a' ELSE 'b' END AS half_0, CASE WHEN h8b % 2 = 0 THEN 'a' ELSE 'b' END AS half_1 FROM items""")
def fn_half(c):
    return c.items().select("image_id", ids.half("image_id", 0).alias("half_0"), ids.half("image_id", 1).alias("half_1"))


@query("fn_hash_mod", "SELECT image_id, h8 % 3 = 0 AS kept FROM items")
def fn_hash_mod(c):
    return c.items().select("image_id", ids.one_in("image_id", 3).alias("kept"))


CODES_SQL = """(SELECT image_id, CASE vec_id % 3 WHEN 0 THEN code::VARCHAR WHEN 1 THEN ' ' || code || ' '
    ELSE ['REAL', 'FULL_SYNTHETIC', 'TAMPERED'][code + 1] END AS raw FROM items)"""


def codes(c):
    """Class codes as three corpora spell them: digits, padded digits, names."""
    return c.items().selectExpr("image_id", """CASE vec_id % 3 WHEN 0 THEN cast(code AS string) WHEN 1 THEN concat(' ', code, ' ')
        ELSE element_at(array('REAL', 'FULL_SYNTHETIC', 'TAMPERED'), code + 1) END AS raw""")


@query("fn_to_label", f"""SELECT image_id, CASE WHEN trim(raw) IN ('0', 'REAL') THEN 0 WHEN trim(raw) IN ('1', 'FULL_SYNTHETIC') THEN 1 END AS label,
    CASE WHEN trim(raw) IN ('2', 'TAMPERED') THEN 1 END AS label_tampered_only FROM {CODES_SQL}""")
def fn_to_label(c):
    return codes(c).select("image_id", labels.to_label("raw").alias("label"),
                           labels.to_label("raw", tampered_only=True).alias("label_tampered_only"))


@query("fn_subclass", f"""SELECT image_id, CASE trim(raw) WHEN '0' THEN 'real' WHEN '1' THEN 'full_synthetic' WHEN '2' THEN 'tampered' ELSE lower(raw) END AS subclass FROM {CODES_SQL}""")
def fn_subclass(c):
    return codes(c).select("image_id", labels.subclass("raw").alias("subclass"))


@query("fn_logit_score", f"""SELECT image_id, round(12 * ({dot_sql('x', '(SELECT w FROM probes WHERE code = 1)')} + (SELECT b FROM probes WHERE code = 1)), 6) AS general,
    round(12 * ({dot_sql('x', '(SELECT w FROM probes WHERE code = 2)')} + (SELECT b FROM probes WHERE code = 2)), 6) AS tampered FROM items""")
def fn_logit_score(c):
    df = vj.score_grid(c.items().select("image_id", "h8", "x"), c.models(), vj.SETTINGS[:1])
    return df.select("image_id", r6("general").alias("general"), r6("tampered").alias("tampered"))


@query("fn_sigmoid", f"SELECT event_id, round({sig('(value - 50) / 10')}, 6) AS p FROM events")
def fn_sigmoid(c):
    return c.table("events").select("event_id", r6(scores.sigmoid((F.col("value") - 50) / 10)).alias("p"))


@query("fn_logit", """SELECT frame_id, round(ln(p / (1 - p)), 6) AS z FROM (SELECT frame_id, greatest(least(raw, 1 - 1e-6), 1e-6) AS p FROM frames)""")
def fn_logit(c):
    return c.frames().select("frame_id", r6(scores.logit("raw")).alias("z"))


@query("fn_platt", f"SELECT event_id, round({sig('0.07 * value - 3.2')}, 6) AS p FROM events")
def fn_platt(c):
    return c.table("events").select("event_id", r6(scores.platt("value", 0.07, -3.2)).alias("p"))


@query("fn_shift", f"SELECT image_id, round({sig('general - ln(0.8092 / 0.1908)')}, 6) AS p FROM {CLEAN}")
def fn_shift(c):
    return clean(c).select("image_id", r6(scores.shifted("general")).alias("p"))


@query("fn_verdict2", "SELECT image_id, variant, CASE WHEN pred >= 0.5 THEN 'AI' ELSE 'real' END AS verdict FROM shipped")
def fn_verdict2(c):
    return c.shipped().select("image_id", "variant", scores.verdict2("pred").alias("verdict"))


@query("fn_verdict3", "SELECT frame_id, verdict FROM frame_scores")
def fn_verdict3(c):
    return c.frames().select("frame_id", scores.verdict3("confidence").alias("verdict"))


REL = """(SELECT *, 0.6 * 2 * abs(pred - 0.5) + 0.4 * CASE WHEN face IS NULL THEN 1.0 ELSE 1 - abs(1 / (1 + exp(-general)) - 1 / (1 + exp(-face))) END AS rel
    FROM shipped WHERE variant = 'clean')"""


@query("fn_reliability", f"""SELECT image_id, round(rel, 6) AS score, CASE WHEN rel > 0.66 THEN 'high' WHEN rel > 0.40 THEN 'medium' ELSE 'low' END AS reliability FROM {REL}""")
def fn_reliability(c):
    df = clean(c).select("image_id", "pred", scores.sigmoid("general").alias("g"), scores.sigmoid("face").alias("f"))
    return df.select("image_id", r6(scores.reliability_score("pred", "g", "f")).alias("score"), scores.reliability("pred", "g", "f").alias("reliability"))


EXPLAIN = """CASE verdict
  WHEN 'likely_ai' THEN 'The ' || CASE WHEN g >= t AND g >= coalesce(f, -1) THEN 'general synthesis probe' WHEN t >= coalesce(f, -1) THEN 'localized-edit probe' ELSE 'face probe' END
       || ' carried the strongest signal (' || round_even(greatest(g, t, coalesce(f, -1)) * 100, 0)::INT || '%) on this ' || content || ' image.'
  WHEN 'likely_real' THEN 'No branch found strong artifacts; the ' || CASE WHEN g <= t AND g <= coalesce(f, 2) THEN 'general synthesis probe' WHEN t <= coalesce(f, 2) THEN 'localized-edit probe' ELSE 'face probe' END
       || ' was most confident this is authentic (' || round_even((1 - least(g, t, coalesce(f, 2))) * 100, 0)::INT || '%).'
  ELSE 'Branches landed close to the decision boundary on this ' || content || ' image -- treat this as low-confidence.' END"""
REPORT_BASE = """(SELECT image_id, content, has_face, face_px, pred, general, face, CASE WHEN pred >= 0.6 THEN 'likely_ai' WHEN pred <= 0.4 THEN 'likely_real' ELSE 'uncertain' END AS verdict,
    1 / (1 + exp(-general)) AS g, 1 / (1 + exp(-(1.1 * tampered - 0.2))) AS t, 1 / (1 + exp(-(0.9 * face + 0.1))) AS f, 1 / (1 + exp(-0.5 * spectral)) AS s
    FROM shipped JOIN contents USING (image_id) WHERE variant = 'clean')"""


@query("fn_explain", f"SELECT image_id, verdict, {EXPLAIN} AS explanation FROM {REPORT_BASE}")
def fn_explain(c):
    from mediaguard.plans.scoring import image_report
    return image_report(clean(c)).select("image_id", "report.verdict", "report.explanation")


@query("rec_image_report", f"""SELECT image_id, verdict, round_even(pred, 4) AS confidence, round_even(g, 4) AS general, round_even(f, 4) AS face, round_even(t, 4) AS tampered,
    round_even(s, 4) AS regularity, content AS content_type, {EXPLAIN} AS explanation,
    CASE WHEN rel > 0.66 THEN 'high' WHEN rel > 0.40 THEN 'medium' ELSE 'low' END AS reliability, has_face::INT AS n_regions,
    CASE WHEN has_face THEN CASE WHEN f >= 0.6 THEN 'likely_ai' WHEN f <= 0.4 THEN 'likely_real' ELSE 'uncertain' END END AS region_verdict
    FROM (SELECT *, 1.2 * abs(pred - 0.5) + 0.4 * CASE WHEN f IS NULL THEN 1.0 ELSE 1 - abs(g - f) END AS rel FROM {REPORT_BASE})""")
def rec_image_report(c):
    from mediaguard.plans.scoring import image_report
    r = image_report(clean(c))
    return r.selectExpr("image_id", "report.verdict", "report.confidence", "report.signals.general", "report.signals.face", "report.signals.tampered",
                        "report.signals.regularity", "report.content_type", "report.explanation", "report.reliability",
                        "size(report.regions) AS n_regions", "get(report.regions, 0).verdict AS region_verdict")


@query("fn_px_feature", "SELECT image_id, round((log2(greatest(face_px, 1)) - 8.2) / 0.75, 6) AS z FROM branches WHERE has_face AND variant = 'clean'")
def fn_px_feature(c):
    return clean(c).where("has_face").select("image_id", r6(scores.px_feature("face_px", 8.2, 0.75)).alias("z"))


@query("fn_l2norm", f"SELECT vec_id, round({norm_sql('x')}, 6) AS before, round(x[1] / {norm_sql('x')}, 6) AS first, round(x[64] / {norm_sql('x')}, 6) AS last FROM (SELECT vec_id, list_transform(x, lambda e: e * 3 + 0.01) AS x FROM items)")
def fn_l2norm(c):
    v = c.items().select("vec_id", F.transform("x", lambda e: e * 3 + 0.01).alias("x"))
    return v.select("vec_id", r6(vx.norm("x")).alias("before"), vx.l2norm("x").alias("u")).select(
        "vec_id", "before", r6(F.col("u")[0]).alias("first"), r6(F.col("u")[63]).alias("last"))


@query("fn_cosine", f"SELECT vec_id, round({dot_sql('x', 'y')} / ({norm_sql('x')} * {norm_sql('y')}), 6) AS cosine FROM (SELECT vec_id, x, list_reverse(x) AS y FROM items)")
def fn_cosine(c):
    return c.items().select("vec_id", r6(vx.cosine(F.col("x"), F.reverse("x"))).alias("cosine"))


CLIPPED = r"(SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)"


@query("fn_clip_text", f"SELECT doc_id, CASE WHEN length(t) <= 400 THEN t ELSE substr(t, 1, 399) || '…' END AS clipped FROM {CLIPPED}")
def fn_clip_text(c):
    return c.texts("documents").select("doc_id", tx.clip_text("text").alias("clipped"))


@query("fn_marker_kind", f"SELECT doc_id, {kind_sql('text')} AS kind, {hit_sql('text')} AS marker FROM documents")
def fn_marker_kind(c):
    return c.texts("documents").select("doc_id", pv.marker("text").alias("m")).select("doc_id", "m.kind", "m.marker")


PNG_KEYS = "['parameters', 'Software', 'Prompt', 'Comment', 'workflow', 'Title', 'dream']"


@query("fn_png_key", f"""SELECT page_id, k AS key, CASE WHEN lower(k) IN ('parameters', 'prompt', 'workflow', 'dream') THEN 'ai' ELSE {kind_sql('url')} END AS kind
    FROM (SELECT page_id, url, {PNG_KEYS}[page_id % 7 + 1] AS k FROM pages)""")
def fn_png_key(c):
    df = c.table("pages").selectExpr("page_id", "url", f"element_at(array({PNG_KEYS[1:-1]}), cast(page_id % 7 + 1 AS int)) AS key")
    return df.select("page_id", "key", pv.png_kind("key", "url").alias("kind"))


FIELDS = """(SELECT page_id, list(DISTINCT kind) FILTER (kind IS NOT NULL) AS kinds, count(*) AS n_fields, bool_or(key = 'html' AND contains(value, 'c2pa')) AS c2pa,
    bool_or(kind = 'ai' AND contains(lower(value), 'trainedalgorithmicmedia')) AS iptc,
    string_agg(key, '; ' ORDER BY ord) FILTER (kind = 'ai') AS ai_keys FROM prov_fields GROUP BY page_id)"""
VERDICT = """CASE WHEN list_contains(coalesce(kinds, []), 'ai') THEN 'ai_declared' WHEN c2pa THEN 'c2pa_present' WHEN list_contains(coalesce(kinds, []), 'camera') THEN 'camera_declared'
    WHEN list_contains(coalesce(kinds, []), 'editor') THEN 'editor_declared' WHEN n_fields > 0 THEN 'metadata_only' ELSE 'none' END"""


@query("fn_prov_verdict", f"SELECT page_id, {VERDICT} AS verdict, n_fields, iptc FROM {FIELDS}")
def fn_prov_verdict(c):
    from mediaguard.plans.metadata import file_verdicts
    f = c.prov_fields().withColumn("kind", pv.marker_kind("value")).withColumn("is_c2pa", F.expr("key = 'html' AND contains(value, 'c2pa')"))
    return file_verdicts(f, ["page_id"], "is_c2pa").select("page_id", "verdict", "n_fields", "iptc")


@query("fn_token_plausible", r"""SELECT doc_id, round(avg((length(trim(token)) >= 2 AND regexp_full_match(token, '[\p{L}\p{N}\s]+'))::INT), 6) AS plausibility FROM tokens GROUP BY doc_id""")
def fn_token_plausible(c):
    return c.tokens().groupBy("doc_id").agg(r6(F.avg(tx.token_is_plausible("token").cast("int"))).alias("plausibility"))


@query("fn_frac_nonascii", r"SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / length(text)::DOUBLE ELSE 0 END, 6) AS frac FROM documents")
def fn_frac_nonascii(c):
    return c.texts("documents").select("doc_id", r6(tx.frac_nonascii("text")).alias("frac"))


@query("fn_glyph_consistency", """SELECT doc_id, round(CASE WHEN count(*) < 2 OR avg(ar) <= 1e-6 THEN 1 ELSE 1 / (1 + stddev_pop(ar) / avg(ar)) END, 6) AS consistency
    FROM (SELECT doc_id, w / greatest(length(token), 1) / h AS ar FROM tokens WHERE h > 1e-3) GROUP BY doc_id""")
def fn_glyph_consistency(c):
    df = c.tokens().where("h > 1e-3").withColumn("ar", F.col("w") / F.greatest(F.length("token"), F.lit(1)) / F.col("h"))
    m = F.avg("ar")
    return df.groupBy("doc_id").agg(r6(F.when((F.count(F.lit(1)) < 2) | (m <= 1e-6), 1.0).otherwise(
        1.0 / (1.0 + F.stddev_pop("ar") / m))).alias("consistency"))


@query("fn_quad_geometry", """SELECT doc_id, round(w * h, 6) AS area, round(sqrt(w * w + tilt * tilt), 6) AS width, round(h, 6) AS height,
    CASE WHEN h >= 8 AND sqrt(w * w + tilt * tilt) >= 8 THEN greatest(least(round_even(224 * sqrt(w * w + tilt * tilt) / h, 0), 672), 56)::INT END AS strip FROM quads""")
def fn_quad_geometry(c):
    df = c.quads().select("doc_id", geo.order_quad(F.col("q")).alias("q"))
    w, h = geo.quad_size(F.col("q"))
    sized = df.select("doc_id", geo.quad_area(F.col("q")).alias("area"), w.alias("width"), h.alias("height"))
    return sized.select("doc_id", r6("area").alias("area"), r6("width").alias("width"), r6("height").alias("height"),
                        geo.strip_width(F.col("width"), F.col("height")).alias("strip"))


@query("fn_bbox_from_quad", """SELECT doc_id, round_even(x0, 0)::INT AS x, round_even(y0, 0)::INT AS y, round_even(w, 0)::INT AS width, round_even(h + tilt, 0)::INT AS height FROM quads""")
def fn_bbox_from_quad(c):
    return c.quads().select("doc_id", geo.bbox(F.col("q")).alias("b")).select("doc_id", "b.x", "b.y", "b.width", "b.height")


@query("fn_tile_offsets", """SELECT doc_id, CASE WHEN n = 1 THEN 0 ELSE round_even(i * (wd - 224) / (n - 1)::DOUBLE, 0)::INT END AS left_edge FROM (
    SELECT doc_id, wd, n, unnest(range(0, n)) AS i FROM (SELECT doc_id, wd, CASE WHEN wd <= 224 THEN 1 ELSE least(3, greatest(1, round_even(wd / 224.0::DOUBLE, 0)::INT)) END AS n
      FROM (SELECT doc_id, (5 + n_chars % 700)::INT AS wd FROM documents)))""")
def fn_tile_offsets(c):
    df = c.table("documents").selectExpr("doc_id", "cast(5 + n_chars % 700 AS int) AS wd")
    return df.select("doc_id", F.explode(geo.tile_offsets(F.col("wd"))).alias("left_edge"))


RATE = "CASE WHEN frame_count / fps <= 60 THEN 1 WHEN frame_count / fps <= 120 THEN 2 WHEN frame_count / fps <= 300 THEN 3 ELSE 4 END"


@query("fn_sampling_rate", f"SELECT video_id, {RATE} AS rate FROM clips")
def fn_sampling_rate(c):
    return c.clips().select("video_id", video.sampling_rate(F.col("frame_count") / F.col("fps")).alias("rate"))


@query("fn_frame_indices", f"""SELECT video_id, count(DISTINCT k) AS n, sum(DISTINCT k)::BIGINT AS total, max(k) AS last FROM (
    SELECT video_id, least(round_even(i * (1.0::DOUBLE / r) * fps, 0)::BIGINT, frame_count - 1) AS k FROM (
      SELECT video_id, fps, frame_count, r, unnest(range(0, greatest(ceil(frame_count / fps * r)::BIGINT, 1))) AS i FROM (SELECT *, {RATE} AS r FROM clips))) GROUP BY video_id""")
def fn_frame_indices(c):
    df = c.clips().withColumn("r", video.sampling_rate(F.col("frame_count") / F.col("fps")))
    df = df.select("video_id", video.frame_indices(F.col("frame_count"), F.col("fps"), F.col("r")).alias("k"))
    return df.select("video_id", F.size("k").cast("long").alias("n"), F.aggregate("k", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"),
                     F.element_at("k", -1).alias("last"))


@query("fn_nonzero_guard", "SELECT image_id, h8 % 10 <> 0 AND len(list_filter(x, lambda e: e <> 0)) > 0 AS measured FROM items")
def fn_nonzero_guard(c):
    v = c.items().select("image_id", F.when(F.col("h8") % 10 == 0, F.transform("x", lambda e: e * 0)).otherwise(F.col("x")).alias("x"))
    return v.select("image_id", vx.measured("x").isNotNull().alias("measured"))


@query("flt_held_out", "SELECT source, split, count(*) AS n FROM manifest WHERE split <> 'calib_ood' GROUP BY 1, 2")
def flt_held_out(c):
    return c.manifest().where(F.col("split") != "calib_ood").groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


@query("flt_keep_variants", "SELECT source, variant, count(*) AS n FROM manifest WHERE variant IN ('clean', 'jpeg50', 'blur10', 'noise005') GROUP BY 1, 2")
def flt_keep_variants(c):
    return c.manifest().where(F.col("variant").isin(fixed.KEPT_VARIANTS)).groupBy("source", "variant").agg(F.count(F.lit(1)).alias("n"))


@query("flt_min_face", "SELECT source, count(*) AS n, min(least(fw, fh)) AS least_side FROM faces WHERE least(fw, fh) >= 64 GROUP BY source")
def flt_min_face(c):
    return c.faces().where(F.least("fw", "fh") >= fixed.MIN_FACE_PX).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.least("fw", "fh")).alias("least_side"))


@query("flt_quarantine", """SELECT page_id, contains(url, 'casino') OR regexp_matches(url, '^https?://(www\\.|m\\.|blog\\.)?(free-bets|cheap-pills)') AS refused FROM pages""")
def flt_quarantine(c):
    from mediaguard.sources.listing import refused
    return c.table("pages").select("page_id", refused(
        F.regexp_replace("url", r"^https?://(www\.|m\.|blog\.)?", ""), "casino", ["free-bets", "cheap-pills"]).alias("refused"))


@query("flt_tampered_holdout", """SELECT image_id, CASE WHEN h8b % 2 = 0 THEN 'calibrate' ELSE 'combine' END AS part FROM items WHERE code = 2 AND h8 % 2 = 1""")
def flt_tampered_holdout(c):
    held = c.items("code = 2").where(ids.half("image_id", 0) == "b")
    return held.select("image_id", F.when(ids.half("image_id", 1) == "a", "calibrate").otherwise("combine").alias("part"))
