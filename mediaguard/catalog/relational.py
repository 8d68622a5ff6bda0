"""Joins, windows, top-k, sampling, set operations and governance."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from mediaguard import fixed
from mediaguard.catalog.aggregations import EVAL, TWO, branch_rows, evalset, grid_long, populations, GRID_LONG, POPS
from mediaguard.catalog.base import auc_sql, dot_sql, query
from mediaguard.functions import ids, scores
from mediaguard.sources.buckets import bucketed
from mediaguard.operators.lineage import cut_lineage
from mediaguard.operators import governance as gov, joins, metrics as mt, near_dup, sampling as sm, vector_jobs as vj

r6 = lambda c: F.round(c, 6)

# ---------------------------------------------------------------- joins


@query("join_branch_left", """SELECT image_id, variant, round(general, 6) AS general, round(spectral, 6) AS spectral, round(face, 6) AS face FROM branches""")
def join_branch_left(c):
    """The images are scored once; the sides are read from one bucketed table, and nothing is shuffled between scan and join."""
    rows = bucketed(c.branches().select("image_id", "variant", "general", "spectral", "has_face", "face"), "branches", ["image_id", "variant"])
    spec = rows.where("spectral IS NOT NULL").select("image_id", "variant", "spectral").hint("merge")
    face = rows.where("has_face").select("image_id", "variant", "face").hint("merge")
    return joins.branches_left(rows.select("image_id", "variant", "general"), spec, face).select(
        "image_id", "variant", r6("general").alias("general"), r6("spectral").alias("spectral"), r6("face").alias("face"))


OWNER = "(SELECT image_id, min({'source': source, 'split': split}) AS o FROM manifest GROUP BY image_id)"


@query("join_manifest_owner", f"""SELECT source, split, count(*) AS n, count(DISTINCT image_id) AS images FROM (
    SELECT r.image_id, r.source, coalesce(w.o.split, r.split) AS split FROM raw_rows r LEFT JOIN {OWNER} w USING (image_id)
    WHERE NOT contains(r.source, 'smoke') AND (w.image_id IS NULL OR w.o.source = r.source)) GROUP BY 1, 2""")
def join_manifest_owner(c):
    return joins.manifest_owner(c.manifest_input(), c.manifest()).groupBy("source", "split").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("image_id").alias("images"))


@query("join_inner_eval", """SELECT doc_id, round(s.pred, 6) AS shipped, k.content, round(t.p, 6) AS text_score, s.label
    FROM (SELECT doc_id, avg(conf) AS p FROM tokens GROUP BY doc_id) t JOIN shipped s ON s.vec_id = t.doc_id AND s.variant = 'clean' JOIN contents k USING (image_id)""")
def join_inner_eval(c):
    text = c.tokens().groupBy("doc_id").agg(F.avg("conf").alias("p"))
    img = c.shipped(variants=["clean"]).select(F.col("vec_id").alias("doc_id"), "pred", "content", "label")
    return text.join(img, "doc_id").select("doc_id", r6("pred").alias("shipped"), "content", r6("p").alias("text_score"), "label")


@query("join_label_lookup", "SELECT d.doc_id, l.quality, l.toxic, d.n_chars FROM documents d JOIN labels l USING (doc_id) WHERE d.n_chars > 0")
def join_label_lookup(c):
    return c.table("documents").select("doc_id", "n_chars").where("n_chars > 0").join(c.table("labels"), "doc_id").select(
        "doc_id", "quality", "toxic", "n_chars")


GRP = "CASE WHEN source IN ('ood_eval', 'organizer_val') THEN 'unseen' WHEN source IN ('web_holdout', 'edited_eval') THEN 'mixed' ELSE 'train' END"


@query("join_face_zero_fill", f"""SELECT grp, source, round(sum(CASE WHEN ok THEN coalesce(f, 0) ELSE 0 END), 4) AS total, count(*) AS n, count(*) FILTER (ok AND f IS NOT NULL) AS with_face FROM (
    SELECT *, {GRP} AS grp, CASE WHEN has_face AND source <> 'web_holdout' THEN p_face END AS f,
           bool_and(EXISTS (SELECT 1 FROM shipped q WHERE q.source = shipped.source AND q.has_face AND q.source <> 'web_holdout')) OVER (PARTITION BY {GRP}) AS ok FROM shipped) GROUP BY 1, 2""")
def join_face_zero_fill(c):
    rows = c.shipped().withColumn("grp", F.expr(GRP))
    faces = rows.where("has_face AND source <> 'web_holdout'").select("image_id", "variant", "source", F.col("p_face").alias("face"))
    out = joins.face_zero_fill(rows.select("image_id", "variant", "source", "grp"), faces, "grp")
    return out.groupBy("grp", "source").agg(F.round(F.sum("face"), 4).alias("total"), F.count(F.lit(1)).alias("n"),
                                            F.count_if(F.col("face") > 0).alias("with_face"))


@query("join_semi_split", "SELECT image_id, label, source FROM items WHERE image_id IN (SELECT image_id FROM manifest WHERE split = 'test_ood')")
def join_semi_split(c):
    keep = c.manifest().where("split = 'test_ood'").select("image_id")
    return c.items().select("image_id", "label", "source").join(keep, "image_id", "left_semi")


@query("join_anti_done", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_anti_done(c):
    return c.table("documents").select("doc_id", "source").join(c.table("labels").select("doc_id"), "doc_id", "left_anti")


@query("join_cross_grid", f"SELECT image_id, idx, variant, round(sqrt({dot_sql('x', 'x')}), 6) AS norm, round(x[1], 6) AS first, round(x[64], 6) AS last FROM grid")
def join_cross_grid(c):
    from mediaguard.functions import vectors as vx
    g = vj.score_grid(c.items().select("image_id", "h8", "x"), vj.Models(), keep_x=True)
    return g.select("image_id", "idx", "variant", r6(vx.norm("x")).alias("norm"), r6(F.col("x")[0]).alias("first"), r6(F.col("x")[63]).alias("last"))


@query("join_cross_chain", """SELECT f.variant AS first, s.variant AS second, 100 + 14 * (f.idx - 1) + s.idx - 1 AS stage_seed, count(*) AS n_images
    FROM items i CROSS JOIN settings f CROSS JOIN settings s WHERE f.idx > 0 AND s.idx > 0 GROUP BY 1, 2, 3""")
def join_cross_chain(c):
    return joins.expand_chains(c.items().select("image_id")).groupBy("first", "second", "stage_seed").agg(F.count(F.lit(1)).alias("n_images"))


BORROW = "(SELECT variant, label, tampered AS score FROM shipped WHERE split = 'test_edited' OR (split = 'test_ood' AND label = 0))"


@query("join_borrow_reals", f"SELECT variant, round(auroc, 6) AS auroc, n_pos, n_neg FROM ({auc_sql(BORROW, ['variant'], 'score')})")
def join_borrow_reals(c):
    rows = c.shipped("split = 'test_edited'").unionByName(c.shipped("split = 'test_ood' AND label = 0"))
    return mt.auroc(rows, "variant", "tampered").select("variant", r6("auroc").alias("auroc"), "n_pos", "n_neg")


TS = "[" + ", ".join(f"{t}::DOUBLE" for t in mt.threshold_grid()) + "]"
CURVE = f"""(SELECT t, count(*) FILTER (pred >= t AND label = 1) AS tp, count(*) FILTER (pred >= t AND label = 0) AS fp, count(*) FILTER (pred < t AND label = 0) AS tn,
    count(*) FILTER (pred < t AND label = 1) AS fn, count(*) AS n FROM {EVAL} CROSS JOIN (SELECT unnest({TS}) AS t) GROUP BY t)"""


@query("join_threshold", f"SELECT t, tp, fp, tn, fn, round((tp + tn) / n::DOUBLE, 6) AS acc FROM {CURVE}")
def join_threshold(c):
    return mt.threshold_curve(evalset(c), [], "pred").select("t", "tp", "fp", "tn", "fn", r6("acc").alias("acc"))


J70 = "list_transform(x, lambda e: round_even(e / 0.03::DOUBLE, 0) * 0.03::DOUBLE)"
NEAR = f"""(SELECT image_id, list_transform(v, lambda e: e / sqrt(list_dot_product(v, v))) AS v, side FROM (
    SELECT image_id, x AS v, 'eval' AS side FROM items WHERE split <> 'train' UNION ALL SELECT image_id, x, 'train' FROM items WHERE split = 'train'
    UNION ALL SELECT image_id, {J70}, 'train' FROM items WHERE split <> 'train' AND h8 % 11 = 0 UNION ALL SELECT image_id, x, 'train' FROM items WHERE split <> 'train' AND h8 % 13 = 0))"""


def near_sides(c):
    """Evaluation vectors, and training vectors that hold re-encoded and exact copies of some."""
    models = vj.Models()
    keep = ["image_id", "h8", "x"]
    ev = c.items("split <> 'train'")
    clean = vj.SETTINGS[:1]
    train = [vj.score_grid(c.items("split = 'train'").select(*keep), models, clean, keep_x=True),
             vj.score_grid(ev.where("h8 % 11 = 0").select(*keep), models, [vj.SETTINGS[2]], keep_x=True),
             vj.score_grid(ev.where("h8 % 13 = 0").select(*keep), models, clean, keep_x=True)]
    right = train[0].unionByName(train[1]).unionByName(train[2])
    from mediaguard.functions import vectors as vx
    return ev.select(F.col("image_id").alias("id"), vx.l2norm("x").alias("x")), right.select(vx.l2norm("x").alias("x"))


@query("join_near_dup", f"SELECT DISTINCT e.image_id AS id FROM {NEAR} e JOIN {NEAR} t ON e.side = 'eval' AND t.side = 'train' WHERE list_dot_product(e.v, t.v) >= 0.95")
def join_near_dup(c):
    left, right = near_sides(c)
    return near_dup.near_duplicates(left, right, 0.95)


PROBES = "(SELECT event_id AS probe_id, user_id AS video_id, epoch(ts) AS t FROM events WHERE event_type = 'purchase')"


@query("join_nearest_frame", f"""SELECT probe_id, frame_id FROM (
    SELECT p.probe_id, f.frame_id, row_number() OVER (PARTITION BY p.probe_id ORDER BY round(abs(f.t - p.t), 6), f.t, f.frame_id) AS k FROM {PROBES} p
    JOIN (SELECT event_id AS frame_id, user_id AS video_id, epoch(ts) AS t FROM events WHERE event_type <> 'purchase') f USING (video_id)) WHERE k = 1""")
def join_nearest_frame(c):
    ev = c.table("events").selectExpr("event_id", "user_id AS video_id", "unix_micros(cast(ts AS timestamp)) / 1e6D AS t", "event_type")
    probes = ev.where("event_type = 'purchase'").select(F.col("event_id").alias("probe_id"), "video_id", "t")
    frames = ev.where("event_type <> 'purchase'").select(F.col("event_id").alias("frame_id"), "video_id", "t")
    return joins.nearest_in_time(probes, frames, "video_id", "t", "t", "frame_id").where("frame_id is not null").select("probe_id", "frame_id")


@query("join_content_proto", "SELECT image_id, content FROM contents")
def join_content_proto(c):
    return c.contents()


PAIRED = """(SELECT image_id, max(label) AS label, max(face) FILTER (variant = 'clean') AS a, max(face) FILTER (variant = 'blur20') AS b FROM shipped
    WHERE has_face AND variant IN ('clean', 'blur20') GROUP BY image_id HAVING count(*) = 2)"""
PAIRED_LONG = f"(SELECT label, unnest(['clean', 'blur20']) AS variant, unnest([a, b]) AS score FROM {PAIRED})"


@query("join_paired_variants", f"SELECT variant, round(auroc, 6) AS auroc, n_pos, n_neg FROM ({auc_sql(PAIRED_LONG, ['variant'], 'score')})")
def join_paired_variants(c):
    rows = c.branches().where("has_face AND variant IN ('clean', 'blur20')")
    both = rows.groupBy("image_id").agg(F.max("label").alias("label"), F.max(F.expr("IF(variant = 'clean', face, NULL)")).alias("a"),
                                        F.max(F.expr("IF(variant = 'blur20', face, NULL)")).alias("b"), F.count(F.lit(1)).alias("k")).where("k = 2")
    long = both.selectExpr("label", "stack(2, 'clean', a, 'blur20', b) AS (variant, score)")
    return mt.auroc(long, "variant", "score").select("variant", r6("auroc").alias("auroc"), "n_pos", "n_neg")


# ---------------------------------------------------------------- windows, top-k, sampling

@query("win_split_priority", "SELECT image_id, split, count(*) AS n FROM resolved GROUP BY 1, 2")
def win_split_priority(c):
    return gov.resolve_splits(c.manifest_input(), parity=False).groupBy("image_id", "split").agg(F.count(F.lit(1)).alias("n"))


@query("win_split_priority_parity", """WITH r AS (SELECT *, CASE split WHEN 'test_organizer' THEN 0 WHEN 'test_ood' THEN 1 WHEN 'test_wild' THEN 2 WHEN 'calib_ood' THEN 3
      WHEN 'calib' THEN 4 WHEN 'train' THEN 5 ELSE 99 END AS q FROM raw_rows WHERE NOT contains(source, 'smoke'))
    SELECT image_id, split FROM (SELECT image_id, split, row_number() OVER (PARTITION BY image_id ORDER BY q, split) AS k FROM r) WHERE k = 1""")
def win_split_priority_parity(c):
    return gov.resolve_splits(c.manifest_input(), parity=True).select("image_id", "split").distinct()


@query("win_dedupe_key", """SELECT image_id, variant, min(file_ord) AS file_ord FROM raw_rows WHERE NOT contains(source, 'smoke') GROUP BY 1, 2""")
def win_dedupe_key(c):
    return gov.dedupe_key(c.manifest_input()).select("image_id", "variant", "file_ord")


@query("win_family_folds", """SELECT image_id, label, CASE WHEN label = 1 THEN dense_rank() OVER (PARTITION BY label ORDER BY generator) - 1
      ELSE h8 % (SELECT count(DISTINCT generator) FROM items WHERE split = 'calib_ood' AND label = 1) END AS fold FROM items WHERE split = 'calib_ood'""")
def win_family_folds(c):
    from mediaguard.plans.fit import family_folds
    return family_folds(c.items("split = 'calib_ood'")).select("image_id", "label", "fold")


@query("win_largest_face", """SELECT image_id, face_no, fw, fh FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY fw * fh DESC, face_no) AS k FROM faces) WHERE k = 1""")
def win_largest_face(c):
    f = c.faces().select("image_id", "face_no", "fw", "fh")
    return sm.largest(f, ["image_id"], F.col("fw") * F.col("fh"), F.col("face_no"))


@query("win_top_faces", "SELECT image_id, face_no, fw, fh FROM kept_faces")
def win_top_faces(c):
    from mediaguard.plans.scoring import top_faces
    return top_faces(c.faces()).select("image_id", "face_no", "fw", "fh")


@query("win_largest_text", """SELECT doc_id, pos, token FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w * h DESC, pos) AS k FROM tokens) WHERE k = 1""")
def win_largest_text(c):
    return sm.largest(c.best_tokens("area", 1), ["doc_id"], F.col("value"), F.col("pos")).select("doc_id", "pos", "token")


@query("win_top_text", """SELECT doc_id, pos, round(conf, 6) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, pos) AS k FROM tokens) WHERE k <= 10""")
def win_top_text(c):
    best = c.best_tokens("conf", fixed.MAX_TEXT_REGIONS)
    return sm.top_n(best, ["doc_id"], [F.desc("value"), F.asc("pos")], fixed.MAX_TEXT_REGIONS).select("doc_id", "pos", r6("value").alias("conf"))


@query("win_cum_threshold", """SELECT source, round(t, 6) AS t, round(sum(p) OVER w / nullif(sum(p) OVER (PARTITION BY source), 0)::DOUBLE, 6) AS tpr,
      round(sum(n) OVER w / nullif(sum(n) OVER (PARTITION BY source), 0)::DOUBLE, 6) AS fpr FROM (
      SELECT source, pred AS t, sum(label) AS p, sum(1 - label) AS n FROM shipped WHERE starts_with(split, 'test') GROUP BY 1, 2) WINDOW w AS (PARTITION BY source ORDER BY t DESC)""")
def win_cum_threshold(c):
    return mt.roc_points(evalset(c), "source", "pred").select("source", r6("t").alias("t"), r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


SRC_CURVE = CURVE.replace("(SELECT t,", "(SELECT source, t,").replace("GROUP BY t)", "GROUP BY source, t)")


@query("win_plateau", f"""SELECT source, min(t) AS lo, max(t) AS hi, round(max(best), 6) AS best_acc FROM (
    SELECT source, t, (tp + tn) / n::DOUBLE AS acc, max((tp + tn) / n::DOUBLE) OVER (PARTITION BY source) AS best FROM {SRC_CURVE}) WHERE acc >= best - 0.01 GROUP BY source""")
def win_plateau(c):
    return mt.plateau(mt.threshold_curve(evalset(c), "source", "pred"), "source").select("source", "lo", "hi", r6("best_acc").alias("best_acc"))


@query("win_quota", """SELECT image_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('q:' || image_id), image_id) AS k FROM items) WHERE k <= 40""")
def win_quota(c):
    return sm.top_n(c.items().select("image_id", "label"), ["label"], [ids.draw_key(F.lit("q"), "image_id").asc(), F.asc("image_id")], 40)


@query("win_sample_variants", "SELECT image_id, idx, variant FROM sampled")
def win_sample_variants(c):
    return c.items().select("image_id", F.explode(joins.sampled_settings(F.col("image_id"))).alias("s")).select("image_id", "s.idx", "s.variant")


@query("win_stride_sample", """SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (ORDER BY url || '|' || page_id) - 1 AS k, count(*) OVER () AS n FROM pages)
    WHERE k % greatest(n // 60, 1) = 0 AND k < greatest(n // 60, 1) * 60""")
def win_stride_sample(c):
    pages = c.table("pages").selectExpr("page_id", "url", "concat(url, '|', page_id) AS k")
    return sm.stride_sample(pages, "k", 60).select("page_id", "url")


@query("win_stratified_sample", """SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('s:' || doc_id), doc_id) AS k FROM labels) WHERE k <= 50""")
def win_stratified_sample(c):
    return sm.top_n(c.table("labels").select("doc_id", "quality"), ["quality"],
                    [ids.draw_key(F.lit("s"), F.col("doc_id").cast("string")).asc(), F.asc("doc_id")], 50)


CHAIN_AUC = auc_sql("chains", ["first", "second"], "score")


@query("srt_worst_chains", f"SELECT first, second, round(auroc, 6) AS auroc FROM ({CHAIN_AUC}) ORDER BY round(auroc, 9), first, second LIMIT 8")
def srt_worst_chains(c):
    per = mt.auroc(c.chains(), ["first", "second"], "score")
    return per.orderBy(F.round("auroc", 9), "first", "second").limit(8).select("first", "second", r6("auroc").alias("auroc"))


@query("srt_confident_errors", """SELECT image_id, label, round(wrong, 6) AS wrong, CASE WHEN (pred >= 0.5) = (label = 0) THEN CASE WHEN label = 0 THEN 'false positive' ELSE 'false negative' END
      ELSE 'correct (near miss)' END AS kind FROM (SELECT *, CASE WHEN label = 0 THEN pred ELSE 1 - pred END AS wrong FROM shipped WHERE variant = 'clean' AND starts_with(split, 'test'))
    ORDER BY round(wrong, 9) DESC, image_id LIMIT 5""")
def srt_confident_errors(c):
    df = evalset(c, ["clean"]).withColumn("wrong", F.expr("IF(label = 0, pred, 1 - pred)"))
    kind = F.expr("IF((pred >= 0.5D) = (label = 0), IF(label = 0, 'false positive', 'false negative'), 'correct (near miss)')")
    return df.orderBy(F.desc(F.round("wrong", 9)), "image_id").limit(5).select("image_id", "label", r6("wrong").alias("wrong"), kind.alias("kind"))


def _stable_sql(label, direction, n=5):
    """Greedy picks as a chain: each is the best row unlike every earlier one."""
    base = f"""per_{label} AS (SELECT s.image_id, s.p, list_transform(i.x, lambda e: e / sqrt(list_dot_product(i.x, i.x))) AS v FROM (
        SELECT image_id, avg(pred) AS p FROM shipped WHERE starts_with(split, 'test') AND label = {label} GROUP BY image_id) s JOIN items i USING (image_id))"""
    parts = [base]
    for k in range(n):
        unlike = " AND ".join(f"list_dot_product(v, (SELECT v FROM pick_{label}_{j})) <= 0.95" for j in range(k)) or "true"
        parts.append(f"pick_{label}_{k} AS (SELECT * FROM per_{label} WHERE {unlike} ORDER BY round(p, 9) {direction}, image_id LIMIT 1)")
    rows = [f"SELECT {label} AS label, {k} AS rank, image_id, round(p, 6) AS p FROM pick_{label}_{k}" for k in range(n)]
    return parts, rows


_A, _B = _stable_sql(0, "DESC"), _stable_sql(1, "ASC")


@query("srt_stable_errors", "WITH " + ", ".join(_A[0] + _B[0]) + " " + " UNION ALL ".join(_A[1] + _B[1]))
def srt_stable_errors(c):
    from mediaguard.plans.errors import stable_errors
    per = evalset(c).groupBy("image_id").agg(F.avg("pred").alias("p"), F.max("label").alias("label"))
    return stable_errors(per, c.items("split LIKE 'test%'").select("image_id", "x"), 5, 0.95)


@query("srt_weights", """SELECT branch, i, round(12 * v, 6) AS coefficient, row_number() OVER (PARTITION BY branch ORDER BY round(abs(v), 12) DESC, i) AS rank FROM (
    SELECT CASE code WHEN 1 THEN 'general' ELSE 'tampered' END AS branch, unnest(range(0, 64)) AS i, unnest(w) AS v FROM probes)""")
def srt_weights(c):
    w = c.model_rows().select("branch", F.posexplode("w").alias("i", "v"))
    return w.select("branch", "i", r6("v").alias("coefficient"), F.row_number().over(
        W.partitionBy("branch").orderBy(F.desc(F.round(F.abs("v") / 12, 12)), "i")).alias("rank"))


@query("srt_drop_rows", f"""SELECT variant, round(avg(g.auroc - k.auroc), 6) AS mean_change FROM {GRID_LONG} g JOIN (SELECT branch, auroc FROM {GRID_LONG} WHERE variant = 'clean') k USING (branch) GROUP BY variant""")
def srt_drop_rows(c):
    clean = F.max(F.when(F.col("variant") == "clean", F.col("auroc"))).over(W.partitionBy("branch"))
    return (grid_long(c).withColumn("d", F.col("auroc") - clean).groupBy("variant").agg(r6(F.avg("d")).alias("mean_change"))
            .orderBy(F.desc("mean_change"), "variant"))


@query("win_hard_negatives", """WITH n AS (SELECT image_id, variant, pred AS p FROM shipped WHERE label = 0 AND split = 'train')
    SELECT image_id, variant, round(p, 6) AS p, unnest(range(0, CASE WHEN p >= (SELECT quantile_cont(p, 0.9) FROM n) THEN 3 ELSE 1 END))::INT AS copy FROM n""")
def win_hard_negatives(c):
    from mediaguard.plans.fit import hard_negatives
    neg = c.shipped("split = 'train' AND label = 0").select("image_id", "variant", F.col("pred").alias("p"))
    return hard_negatives(neg, "p", 0.9, 3).withColumn("p", r6("p"))


# ---------------------------------------------------------------- set operations

@query("set_union", "SELECT source, split, count(*) AS n FROM raw_rows WHERE source IN ('core_train', 'edited_train', 'ood_eval') GROUP BY 1, 2")
def set_union(c):
    rows = c.raw_rows()
    parts = [rows.where(F.col("source") == s) for s in ("core_train", "edited_train", "ood_eval")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


SHARED_SRC = "(SELECT image_id, list(DISTINCT source ORDER BY source) AS s FROM raw_rows WHERE NOT contains(source, 'smoke') GROUP BY image_id HAVING count(DISTINCT source) > 1)"


@query("set_intersect_disjoint", f"SELECT image_id, array_to_string(s, ',') AS sources FROM {SHARED_SRC}")
def set_intersect_disjoint(c):
    return gov.shared_sources(c.manifest_input()).select("image_id", F.concat_ws(",", "sources").alias("sources"))


@query("set_intersect_generators", """SELECT generator FROM raw_rows WHERE split = 'test_ood' AND label = 1 INTERSECT SELECT generator FROM raw_rows WHERE split = 'test_organizer' AND label = 1""")
def set_intersect_generators(c):
    rows = c.raw_rows().where("label = 1").select("generator", "split")
    return rows.where("split = 'test_ood'").select("generator").intersect(rows.where("split = 'test_organizer'").select("generator"))


@query("set_except", "SELECT vec_id FROM items EXCEPT SELECT doc_id FROM labels")
def set_except(c):
    return c.items().select("vec_id").exceptAll(c.table("labels").select(F.col("doc_id").alias("vec_id")).distinct())


@query("set_partition_check", """SELECT count(*) AS n_ids, count(*) FILTER (a) AS in_a, count(*) FILTER (b) AS in_b, count(*) FILTER (a AND b) AS in_both, count(*) FILTER (NOT a AND NOT b) AS in_none
    FROM (SELECT image_id, bool_or(('0x' || substr(image_id, 1, 8))::BIGINT % 2 = 0) AS a, bool_or(('0x' || substr(image_id, 1, 8))::BIGINT % 2 = 1) AS b FROM manifest GROUP BY image_id)""")
def set_partition_check(c):
    h = ids.half("image_id")
    per = c.manifest().groupBy("image_id").agg(F.bool_or(h == "a").alias("a"), F.bool_or(h == "b").alias("b"))
    return per.agg(F.count(F.lit(1)).alias("n_ids"), F.count_if("a").alias("in_a"), F.count_if("b").alias("in_b"),
                   F.count_if(F.expr("a AND b")).alias("in_both"), F.count_if(F.expr("NOT a AND NOT b")).alias("in_none"))


# ---------------------------------------------------------------- governance

GATES: list[str] = []


def planted(manifest: DataFrame) -> DataFrame:
    """The manifest with violations of every gate."""
    h, variant = F.conv(F.substring("image_id", 9, 8), 16, 10).cast("long") % 11, F.col("variant")
    split = (F.when(h == 1, "train").when(h == 2, "calib_ood").when((h == 3) & (variant == "clean"), "test_ood").otherwise(F.col("split")))
    kept = manifest.where(~((h == 4) & (variant == "noise01")) & ~((h > 4) & (F.col("label") == 0) & (F.col("split") == "train")))
    return kept.withColumn("split", split)


def _gate(key, fn, sql, rows=None):
    """A gate on the manifest as built and on one with planted violations, or on ``rows``."""
    if rows is not None:
        query(key, sql)(lambda c: fn(rows(c)))
        return
    GATES.append(sql)
    query(key, both(sql))(lambda c: fn(c.manifest()).withColumn("scope", F.lit("manifest")).unionByName(fn(planted(c.manifest())).withColumn("scope", F.lit("planted"))))


def both(sql: str) -> str:
    return f"SELECT *, 'manifest' AS scope FROM ({sql}) UNION ALL SELECT *, 'planted' AS scope FROM ({sql.replace('FROM manifest', 'FROM planted')})"


_gate("gov_quarantine", gov.gate_quarantine, "SELECT 'quarantine' AS gate, CASE WHEN count(*) = 0 THEN 1 ELSE count(*) FILTER (split <> 'test_organizer') END AS violations FROM manifest WHERE source = 'organizer_val'")
_gate("gov_ood_only", gov.gate_ood_only, "SELECT 'ood_only' AS gate, count(*) FILTER (split NOT IN ('test_ood', 'calib_ood')) AS violations FROM manifest WHERE source = 'ood_eval'")
_gate("gov_disjoint", gov.gate_generators_disjoint, """SELECT 'generators_disjoint' AS gate, count(*) FILTER (k AND t) + CASE WHEN bool_or(k) THEN 0 ELSE 1 END + CASE WHEN bool_or(t) THEN 0 ELSE 1 END AS violations FROM (
    SELECT generator, bool_or(split = 'calib_ood') AS k, bool_or(split = 'test_ood') AS t FROM manifest WHERE source = 'ood_eval' AND label = 1 GROUP BY generator)""")
_gate("gov_images_disjoint", gov.gate_images_disjoint, """SELECT 'images_disjoint' AS gate, count(*) FILTER (k AND t) AS violations FROM (
    SELECT image_id, bool_or(split = 'calib_ood') AS k, bool_or(split = 'test_ood') AS t FROM manifest WHERE source = 'ood_eval' GROUP BY image_id)""")
_gate("gov_calib", gov.gate_calib, "SELECT 'calib_only' AS gate, count(*) FILTER (split <> 'calib') AS violations FROM manifest WHERE source = 'core_calib'")
_gate("gov_one_split", gov.gate_one_split, "SELECT 'one_split' AS gate, count(*) AS violations FROM (SELECT image_id FROM raw_rows WHERE NOT contains(source, 'smoke') GROUP BY image_id HAVING count(DISTINCT split) > 1)",
      lambda c: c.manifest_input())
_gate("gov_balance", gov.gate_balance, "SELECT 'balance' AS gate, CASE WHEN avg(label) > 0.35 AND avg(label) < 0.65 THEN 0 ELSE 1 END AS violations FROM manifest WHERE split = 'train' AND variant = 'clean'")
_gate("gov_full_grid", gov.gate_full_grid, """SELECT 'full_grid' AS gate, count(*) FILTER (n <> 15) AS violations FROM (SELECT image_id, count(DISTINCT variant) AS n FROM manifest
    WHERE starts_with(split, 'test') OR starts_with(split, 'calib') GROUP BY image_id)""")
_gate("gov_sources_disjoint", gov.gate_sources_disjoint, f"SELECT 'sources_disjoint' AS gate, count(*) AS violations FROM {SHARED_SRC}", lambda c: c.manifest_input())


@query("gov_carve", "SELECT source, generator, split, count(*) AS n FROM manifest GROUP BY 1, 2, 3")
def gov_carve(c):
    return c.manifest().groupBy("source", "generator", "split").agg(F.count(F.lit(1)).alias("n"))


ONE_SPLIT = "SELECT 'one_split' AS gate, count(*) AS violations FROM (SELECT image_id FROM manifest GROUP BY image_id HAVING min(split) <> max(split))"


ALL_GATES = " UNION ALL ".join(f"({x})" for x in [*GATES, ONE_SPLIT])


@query("gov_all", both(ALL_GATES))
def gov_all(c):
    """Every gate over the manifest as built and over the one with planted violations; the manifest is built once."""
    m = cut_lineage(c.manifest().select("image_id", "source", "split", "variant", "label", "generator"))
    return gov.all_gates(m).withColumn("scope", F.lit("manifest")).unionByName(gov.all_gates(planted(m)).withColumn("scope", F.lit("planted")))


@query("gov_all_planted", ALL_GATES.replace("FROM manifest", "FROM planted"))
def gov_all_planted(c):
    """The same over a manifest with violations of every gate."""
    return gov.all_gates(planted(c.manifest()))


@query("gov_shortcut", """WITH tr AS (SELECT d.source, l.quality AS label, d.lang FROM documents d JOIN labels l USING (doc_id)),
    src AS (SELECT source, count(*) AS n, min(label) AS lo, max(label) AS hi FROM tr GROUP BY source)
    SELECT 'source' AS scope, source AS name, lo = hi AND n / (SELECT sum(n) FROM src)::DOUBLE > 0.3 AS fails FROM src
    UNION ALL SELECT 'format', lang, greatest(sum(label), sum(1 - label)) / count(*)::DOUBLE >= 0.75 FROM tr GROUP BY lang""")
def gov_shortcut(c):
    rows = c.table("documents").join(c.table("labels"), "doc_id").select("source", F.col("quality").alias("label"), "lang", F.lit("train").alias("split"))
    return gov.shortcut_risk(rows, "lang").selectExpr("scope", "name", "risk AS fails")
