"""Registry of queries and the oracle's shared table expressions."""
from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from mediaguard import fixed
from mediaguard.plans.corpus import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, body: str | None = None):
    """Register ``fn(corpus)`` under ``key``; ``body`` is the SELECT that must agree with it."""
    def wrap(fn):
        QUERIES[key] = lambda spark, sf_dir: fn(Corpus(spark, sf_dir))
        if body is not None:
            ORACLES[key] = with_tables(body)
        return fn
    return wrap


def _settings_rows() -> str:
    rows = [(0, "clean", "0", "clean")] + [
        (i + 1, k, p, f"{k}{p}".replace(".", "")) for i, (k, p) in enumerate(fixed.GRID)]
    return ", ".join(f"({i}, '{k}', {float(p)}::DOUBLE, '{v}')" for i, k, p, v in rows)


def dot_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def norm_sql(a: str) -> str:
    return f"sqrt(list_dot_product({a}, {a}))"


def sig(z: str) -> str:
    return f"(1.0/(1.0+exp(-({z}))))"


DEGRADE = """CASE kind
            WHEN 'clean' THEN x
            WHEN 'jpeg' THEN list_transform(x, lambda e: round_even(e / ((100 - param) / 1000), 0) * ((100 - param) / 1000))
            WHEN 'blur' THEN list_transform(x, lambda e, k: (1 - param / 4) * e
                 + (param / 8) * x[CASE WHEN k = 1 THEN 64 ELSE k - 1 END] + (param / 8) * x[CASE WHEN k = 64 THEN 1 ELSE k + 1 END])
            WHEN 'resize' THEN list_transform(x, lambda e, k: list_sum(x[
                 ((k - 1) // (1 / param)::INT) * (1 / param)::INT + 1 : ((k - 1) // (1 / param)::INT + 1) * (1 / param)::INT]) * param)
            WHEN 'noise' THEN list_transform(x, lambda e, k: e + param *
                 (((h8 * k * 7919 + k * 104729 + idx::BIGINT * 15485863) % 1000003) / 1000003.0::DOUBLE - 0.5))
            WHEN 'jitter' THEN list_transform(x, lambda e: e * (1 + param * (2 * ((h8 % 1009) / 1009.0::DOUBLE) - 1)))
            ELSE list_transform(x, lambda e, k: x[7 + floor((k - 1) * param)::INT]) END"""

def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def kind_sql(value: str) -> str:
    """Marker kind of a value: the first list with a hit decides."""
    hit = lambda words: f"len(list_filter({_list(words)}, lambda m: contains(lower({value}), m))) > 0"
    return (f"CASE WHEN {hit(fixed.AI_MARKERS)} THEN 'ai' WHEN {hit(fixed.CAMERA_MARKERS)} THEN 'camera' "
            f"WHEN {hit(fixed.EDITOR_MARKERS)} THEN 'editor' END")


def hit_sql(value: str) -> str:
    words = fixed.AI_MARKERS + fixed.CAMERA_MARKERS + fixed.EDITOR_MARKERS
    return f"list_filter({_list(words)}, lambda m: contains(lower({value}), m))[1]"


TABLES: dict[str, str] = {
    "settings": f"SELECT * FROM (VALUES {_settings_rows()}) AS s(idx, kind, param, variant)",
    "items0": """
        SELECT vec_id, substr(sha256(vec_id::VARCHAR), 1, 16) AS image_id,
               list_transform(embedding, lambda e: e::DOUBLE) AS x, label AS cls,
               label // 2 AS family, CASE WHEN label = 4 THEN 2 WHEN label > 4 THEN 1 ELSE 0 END AS code
        FROM embeddings""",
    "items1": """
        SELECT *, ('0x' || substr(image_id, 1, 8))::BIGINT AS h8, ('0x' || substr(image_id, 9, 8))::BIGINT AS h8b,
               CASE WHEN code = 0 THEN 0 ELSE 1 END AS label,
               CASE code WHEN 0 THEN 'real' WHEN 1 THEN 'full_synthetic' ELSE 'tampered' END AS subclass,
               CASE WHEN code = 1 THEN 'g' || cls ELSE 'unknown' END AS generator,
               CASE WHEN code = 2 THEN CASE WHEN vec_id % 10 < 5 THEN 'edited_train' ELSE 'edited_eval' END
                    WHEN vec_id % 10 < 4 THEN 'core_train' WHEN vec_id % 10 = 4 THEN 'core_calib'
                    WHEN vec_id % 10 < 8 THEN 'ood_eval' WHEN vec_id % 10 = 8 THEN 'organizer_val'
                    ELSE 'web_holdout' END AS source
        FROM items0""",
    "items": """
        SELECT *, CASE source WHEN 'edited_train' THEN 'train' WHEN 'edited_eval' THEN 'test_edited'
                    WHEN 'core_train' THEN 'train' WHEN 'core_calib' THEN 'calib'
                    WHEN 'ood_eval' THEN CASE WHEN (label = 1 AND generator IN ('g6', 'g7'))
                         OR (label = 0 AND h8 % 3 = 0) THEN 'calib_ood' ELSE 'test_ood' END
                    WHEN 'organizer_val' THEN 'test_organizer' ELSE 'test_holdout' END AS split
        FROM items1""",
    "centres": """
        SELECT code, i, avg(x[i]) AS a FROM (SELECT code, x, unnest(range(1, 65)) AS i FROM items WHERE split = 'train')
        GROUP BY code, i""",
    "directions": """
        SELECT g.code, list(g.a - r.a ORDER BY g.i) AS d, list((g.a + r.a) / 2 ORDER BY g.i) AS m
        FROM centres g JOIN centres r ON g.i = r.i AND r.code = 0 WHERE g.code > 0 GROUP BY g.code""",
    "probes": """
        SELECT code, list_transform(d, lambda e: e / sqrt(list_dot_product(d, d))) AS w,
               -list_dot_product(d, m) / sqrt(list_dot_product(d, d)) AS b FROM directions""",
    "protos0": """
        SELECT family, list(a ORDER BY i) AS p FROM (
            SELECT family, i, avg(x[i]) AS a FROM (SELECT family, x, unnest(range(1, 65)) AS i FROM items)
            GROUP BY family, i) GROUP BY family""",
    "protos": """
        SELECT family, list_transform(p, lambda e: e / sqrt(list_dot_product(p, p))) AS p FROM protos0""",
    "grid": f"""
        SELECT i.* EXCLUDE (x), s.*, i.x AS x0,
          {DEGRADE} AS x
        FROM items i CROSS JOIN settings s""",
    "scored": f"""
        SELECT g.* EXCLUDE (x, x0), 12 * ({dot_sql('x', '(SELECT w FROM probes WHERE code = 1)')} + (SELECT b FROM probes WHERE code = 1)) AS general,
               12 * ({dot_sql('x', '(SELECT w FROM probes WHERE code = 2)')} + (SELECT b FROM probes WHERE code = 2)) AS tampered,
               g.x AS xv, g.x0 AS x0
        FROM grid g""",
    "branches": f"""
        SELECT * EXCLUDE (xv, x0),
               CASE WHEN has_face THEN 0.8 * general + 0.3 * (log2(face_px) - 8.2) / 0.75 - 0.4 END AS face,
               CASE WHEN h8b % 4 <> 0 THEN
                   round(20 * (list_sum(list_transform(xv[1:32], lambda e: abs(e))) - list_sum(list_transform(xv[33:64], lambda e: abs(e)))) / 32, 9) END AS spectral,
               CASE WHEN h8b % 4 <> 0 THEN {sig("40 * (0.1 - list_sum(list_transform(xv, lambda e: abs(e))) / 64)")} END AS degradation_estimate
        FROM (SELECT *, h8 % 3 = 0 AND (h8 + idx * 7) % 11 <> 0 AS has_face, (64 + h8b % 549)::DOUBLE AS face_px FROM scored)""",
    "shipped": f"""
        SELECT *, greatest({sig('greatest(general, 1.25 * tampered) - ln(0.8092 / 0.1908)')},
                           coalesce({sig('face - ln(0.8092 / 0.1908)')}, 0)) AS pred,
               {sig('general - ln(0.8092 / 0.1908)')} AS p_general, {sig('tampered - ln(0.8092 / 0.1908)')} AS p_tampered,
               {sig('face - ln(0.8092 / 0.1908)')} AS p_face
        FROM branches""",
    "contents": """
        SELECT i.image_id, ['face', 'animal', 'object', 'scene', 'text'][(arg_max(p.family, list_dot_product(i.x, p.p) - 0.0) + 1)::INT] AS content
        FROM items i CROSS JOIN protos p GROUP BY i.image_id""",
    "sampled": """
        SELECT image_id, idx, variant FROM (
          SELECT i.image_id, s.idx, s.variant,
                 row_number() OVER (PARTITION BY i.image_id ORDER BY md5(i.image_id || ':' || s.idx::VARCHAR)) AS rk
          FROM items i CROSS JOIN settings s WHERE s.idx > 0) WHERE rk <= 3""",
    "raw_rows": """
        WITH base AS (
          SELECT i.image_id, s.variant, i.label, i.source, i.subclass, i.generator,
                 CASE WHEN i.split = 'calib_ood' THEN 'test_ood' ELSE i.split END AS split, i.h8, i.vec_id, s.idx
          FROM items i CROSS JOIN settings s
          WHERE i.split <> 'train' OR s.idx = 0
             OR EXISTS (SELECT 1 FROM sampled p WHERE p.image_id = i.image_id AND p.idx = s.idx))
        SELECT image_id, variant, label, source, subclass, generator, split, vec_id * 100 + idx AS file_ord FROM base
        UNION ALL
        SELECT image_id, variant, label, source, subclass, generator, split, 1000000000 + vec_id * 100 + idx FROM base WHERE h8 % 7 = 0
        UNION ALL
        SELECT image_id, variant, label, 'core_train', subclass, generator, 'train', 2000000000 + vec_id * 100 + idx FROM base
          WHERE h8 % 11 = 0 AND source <> 'web_holdout'
        UNION ALL
        SELECT image_id, variant, label, 'core_smoke', subclass, generator, 'train', 3000000000 + vec_id * 100 + idx FROM base WHERE h8 % 13 = 0""",
    "ranked_rows": """
        SELECT *, CASE split WHEN 'test_organizer' THEN 0 WHEN 'test_ood' THEN 1 WHEN 'test_wild' THEN 2 WHEN 'calib_ood' THEN 3
                  WHEN 'calib' THEN 4 WHEN 'train' THEN 5 ELSE CASE WHEN starts_with(split, 'test') THEN 2 ELSE 99 END END AS pr
        FROM raw_rows WHERE NOT contains(source, 'smoke')""",
    "resolved": """
        SELECT r.* EXCLUDE (pr) FROM ranked_rows r JOIN (
          SELECT image_id, split FROM (SELECT image_id, split, row_number() OVER (PARTITION BY image_id ORDER BY pr, split) AS k
                                       FROM ranked_rows) WHERE k = 1) q ON r.image_id = q.image_id AND r.split = q.split""",
    "deduped": """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY image_id, variant ORDER BY file_ord) AS rn FROM resolved)
        WHERE rn = 1""",
    "manifest": """
        SELECT * EXCLUDE (split), CASE WHEN source = 'ood_eval' AND ((label = 1 AND generator IN ('g6', 'g7'))
               OR (label = 0 AND ('0x' || substr(image_id, 1, 8))::BIGINT % 3 = 0)) THEN 'calib_ood' ELSE split END AS split
        FROM deduped""",
    # the manifest with violations: images of training in evaluation and the reverse, both sides of the carve, a missing variant
    "planted": """
        SELECT * EXCLUDE (split), CASE h % 11 WHEN 1 THEN 'train' WHEN 2 THEN 'calib_ood' WHEN 3 THEN CASE WHEN variant = 'clean' THEN 'test_ood' ELSE split END ELSE split END AS split
        FROM (SELECT *, ('0x' || substr(image_id, 9, 8))::BIGINT AS h FROM manifest) WHERE NOT (h % 11 = 4 AND variant = 'noise01') AND NOT (h % 11 > 4 AND label = 0 AND split = 'train')""",
    "frames": """
        SELECT user_id AS video_id, event_id AS frame_id, ts, epoch(ts) AS t, value / (value + 20) AS raw,
               round_even(value / (value + 20), 4) AS confidence,
               CASE WHEN event_type <> 'error' THEN round_even(value / (value + 35), 4) END AS s_general,
               CASE WHEN event_type IN ('click', 'purchase') THEN round_even(value / (value + 50), 4) END AS s_face
        FROM events""",
    "frame_scores": """
        SELECT *, CASE WHEN confidence >= 0.6 THEN 'likely_ai' WHEN confidence <= 0.4 THEN 'likely_real' ELSE 'uncertain' END AS verdict
        FROM frames""",
    "tokens": """
        SELECT doc_id, pos, token, length(regexp_replace(token, '[^A-Za-z]', '', 'g')) / length(token)::DOUBLE AS conf,
               length(token) * 8.0 + (pos % 5) AS w, 20.0 + (pos % 7) AS h
        FROM (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda t: length(t) > 0)) AS token,
                     generate_subscripts(list_filter(string_split_regex(text, '\\s+'), lambda t: length(t) > 0), 1) - 1 AS pos
              FROM documents)""",
    "chain1": f"SELECT i.* EXCLUDE (x), s.idx AS first_idx, s.variant AS first, {DEGRADE} AS x FROM items i CROSS JOIN settings s WHERE i.split = 'test_ood' AND s.idx > 0",
    "chain2": f"""
        SELECT image_id, label, first, variant AS second, {DEGRADE} AS x FROM (
          SELECT c.* , s.variant, s.kind, s.param, 100 + 14 * (c.first_idx - 1) + s.idx - 1 AS idx FROM chain1 c CROSS JOIN settings s WHERE s.idx > 0)""",
    "chains": f"""
        SELECT image_id, label, first, second, {sig("greatest(12 * (list_dot_product(x, (SELECT w FROM probes WHERE code = 1)) + (SELECT b FROM probes WHERE code = 1)), "
            "1.25 * 12 * (list_dot_product(x, (SELECT w FROM probes WHERE code = 2)) + (SELECT b FROM probes WHERE code = 2))) - ln(0.8092 / 0.1908)")} AS score
        FROM chain2""",
    "faces": """
        SELECT image_id, label, source, split, face_no, 40 + (h8b * (face_no + 1)) % 300 AS fw, 40 + (h8b * (face_no + 3)) % 280 AS fh,
               general + ((h8b * (face_no + 1) * 31) % 1000) / 250.0::DOUBLE - 2 AS logit
        FROM (SELECT *, unnest(range(0, h8b % 12 + 1)) AS face_no FROM scored WHERE variant = 'clean' AND h8 % 3 = 0)""",
    "kept_faces": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY fw * fh DESC, face_no) AS rk FROM faces WHERE least(fw, fh) >= 64)
        WHERE rk <= 8""",
    "quads": """
        SELECT doc_id, [{'x': x0 + w, 'y': y0 + h + tilt}, {'x': x0, 'y': y0}, {'x': x0 + w, 'y': y0 + tilt}, {'x': x0, 'y': y0 + h}] AS q, x0, y0, w, h, tilt
        FROM (SELECT doc_id, (doc_id * 37 % 400) / 4.0::DOUBLE AS x0, (doc_id * 53 % 300) / 4.0::DOUBLE AS y0, (5 + n_chars % 700)::DOUBLE AS w,
                     (6 + doc_id * 7 % 40)::DOUBLE AS h, (doc_id % 4)::DOUBLE AS tilt FROM documents)""",
    "clips": """
        SELECT user_id AS video_id, count(*) * (user_id % 9 + 1) AS frame_count, (24 + user_id % 7)::DOUBLE AS fps FROM events GROUP BY user_id""",
    "prov_fields": f"""
        SELECT page_id, key, value, ord, {kind_sql('value')} AS kind FROM (
          SELECT page_id, unnest(['html', 'url', 'title']) AS key, unnest([html, url, regexp_extract(html, '<title>([^<]*)</title>', 1)]) AS value,
                 unnest([0, 1, 2]) AS ord FROM pages) WHERE length(value) > 0""",
}

_HEAVY = {"items", "probes", "protos", "grid", "scored", "branches", "shipped", "raw_rows", "ranked_rows",
          "resolved", "deduped", "manifest", "planted", "tokens", "sampled", "contents", "chains", "chain2", "faces", "prov_fields"}


def with_tables(body: str) -> str:
    """Prefix ``body`` with the shared table expressions it names, in dependency order."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(TABLES[name])
    visit(body)
    ctes = [f"{n} AS {'MATERIALIZED ' if n in _HEAVY else ''}({TABLES[n].strip()})" for n in TABLES if n in need]
    body = body.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def auc_sql(table: str, by: list[str], score: str, label: str = "label") -> str:
    """Rank-sum AUROC per group with average ranks for ties."""
    g, sel = ", ".join(by), "".join(f"{b}, " for b in by)
    part = f"PARTITION BY {g} " if by else ""
    ties = ", ".join([*by, score])
    return f"""SELECT {sel}CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1) / 2.0) / (p * n::DOUBLE) END AS auroc,
             p AS n_pos, n AS n_neg
      FROM (SELECT {sel}sum({label})::BIGINT AS p, sum(1 - {label})::BIGINT AS n,
                   sum(CASE WHEN {label} = 1 THEN rk END)::DOUBLE AS rs
            FROM (SELECT {sel}{label}, rank() OVER ({part}ORDER BY {score})
                         + (count(*) OVER (PARTITION BY {ties}) - 1) / 2.0 AS rk
                  FROM {table} WHERE {score} IS NOT NULL)
            {'GROUP BY ' + g if by else ''})"""


def confusion_key(which: str) -> str:
    """AUROC or accuracy per (population, detector, setting) of the reported detectors."""
    t = ("(SELECT source AS population, variant AS setting, label, unnest(['general', 'shipped']) AS detector, unnest([p_general, pred]) AS score "
         "FROM shipped WHERE starts_with(split, 'test'))")
    by = ["population", "detector", "setting"]
    if which == "auc":
        return auc_sql(t, by, "score")
    return f"SELECT population, detector, setting, avg(((score >= 0.5) = (label = 1))::INT) AS acc FROM {t} GROUP BY ALL"
