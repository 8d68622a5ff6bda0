"""Operators on small fixtures built to be awkward: copies, hot groups, gaps, late batches."""
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaguard import fixed
from mediaguard.functions import vectors as vx
from mediaguard.operators import embed, governance as gov, joins, near_dup, raster as ra, sampling as sm, vector_jobs as vj
from mediaguard.plans import errors, fit


def unit(n, d, seed):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# ---------------------------------------------------------------- near duplicates

@pytest.mark.parametrize("threshold", [0.95, 0.98])
def test_near_dup_equals_brute_force_with_copies(spark, threshold):
    rng = np.random.default_rng(5)
    base = unit(120, 16, 1)
    noisy = base[:60] + rng.normal(0, 0.06, (60, 16))
    left = np.vstack([noisy / np.linalg.norm(noisy, axis=1, keepdims=True), unit(60, 16, 2), np.repeat(base[:1], 60, 0)])
    close = base[1] + rng.normal(0, 0.01, (80, 16))
    right = np.vstack([base, np.repeat(base[:1], 60, 0), close / np.linalg.norm(close, axis=1, keepdims=True)])
    want = {i for i, v in enumerate(left) if (right @ v).max() >= threshold}
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(left)], "id INT, x ARRAY<DOUBLE>")
    b = spark.createDataFrame([(v.tolist(),) for v in right], "x ARRAY<DOUBLE>")
    assert {r.id for r in near_dup.near_duplicates(a, b, threshold, bits=5, dim=16).collect()} == want


def test_stable_errors_skip_copies(spark):
    base = unit(12, 8, 3)
    rows = [(f"h{i:03d}", 0.99 - i / 1000, 0, base[0].tolist()) for i in range(40)]       # forty copies lead the list
    rows += [(f"r{i}", 0.9 - i / 100, 0, base[i + 1].tolist()) for i in range(5)] + [(f"f{i}", 0.1 + i / 100, 1, base[i + 6].tolist()) for i in range(3)]
    df = spark.createDataFrame(rows, "image_id STRING, p DOUBLE, label INT, x ARRAY<DOUBLE>")
    got = errors.stable_errors(df.drop("x"), df.select("image_id", "x"), 4).orderBy("label", "rank").collect()
    picks = [r.image_id for r in got if r.label == 0]
    assert picks[0] == "h000" and all(p.startswith("r") for p in picks[1:]) and len(picks) == 4
    assert [r.image_id for r in got if r.label == 1] == ["f0", "f1", "f2"]


# ---------------------------------------------------------------- time joins, sampling

def test_nearest_frame_hot_video_and_gaps(spark):
    rnd = random.Random(4)
    frames = [(v, i, float(rnd.randint(0, 400000))) for v, n in (("hot", 300), ("b", 5), ("c", 1)) for i in range(n)]
    probes = [(v, 1000 + i, float(rnd.randint(-5000, 500000))) for v in ("hot", "b", "c", "none") for i in range(60)]
    f = spark.createDataFrame(frames, "v STRING, frame INT, t DOUBLE")
    p = spark.createDataFrame(probes, "v STRING, probe INT, t DOUBLE")
    got = {(r.v, r.probe): r.frame for r in joins.nearest_in_time(p, f, "v", "t", "t", "frame").collect()}
    for v, k, t in probes:
        own = [(abs(ft - t), ft, i) for fv, i, ft in frames if fv == v]
        assert got[(v, k)] == (min(own)[2] if own else None)


def test_global_rank_and_stride(spark):
    names = [f"{i * 7919 % 1009:05d}" for i in range(1000)]
    df = spark.createDataFrame([(n,) for n in names], "name STRING").repartition(7)
    ranked = {r.name: r.k for r in sm.global_rank(df, "name", "k").collect()}
    assert [n for n, _ in sorted(ranked.items(), key=lambda kv: kv[1])] == sorted(names) and sorted(ranked.values()) == list(range(1000))
    got = sorted(r.name for r in sm.stride_sample(df, "name", 30).collect())
    assert got == sorted(names)[::33][:30]


def test_top_n_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    plan = sm.top_n(df, ["g"], [F.asc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert sm.top_n(df, ["g"], [F.asc("id")], 3).count() == 6


# ---------------------------------------------------------------- governance

def rows(spark, data):
    return spark.createDataFrame(data, "image_id STRING, variant STRING, label INT, source STRING, generator STRING, split STRING, file_ord BIGINT")


def test_eval_copy_wins_and_parity_flag(spark):
    df = rows(spark, [("a", "clean", 0, "core_train", "u", "train", 2), ("a", "clean", 0, "ood_eval", "u", "test_ood", 9),
                      ("b", "clean", 0, "core_train", "u", "train", 3), ("b", "clean", 0, "web_holdout", "u", "test_holdout", 4)])
    strict = {r.image_id: r.split for r in gov.resolve_splits(df, parity=False).collect()}
    assert strict == {"a": "test_ood", "b": "test_holdout"}
    assert {r.image_id: r.split for r in gov.resolve_splits(df, parity=True).collect()}["b"] == "train"


def test_first_row_in_file_order_survives(spark):
    df = rows(spark, [("a", "clean", 0, "s", "late", "train", 9), ("a", "clean", 0, "s", "first", "train", 1)])
    assert [r.generator for r in gov.dedupe_key(df).collect()] == ["first"]


def test_gates_fire_and_block_the_write(spark, tmp_path):
    from mediaguard.sources.vectors import write_manifest
    df = rows(spark, [("00000001", "clean", 0, "organizer_val", "u", "train", 1), ("00000002", "clean", 1, "ood_eval", "g1", "test_ood", 2),
                      ("00000003", "clean", 1, "ood_eval", "g1", "calib_ood", 3)])
    bad = {r.gate: r.violations for r in gov.all_gates(df).collect()}
    assert bad["quarantine"] == 1 and bad["generators_disjoint"] == 1 and bad["full_grid"] == 2 and bad["balance"] == 1
    single = {f(df).first().gate: f(df).first().violations for f in (
        gov.gate_quarantine, gov.gate_ood_only, gov.gate_images_disjoint, gov.gate_calib, gov.gate_one_split, gov.gate_balance, gov.gate_full_grid)}
    assert all(bad[k] == v for k, v in single.items())
    with pytest.raises(ValueError, match="quarantine"):
        write_manifest(df, str(tmp_path / "m"))
    assert not (tmp_path / "m").exists()


# ---------------------------------------------------------------- vectors and rasters

def test_l2norm_and_guard(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a ARRAY<DOUBLE>, z ARRAY<DOUBLE>").select(
        vx.l2norm("a").alias("u"), vx.measured("z").alias("m")).first()
    assert r.u == pytest.approx([0.6, 0.8]) and r.m is None


def test_group_means_hot_group(spark):
    x = unit(900, 8, 7)
    df = spark.createDataFrame([(0 if i % 3 else i % 7, v.tolist()) for i, v in enumerate(x)], "g INT, x ARRAY<DOUBLE>").repartition(5)
    got = {r.g: np.array(r["mean"]) for r in vj.group_means(df, ["g"]).collect()}
    for g in got:
        assert np.allclose(got[g], x[[i for i in range(900) if (0 if i % 3 else i % 7) == g]].mean(0))


def image(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)


def table(spark, imgs):
    return spark.createDataFrame([(f"{i:016x}", (a.shape[0], a.shape[1], 3, bytearray(a.tobytes()))) for i, a in enumerate(imgs)],
                                 "image_id STRING, raster STRUCT<height: INT, width: INT, nChannels: INT, data: BINARY>")


def test_degradations_are_stable_and_not_no_ops(spark):
    df = table(spark, [image(40, 56), image(33, 17, 1)])
    a = {(r.image_id, r.variant): bytes(r.raster.data) for r in ra.degrade_table(df).collect()}
    b = {(r.image_id, r.variant): bytes(r.raster.data) for r in ra.degrade_table(df.repartition(2)).collect()}
    assert a == b and len(a) == 30
    for iid in ("0" * 16, "0" * 15 + "1"):
        clean = a[(iid, "clean")]
        assert all(v != clean and len(v) == len(clean) for (i, n), v in a.items() if i == iid and n != "clean")
    assert a[("0" * 16, "noise005")] != a[("0" * 16, "noise01")]


def test_jpeg_model_loses_more_at_low_quality():
    y, x = np.mgrid[:64, :64]
    a = np.stack([128 + 60 * np.sin(x / 5) + 40 * np.cos(y / 7)] * 3, 2)
    err = [np.abs(ra.jpeg_like(a, q) - a).mean() for q in (90, 70, 50, 30)]
    assert err == sorted(err) and err[0] < 2
    assert np.allclose(ra.resample(np.full((20, 30, 3), 7.0), 11, 9), 7.0)
    assert np.allclose(ra.gaussian(np.full((20, 30, 3), 7.0), 2.0), 7.0)


def test_spectral_features_see_noise(spark):
    flat, noise = np.full((64, 64, 3), 127, np.uint8), image(64, 64)
    got = [np.array(r.spectral) for r in ra.spectral_table(table(spark, [flat, noise]), n=32).orderBy("image_id").collect()]
    assert got[0].shape == (8,) and np.isfinite(got).all() and got[1][:5].mean() > got[0][:5].mean()
    grey = np.random.default_rng(0).random((40, 300))
    kernel = ra.Spectrum(128)
    own = kernel.window(grey)
    assert own.shape == (128, 128) and (own[40:80] == own[:40][::-1]).all() and (own[:40] == grey[:, 86:214]).all()
    c, yx = 64, np.indices((128, 128)) - 64
    near = np.pad(own, 1, mode="edge")
    rest = own - np.array([[np.median(near[i:i + 3, j:j + 3]) for j in range(128)] for i in range(128)])
    power, r = np.fft.fftshift(np.log1p(np.abs(np.fft.fft2(rest)))), np.hypot(*yx) / c
    bands = [power[(r * 5).astype(int).clip(0, 4) == k].mean() for k in range(5)]
    want = [*bands, power[r > 0.25].max() / np.median(power), power[np.ix_([64, 96], [64, 96])].mean() / np.median(power), np.polyfit(range(5), bands, 1)[0]]
    assert np.allclose(kernel(own[None])[0], want)


def test_image_files_are_listed_and_decoded(spark, tmp_path):
    from mediaguard.sources import images, listing

    def chunk(k, b):
        return struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    png = (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 3, 8, 2, 0, 0, 0))
           + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(range(6)) for _ in range(3)))) + chunk(b"IEND", b""))
    (tmp_path / "deep").mkdir()
    for name, data in (("b.PNG", png), ("deep/a.png", png), ("c.jpeg", b"broken"), ("d.txt", b"x"), ("e.WebP", b"x"), ("f.bmp", b"x")):
        (tmp_path / name).write_bytes(data)
    found = [r.path.split("/")[-1] for r in listing.images(spark, str(tmp_path)).select("path").collect()]
    assert sorted(found) == ["a.png", "b.PNG", "c.jpeg", "e.WebP", "f.bmp"]
    ok = images.decode_files(spark, str(tmp_path)).collect()
    assert sorted(r.path.split("/")[-1] for r in ok) == ["a.png", "b.PNG"]
    assert (ok[0].raster.height, ok[0].raster.width, ok[0].raster.nChannels, len(ok[0].raster.data)) == (3, 2, 3, 18)
    assert bytes(ok[0].raster.data) == bytes(range(6)) * 3  # red, green, blue as in the file
    lost = {r.extension: (r.files, r.undecoded) for r in images.undecoded(spark, str(tmp_path)).collect()}
    assert lost == {"png": (2, 0), "jpeg": (1, 1), "webp": (1, 1), "bmp": (1, 1)}
    df = table(spark, [image(4, 4)]).unionByName(spark.createDataFrame([("x", (4, 4, 3, bytearray(b"12")))], table(spark, [image(1, 1)]).schema))
    kept, seen = images.decoded(df)
    assert kept.count() == 1 and seen.get["skipped"] == 1


def test_embed_gives_unit_vectors(spark):
    df = spark.createDataFrame([(v.tolist(),) for v in unit(50, 8, 1)], "x ARRAY<DOUBLE>")
    got = embed.embed(df, embed.projection(8, 5), 8).select(vx.norm("vector").alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in got)


# ---------------------------------------------------------------- fits

def newton(x, y, c, steps=40):
    a = np.hstack([x, np.ones((len(x), 1))])
    pen = np.diag([1 / c] * x.shape[1] + [0.0])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pen, a.T @ (p - y) + pen @ w)
    return w


@pytest.fixture(scope="module")
def labelled(spark):
    x = unit(400, 6, 9) * 2
    y = (x @ np.array([1, -2, .5, 0, 0, 1]) + np.random.default_rng(1).normal(0, .7, 400) > 0.4).astype(int)
    return x, y, spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "x ARRAY<DOUBLE>, label INT")


@pytest.mark.parametrize("c", [1.0, 1e6])
def test_logistic_is_the_newton_optimum(labelled, c):
    x, y, df = labelled
    p, w = fit.logistic(df, c=c), newton(x, y, c)
    assert np.allclose(p.w, w[:-1], atol=1e-4) and abs(p.b - w[-1]) < 1e-4


@pytest.mark.parametrize("alpha", [0.001, 10.0])
def test_ridge_is_the_closed_form(labelled, alpha):
    x, y, df = labelled
    t = 2 * y - 1
    xc, tc = x - x.mean(0), t - t.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ tc)
    p = fit.ridge(df, alpha=alpha)
    assert np.allclose(p.w, w, atol=1e-8) and abs(p.b - (t.mean() - x.mean(0) @ w)) < 1e-8


def test_folded_calibration_and_mean(labelled):
    p = vj.Linear((1.0, 2.0), 0.5)
    q = fit.fold_calibration(p, (2.0, -1.0))
    assert q == vj.Linear((2.0, 4.0), 0.0) and fit.mean_probe([p, q]) == vj.Linear((1.5, 3.0), 0.25)


def test_assembled_columns_stay_in_range(spark):
    df = spark.createDataFrame([(1.0, 2.0, None, None, None, "face"), (-9.0, 3.0, 0.3, -0.2, 0.9, "text")],
                               "general DOUBLE, tampered DOUBLE, face DOUBLE, spectral DOUBLE, degradation_estimate DOUBLE, content STRING")
    out = fit.assemble(df, {b: (1.0, 0.0) for b in ("general", "tampered", "face", "spectral")}).select(*fixed.FUSION_COLUMNS).collect()
    assert len(out[0]) == 14 and all(0 <= v <= 1 for r in out for v in r)
    assert out[0].cal_face == 0.5 and out[0].face_present == 0 and out[1].content_text == 1


def test_near_dup_candidates_carry_keys_only_and_miss_nothing(spark):
    base = unit(300, 32, 8)
    rng = np.random.default_rng(9)
    noisy = base + rng.normal(0, 0.02, base.shape)
    noisy /= np.linalg.norm(noisy, axis=1, keepdims=True)
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(noisy)], "k LONG, x ARRAY<DOUBLE>")
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "k LONG, x ARRAY<DOUBLE>")
    tables = near_dup.n_tables(0.95, 9)
    assert tables < near_dup.n_tables(0.95, 20) < 35
    sides = [near_dup.probes(near_dup.signatures(df, tables, 9, 32), 9, near) for df, near in ((a, True), (b, False))]
    assert all("x" not in s.columns for s in sides) and sides[0].count() == 300 * tables * 10
    pairs = {(r.k, r.r) for r in near_dup.candidates(*sides, near_dup.sketch_cut(0.95, 1e-7)).collect()}
    want = {(i, j) for i, j in zip(*np.nonzero(noisy @ base.T >= 0.95))}
    assert want <= pairs and len(pairs) < 3 * len(want)


def test_table_functions(spark):
    from mediaguard.operators import table_functions as tf
    tf.register(spark)
    spark.createDataFrame([(1, 0), (2, 1)], "image_id INT, label INT").createOrReplaceTempView("tf_items")
    got = spark.sql("SELECT i.image_id, s.variant FROM tf_items i, LATERAL grid_settings(i.label, 1) s").collect()
    assert len(got) == 14 and {r.image_id for r in got} == {2} and len({r.variant for r in got}) == 14
    rows = [(v, float(t), p) for v in range(3) for t, p in [(0, 0.9), (10, 0.9), (20, 0.1), (9000, 0.1), (9010, 0.5)]]
    spark.createDataFrame(rows, "video_id INT, t DOUBLE, confidence DOUBLE").createOrReplaceTempView("tf_frames")
    got = spark.sql("SELECT * FROM verdict_runs(TABLE(tf_frames) PARTITION BY video_id ORDER BY (t), 100.0D)").collect()
    assert sorted(tuple(r) for r in got if r.video_id == 2) == [
        (2, "likely_ai", 0.0, 10.0, 2), (2, "likely_real", 20.0, 20.0, 1), (2, "likely_real", 9000.0, 9000.0, 1), (2, "uncertain", 9010.0, 9010.0, 1)] and len(got) == 12
    assert spark.sql("SELECT * FROM verdict_runs(TABLE(SELECT * FROM tf_frames WHERE false) PARTITION BY video_id ORDER BY (t), 100.0D)").count() == 0
