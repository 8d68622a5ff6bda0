"""Queries that once did less than their whole job or missed their optimum, beside their SQL."""
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from mediaguard.plans import fit
from mediaguard.plans.corpus import Corpus


def agrees(spark, sf_dir, key):
    state, n, _, message = check.compare(spark, check.connect(str(sf_dir)), entry.queries()[key], entry.oracle_sql()[key], str(sf_dir))
    assert state == "ok", message
    return n


def vectors(spark, folder, n, value):
    """An embeddings table in one file; ``value`` gives the vector's mean from (id, class)."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    rng = np.random.default_rng(3)
    cls = rng.integers(0, 8, n)
    x = rng.normal(0, 0.1, (n, 64)) + np.array([value(i, k) for i, k in enumerate(cls)])[:, None]
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())), "label": pa.array(cls.astype(np.int32))}),
                   f"{folder}/embeddings.parquet")


def test_platt_is_the_optimum(spark):
    rng = np.random.default_rng(2)
    s = rng.normal(0, 3, 500)
    y = (s * 0.1 + rng.normal(0, 1, 500) > 0.2).astype(int)
    df = spark.createDataFrame(list(zip(s.tolist(), y.tolist())), "s DOUBLE, label INT")
    for c in (1.0, 1e6):
        a, b = fit.platt(df, "s", c)
        p = 1 / (1 + np.exp(-(a * s + b)))
        assert abs(((p - y) * s).sum() + a / c) < 1e-9 and abs((p - y).sum()) < 1e-9


def test_a_calibration_that_turns_the_probe_round(spark, tmp_path):
    """The rows of the calibration lie the other way: the slope is negative, as the SQL reports it."""
    vectors(spark, tmp_path, 600, lambda i, k: (0.02 if k >= 4 else -0.02) * (-1 if 5 <= i % 10 <= 7 else 1))
    agrees(spark, tmp_path, "fit_fold_calibration")
    assert entry.queries()["fit_fold_calibration"](spark, str(tmp_path)).first().w_norm < 0


def test_all_gates_on_both_manifests(spark, sf):
    rows = entry.queries()["gov_all"](spark, sf).collect()
    assert len(rows) == 16 and {r.scope for r in rows} == {"manifest", "planted"}
    assert any(r.violations > 0 for r in rows if r.scope == "planted")


def test_windows_and_sessions_hold_every_frame(spark, sf):
    """Those still open when the stream ends too."""
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    for key in ("str_video_median", "str_video_session"):
        assert entry.queries()[key](spark, sf).agg(F.sum("n_frames")).first()[0] == n


def test_files_keep_any_name_and_few_folders(spark, tmp_path):
    from mediaguard.sources import images, listing
    names = ["a b.png", "a+b%2F.PNG", "_hid/den=1.png", ".x.Png", "\u00e9.jpg", "no.txt", "t.png.gif"] + [f"i{k}.png" for k in range(300)]
    raster = F.struct(F.lit(1).alias("height"), F.lit(2).alias("width"), F.lit(1).alias("nChannels"), F.unhex(F.lit("0A0B")).alias("data")).alias("raster")
    files = images.encoded(spark.createDataFrame([(n,) for n in names], "name STRING").select("name", raster))
    root = f"file://{tmp_path}/files"
    images.write_files(files.union(spark.createDataFrame([("void.png", b"")], "name STRING, content BINARY")), root, folders=4)
    want = {n for n in names if n.lower().endswith(("png", "jpg"))}
    assert len(list((tmp_path / "files").iterdir())) <= 4
    assert {r.name for r in listing.stored(spark, root).collect()} == {*names, "void.png"}
    assert sorted(r.name for r in listing.named(spark, root).collect()) == sorted({*want, "void.png"})
    found, seen = images.decode_named(spark, root)
    assert sorted((r.name, r.raster.data) for r in found.collect()) == sorted((n, b"\n\x0b") for n in want)
    assert seen.get == {"seen": len(want) + 1, "corrupt": 1}


def test_table_functions_make_no_data_frame_a_row(spark, sf):
    for key in ("udf_udtf", "udf_udtf_table"):
        plan = entry.queries()[key](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan


def test_text_regions_are_picked_inside_the_row(spark, tmp_path):
    """Ties, blanks, nulls and a document in two rows; what is sorted is a row a document row, not one a token."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    texts = ["aa bb " * 40 + "longest1 longest2", None, " \n ", "x", "\u00e9\u00e9\u00e9 abc 1234567 abc", "a1 b2 c3 " * 30, "two words"]
    ids = [1, 2, 3, 4, 5, 6, 7]
    pq.write_table(pa.table({"doc_id": pa.array(ids), "text": pa.array(texts)}), f"{tmp_path}/documents.parquet")
    assert agrees(spark, tmp_path, "win_largest_text") == 5
    agrees(spark, tmp_path, "win_top_text")
    for key, order, n in (("win_largest_text", "area", 1), ("win_top_text", "conf", 10)):
        plan = entry.queries()[key](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "posexplode" not in plan
        assert Corpus(spark, str(tmp_path)).best_tokens(order, n).groupBy("doc_id").count().agg(F.max("count")).first()[0] == n
    pq.write_table(pa.table({"doc_id": pa.array([8, 8]), "text": pa.array(["a bb", "c dd eeeeee"])}), f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in entry.queries()["win_largest_text"](spark, str(tmp_path)).collect()] == [(8, 2, "eeeeee")]
