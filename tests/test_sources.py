import pytest
from pyspark.sql import functions as F

from mediaguard.operators import vector_jobs as vj
from mediaguard.sources import listing, models, sinks, vectors
from mediaguard.sources.spread import spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_append_twice_and_load_one_source(spark, tmp_path):
    out = str(tmp_path / "v")
    df = spark.range(40).selectExpr("cast(id AS string) AS image_id", "IF(id % 4 = 0, 'a', 'ab') AS source", "array(cast(id AS double)) AS x")
    vectors.append(df, out)
    vectors.append(df.where("image_id IN ('0', '1')"), out)
    got = vectors.load(spark, out, "a")
    assert got.where("source <> 'a'").count() == 0 and got.select("image_id").distinct().count() == 10
    assert "PartitionFilters: [isnotnull(source" in plan(got)


def test_row_files_by_name(spark, tmp_path):
    head = "image_id,source\n"
    for name, source in (("rows_a_000.csv", "a"), ("rows_face_a_000.csv", "a"), ("rows_spec_a_000.csv", "a"), ("rows_smoke_0.csv", "smoke_x")):
        (tmp_path / name).write_text(head + f"i,{source}\n")
    got = vectors.read_row_files(spark, str(tmp_path), "image_id STRING, source STRING").collect()
    assert [r.file for r in got] == ["rows_a_000.csv"]


def test_cache_resumes(spark, tmp_path):
    out = str(tmp_path / "cache")
    want = spark.range(20).select(F.col("id").alias("k"))
    assert sinks.todo(want, spark, out, "k").count() == 20
    sinks.commit(want.where("k < 5").union(want.where("k < 5")), out, "k")
    left = sinks.todo(want, spark, out, "k")
    assert left.count() == 15
    sinks.commit(left, out, "k")
    assert spark.read.parquet(out).count() == 20 and sinks.todo(want, spark, out, "k").count() == 0


def test_results_round_trip(spark, tmp_path):
    rows = [("p", "d1", "clean", 0.5, 0.25), ("p", "d2", "clean", 0.75, 1.0), ("q", "d1", "blur20", 0.125, 0.5)]
    df = spark.createDataFrame(rows, "population STRING, detector STRING, setting STRING, auroc DOUBLE, acc DOUBLE")
    sinks.write_results(df, str(tmp_path / "r"))
    assert sorted(tuple(r) for r in sinks.read_results(spark, str(tmp_path / "r")).collect()) == sorted(rows)


def test_members_first_wins_and_fetch_plan(spark):
    cat = spark.createDataFrame([(1, "x/a.png"), (2, "y/a.png"), (3, "y/b.png"), (4, "z/"), (5, "w/c.png")], "o INT, path STRING")
    got = {r.name: r.path for r in listing.members(cat, "path", "o").collect()}
    assert got == {"a.png": "x/a.png", "b.png": "y/b.png", "c.png": "w/c.png"}
    names = spark.createDataFrame([(n,) for n in got], "name STRING")
    assert {r.name for r in listing.fetch_plan(names, names.where("name = 'a.png'"), "name").collect()} == {"b.png", "c.png"}
    assert listing.fetch_plan(names, names.where("name = 'zz'"), "name", 3, 2).count() == 2


def test_quarantined_fetch_is_refused(spark):
    bad = spark.createDataFrame([("coco/val2017/1.jpg",)], "path STRING")
    with pytest.raises(ValueError, match="refused"):
        listing.check_fetch(bad, "path")
    listing.check_fetch(spark.createDataFrame([("coco/train2017/1.jpg",)], "path STRING"), "path")
    for row in (("DALLE/Advanced/DALLE3/1.png", "u"), ("x/1.png", "http://h/val2017.zip")):
        with pytest.raises(ValueError):
            listing.check_fetch(spark.createDataFrame([row], "path STRING, url STRING"), "path", url="url")


def test_models_by_version(spark, tmp_path):
    out = str(tmp_path / "m")
    for v, b in (("v1", 1.0), ("v2", 2.0)):
        models.write(models.models_table(spark, vj.Models({"general": vj.Linear((1.0, 2.0), b)}), v), out)
    assert models.load(spark, out, "v2").probes == {"general": vj.Linear((1.0, 2.0), 2.0)}


def test_spread_leaves_large_inputs_alone_and_keeps_pruning(spark, sf):
    wide = spark.range(100, numPartitions=64)
    assert spread(wide) is wide
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet")).where("lang = 'en'").select("doc_id")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan(docs) and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan(docs)


@pytest.mark.parametrize("key", ["agg_auroc_by_variant", "join_branch_left", "join_threshold", "win_top_text", "agg_reliability", "join_nearest_frame"])
def test_no_nested_loop_plans(spark, sf, key):
    import __spark_entry__ as entry
    text = plan(entry.queries()[key](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_bucketed_sides_join_without_a_shuffle(spark):
    from mediaguard.operators.joins import branches_left
    from mediaguard.sources.buckets import bucketed
    df = spark.range(300).selectExpr("cast(id % 100 AS string) AS image_id", "concat('v', id div 100) AS variant", "id * 1.0D AS general", "IF(id % 3 = 0, id * 2.0D, NULL) AS spectral",
                                     "id % 2 = 0 AS has_face", "id * 3.0D AS face")
    rows = bucketed(df, "t", ["image_id", "variant"], 4)
    got = branches_left(rows.select("image_id", "variant", "general"), rows.where("spectral is not null").select("image_id", "variant", "spectral").hint("merge"),
                        rows.where("has_face").select("image_id", "variant", "face").hint("merge"))
    assert "Exchange" not in plan(got) and plan(got).count("SortMergeJoin") == 2
    assert got.count() == 300 and got.where("spectral is not null").count() == 100 and got.where("face = 3 * general").count() == 150


def test_a_source_is_read_without_those_that_continue_its_name(spark, tmp_path):
    out = str(tmp_path / "v")
    df = spark.range(60).selectExpr("cast(id AS string) AS image_id", "element_at(array('a', 'a_ext', 'b'), cast(id % 3 + 1 AS int)) AS source", "array(cast(id AS double)) AS x")
    vectors.append(df, out)
    got = vectors.load(spark, out, "a")
    read = {r[0].split("source=")[1].split("/")[0] for r in got.select(F.input_file_name()).distinct().collect()}
    assert read == {"a"} and got.count() == 20
    assert "PartitionFilters: [isnotnull(source" in plan(got) and "DataFilters: []" in plan(got)


@pytest.mark.parametrize("channels", [1, 3])
def test_rasters_survive_files_and_corrupt_ones_are_counted(spark, tmp_path, channels):
    from mediaguard.sources import images
    import numpy as np
    rng = np.random.default_rng(3)
    rows = [(f"f{i}.{'png' if i % 4 else 'txt'}", (5, 7 + i, channels, bytearray(rng.integers(0, 256, 5 * (7 + i) * channels, dtype=np.uint8).tobytes()))) for i in range(12)]
    df = spark.createDataFrame(rows, f"name string, raster {images.RASTER}")
    files = images.encoded(df)
    root = str(tmp_path / "i")
    images.write_files(files.selectExpr("name", "IF(name IN ('f1.png', 'f2.png'), substring(content, 1, 30), IF(name = 'f3.png', cast('' AS binary), content)) AS content"), root)
    found, seen = images.decode_named(spark, root)
    got = {r.name: (r.raster.height, r.raster.width, r.raster.nChannels, bytes(r.raster.data)) for r in found.collect()}
    want = {n: (*v[:3], bytes(v[3])) for n, v in rows if n.endswith("png") and n not in ("f1.png", "f2.png", "f3.png")}
    assert got == want and seen.get == {"seen": 9, "corrupt": 3}
    assert {r.name for r in listing.named(spark, root).collect()} == {n for n, _ in rows if n.endswith("png")}
