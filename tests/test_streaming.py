import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from mediaguard.streaming import ingest, video

ROWS = "image_id BIGINT, label INT"


def drop(spark, df, folder, i):
    df.coalesce(1).write.parquet(str(folder / f"part{i}"))


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))


def done(q):
    q.awaitTermination()
    assert q.exception() is None


def test_quota_over_batches_and_restart(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    for i in range(3):
        drop(spark, spark.range(i * 100, i * 100 + 100).select(F.col("id").alias("image_id"), F.expr("IF(id % 10 = 0, 1, 0)").alias("label")), src, i)
    done(ingest.take_quota(source(spark, src, ROWS), out, ck, 25))
    counts = {r.label: r["count"] for r in spark.read.parquet(out).groupBy("label").count().collect()}
    assert counts == {0: 25, 1: 25}
    drop(spark, spark.range(1000, 1200).selectExpr("id AS image_id", "1 AS label"), src, 9)
    done(ingest.take_quota(source(spark, src, ROWS), out, ck, 25))
    got = spark.read.parquet(out)
    assert got.count() == 50 and got.select("image_id").distinct().count() == 50


def test_dedupe_over_batches(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    for i in range(3):
        drop(spark, spark.range(i * 50, i * 50 + 100).selectExpr("id AS image_id", "0 AS label"), src, i)
    done(ingest.dedupe_against_table(source(spark, src, ROWS), out, str(tmp_path / "ck"), ["image_id"]))
    got = spark.read.parquet(out)
    assert got.count() == 200 and got.select("image_id").distinct().count() == 200


def test_watermark_dedupe_keeps_one(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    schema = "image_id BIGINT, variant STRING, ts TIMESTAMP"
    for i in range(2):
        drop(spark, spark.range(40).selectExpr("id % 10 AS image_id", "'clean' AS variant", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts"), src, i)
    done(ingest.append(ingest.dedupe(source(spark, src, schema), ["image_id", "variant"], "ts", "1 hour"), out, str(tmp_path / "ck")))
    assert spark.read.parquet(out).count() == 10


def test_windows_equal_batch_and_late_frames_drop(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    schema = "video_id INT, ts TIMESTAMP, confidence DOUBLE"
    day = spark.sql("""SELECT cast(id % 3 AS int) AS video_id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS ts,
                       bround(id * 37 % 101 / 100, 4) AS confidence FROM range(96)""")
    drop(spark, day, src, 1)
    late = spark.sql("SELECT 0 AS video_id, timestamp'2024-01-01 01:00:00' AS ts, 1.0D AS confidence")
    closing = spark.sql("SELECT 0 AS video_id, timestamp'2024-02-01 00:00:00' AS ts, 1.0D AS confidence")
    q = lambda: video.windowed(source(spark, src, schema)).selectExpr("w.start AS d", "video_id", "confidence", "n_frames", "n_ai")
    done(ingest.append(q(), out, str(tmp_path / "ck")))
    drop(spark, late, src, 2)
    done(ingest.append(q(), out, str(tmp_path / "ck")))
    drop(spark, closing, src, 3)
    done(ingest.append(q(), out, str(tmp_path / "ck")))
    got = {(str(r.d), r.video_id): (r.confidence, r.n_frames) for r in spark.read.parquet(out).collect()}
    want = {(str(r.d), r.video_id): (r.c, r.n) for r in day.groupBy(F.date_trunc("day", "ts").alias("d"), "video_id").agg(
        F.median("confidence").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    assert {k: v for k, v in got.items() if k in want and not k[0].startswith("2024-02")} == want


def progress(q):
    return [op.numRowsTotal for p in q.recentProgress for op in p.stateOperators]


def test_quota_stops_once_all_classes_are_full(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    for i in range(8):
        drop(spark, spark.range(i * 100, i * 100 + 100).selectExpr("id AS image_id", "cast(id % 2 AS int) AS label"), src, i)
    q = ingest.take_quota(source(spark, src, ROWS), out, ck, 60, classes=[0, 1])
    done(q)
    got = spark.read.parquet(out)
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {0: 60, 1: 60}
    assert got.agg(F.max("batch")).first()[0] < 7 and got.select("image_id").distinct().count() == 120


def test_quota_of_a_restarted_stream_equals_one_run(spark, tmp_path):
    def rows(i):
        return spark.range(i * 70, i * 70 + 70).selectExpr("id AS image_id", "cast(id % 5 = 0 AS int) AS label")
    one, two = tmp_path / "one", tmp_path / "two"
    for i in range(4):
        drop(spark, rows(i), one, i)
    done(ingest.take_quota(source(spark, one, ROWS), str(one) + "-out", str(one) + "-ck", 45))
    for i in range(4):  # a run ends after every file and another takes up its checkpoint
        drop(spark, rows(i), two, i)
        done(ingest.take_quota(source(spark, two, ROWS), str(two) + "-out", str(two) + "-ck", 45))
    a, b = ({r.image_id for r in spark.read.parquet(f"{d}-out").collect()} for d in (one, two))
    assert a == b and len(a) == 45 + 45


def test_quota_of_a_hot_class_reads_no_earlier_output(spark, tmp_path):
    src, out, ck = tmp_path / "src", tmp_path / "out", str(tmp_path / "ck")
    drop(spark, spark.range(2000).selectExpr("id AS image_id", "0 AS label"), src, 0)
    done(ingest.take_quota(source(spark, src, ROWS), str(out), ck, 30))
    (out / "batch=0").rename(tmp_path / "elsewhere")  # what was written may move on
    drop(spark, spark.range(2000, 2100).selectExpr("id AS image_id", "cast(id % 2 AS int) AS label"), src, 1)
    done(ingest.take_quota(source(spark, src, ROWS), str(out), ck, 30))
    assert {r.label: r["count"] for r in spark.read.parquet(str(out)).groupBy("label").count().collect()} == {1: 30}


def test_watermark_dedupe_forgets_and_drops_late_rows(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "image_id BIGINT, ts TIMESTAMP"
    day = lambda d: spark.range(50).selectExpr("id % 25 + 1000 * {0} AS image_id".format(d), f"timestamp'2024-01-{d + 1:02d} 00:00:00' AS ts")
    for d in range(6):
        drop(spark, day(d), src, d)
    drop(spark, day(0), src, 9)  # five days late, its state long gone
    q = ingest.emit(ingest.dedupe(source(spark, src, schema), ["image_id"], "ts", "1 day"), out, ck)
    done(q)
    got = spark.read.parquet(out)
    assert got.count() == 150 and got.select("image_id").distinct().count() == 150
    sizes = progress(q)
    assert max(sizes) <= 3 * 25 and sizes[-1] < max(sizes)  # not 150: keys go as the watermark moves


def test_sessions_are_emitted_once_and_leave_no_state(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "video_id INT, ts TIMESTAMP, confidence DOUBLE"
    for d in range(5):
        drop(spark, spark.range(40).selectExpr("cast(id % 10 AS int) AS video_id", f"timestamp'2024-01-{2 * d + 1:02d} 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts", "0.5D AS confidence"), src, d)
        done(q := ingest.emit(video.sessions(source(spark, src, schema), gap="1 hour").selectExpr("w.start AS s", "video_id", "n_frames"), out, ck))
    got = spark.read.parquet(out)
    assert got.count() == 40 and got.select("s", "video_id").distinct().count() == 40  # the last day is still open
    assert {r.n_frames for r in got.collect()} == {4} and progress(q)[-1] <= 20


def test_one_class_fails_after_the_first_rows(spark, tmp_path):
    src, good = tmp_path / "src", tmp_path / "good"
    for i in range(5):
        drop(spark, spark.range(i * 200, i * 200 + 200).selectExpr("id AS image_id", "1 AS label"), src, i)
        drop(spark, spark.range(i * 200, i * 200 + 200).selectExpr("id AS image_id", "cast(id % 7 = 0 AS int) AS label"), good, i)
    q = ingest.checked_labels(source(spark, src, ROWS), str(tmp_path / "out"), str(tmp_path / "ck"))
    with pytest.raises(StreamingQueryException, match="LabelMappingError"):
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400  # two of five files
    done(ingest.checked_labels(source(spark, good, ROWS), str(tmp_path / "out2"), str(tmp_path / "ck2")))
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 1000
