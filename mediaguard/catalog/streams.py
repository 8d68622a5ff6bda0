"""Streams run to the end of the available data, then read back."""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from mediaguard.catalog.base import query, sig
from mediaguard.functions import scores
from mediaguard.sources import scratch
from mediaguard.streaming import ingest, video

r6 = lambda c: F.round(c, 6)


def events(c, folder: str | None = None):
    """The events table as a stream of scored frames: all at hand in one batch, or the files of a staged folder one by one."""
    kind = c.table("events").schema
    s = ingest.read(c.spark, c.sf_dir, kind, "events.parquet", 1 << 30) if folder is None else ingest.read(c.spark, f"{folder}/*", kind, files_per_trigger=1)
    v = F.col("value")
    return s.select("event_id", F.col("user_id").alias("video_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value",
                    F.bround(v / (v + 20), 4).alias("confidence"))


def staged(c, slices: int = 6, late: bool = False) -> str:
    """The events in ``slices`` files or more, written in order of time as they would arrive; ``late`` sends those of the first
    slice once more at the end."""
    out = scratch.folder(c.spark, "arrivals")
    span = c.table("events").select(F.min("ts").alias("a"), F.max("ts").alias("b")).selectExpr("unix_micros(cast(a AS timestamp)) AS a", "unix_micros(cast(b AS timestamp)) - unix_micros(cast(a AS timestamp)) + 1 AS w").first()
    part = F.expr(f"(unix_micros(cast(ts AS timestamp)) - {span.a}L) * {slices}L div {span.w}L") if span.a is not None else F.lit(0)
    for turn, k in enumerate([*range(slices), *([0] if late else [])]):
        c.table("events").where(part == k).write.parquet(f"{out}/turn{turn}")
    return out


def finish(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query("src_stream", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def src_stream(c):
    out, ck = scratch.folder(c.spark, "stream"), scratch.folder(c.spark, "ck")
    finish(ingest.append(events(c).select("event_type", "value"), out, ck))
    return c.spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("str_ingest", f"SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, round({sig('(value - 50) / 25')}, 6) AS score FROM events WHERE event_type <> 'view'")
def str_ingest(c):
    out, ck = scratch.folder(c.spark, "ingest"), scratch.folder(c.spark, "ck")
    labelled = events(c).withColumn("label", F.expr("CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN 1 ELSE 0 END")).where("label IS NOT NULL")
    finish(ingest.append(labelled.select("event_id", "label", r6(scores.sigmoid((F.col("value") - 50) / 25)).alias("score")), out, ck))
    return c.spark.read.parquet(out)


@query("str_quota", "SELECT event_type AS label, least(count(*), 300) AS taken FROM events GROUP BY event_type")
def str_quota(c):
    out, ck = scratch.folder(c.spark, "quota"), scratch.folder(c.spark, "ck")
    rows = events(c, staged(c)).select(F.col("event_id").alias("image_id"), F.col("event_type").alias("label"))
    names = [r.event_type for r in c.table("events").select("event_type").distinct().collect()]
    finish(ingest.take_quota(rows, out, ck, 300, classes=names))
    return c.spark.read.parquet(out).groupBy("label").agg(F.count(F.lit(1)).alias("taken"))


@query("str_dedupe", "SELECT DISTINCT user_id AS video_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events")
def str_dedupe(c):
    """The first event of a kind per video and day.  Events of the first days arrive a second time, long after their state has
    gone: the watermark, six days behind, drops them."""
    out, ck = scratch.folder(c.spark, "dedupe"), scratch.folder(c.spark, "ck")
    rows = events(c, staged(c, late=True)).select("video_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts")
    finish(ingest.emit(ingest.dedupe(rows, ["video_id", "event_type", "day"], "ts", "6 days"), out, ck))
    return c.spark.read.parquet(out).select("video_id", "event_type", "day")


@query("str_dedupe_all", "SELECT DISTINCT user_id AS video_id, event_type FROM events")
def str_dedupe_all(c):
    out, ck = scratch.folder(c.spark, "dedupe"), scratch.folder(c.spark, "ck")
    finish(ingest.dedupe_against_table(events(c).select("video_id", "event_type"), out, ck, ["video_id", "event_type"]))
    return c.spark.read.parquet(out).select("video_id", "event_type")


@query("str_flush", "SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids, round(sum(value), 2) AS total FROM events")
def str_flush(c):
    out, ck = scratch.folder(c.spark, "flush"), scratch.folder(c.spark, "ck")
    finish(ingest.flush(events(c).select("event_id", "value"), out, ck, 1000))
    return c.spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"), F.round(F.sum("value"), 2).alias("total"))


def closed(c, verdicts, out: str):
    """All windows or sessions of the events: those that the watermark passes are emitted as the stream runs, those still open
    when it has ended by a last frame, long after the others, that a second run takes up from the checkpoint."""
    ck, beat = scratch.folder(c.spark, "ck"), scratch.folder(c.spark, "beat")
    last = c.table("events").agg(F.max(F.col("ts").cast("timestamp")).alias("ts"))
    nobody = [F.lit(None).cast(f.dataType).alias(f.name) for f in events(c).schema if f.name != "ts"]
    beats = last.where("ts IS NOT NULL").select(*nobody, (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    beats.limit(0).write.parquet(beat)  # the folder is there, without a frame
    kind = c.spark.read.parquet(beat).schema

    def run() -> None:
        finish(ingest.emit(verdicts(events(c).unionByName(ingest.read(c.spark, beat, kind))), out, ck))
    run()
    beats.write.mode("append").parquet(beat)
    run()


@query("str_video_median", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, video_id, round(median(confidence), 6) AS confidence, count(*) AS n_frames, count(*) FILTER (confidence >= 0.6) AS n_ai
    FROM frames GROUP BY 1, 2""")
def str_video_median(c):
    """Every day of a video, emitted once: when the watermark has passed it or the stream has ended."""
    out = scratch.folder(c.spark, "median")
    closed(c, lambda frames: video.windowed(frames).withColumn("day", F.date_format("w.start", "yyyy-MM-dd")).drop("w"), out)
    return c.spark.read.parquet(out).select("day", "video_id", r6("confidence").alias("confidence"), "n_frames", "n_ai")


@query("str_video_session", """SELECT video_id, count(*) AS n_frames, round(median(confidence), 6) AS confidence, count(*) FILTER (confidence >= 0.6) AS n_ai FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY ts, frame_id) AS s FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY video_id ORDER BY ts, frame_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM frames)) GROUP BY video_id, s""")
def str_video_session(c):
    """Every session, emitted once: when the watermark has passed it or the stream has ended."""
    out = scratch.folder(c.spark, "session")
    closed(c, lambda frames: video.sessions(frames).drop("w"), out)
    return c.spark.read.parquet(out).select("video_id", "n_frames", r6("confidence").alias("confidence"), "n_ai")


@query("gov_label_sanity", """SELECT source, count(*) AS usable, count(*) FILTER (label = 0) AS reals, count(*) FILTER (label = 1) AS ai, count(*) >= 300 AND min(label) = max(label) AS suspicious FROM raw_rows GROUP BY source""")
def gov_label_sanity(c):
    """Each source as an ingest of its own; those with one class only fail in their first batch."""
    rows = scratch.folder(c.spark, "sources")
    c.raw_rows().select("source", "image_id", "label").write.partitionBy("source").parquet(rows)
    names = sorted(r.source for r in c.spark.read.parquet(rows).select("source").distinct().collect())

    def one(name):
        out, ck = scratch.folder(c.spark, "labelled"), scratch.folder(c.spark, "ck")
        q = ingest.checked_labels(ingest.read(c.spark, f"{rows}/source={name}", "image_id STRING, label INT", files_per_trigger=1 << 30), out, ck)
        try:
            q.awaitTermination()
            stopped = False
        except StreamingQueryException as e:
            if "LabelMappingError" not in str(e):
                raise
            stopped = True
        return c.spark.read.parquet(out).select(F.lit(name).alias("source"), "label", F.lit(stopped).alias("suspicious"))
    with ThreadPoolExecutor(4) as pool:
        parts = list(pool.map(one, names))
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("source", "suspicious").agg(
        F.count(F.lit(1)).alias("usable"), F.count_if(F.col("label") == 0).alias("reals"), F.count_if(F.col("label") == 1).alias("ai"))
