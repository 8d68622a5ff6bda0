"""One-pass ingest that survives restarts: label, quota, dedupe, append.

Each micro-batch writes its own ``batch=<id>`` folder.  A batch that is repeated after a
failure overwrites that folder, so rows are neither lost nor doubled.
"""
from __future__ import annotations

import threading

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from mediaguard import fixed
from mediaguard.functions import ids


def read(spark: SparkSession, folder: str, schema, glob: str | None = None, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream; the checkpoint replaces a row offset."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(folder)


def append(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Plain append of transformed rows."""
    return (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


class LabelMappingError(ValueError):
    """An ingest whose labels all fall into one class."""


def _tally(spark: SparkSession, folder: str, batch_id: int, schema: str) -> DataFrame:
    """What the batches before this one add up to: a few rows that each batch leaves beside the checkpoint."""
    return spark.read.schema(schema).parquet(f"{folder}/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], schema)


def admitted(stream: DataFrame, n: int, label: str = "label", key: str = "image_id", salts: int = 16) -> DataFrame:
    """At most ``n`` rows of each (label, salt) over the whole stream; the salt comes from the key.

    One counter per pair is all the state there is, in the state store of the checkpoint.  Within a batch the rows with the
    lowest draw are admitted, so a repeated batch admits the same ones.
    """
    schema = stream.schema
    salted = stream.withColumn("_draw", ids.draw_key(F.lit("quota"), F.col(key).cast("string"))).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))

    def take(_, parts, state):
        have = state.get[0] if state.exists else 0
        best = None
        for part in parts:
            if have < n:
                both = part if best is None else pd.concat([best, part])
                best = both.sort_values(["_draw", key]).head(n - have)
        if best is not None:
            state.update((have + len(best),))
            yield best[schema.names]
    return salted.groupBy(label, "_salt").applyInPandasWithState(take, schema, "taken LONG", "append", GroupStateTimeout.NoTimeout)


def take_quota(stream: DataFrame, out: str, checkpoint: str, n: int, label: str = "label", key: str = "image_id", classes: list | None = None) -> StreamingQuery:
    """Stop taking a class once it holds ``n`` rows, and stop the stream once all of ``classes`` do.

    ``admitted`` lets up to ``n`` rows of each (label, salt) pass, so a class that fills a whole stream is cut by many tasks;
    what is left is ranked against what the class still needs.  That number comes from the tally of the batch before
    (one row a class beside the checkpoint), never from the rows written earlier.
    """
    kind = stream.schema[label].dataType.simpleString()
    tally, schema, full = f"{checkpoint}/taken", f"{label} {kind}, have LONG", threading.Event()

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        have = _tally(spark, tally, batch_id, schema)
        rk = F.row_number().over(W.partitionBy(label).orderBy(ids.draw_key(F.lit("quota"), F.col(key).cast("string")), key))
        ranked = batch.withColumn("_rk", rk).where(F.col("_rk") <= n).join(have, label, "left")
        # the batch is read once: a second read would run its state again
        ranked.where(F.col("_rk") <= n - F.coalesce("have", F.lit(0))).select(*batch.columns).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        now = spark.read.schema(batch.schema).parquet(f"{out}/batch={batch_id}").groupBy(label).agg(F.count(F.lit(1)).alias("have"))
        have.unionByName(now).groupBy(label).agg(F.sum("have").alias("have")).coalesce(1).write.mode("overwrite").parquet(f"{tally}/batch={batch_id}")
        if classes is not None:
            done = spark.read.schema(schema).parquet(f"{tally}/batch={batch_id}").where(F.col(label).isin(classes) & (F.col("have") >= n))
            if done.count() == len(set(classes)):
                full.set()
    q = admitted(stream, n, label, key).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def watch() -> None:
        while q.isActive:
            if full.wait(0.2):
                q.stop()
    threading.Thread(target=watch, daemon=True).start()
    return q


def checked_labels(stream: DataFrame, out: str, checkpoint: str, label: str = "label", classes: tuple = (0, 1), at: int = fixed.FIRST_LABELS) -> StreamingQuery:
    """Append labelled rows, but fail as soon as ``at`` rows are in and a class has none.

    The counts are observed while each batch is written and added to those of the batches before; a wrong label
    mapping so costs a batch, not the whole stream.
    """
    schema = ", ".join(f"n{k} LONG" for k in range(len(classes)))

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark, seen = batch.sparkSession, Observation()
        usable = batch.where(F.col(label).isin(*classes))
        usable.observe(seen, *[F.count_if(F.col(label) == v).alias(f"n{k}") for k, v in enumerate(classes)]).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        before = _tally(spark, f"{checkpoint}/labels", batch_id, schema).first()
        counts = [seen.get[f"n{k}"] + (before[k] if before else 0) for k in range(len(classes))]
        spark.createDataFrame([tuple(counts)], schema).coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}/labels/batch={batch_id}")
        if sum(counts) >= at and min(counts) == 0:
            raise LabelMappingError(f"{sum(counts)} usable rows, by class {dict(zip(classes, counts))}")
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First row of each key within the watermark; state is dropped as the watermark passes."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def emit(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append mode into one folder per batch: each result is emitted once, when the watermark has passed it, and a
    repeated batch overwrites its own folder."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return (stream.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def dedupe_against_table(stream: DataFrame, out: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """First row of each key, however long ago: the state store keeps one entry per key for ever, earlier output is not read."""
    return emit(stream.dropDuplicates(keys), out, checkpoint)


def flush(stream: DataFrame, out: str, checkpoint: str, max_records: int = 10_000) -> StreamingQuery:
    """Bounded files per micro-batch; a failure loses at most the batch in flight."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("maxRecordsPerFile", max_records).parquet(f"{out}/batch={batch_id}")
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
