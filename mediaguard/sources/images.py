"""Decoding of image files with Spark's own readers."""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from mediaguard.sources.listing import IMAGE_GLOB, extension, images, is_image, stored_name

RASTER = "struct<height:int,width:int,nChannels:int,data:binary>"


def _rgb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The image source keeps blue, green, red (and alpha); turn them to red, green, blue."""
    for b in batches:
        rasters = b["raster"].to_pylist()
        for r in rasters:
            n = r["nChannels"]
            if n >= 3:
                px = np.frombuffer(r["data"], np.uint8).reshape(-1, n)
                r.update(nChannels=3, data=np.ascontiguousarray(px[:, 2::-1]).tobytes())
        yield pa.RecordBatch.from_arrays([b["path"], pa.array(rasters, b.schema.field("raster").type)], schema=b.schema)


def undecoded(spark: SparkSession, root: str) -> DataFrame:
    """Per extension: image files listed and how many of them no reader of this session decodes
    (corrupt files, and whole formats such as WebP that the JDK has no reader for)."""
    bare = F.regexp_replace("path", "^[a-z]+:/+", "/").alias("path")  # readers write the scheme in their own ways
    ok = decode_files(spark, root).select(bare).withColumn("ok", F.lit(True))
    every = images(spark, root).select(bare)
    return every.join(ok, "path", "left").groupBy(extension(F.col("path")).alias("extension")).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("ok").isNull()).alias("undecoded"))


def decode_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, raster) of every decodable image below ``root``, channels in red, green, blue; ``undecoded`` counts the others."""
    df = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(root)
    found = df.select(F.col("image.origin").alias("path"), F.struct(
        "image.height", "image.width", "image.nChannels", "image.data").cast(RASTER).alias("raster")).where(is_image(F.col("path")))
    return found.mapInArrow(_rgb, found.schema)


def encode_png(raster: dict) -> bytes:
    """An 8-bit grey or RGB raster as a PNG file."""
    h, w, n = raster["height"], raster["width"], raster["nChannels"]
    rows = np.frombuffer(raster["data"], np.uint8).reshape(h, w * n)
    body = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()  # every row unfiltered

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if n == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def encoded(df: DataFrame, raster: str = "raster", out: str = "content") -> DataFrame:
    """Replace rasters by PNG bytes."""
    keep = [f for f in df.schema.fields if f.name != raster]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b[f.name] for f in keep], pa.array([encode_png(r) for r in b[raster].to_pylist()], pa.binary())], [*[f.name for f in keep], out])
    return df.mapInArrow(run, StructType([*keep, StructField(out, BinaryType())]))


def write_files(df: DataFrame, root: str, folders: int = 256) -> None:
    """One file per row of (name, content), names being distinct, dealt over a bounded number of folders: ``root/<number>/name=<name>``.

    Spark has no writer of single binary files, and a folder per file makes listings dear; the tasks put the bytes into the shared
    folder themselves (whatever pyarrow opens: local, HDFS, object stores), where a repeated task overwrites its own files.  A line feed
    that image formats don't mind comes after the bytes, as Spark's listings pass over empty files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        made, n = set(), 0
        for b in batches:
            for name, content in zip(b["name"].to_pylist(), b["content"].to_pylist()):
                folder = f"{base}/{zlib.crc32(name.encode()) % folders}"
                if folder not in made:
                    files.create_dir(folder)
                    made.add(folder)
                with files.open_output_stream(f"{folder}/name={quote(name, safe='')}", buffer_size=0) as out:
                    out.write((content or b"") + b"\n")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})
    files, base = fs.FileSystem.from_uri(root)
    files.create_dir(base)
    df.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n LONG").agg(F.sum("n")).collect()


def decode_named(spark: SparkSession, root: str) -> tuple[DataFrame, Observation]:
    """(name, raster) of the image files of ``write_files`` that decode, channels in red, green, blue, and an observation that counts
    ``seen`` and ``corrupt`` ones while they are read."""
    seen = Observation()
    df = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", IMAGE_GLOB).load(root)
    df = df.withColumn("path", F.col("_metadata.file_path"))
    df = df.observe(seen, F.count(F.lit(1)).alias("seen"), F.count_if(F.coalesce(F.col("image.height") < 0, F.lit(True))).alias("corrupt"))
    found = df.where("image.height >= 0").select("path", F.struct(
        "image.height", "image.width", "image.nChannels", "image.data").cast(RASTER).alias("raster"))
    return found.mapInArrow(_rgb, found.schema).select(stored_name(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))).alias("name"), "raster"), seen


def checked(df: DataFrame, raster: str = "raster") -> DataFrame:
    """Adds ``ok``: the data length agrees with the declared size."""
    r = F.col(raster)
    return df.withColumn("ok", F.coalesce(F.length(r["data"]) == r["height"] * r["width"] * r["nChannels"], F.lit(False)))


def decoded(df: DataFrame, raster: str = "raster"):
    """Rows that decode, and an observation that counts the skipped ones as the job runs."""
    seen = Observation()
    out = checked(df, raster).observe(seen, F.count_if(~F.col("ok")).alias("skipped"), F.count(F.lit(1)).alias("seen"))
    return out.where("ok"), seen
