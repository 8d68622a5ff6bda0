"""File listings, catalogues and what is left to fetch."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mediaguard import fixed
from mediaguard.functions import ids


def images(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Image files below ``root`` by path; the extension test ignores case."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .where(is_image(F.col("path"))))
    return files.orderBy("path").limit(limit) if limit else files


# the extensions in either case, as the readers' file name filter takes them
IMAGE_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in fixed.IMAGE_EXTENSIONS) + "}"


def stored_name(path: Column) -> Column:
    """The name that ``images.write_files`` put into a path."""
    return F.url_decode(F.regexp_extract(path, "name=([^/]*)$", 1))


def stored(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(name, length) of the files that ``images.write_files`` left below ``root``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select(stored_name(F.col("path")).alias("name"), "length")


def named(spark: SparkSession, root: str) -> DataFrame:
    """The same of the image files only."""
    return stored(spark, root, IMAGE_GLOB)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(fixed.IMAGE_EXTENSIONS)


def refused(path: Column, anywhere: str = fixed.FORBIDDEN_ANYWHERE, prefixes: list[str] = fixed.FORBIDDEN_PREFIXES) -> Column:
    """True for a path that may not feed training: a forbidden word anywhere or at its start."""
    return reduce(lambda a, p: a | path.startswith(p), prefixes, path.contains(anywhere))


def check_fetch(plan: DataFrame, path: str, prefixes: list[str] = fixed.FORBIDDEN_PREFIXES, url: str | None = None) -> None:
    """Raise when a training fetch plan holds a refused path, or a URL with the forbidden word; one row is read."""
    bad = refused(F.col(path), prefixes=prefixes)
    hit = plan.where(bad | F.col(url).contains(fixed.FORBIDDEN_ANYWHERE) if url else bad).limit(1).collect()
    if hit:
        raise ValueError(f"refused for training: {hit[0][path]}")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def members(catalogue: DataFrame, path: str, order: str, prefix: str = "") -> DataFrame:
    """One member per distinct basename, the first in catalogue order."""
    m = catalogue.where(F.col(path).startswith(prefix) & ~F.col(path).endswith("/"))
    named = m.withColumn("name", basename(F.col(path)))
    return named.groupBy("name").agg(F.min_by(path, order).alias(path), F.min(order).alias(order))


def fetch_plan(wanted: DataFrame, local: DataFrame, key: str, seed: int = 0, limit: int = 0) -> DataFrame:
    """Wanted minus local.  With a limit, a seeded sample of the wanted names is taken first."""
    if limit:
        wanted = wanted.orderBy(ids.draw_key(F.lit(str(seed)), key), key).limit(limit)
    return wanted.join(local, key, "left_anti")


def pick_shards(files: DataFrame, path: str, split: str, seed: int = 42, max_shards: int = 0) -> DataFrame:
    """Shards of one split in seeded order, capped when asked."""
    f = files.where(F.col(path).endswith(".parquet") & F.col(path).contains(split))
    f = f.orderBy(ids.draw_key(F.lit(str(seed)), path), path)
    return f.limit(max_shards) if max_shards else f
