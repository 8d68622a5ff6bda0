"""Dense-vector work in Arrow batches: degrade, score and classify in one narrow stage.

Array lambdas in the JVM are interpreted element by element, about a microsecond each; a
768-number vector under 15 settings would cost milliseconds per image.  Here a task turns an
Arrow batch into one matrix and does each step as a matrix operation.  Models are a few
vectors that every task receives with its closure; their size depends on the dimension only.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from mediaguard import fixed

SETTINGS = [(0, "clean", 0.0, "clean")] + [
    (i + 1, k, float(p), f"{k}{p}".replace(".", "")) for i, (k, p) in enumerate(fixed.GRID)]


@dataclass(frozen=True)
class Linear:
    """One linear probe."""
    w: tuple
    b: float


@dataclass(frozen=True)
class Models:
    """What a scoring task needs: probes by branch and, optionally, unit prototypes."""
    probes: dict = field(default_factory=dict)
    prototypes: tuple = ()
    names: tuple = ()


def to_matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Fixed-length list column to an (n, d) float64 matrix without a Python loop."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(arr), -1) if len(arr) else np.zeros((0, 0))


def to_lists(m: np.ndarray) -> pa.Array:
    n, d = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d), pa.int32()), pa.array(m.ravel()))


def degrade(x: np.ndarray, seed: np.ndarray, idx: int, kind: str, param: float) -> np.ndarray:
    """One setting applied to all rows; noise and gain are drawn from the row's id."""
    d = x.shape[1]
    if kind == "clean":
        return x
    if kind == "jpeg":                      # coarser quantisation for lower quality
        step = (100 - param) / 1000
        return np.rint(x / step) * step
    if kind == "blur":                      # circular three-point smoothing
        return (1 - param / 4) * x + (param / 8) * np.roll(x, 1, 1) + (param / 8) * np.roll(x, -1, 1)
    if kind == "resize":                    # mean over a block, spread back over the block
        k = int(round(1 / param))
        return np.repeat(x.reshape(len(x), d // k, k).mean(2), k, axis=1)
    if kind == "noise":
        j = np.arange(1, d + 1, dtype=np.int64)
        u = ((seed[:, None] * (j * 7919) + j * 104729 + idx * 15485863) % 1000003) / 1000003.0
        return x + param * (u - 0.5)
    if kind == "jitter":
        return x * (1 + param * (2 * ((seed % 1009) / 1009.0) - 1))[:, None]
    take = 6 + np.floor(np.arange(d) * param).astype(int)   # centre window stretched back
    return x[:, take]


_EXTRA = [T.StructField("idx", T.IntegerType()), T.StructField("variant", T.StringType())]


def score_grid(items: DataFrame, models: Models, settings=SETTINGS, keep_x: bool = False) -> DataFrame:
    """One row per (image, setting): a logit per probe, magnitude statistics, nearest prototype.

    ``items`` carries ``x`` and the integer draw ``h8``; other columns pass through.  The
    stage is narrow: nothing is shuffled between reading a vector and its 15 scores.
    """
    meta = [f for f in items.schema.fields if f.name != "x"]
    names = list(models.probes)
    out = T.StructType(meta + _EXTRA + [T.StructField(n, T.DoubleType()) for n in names] + [
        T.StructField(n, T.DoubleType()) for n in ("abs_lo", "abs_hi")]
        + ([T.StructField("content", T.StringType())] if models.prototypes else [])
        + ([T.StructField("x", T.ArrayType(T.DoubleType()))] if keep_x else []))
    weights = np.array([models.probes[n].w for n in names]).T if names else None
    bias = np.array([models.probes[n].b for n in names])
    protos = np.array(models.prototypes).T if models.prototypes else None
    labels = np.array(models.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            x = to_matrix(batch.column("x"))
            seed = batch.column("h8").to_numpy(zero_copy_only=False).astype(np.int64)
            kept = {f.name: batch.column(f.name) for f in meta}
            content = pa.array(labels[np.argmax(x @ protos, axis=1)]) if protos is not None else None
            half = x.shape[1] // 2
            for idx, kind, param, variant in settings:
                v = degrade(x, seed, idx, kind, param)
                cols = dict(kept)
                cols["idx"] = pa.array(np.full(n, idx, np.int32))
                cols["variant"] = pa.array([variant] * n)
                if weights is not None:
                    z = v @ weights + bias
                    for i, name in enumerate(names):
                        cols[name] = pa.array(z[:, i])
                a = np.abs(v)
                cols["abs_lo"], cols["abs_hi"] = pa.array(a[:, :half].mean(1)), pa.array(a[:, half:].mean(1))
                if content is not None:
                    cols["content"] = content
                if keep_x:
                    cols["x"] = to_lists(v)
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return items.mapInArrow(run, out)


def score_chains(items: DataFrame, models: Models, combine) -> DataFrame:
    """One row per (image, first, second) with the combined score of the chained settings.

    Holds one first-stage matrix at a time, so memory is two matrices per batch, not 196.
    ``combine`` turns the (n, branches) logit matrix into scores.
    """
    meta = [f for f in items.schema.fields if f.name != "x"]
    names = list(models.probes)
    out = T.StructType(meta + [T.StructField("first", T.StringType()), T.StructField("second", T.StringType()),
                               T.StructField("score", T.DoubleType())])
    weights = np.array([models.probes[n].w for n in names]).T
    bias = np.array([models.probes[n].b for n in names])
    stages = SETTINGS[1:]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            x = to_matrix(batch.column("x"))
            seed = batch.column("h8").to_numpy(zero_copy_only=False).astype(np.int64)
            kept = {f.name: batch.column(f.name) for f in meta}
            for i, (idx, kind, param, first) in enumerate(stages):
                stage = degrade(x, seed, idx, kind, param)
                for j, (_, kind2, param2, second) in enumerate(stages):
                    v = degrade(stage, seed, 100 + len(stages) * i + j, kind2, param2)
                    cols = dict(kept)
                    cols["first"], cols["second"] = pa.array([first] * n), pa.array([second] * n)
                    cols["score"] = pa.array(combine(v @ weights + bias))
                    yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return items.mapInArrow(run, out)


def shipped_numpy(z: np.ndarray, shift: float, scale: float) -> np.ndarray:
    """Emitted score of (general, tampered) logits, for tasks that score before emitting rows."""
    return 1.0 / (1.0 + np.exp(-(np.maximum(z[:, 0], scale * z[:, 1]) - shift)))


def classify(items: DataFrame, models: Models) -> DataFrame:
    """Nearest prototype of each vector by dot product; the lowest index wins a tie."""
    meta = [f for f in items.schema.fields if f.name != "x"]
    protos, labels = np.array(models.prototypes).T, np.array(models.names)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                k = np.argmax(to_matrix(batch.column("x")) @ protos, axis=1)
                cols = {f.name: batch.column(f.name) for f in meta}
                cols["content"] = pa.array(labels[k])
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return items.mapInArrow(run, T.StructType(meta + [T.StructField("content", T.StringType())]))


def group_means(df: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """Mean vector and count per group: each batch is summed per group before the shuffle.

    What is shuffled is one vector per group and batch, whatever the number of rows.
    """
    keys = [df.schema[b] for b in by]
    part = T.StructType(keys + [T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = to_matrix(batch.column(x))
            t = pa.table({b: batch.column(b) for b in by})
            combo = t.to_pandas()
            code, uniq = combo.groupby(by, dropna=False, sort=True).ngroup().to_numpy(), combo.drop_duplicates()
            order = combo.assign(_c=code).drop_duplicates("_c").sort_values("_c")
            sums = np.zeros((len(uniq), m.shape[1]))
            np.add.at(sums, code, m)
            cols = [pa.array(order[b], type=t.schema.field(b).type) for b in by]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(np.bincount(code, minlength=len(uniq)).astype(np.int64)), to_lists(sums)],
                names=[*by, "n", "s"])
    from pyspark.sql import functions as F
    parts = df.select(*by, x).mapInArrow(run, part)
    cells = parts.select(*by, "n", F.posexplode("s").alias("i", "v")).groupBy(*by, "i").agg(
        F.sum("v").alias("v"), F.sum("n").alias("n"))
    return cells.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("v") / F.col("n")).alias("m")))),
                    lambda e: e["m"]).alias("mean"), F.max("n").alias("n"))


def mean_pool(df: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """Renormalised mean of the few vectors of each key (the tiles of one strip).

    For keys with a bounded number of vectors: they meet as one list and are averaged in
    Arrow.  For groups of any size use ``group_means``.
    """
    from pyspark.sql import functions as F
    lists = df.groupBy(*by).agg(F.collect_list(x).alias("xs"), F.count(F.lit(1)).alias("n"))
    keys = [lists.schema[b] for b in by]
    out = T.StructType(keys + [T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                xs = batch.column("xs")
                inner = to_matrix(xs.flatten())
                starts = np.asarray(xs.offsets)[:-1] - np.asarray(xs.offsets)[0]
                v = np.add.reduceat(inner, starts, axis=0)
                v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-9
                yield pa.RecordBatch.from_arrays([*[batch.column(b) for b in by], to_lists(v), batch.column("n")], names=[*by, "v", "n"])
    return lists.mapInArrow(run, out)
