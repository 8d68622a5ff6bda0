"""Near-duplicate audit between two sets of unit vectors.

Candidates come from random-hyperplane codes in several tables.  The left side also probes every code that differs in one
bit, so a pair at the threshold is missed by one table with probability ``1 - p**bits - bits * (1 - p) * p**(bits - 1)`` where
``p = 1 - acos(t) / pi``; the number of tables is chosen so that all of them miss it with probability at most ``miss``.

Only codes, row keys and a sketch of ``SKETCH`` sign bits are shuffled.  Candidates whose sketches differ in more bits than a pair
at the threshold does (but for ``miss``) go at once; a vector is fetched once for each distinct pair that is left, and the exact
cosine decides.  No bucket is capped.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T, functions as F

from mediaguard.operators.lineage import cut_lineage
from mediaguard.operators.vector_jobs import to_matrix
from mediaguard.sources.spread import spread

SKETCH = 256


def n_tables(threshold: float, bits: int, miss: float = 1e-6) -> int:
    p = 1 - math.acos(threshold) / math.pi
    hit = p ** bits + bits * (1 - p) * p ** (bits - 1)
    return max(1, math.ceil(math.log(miss) / math.log(1 - hit))) if hit < 1 else 1


def sketch_cut(threshold: float, miss: float = 1e-6) -> int:
    """Most bits by which the sketches of a pair at the threshold differ, but for ``miss``."""
    q, total = math.acos(threshold) / math.pi, 0.0
    for k in range(SKETCH + 1):
        total += math.comb(SKETCH, k) * q ** k * (1 - q) ** (SKETCH - k)
        if total >= 1 - miss:
            return k
    return SKETCH


def signatures(df: DataFrame, tables: int, bits: int, dim: int, seed: int = 7) -> DataFrame:
    """(k, codes, sketch) of rows (k, x): a code per table, the sketch in whole numbers of 64 bits."""
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits + SKETCH))
    powers, wide = 1 << np.arange(bits, dtype=np.int64), np.uint64(1) << np.arange(64, dtype=np.uint64)

    def lists(a: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1]), pa.int32()), pa.array(a.ravel()))

    def run(batches):
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            signs = to_matrix(b.column("x")) @ planes > 0
            codes = (signs[:, :tables * bits].reshape(n, tables, bits) * powers).sum(2)
            sketch = (signs[:, tables * bits:].reshape(n, -1, 64) * wide).sum(2).astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("k"), lists(codes), lists(sketch)], names=["k", "codes", "sketch"])
    return df.select("k", "x").mapInArrow(run, "k LONG, codes ARRAY<LONG>, sketch ARRAY<LONG>")


def probes(signed: DataFrame, bits: int, near: bool) -> DataFrame:
    """(tab, bucket, k, s0..): one row per table, or also one per code that differs in one bit."""
    words = [F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH // 64)]
    flat = signed.select("k", *words, F.posexplode("codes").alias("tab", "code"))
    flips = [0, *[1 << j for j in range(bits)]] if near else [0]
    each = F.explode(F.array(*[F.col("code").bitwiseXOR(F.lit(f).cast("long")) for f in flips])) if near else F.col("code")
    return flat.select("tab", each.alias("bucket"), "k", *[f"s{i}" for i in range(SKETCH // 64)])


def candidates(left: DataFrame, right: DataFrame, cut: int) -> DataFrame:
    """Distinct (k, r) of probes that share a bucket and whose sketches are near."""
    far = " + ".join(f"bit_count(l.s{i} ^ q.s{i})" for i in range(SKETCH // 64))
    j = left.alias("l").join(right.alias("q"), F.expr("l.tab = q.tab AND l.bucket = q.bucket")).where(f"{far} <= {cut}")
    return j.select(F.col("l.k").alias("k"), F.col("q.k").alias("r")).distinct()


def close_pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    """Rows of (key, x, y) whose unit vectors reach the threshold; only keys are kept."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                cos = np.einsum("ij,ij->i", to_matrix(b.column("x")), to_matrix(b.column("y")))
                keep = np.flatnonzero(cos >= threshold)
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(keep))], names=["key"])
    return pairs.select("key", "x", "y").mapInArrow(run, T.StructType([pairs.schema["key"]])).distinct()


def near_duplicates(left: DataFrame, right: DataFrame, threshold: float = 0.95, bits: int | None = None, dim: int = 64,
                    miss: float = 1e-6) -> DataFrame:
    """Ids of ``left`` (columns id, x) that have a near copy in ``right`` (column x).

    Copies are collapsed first, so a group of identical vectors costs one.  A left vector is
    then tried against one representative of each of its buckets; in a dense bucket that
    settles nearly all of them, and only the rest meets the whole bucket.
    """
    def key():
        return F.sha2(F.to_json(F.struct("x")), 256)
    lk = left.select("id", "x", key().alias("key"))
    lx = lk.groupBy("key").agg(F.any_value("x").alias("x"))
    rx = right.select("x", key().alias("rkey")).groupBy("rkey").agg(F.any_value("x").alias("x"))
    exact = lx.join(rx.select(F.col("rkey").alias("key")), "key", "left_semi").select("key")
    # sides are used by both rounds, so they are cut here: later rounds read them back
    lx = cut_lineage(lx.join(exact, "key", "left_anti").withColumn("k", F.xxhash64("key")))
    rx = cut_lineage(rx.withColumn("k", F.xxhash64("rkey")))
    # about one unrelated vector per bucket, whatever the size of the right side
    bits = bits or min(62, max(8, math.ceil(math.log2(max(rx.count(), 2)))))
    tables, cut = n_tables(threshold, bits, miss), sketch_cut(threshold, miss / 10)
    rs = cut_lineage(signatures(spread(rx), tables, bits, dim))
    ls = cut_lineage(signatures(spread(lx), tables, bits, dim))
    index = probes(rs, bits, False)
    rep = index.groupBy("tab", "bucket").agg(F.min_by(F.struct(*[c for c in index.columns if c not in ("tab", "bucket")]), "k").alias("p")).select("tab", "bucket", "p.*")

    def settle(pairs: DataFrame) -> DataFrame:
        both = pairs.join(lx.select("k", "key", "x"), "k").join(rx.select(F.col("k").alias("r"), F.col("x").alias("y")), "r")
        return cut_lineage(close_pairs(both, threshold))
    first = settle(candidates(probes(ls, bits, True), rep, cut))
    rest = ls.join(first.select(F.xxhash64("key").alias("k")), "k", "left_anti")
    second = settle(candidates(probes(rest, bits, True), index, cut))
    found = exact.unionByName(first).unionByName(second)
    return lk.select("id", "key").join(found, "key", "left_semi").select("id")
