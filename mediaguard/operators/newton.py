"""Many logistic fits over one scan.

``logistic_many`` fits k models whose rows come from one table: a Newton step is one job, in which each task adds up
gradient and Hessian of all models over its rows, and the sums are merged in two levels.  ``sigmoids_by`` fits a
two-parameter sigmoid per group, for any number of groups at once: six sums per group and step, no Python worker.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from mediaguard.operators.lineage import cut_lineage
from mediaguard.operators.vector_jobs import Linear, to_matrix

SUMS = "model INT, part BINARY"


def _weights(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return np.asarray(batch["in_models"].flatten().to_numpy(zero_copy_only=False), float).reshape(-1, k)


def _partials(kernel, k: int):
    """Per task, the sum over its batches of ``kernel``'s k arrays."""
    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = to_matrix(b.column("x"))
                got = kernel(np.concatenate([x, np.ones((len(x), 1))], axis=1), b["label"].to_numpy(zero_copy_only=False).astype(float), _weights(b, k))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([row.tobytes() for row in total], pa.binary())], ["model", "part"])
    return run


def _merge(key: tuple, parts: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(p, float) for p in parts["part"].to_pylist())
    return pa.table({"model": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})


def sums(rows: DataFrame, kernel, k: int) -> np.ndarray:
    """The kernel's arrays over all rows, one line per model; what comes back is k lines."""
    parts = rows.select("x", "label", "in_models").mapInArrow(_partials(kernel, k), SUMS)
    width = math.isqrt(max(1, rows.rdd.getNumPartitions()))
    if width > 1:
        parts = parts.withColumn("lane", F.spark_partition_id() % width).groupBy("model", "lane").applyInArrow(lambda key, t: _merge(key, t), SUMS)
    got = parts.groupBy("model").applyInArrow(_merge, SUMS).collect()
    return np.stack([np.frombuffer(r.part, float) for r in sorted(got, key=lambda r: r.model)]) if got else np.zeros((k, 0))


def logistic_many(rows: DataFrame, k: int, c: float = 1.0, steps: int = 40, tol: float = 1e-10) -> list[Linear | None]:
    """k L2 logistic regressions with free intercepts over ``rows`` (x, label, in_models), where ``in_models`` holds the
    weight of the row in each model (0: not in it).

    The rows should be stored: every step reads them once.  A model without both classes is None.  A step that raises a
    model's loss is halved.
    """
    w, last, step = None, None, None
    for _ in range(steps + 1):
        at = w

        def kernel(x, y, m):
            v = np.zeros((k, x.shape[1])) if at is None else at
            z = x @ v.T
            p = 0.5 * (1 + np.tanh(z / 2))
            loss = (m * (np.logaddexp(0, z) - y[:, None] * z)).sum(0)
            grad = (m * (p - y[:, None])).T @ x
            hess = np.stack([(x * (m[:, i] * p[:, i] * (1 - p[:, i]))[:, None]).T @ x for i in range(k)])
            return np.concatenate([loss[:, None], (m * y[:, None]).sum(0)[:, None], m.sum(0)[:, None], grad, hess.reshape(k, -1)], axis=1)
        got = sums(rows, kernel, k)
        if not got.size:
            return [None] * k
        if w is None:
            d = next(d for d in range(1, got.shape[1]) if 3 + d + d * d == got.shape[1])
            w, last, step = np.zeros((k, d)), np.full(k, np.inf), np.zeros((k, d))
        both = (got[:, 1] > 0) & (got[:, 1] < got[:, 2])
        ridge = np.concatenate([np.full(d - 1, 1 / c), [0.0]])
        loss = got[:, 0] + 0.5 * (w * w * ridge).sum(1)
        grad = got[:, 3:3 + d] + w * ridge
        done = ~both | (np.abs(grad).max(axis=1) <= tol * np.maximum(got[:, 2], 1))
        if done.all():
            break
        for i in np.flatnonzero(~done):
            if loss[i] > last[i] * (1 + 1e-12) + 1e-12:  # too far: half way back
                step[i] /= 2
                w[i] = w[i] - step[i]
            else:
                last[i] = loss[i]
                step[i] = -np.linalg.solve(got[i, 3 + d:].reshape(d, d) + np.diag(ridge + 1e-12), grad[i])
                w[i] = w[i] + step[i]
        w = w.copy()
    return [Linear(tuple(float(v) for v in w[i, :-1]), float(w[i, -1])) if both[i] else None for i in range(k)]


def ridge_many(rows: DataFrame, k: int, alpha: float = 0.001) -> list[Linear | None]:
    """k ridge regressions on -1/+1 targets with free intercepts, in one job."""
    def kernel(x, y, m):
        t = 2 * y - 1
        return np.stack([np.concatenate([((x * m[:, i:i + 1]).T @ x).ravel(), (x * m[:, i:i + 1]).T @ t]) for i in range(k)])
    got = sums(rows, kernel, k)
    if not got.size:
        return [None] * k
    d = next(d for d in range(1, got.shape[1] + 1) if d * d + d == got.shape[1])
    out = []
    for g in got:
        a, b = g[:d * d].reshape(d, d), g[d * d:]
        v = np.linalg.solve(a + np.diag([alpha] * (d - 1) + [0.0]), b) if a[-1, -1] > 0 else None
        out.append(None if v is None else Linear(tuple(float(q) for q in v[:-1]), float(v[-1])))
    return out


def decide_many(rows: DataFrame, probes: list[Linear | None], x: str = "x", out: str = "zs") -> DataFrame:
    """Adds the logits of all probes as an array, in place of the vector; a missing probe gives null."""
    known = [p for p in probes if p is not None]
    w, b = np.array([p.w for p in known]).reshape(len(known), -1), np.array([p.b for p in known])
    keep = [f for f in rows.schema.fields if f.name != x]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                z = to_matrix(batch.column(x)) @ w.T + b if known else np.zeros((batch.num_rows, 0))
                wide = np.full((len(z), len(probes)), np.nan)
                wide[:, [i for i, p in enumerate(probes) if p is not None]] = z
                flat = pa.array(wide.ravel(), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, wide.size + 1, len(probes)), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], lists], names=[*[f.name for f in keep], out])
    return rows.mapInArrow(run, T.StructType([*keep, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def polished(rows: DataFrame, a: float, b: float, c: float, steps: int = 8) -> tuple[float, float]:
    """The optimum of sigmoid(a * s + b) near a solution; ``rows`` has s and label, and each step is one aggregate over them.

    The solution with the smallest gradient is returned, so rows of one class only leave it as it was.
    """
    best, least = (a, b), math.inf
    for _ in range(steps):
        if not (math.isfinite(a) and math.isfinite(b)):
            break
        q = rows.withColumn("p", F.expr(f"1 / (1 + exp(-({a!r}D * s + {b!r}D)))")).withColumn("v", F.expr("p * (1 - p)"))
        g = q.agg(F.sum(F.expr("(p - label) * s")).alias("ga"), F.sum(F.expr("p - label")).alias("gb"), F.sum(F.expr("v * s * s")).alias("haa"),
                  F.sum(F.expr("v * s")).alias("hab"), F.sum("v").alias("hbb")).first()
        ga, haa = g.ga + a / c, g.haa + 1.0 / c
        det, now = haa * g.hbb - g.hab * g.hab, math.hypot(ga, g.gb)
        if now >= least:
            break
        best, least = (a, b), now
        if det <= 0:
            break
        a, b = a - (g.hbb * ga - g.hab * g.gb) / det, b - (haa * g.gb - g.hab * ga) / det
    return best


def sigmoids_by(rows: DataFrame, by: list[str], score: str, label: str = "label", c: float = 1e6, steps: int = 14) -> DataFrame:
    """(by, a, b, n): per group the sigmoid(a * score + b) of a logistic fit with penalty 1 / c on a.

    Null scores take no part; a group without both classes has null a and b.  Each Newton step is one aggregate over all
    groups, combined in the tasks before it is shuffled, so a group of any size costs one row a task.
    """
    own = cut_lineage(rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*by, F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y")))
    at = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.min("y") < F.max("y")).alias("both"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    at = cut_lineage(at)
    for _ in range(steps):
        p = F.expr("1 / (1 + exp(-(a * s + b)))")
        q = own.join(at.where("both"), by).withColumn("p", p).withColumn("v", F.expr("p * (1 - p)"))
        g = q.groupBy(*by).agg(F.any_value("a").alias("a0"), F.any_value("b").alias("b0"), F.sum(F.expr("(p - y) * s")).alias("ga"), F.sum(F.expr("p - y")).alias("gb"),
                               F.sum(F.expr("v * s * s")).alias("haa"), F.sum(F.expr("v * s")).alias("hab"), F.sum("v").alias("hbb"))
        g = g.withColumns({"ga": F.col("ga") + F.col("a0") / c, "haa": F.col("haa") + 1.0 / c}).withColumn("det", F.expr("haa * hbb - hab * hab"))
        moved = g.select(*by, F.expr("(hbb * ga - hab * gb) / det").alias("da"), F.expr("(haa * gb - hab * ga) / det").alias("db"))
        move = F.coalesce(F.greatest(F.abs("da"), F.abs("db")), F.lit(0.0)).alias("moved")
        at = cut_lineage(at.join(moved, by, "left").select(*by, "n", "both", (F.col("a") - F.coalesce("da", F.lit(0.0))).alias("a"),
                                                           (F.col("b") - F.coalesce("db", F.lit(0.0))).alias("b"), move))
        if at.where("moved > 1e-10").isEmpty():
            break
        at = at.drop("moved")
    return at.select(*by, F.expr("if(both, a, null)").alias("a"), F.expr("if(both, b, null)").alias("b"), "n")
