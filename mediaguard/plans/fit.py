"""Fitting, calibration and combination of linear probes on Spark ML."""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from mediaguard import fixed
from mediaguard.functions import ids, scores
from mediaguard.operators import metrics as mt, newton
from mediaguard.operators.lineage import cut_lineage
from mediaguard.operators.vector_jobs import Linear


def family_folds(rows: DataFrame) -> DataFrame:
    """Fold number per row: generators in name order for AI rows, the id for reals.

    Only the distinct generators are ranked, a list that does not grow with the rows.
    """
    names = [r.generator for r in rows.where("label = 1").select("generator").distinct().orderBy("generator").collect()]
    order = F.create_map(*[F.lit(v) for i, n in enumerate(names) for v in (n, i)]) if names else None
    real = (ids.seed("image_id") % max(len(names), 1)).cast("int")
    return rows.withColumn("fold", F.when(F.col("label") == 1, order[F.col("generator")]).otherwise(real) if names else real)


def hard_negatives(neg: DataFrame, score: str, quantile: float = 0.9, copies: int = 3) -> DataFrame:
    """Negatives with the top slice repeated."""
    cut = mt.quantiles(neg, [], score, {"q": quantile}).first()["q"]
    n = F.when(F.col(score) >= cut, copies).otherwise(1)
    return neg.withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))


def _vector(df: DataFrame, x: str) -> DataFrame:
    return df.select(array_to_vector(F.col(x)).alias("features"), F.col("label").cast("double").alias("label"))


def logistic(df: DataFrame, x: str = "x", c: float = 1.0, max_iter: int = 300) -> Linear:
    """L2 logistic regression with a free intercept; ``df`` has ``x`` and ``label``.

    The summed-loss penalty ``1/C`` becomes ``1/(C n)`` for Spark's mean loss.
    """
    data = _vector(df, x).persist()
    try:
        n = data.count()
        m = LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-10).fit(data)
    finally:
        data.unpersist()
    return Linear(tuple(float(v) for v in m.coefficients), float(m.intercept))


def ridge(df: DataFrame, x: str = "x", alpha: float = 0.001) -> Linear:
    """Ridge on -1/+1 targets.  Spark divides the penalty by the target's deviation, so it is
    scaled by it here to keep the closed form."""
    data = _vector(df.withColumn("label", F.col("label") * 2 - 1), x).persist()
    try:
        s = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("sd")).first()
        m = LinearRegression(regParam=alpha * s.sd / s.n, elasticNetParam=0.0, standardization=False, solver="normal").fit(data)
    finally:
        data.unpersist()
    return Linear(tuple(float(v) for v in m.coefficients), float(m.intercept))


def platt(df: DataFrame, score: str, c: float = 1e6) -> tuple[float, float]:
    """(a, b) of the sigmoid that calibrates ``score``; nulls take no part.

    Spark's optimiser stops some 1e-8 from the optimum, which shows where results are rounded; Newton steps go the rest.
    """
    rows = cut_lineage(df.where(F.col(score).isNotNull() & F.col("label").isNotNull()).select(F.col(score).cast("double").alias("s"), F.col("label").cast("double").alias("label")))
    m = logistic(rows.select(F.array("s").alias("x"), "label"), c=c)
    return newton.polished(rows, m.w[0], m.b, c)


def fold_calibration(p: Linear, ab: tuple[float, float]) -> Linear:
    """Calibration folded into the weights: still one linear probe."""
    a, b = ab
    return Linear(tuple(a * v for v in p.w), a * p.b + b)


def mean_probe(probes: list[Linear]) -> Linear:
    w = np.mean([p.w for p in probes], axis=0)
    return Linear(tuple(float(v) for v in w), float(np.mean([p.b for p in probes])))


def decision(df: DataFrame, p: Linear, x: str = "x", out: str = "z") -> DataFrame:
    """Adds the probe's logit, in Arrow batches."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from mediaguard.operators.vector_jobs import to_matrix
    w, b = np.array(p.w), p.b
    keep = [f for f in df.schema.fields if f.name != x]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                z = to_matrix(batch.column(x)) @ w + b
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], pa.array(z)], names=[*[f.name for f in keep], out])
    return df.mapInArrow(run, T.StructType(keep + [T.StructField(out, T.DoubleType())]))


def rotated(train: DataFrame, calib: DataFrame) -> tuple[Linear, list[Linear]]:
    """Train with all calibration families but one, calibrate on that one, rotate, average.

    ``train`` has x, label; ``calib`` has image_id, generator, label, variant, x.  All ridge fits share one
    scan, and all calibrations are one grouped fit.
    """
    folds = cut_lineage(family_folds(calib).select("fold", "variant", "label", "x"))
    n = folds.agg(F.max("fold").alias("m")).first()["m"] + 1
    spine = train.select("x", "label", F.array_repeat(F.lit(1.0), n).alias("in_models"))
    extra = folds.where(F.col("variant").isin(fixed.KEPT_VARIANTS)).select(
        "x", "label", F.array(*[(F.col("fold") != k).cast("double") for k in range(n)]).alias("in_models"))
    probes = newton.ridge_many(spine.unionByName(extra), n)
    held = newton.decide_many(folds.select("fold", "label", "x"), probes).withColumn("z", F.get("zs", "fold"))
    ab = {r.fold: (r.a, r.b) for r in newton.sigmoids_by(held, ["fold"], "z", c=1.0).collect()}
    probes = [fold_calibration(p, ab[k]) for k, p in enumerate(probes)]
    return mean_probe(probes), probes


def moment_match(df: DataFrame, score: str, ref: str) -> tuple[float, float]:
    """(a, b) that give ``score`` the mean and deviation of ``ref``; no labels used."""
    s = df.agg(F.avg(score).alias("m"), F.stddev_pop(score).alias("s"), F.avg(ref).alias("rm"), F.stddev_pop(ref).alias("rs")).first()
    a = s.rs / s.s
    return a, s.rm - a * s.m


def calibrators(cal: DataFrame, tampered: DataFrame) -> dict[str, tuple[float, float]]:
    """Platt pairs per branch on half a; the edit branch pairs its own held-out rows with reals."""
    a = cal.where(ids.half("image_id", 0) == "a")
    pair = a.where("label = 0").select("tampered", "label").unionByName(tampered.select("tampered", F.lit(1).alias("label")))
    tasks = {"general": a, "face": a, "spectral": a, "tampered": pair}
    with ThreadPoolExecutor(len(tasks)) as pool:        # four independent jobs side by side
        return dict(zip(tasks, pool.map(lambda b: platt(tasks[b], b), tasks)))


def assemble(rows: DataFrame, cals: dict[str, tuple[float, float]]) -> DataFrame:
    """The combiner's frozen columns: absent branches get a neutral fill and a presence flag."""
    fill = F.lit(fixed.NEUTRAL_FILL)

    def cal(b):
        return F.coalesce(scores.platt(b, *cals[b]), fill)
    cols = {
        "cal_general": cal("general"), "cal_tampered": cal("tampered"), "cal_face": cal("face"),
        "face_present": F.col("face").isNotNull().cast("double"), "cal_spectral": cal("spectral"),
        "cal_text": fill, "text_present": F.lit(0.0),
        **{f"content_{n}": (F.col("content") == n).cast("double") for n in fixed.CONTENT_CLASSES},
        "degradation_estimate": F.coalesce("degradation_estimate", fill), "provenance_prior": fill}
    keep = [c for c in rows.columns if c not in cols]
    return rows.select(*keep, *[cols[n].alias(n) for n in fixed.FUSION_COLUMNS])


def fusion(assembled: DataFrame) -> Linear:
    """Logistic combiner over the frozen columns."""
    return logistic(assembled.select(F.array(*fixed.FUSION_COLUMNS).alias("x"), "label"))


def fuse(assembled: DataFrame, model: Linear, out: str = "fused") -> DataFrame:
    z = F.lit(model.b)
    for name, w in zip(fixed.FUSION_COLUMNS, model.w):
        z = z + F.col(name) * w
    return assembled.withColumn(out, scores.sigmoid(z))
