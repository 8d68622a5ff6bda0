"""Ranking, threshold and calibration metrics as grouped jobs.

Every ordered step works on scores that were first summed per (group, score) and is
range-partitioned, so one large group spreads over many tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mediaguard.operators.lineage import cut_lineage


def _keys(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def score_counts(df: DataFrame, by, score: str, label: str, weight: str | None = None) -> DataFrame:
    """One row per (group, score) with the weight of positives and negatives."""
    w = F.col(weight) if weight else F.lit(1)
    return df.groupBy(*_keys(by), F.col(score).alias("_s")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).cast("double").alias("_pos"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(0)).cast("double").alias("_neg"))


def auroc(df: DataFrame, by, score: str, label: str = "label", weight: str | None = None,
          out: str = "auroc", cut: float | None = None) -> DataFrame:
    """Exact AUROC per group, ties counted half, null where a group has one class.

    The distinct scores are range-partitioned by (group, score).  Each range reports its own
    pair count and class totals; a running sum over the ranges, of which there are as many as
    partitions, adds the pairs that straddle ranges.  No group is ever sorted in one task.
    With ``cut`` the counts and rates at that threshold come from the same pass.
    """
    by = _keys(by)
    counts = score_counts(df.where(F.col(score).isNotNull()), by, score, label, weight)
    ranged = counts.repartitionByRange(*by, "_s").withColumn("_part", F.spark_partition_id())
    below = F.coalesce(F.sum("_neg").over(
        W.partitionBy(*by, "_part").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    parts = (ranged.withColumn("_pairs", F.col("_pos") * (below + F.col("_neg") / 2))
             .groupBy(*by, "_part")
             .agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"),
                  F.sum("_pairs").alias("_pairs"), F.min("_s").alias("_lo"),
                  *([] if cut is None else [F.sum(F.when(F.col("_s") >= cut, F.col(c)).otherwise(0.0)).alias(c + "_hit")
                                            for c in ("_pos", "_neg")])))
    key = by or [F.lit(0)]
    before = F.coalesce(F.sum("_neg").over(
        W.partitionBy(*key).orderBy("_lo").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    pairs = parts.withColumn("_pairs", F.col("_pairs") + F.col("_pos") * before)
    p, n = F.sum("_pos"), F.sum("_neg")
    base = [F.when((p > 0) & (n > 0), F.sum("_pairs") / (p * n)).alias(out),
            p.cast("long").alias("n_pos"), n.cast("long").alias("n_neg")]
    if cut is None:
        return pairs.groupBy(*by).agg(*base)
    counted = pairs.groupBy(*by).agg(*base, F.sum("_pos_hit").cast("long").alias("tp"), F.sum("_neg_hit").cast("long").alias("fp"))
    full = counted.withColumn("tn", F.col("n_neg") - F.col("fp")).withColumn("fn", F.col("n_pos") - F.col("tp"))
    return full.select("*", *rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def auroc_shared(df: DataFrame, by, group: str, score: str, label: str = "label", out: str = "auroc") -> DataFrame:
    """AUROC of each positive group against all negatives of ``by``.

    The negatives are ordered once and shared; they are never copied per group.
    """
    by = _keys(by)
    rows = df.where(F.col(score).isNotNull())
    counts = rows.groupBy(*by, F.col(score).alias("_s"),
                          F.when(F.col(label) == 1, F.col(group)).alias("_g")).agg(
        F.count_if(F.col(label) == 1).cast("double").alias("_pos"),
        F.count_if(F.col(label) == 0).cast("double").alias("_neg"))
    ranged = counts.repartitionByRange(*by, "_s").withColumn("_part", F.spark_partition_id())
    upto = F.sum("_neg").over(W.partitionBy(*by, "_part").orderBy("_s")
                              .rangeBetween(W.unboundedPreceding, W.currentRow))
    here = F.sum("_neg").over(W.partitionBy(*by, "_part", "_s"))
    parts = (ranged.withColumn("_below", upto - here / 2)
             .groupBy(*by, "_part", "_g")
             .agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"),
                  F.sum(F.col("_pos") * F.col("_below")).alias("_pairs"), F.min("_s").alias("_lo")))
    # a range holds one row per group; its negatives and lower end are spread to all of them
    per = W.partitionBy(*by, "_part")
    ends = parts.withColumn("_n", F.sum("_neg").over(per)).withColumn("_lo", F.min("_lo").over(per))
    key = by or [F.lit(0)]
    before = (F.sum("_neg").over(W.partitionBy(*key).orderBy("_lo").rangeBetween(W.unboundedPreceding, W.currentRow))
              - F.col("_n"))
    tot = F.sum("_neg").over(W.partitionBy(*key))
    done = ends.withColumn("_pairs", F.col("_pairs") + F.col("_pos") * before).withColumn("_tot", tot)
    p = F.sum("_pos")
    return (done.where(F.col("_g").isNotNull()).groupBy(*by, F.col("_g").alias(group))
            .agg(F.when((p > 0) & (F.max("_tot") > 0), F.sum("_pairs") / (p * F.max("_tot"))).alias(out),
                 p.cast("long").alias("n_pos"), F.max("_tot").cast("long").alias("n_neg")))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> list[Column]:
    return [safe_div(tp + tn, tp + fp + tn + fn).alias("acc"), safe_div(tp, tp + fp).alias("prec"),
            safe_div(tp, tp + fn).alias("rec"), safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
            safe_div(fp, fp + tn).alias("fpr"), safe_div(fn, fn + tp).alias("fnr")]


def confusion(df: DataFrame, by, score: str, label: str = "label", cut: Column | float = 0.5) -> DataFrame:
    """Counts and rates at a threshold; a rate without denominator is null."""
    hat, y = F.col(score) >= cut, F.col(label)
    tp, fp = F.count_if(hat & (y == 1)), F.count_if(hat & (y == 0))
    fn, tn = F.count_if(~hat & (y == 1)), F.count_if(~hat & (y == 0))
    return df.where(F.col(score).isNotNull()).groupBy(*_keys(by)).agg(
        tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"), *rates(tp, fp, tn, fn))


def reliability(df: DataFrame, by, prob: str, label: str = "label", bins: int = 10) -> DataFrame:
    """Mean confidence and observed frequency in equal-width bins; empty bins are kept.

    A value on an edge belongs to the bin above it, compared with the literal edges.
    """
    by = _keys(by)
    edges = [i / bins for i in range(1, bins)]
    b = F.lit(0)
    for e in edges:
        b = b + (F.col(prob) >= e).cast("int")
    sums = df.groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(prob).alias("_c"), F.sum(label).alias("_f"))
    frame = sums.groupBy(*by).agg(F.lit(1).alias("_one")).drop("_one") if by else None
    grid = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    every = (frame.select(*by, grid) if by
             else df.sparkSession.range(1).select(grid))
    full = every.join(sums, [*by, "bin"], "left")
    return full.select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"),
                       (F.coalesce("_c", F.lit(0.0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("conf"),
                       (F.coalesce("_f", F.lit(0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("freq"))


def ece(df: DataFrame, by, prob: str, label: str = "label", bins: int = 10) -> DataFrame:
    """Bin-weighted mean of |confidence - frequency|."""
    r = reliability(df, by, prob, label, bins)
    return r.groupBy(*_keys(by)).agg(
        (F.sum(F.col("n") * F.abs(F.col("conf") - F.col("freq"))) / F.sum("n")).alias("ece"),
        F.sum("n").alias("n"))


def threshold_grid(lo: float = 0.02, hi: float = 0.98, n: int = 481) -> list[float]:
    step = (hi - lo) / (n - 1)
    return [round(lo + i * step, 6) for i in range(n)]


def threshold_curve(df: DataFrame, by, score: str, label: str = "label",
                    lo: float = 0.02, hi: float = 0.98, n: int = 481) -> DataFrame:
    """Confusion counts at every threshold of an even grid.

    Each row is binned once by how many thresholds it passes; suffix sums over the bins give
    the counts, so rows are never multiplied by thresholds.  At most n+1 bins per group.
    """
    by = _keys(by)
    grid = threshold_grid(lo, hi, n)
    step = (hi - lo) / (n - 1)
    edges = F.array(*[F.lit(t) for t in grid])
    # arithmetic position, then corrected against the literal edge on either side
    guess = F.greatest(F.least(F.floor((F.col(score) - lo) / step).cast("int") + 1, F.lit(n)), F.lit(0))
    up = (guess < n) & (F.col(score) >= F.get(edges, guess))
    down = (guess > 0) & (F.col(score) < F.get(edges, guess - 1))
    passed = guess + F.when(up, 1).when(down, -1).otherwise(0)
    bins = df.where(F.col(score).isNotNull()).groupBy(*by, passed.alias("_k")).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    totals = bins.groupBy(*by).agg(F.sum("_p").alias("pos"), F.sum("_n").alias("neg"))
    ks = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_k")
    frame = totals.select(*by, "pos", "neg", ks)
    joined = frame.join(bins, [*by, "_k"], "left")
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("_k"))
    tp = F.sum(F.coalesce("_p", F.lit(0))).over(w)
    fp = F.sum(F.coalesce("_n", F.lit(0))).over(w)
    return joined.select(
        *by, F.get(edges, F.col("_k") - 1).alias("t"), tp.alias("tp"), fp.alias("fp"),
        (F.col("neg") - fp).alias("tn"), (F.col("pos") - tp).alias("fn"),
        ((tp + F.col("neg") - fp) / (F.col("pos") + F.col("neg"))).alias("acc"))


def plateau(curve: DataFrame, by, tol: float = 0.01) -> DataFrame:
    """Lowest and highest threshold whose accuracy is within ``tol`` of the best."""
    by = _keys(by)
    best = F.max("acc").over(W.partitionBy(*(by or [F.lit(0)])))
    return (curve.withColumn("best", best).where(F.col("acc") >= F.col("best") - tol)
            .groupBy(*by).agg(F.min("t").alias("lo"), F.max("t").alias("hi"),
                              F.max("best").alias("best_acc")))


def histogram(df: DataFrame, by, score: str, bins: int = 45) -> DataFrame:
    """Equal bins over [0, 1]; the last bin is closed."""
    b = F.least(F.floor(F.col(score) * bins).cast("int"), F.lit(bins - 1))
    return df.groupBy(*_keys(by), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def running_counts(df: DataFrame, by, score: str, label: str | None = "label") -> DataFrame:
    """Per (group, distinct score): ``_pos`` and ``_neg``, their sums at or below it (``_pos_upto``, ``_neg_upto``)
    and in the group (``_pos_all``, ``_neg_all``).

    The distinct scores are range-partitioned by (group, score) and written once; sums run inside
    a range and start from those of the ranges before, of which there are as many as
    partitions.  No group is sorted in one task.  Without a label every row counts as positive.
    """
    by = _keys(by)
    rows = df.where(F.col(score).isNotNull())
    counts = score_counts(rows if label else rows.withColumn("_one", F.lit(1)), by, score, label or "_one")
    ranged = cut_lineage(counts.repartitionByRange(*by, "_s").withColumn("_part", F.spark_partition_id()))
    key = W.partitionBy(*(by or [F.lit(0)]))
    before = key.orderBy("_lo").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "_part").agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"), F.min("_s").alias("_lo"))
    starts = sums.select(*by, "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}_from") for c in ("_p", "_n")],
                         F.sum("_p").over(key).alias("_pos_all"), F.sum("_n").over(key).alias("_neg_all"))
    inside = W.partitionBy(*by, "_part").orderBy("_s").rowsBetween(W.unboundedPreceding, 0)
    run = ranged.withColumns({"_pos_upto": F.sum("_pos").over(inside), "_neg_upto": F.sum("_neg").over(inside)})
    joined = run.join(starts.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_part").alias("_k_part"), "_p_from", "_n_from", "_pos_all", "_neg_all"),
                      [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by] + [F.col("_part") == F.col("_k_part")])
    return joined.select(*by, "_s", "_pos", "_neg", (F.col("_pos_upto") + F.col("_p_from")).alias("_pos_upto"),
                         (F.col("_neg_upto") + F.col("_n_from")).alias("_neg_upto"), "_pos_all", "_neg_all")


def quantiles(df: DataFrame, by, score: str, points: dict[str, float]) -> DataFrame:
    """Exact quantiles per group, linear between neighbours; one column for each point."""
    run = running_counts(df, by, score, None)
    first, place = F.col("_pos_upto") - F.col("_pos"), lambda q: (F.col("_pos_all") - 1) * F.lit(q)
    at = lambda rank: F.max(F.when((first <= rank) & (rank < F.col("_pos_upto")), F.col("_s")))
    part = lambda q: F.max(place(q) - F.floor(place(q)))
    return run.groupBy(*_keys(by)).agg(*[
        (at(F.floor(place(q))) + (at(F.ceil(place(q))) - at(F.floor(place(q)))) * part(q)).alias(n) for n, q in points.items()])


def roc_points(df: DataFrame, by, score: str, label: str = "label") -> DataFrame:
    """TPR and FPR at every distinct score: the shares at or above it."""
    run = running_counts(df, by, score, label)
    above = lambda c: safe_div(F.col(f"{c}_all") - F.col(f"{c}_upto") + F.col(c), F.col(f"{c}_all"))
    return run.select(*_keys(by), F.col("_s").alias("t"), above("_pos").alias("tpr"), above("_neg").alias("fpr"))


def tpr_at_fpr(df: DataFrame, by, score: str, target: float = 0.01, label: str = "label") -> DataFrame:
    """Largest TPR whose FPR does not exceed ``target``, 0 when no point qualifies."""
    pts = roc_points(df, by, score, label)
    return pts.groupBy(*_keys(by)).agg(
        F.coalesce(F.max(F.when(F.col("fpr") <= target, F.col("tpr"))), F.lit(0.0)).alias("tpr"))


def log2_stats(df: DataFrame, by, px: str) -> DataFrame:
    """Mean and population deviation of log2(px); a zero deviation reads 1."""
    z = F.log2(F.greatest(F.col(px).cast("double"), F.lit(1.0)))
    sd = F.stddev_pop(z)
    return df.groupBy(*_keys(by)).agg(F.avg(z).alias("px_mu"),
                                      F.when(sd == 0, 1.0).otherwise(sd).alias("px_sd"))
