import math
import random

import pytest
from pyspark.sql import functions as F

from mediaguard.operators import metrics as mt


def frame(spark, ys, ps, g="a"):
    return spark.createDataFrame([(g, y, float(p)) for y, p in zip(ys, ps)], "g STRING, label INT, p DOUBLE")


def brute(rows):
    pos, neg = [p for y, p in rows if y == 1], [p for y, p in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("ps,want", [([.1, .4, .6, .9], 1.0), ([.9, .6, .4, .1], 0.0)])
def test_auroc_golden(spark, ps, want):
    assert mt.auroc(frame(spark, [0, 0, 1, 1], ps), "g", "p").first().auroc == want


def test_confusion_golden(spark):
    r = mt.confusion(frame(spark, [0, 0, 1, 1], [.9, .4, .6, .4]), "g", "p").first()
    assert (r.prec, r.rec, r.acc) == (0.5, 0.5, 0.5)
    r = mt.confusion(frame(spark, [0, 0], [.1, .2]), "g", "p").first()
    assert r.prec is None and r.rec is None and r.fpr == 0


def test_one_class_is_null(spark):
    assert mt.auroc(frame(spark, [0, 0], [.1, .2]), "g", "p").first().auroc is None


def test_auroc_ties_skew_partitions_and_monotone_maps(spark):
    rnd = random.Random(1)
    rows = [("hot", rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(3000)]
    rows += [(f"g{i % 20}", rnd.randint(0, 1), round(rnd.random(), 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "g STRING, label INT, p DOUBLE")
    want = {g: brute([(y, p) for h, y, p in rows if h == g]) for g in {r[0] for r in rows}}
    for n in (1, 3, 11):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got = {r.g: r.auroc for r in mt.auroc(df.repartition(n), "g", "p").collect()}
        assert got.keys() == want.keys()
        assert all(got[g] == pytest.approx(want[g], abs=1e-12) if want[g] is not None else got[g] is None for g in want)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    warped = mt.auroc(df.withColumn("p", F.exp("p") * 3 - 7), "g", "p").collect()
    assert all(r.auroc == pytest.approx(want[r.g], abs=1e-12) for r in warped if want[r.g] is not None)


def test_auroc_shared_matches_replication(spark):
    rnd = random.Random(2)
    rows = [(1, f"g{rnd.randint(0, 4)}", round(rnd.random(), 2)) for _ in range(400)] + [(0, "unknown", round(rnd.random(), 2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "label INT, gen STRING, p DOUBLE")
    got = {r.gen: r.auroc for r in mt.auroc_shared(df, [], "gen", "p").collect()}
    neg = [(0, p) for y, _, p in rows if y == 0]
    for g in {r[1] for r in rows if r[0] == 1}:
        assert got[g] == pytest.approx(brute([(1, p) for y, h, p in rows if y == 1 and h == g] + neg), abs=1e-12)


def test_weighted_auroc_is_replication(spark):
    rows = [(0, .2, 2), (0, .5, 1), (1, .5, 3), (1, .9, 1), (0, .7, 0)]
    df = spark.createDataFrame(rows, "label INT, p DOUBLE, w INT")
    want = brute([(y, p) for y, p, w in rows for _ in range(w)])
    assert mt.auroc(df, [], "p", weight="w").first().auroc == pytest.approx(want)


def test_reliability_edges_and_empty_bins(spark):
    r = mt.reliability(frame(spark, [1, 0, 1], [.3, .1 + .2, 1.0]), "g", "p").orderBy("bin").collect()
    assert len(r) == 10 and sum(x.n for x in r) == 3 and r[3].n == 2 and r[9].n == 1 and r[0].conf == 0


def test_platt_lowers_ece(spark):
    from mediaguard.functions import scores
    from mediaguard.plans import fit
    rnd = random.Random(0)
    rows = [(y, rnd.gauss(2 * y - 1, 1) * 20) for y in (rnd.randint(0, 1) for _ in range(6000))]
    df = spark.createDataFrame(rows, "label INT, s DOUBLE")
    a, b = fit.platt(df, "s")
    p = df.select("label", scores.platt("s", a, b).alias("p"), scores.sigmoid("s").alias("raw"))
    cal, raw = mt.ece(p, [], "p").first().ece, mt.ece(p, [], "raw").first().ece
    assert cal < raw and cal < 0.02


def test_threshold_curve_matches_direct_counts(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), p) for p in [0.0, 1.0, 0.02, 0.5, 0.98] + [rnd.random() for _ in range(300)] + mt.threshold_grid()[::17]]
    df = spark.createDataFrame(rows, "label INT, p DOUBLE")
    for r in mt.threshold_curve(df, [], "p").collect():
        assert r.tp == sum(y == 1 and p >= r.t for y, p in rows) and r.fp == sum(y == 0 and p >= r.t for y, p in rows)


def test_plateau_prefers_reported_ends(spark):
    df = frame(spark, [0] * 50 + [1] * 50, [0.3] * 50 + [0.7] * 50)
    r = mt.plateau(mt.threshold_curve(df, "g", "p"), "g").first()
    assert math.isclose(r.lo, 0.302) and math.isclose(r.hi, 0.7) and r.best_acc == 1.0
