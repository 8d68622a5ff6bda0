import math

from pyspark.sql import functions as F

from mediaguard import fixed
from mediaguard.functions import geometry as geo, ids, labels, scores, text, video


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_operating_point_is_half(spark):
    z = math.log(fixed.OPERATING_POINT / (1 - fixed.OPERATING_POINT))
    assert abs(one(spark, p=scores.shipped(F.lit(z))).p - 0.5) < 1e-12


def test_monotone_and_inside(spark):
    p = [r.p for r in spark.range(-30, 31).select(scores.shipped(F.col("id").cast("double")).alias("p")).collect()]
    assert all(a < b for a, b in zip(p, p[1:])) and 0 < p[0] and p[-1] < 1


def test_max_of_logits_is_max_of_sigmoids(spark):
    r = one(spark, a=scores.shipped(F.lit(0.3), F.lit(1.1)), b=F.greatest(scores.shifted(F.lit(0.3)), scores.shifted(F.lit(1.25 * 1.1))))
    assert abs(r.a - r.b) < 1e-12


def test_absent_face_changes_nothing(spark):
    r = one(spark, a=scores.shipped(F.lit(0.3), F.lit(0.1), F.lit(None).cast("double")), b=scores.shipped(F.lit(0.3), F.lit(0.1)),
            c=scores.shipped(F.lit(0.3), F.lit(0.1), F.lit(0.9)))
    assert r.a == r.b and r.c == 0.9


def test_four_decimals_half_even(spark):
    assert one(spark, p=F.bround(F.lit(0.123456), 4)).p == 0.1235


def test_variant_names():
    names = [f"{k}{p}".replace(".", "") for k, p in fixed.GRID]
    assert len(set(names)) == 14 and names[:2] == ["jpeg90", "jpeg70"] and "blur05" in names and "resize025" in names


def test_halves_partition_ids(spark):
    df = spark.range(5000).select(ids.content_id(F.col("id").cast("string")).alias("i"))
    n = {r.h: r["count"] for r in df.groupBy(ids.half("i").alias("h")).count().collect()}
    assert set(n) == {"a", "b"} and sum(n.values()) == 5000 and 0.45 < n["a"] / 5000 < 0.55
    both = df.where(ids.half("i", 0) == "a").groupBy(ids.half("i", 1).alias("h")).count().count()
    assert both == 2


def test_labels(spark):
    rows = [("0", 0, None), (" 1 ", 1, None), ("2", None, 1), ("7", None, None), ("REAL", 0, None), ("FULL_SYNTHETIC", 1, None), ("TAMPERED", None, 1)]
    df = spark.createDataFrame([(r[0],) for r in rows], "c STRING")
    got = [(r.a, r.b) for r in df.select(labels.to_label("c").alias("a"), labels.to_label("c", True).alias("b")).collect()]
    assert got == [(r[1], r[2]) for r in rows]


def test_quad_order_any_input_order(spark):
    pts = [(0., 0.), (10., 1.), (10., 5.), (0., 4.)]
    import itertools
    for perm in list(itertools.permutations(pts))[::5]:
        q = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in perm])
        r = one(spark, q=geo.order_quad(q), a=geo.quad_area(geo.order_quad(q)))
        assert [(p.x, p.y) for p in r.q] == pts and abs(r.a - 40) < 1e-9


def test_small_region_gives_no_strip(spark):
    r = one(spark, a=geo.strip_width(F.lit(7.0), F.lit(30.0)), b=geo.strip_width(F.lit(2000.0), F.lit(10.0)), c=geo.strip_width(F.lit(10.0), F.lit(100.0)))
    assert r.a is None and r.b == 672 and r.c == 56


def test_clip_keeps_400(spark):
    r = one(spark, a=text.clip_text(F.lit("a  b\n c")), b=text.clip_text(F.lit("x" * 401)), c=text.clip_text(F.lit("x" * 400)))
    assert r.a == "a b c" and len(r.b) == 400 and r.b.endswith("…") and r.c == "x" * 400


def test_frames(spark):
    r = one(spark, k=video.frame_indices(F.lit(60), F.lit(24.0), F.lit(1)), s=video.frame_indices(F.lit(3), F.lit(2.0), F.lit(4)))
    assert r.k == [0, 24, 48] and r.s == [0, 1, 2]


def test_reliability_words(spark):
    r = one(spark, a=scores.reliability(F.lit(0.99), F.lit(0.9), F.lit(None).cast("double")), b=scores.reliability(F.lit(0.5), F.lit(0.9), F.lit(0.1)))
    assert r.a == "high" and r.b == "low"
