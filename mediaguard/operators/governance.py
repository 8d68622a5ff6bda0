"""Split resolution, the calibration carve and the gates that must report no violation."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mediaguard import fixed
from mediaguard.functions import ids
from mediaguard.operators.sampling import top_n

N_VARIANTS = len(fixed.GRID) + 1


def split_rank(split, parity: bool = True) -> Column:
    """Priority of a split, 99 when unlisted.

    With ``parity`` off, unlisted ``test*`` splits outrank everything that trains, so an eval
    split that nobody listed cannot lose an image to training.
    """
    split = split if isinstance(split, Column) else F.col(split)
    rank = reduce(lambda acc, it: acc.when(split == it[1], it[0]), enumerate(fixed.SPLIT_PRIORITY),
                  F.when(F.lit(False), 0))
    if not parity:
        rank = rank.when(split.startswith("test"), 2)
    return rank.otherwise(99)


def resolve_splits(rows: DataFrame, parity: bool = True) -> DataFrame:
    """One split per image, the highest priority wins; rows of other splits are dropped.

    The distinct splits per image, which combine map-side, are ranked; the rows then meet their
    image's winner in one equi-join.
    """
    keep = top_n(rows.select("image_id", "split").distinct(), ["image_id"], [split_rank("split", parity).asc(), F.asc("split")], 1)
    return rows.join(keep, ["image_id", "split"], "left_semi")


def dedupe_key(rows: DataFrame, order: str = "file_ord") -> DataFrame:
    """First row per (image, variant) in file order; each task sends one row per key at most."""
    return top_n(rows, ["image_id", "variant"], [F.asc(order)], 1)


def carve(rows: DataFrame, source: str, generators: list[str], real_one_in: int = 3) -> DataFrame:
    """Move whole generator families and one real in three of ``source`` to calibration."""
    ai = (F.col("label") == 1) & F.col("generator").isin(generators)
    real = (F.col("label") == 0) & ids.one_in("image_id", real_one_in)
    return rows.withColumn("split", F.when((F.col("source") == source) & (ai | real), "calib_ood")
                           .otherwise(F.col("split")))


def _gate(df: DataFrame, name: str, bad: Column) -> DataFrame:
    return df.agg(F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("violations")).select(
        F.lit(name).alias("gate"), "violations")


def gate_quarantine(rows, source="organizer_val", split="test_organizer"):
    """The quarantined source exists and all of it sits in its own split."""
    r = rows.where(F.col("source") == source)
    return r.agg(F.when(F.count(F.lit(1)) == 0, 1).otherwise(F.count_if(F.col("split") != split))
                 .cast("long").alias("violations")).select(F.lit("quarantine").alias("gate"), "violations")


def gate_ood_only(rows, source="ood_eval"):
    return _gate(rows.where(F.col("source") == source), "ood_only",
                 ~F.col("split").isin("test_ood", "calib_ood"))


def gate_generators_disjoint(rows, source="ood_eval"):
    """Generators on both sides of the carve, plus one for each empty side."""
    g = (rows.where((F.col("source") == source) & (F.col("label") == 1)).groupBy("generator")
         .agg(F.bool_or(F.col("split") == "calib_ood").alias("c"),
              F.bool_or(F.col("split") == "test_ood").alias("t")))
    return g.agg((F.count_if(F.col("c") & F.col("t"))
                  + F.when(F.count_if("c") > 0, 0).otherwise(1)
                  + F.when(F.count_if("t") > 0, 0).otherwise(1)).cast("long").alias("violations")
                 ).select(F.lit("generators_disjoint").alias("gate"), "violations")


def gate_images_disjoint(rows, source="ood_eval"):
    g = (rows.where(F.col("source") == source).groupBy("image_id")
         .agg(F.bool_or(F.col("split") == "calib_ood").alias("c"),
              F.bool_or(F.col("split") == "test_ood").alias("t")))
    return _gate(g, "images_disjoint", F.col("c") & F.col("t"))


def gate_calib(rows, source="core_calib"):
    return _gate(rows.where(F.col("source") == source), "calib_only", F.col("split") != "calib")


def split_spans(rows: DataFrame) -> DataFrame:
    """Images seen under more than one split; min and max suffice, no distinct needed."""
    return (rows.groupBy("image_id").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
            .where("lo <> hi"))


def gate_one_split(rows):
    return split_spans(rows).agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit("one_split").alias("gate"), "violations")


def gate_balance(rows, lo: float = 0.35, hi: float = 0.65):
    tr = rows.where((F.col("split") == "train") & (F.col("variant") == "clean"))
    m = F.avg("label")
    return tr.agg(F.when((m > lo) & (m < hi), 0).otherwise(1).cast("long").alias("violations")).select(
        F.lit("balance").alias("gate"), "violations")


def variants_per_image(rows: DataFrame) -> DataFrame:
    return rows.groupBy("image_id").agg(F.countDistinct("variant").alias("n_variants"))


def gate_full_grid(rows):
    ev = rows.where(F.col("split").startswith("test") | F.col("split").startswith("calib"))
    return _gate(variants_per_image(ev), "full_grid", F.col("n_variants") != N_VARIANTS)


def shared_sources(rows: DataFrame) -> DataFrame:
    """Images held by more than one source.  The set per image is bounded by the sources."""
    return (rows.groupBy("image_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
            .where(F.size("sources") > 1))


def gate_sources_disjoint(rows):
    return _gate(shared_sources(rows), "sources_disjoint", F.lit(True))


def all_gates(rows: DataFrame, organizer: str = "organizer_val", ood: str = "ood_eval", calib: str = "core_calib") -> DataFrame:
    """Every gate in three passes: over rows, over images, over generators."""
    src, split = F.col("source"), F.col("split")
    held = split.startswith("test") | split.startswith("calib")
    clean_train = (split == "train") & (F.col("variant") == "clean")
    mean = F.avg(F.when(clean_train, F.col("label")))
    by_row = rows.agg(
        F.when(F.count_if(src == organizer) == 0, 1).otherwise(F.count_if((src == organizer) & (split != "test_organizer"))).alias("quarantine"),
        F.count_if((src == ood) & ~split.isin("test_ood", "calib_ood")).alias("ood_only"),
        F.count_if((src == calib) & (split != "calib")).alias("calib_only"),
        F.when((mean > 0.35) & (mean < 0.65), 0).otherwise(1).alias("balance"))
    by_image = rows.groupBy("image_id").agg(
        (F.min("split") != F.max("split")).alias("spans"),
        (F.bool_or((src == ood) & (split == "calib_ood")) & F.bool_or((src == ood) & (split == "test_ood"))).alias("both"),
        F.bool_or(held).alias("held"), F.countDistinct(F.when(held, F.col("variant"))).alias("n")).agg(
        F.count_if("spans").alias("one_split"), F.count_if("both").alias("images_disjoint"),
        F.count_if(F.col("held") & (F.col("n") != N_VARIANTS)).alias("full_grid"))

    def tall(df):
        names = df.columns
        return df.selectExpr(f"stack({len(names)}, " + ", ".join(f"'{n}', cast({n} AS bigint)" for n in names) + ") AS (gate, violations)")
    return tall(by_row).unionByName(tall(by_image)).unionByName(gate_generators_disjoint(rows, ood))


def require_green(rows: DataFrame) -> None:
    """Raise before anything is written if a gate reports a violation (eight rows come back)."""
    bad = all_gates(rows).where("violations > 0").collect()
    if bad:
        raise ValueError("gates failed: " + ", ".join(f"{r.gate}={r.violations}" for r in bad))


def shortcut_risk(rows: DataFrame, fmt: str, share: float = 0.30, one_label: float = 0.75) -> DataFrame:
    """What could stand in for the label in training: (scope, name, n, share, risk).

    A source is a risk if it has one label and more than ``share`` of the training rows; a file
    format is one if one label has ``one_label`` or more of its rows.
    """
    tr = rows.where(F.col("split") == "train")
    per = tr.groupBy("source", F.col(fmt).alias("fmt"), "label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))
    src = per.groupBy("source").agg(F.sum("n").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    src = src.withColumn("share", F.col("n") / total).select(
        F.lit("source").alias("scope"), F.col("source").alias("name"), "n", "share", ((F.col("lo") == F.col("hi")) & (F.col("share") > share)).alias("risk"))
    form = per.groupBy("fmt", "label").agg(F.sum("n").alias("n")).groupBy("fmt").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    form = form.withColumn("share", F.col("top") / F.col("n")).select(
        F.lit("format").alias("scope"), F.col("fmt").alias("name"), "n", "share", (F.col("share") >= one_label).alias("risk"))
    return src.unionByName(form)
