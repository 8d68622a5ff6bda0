"""From shared buckets to verified links and their components, without all pairs of a bucket."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaguard.llm.common import cut, drop
from mediaguard.llm.tokens import mix

SLOTS = 1 << 23
STARS, DENSE = 3, 32


def _slot(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(values.astype(np.int64).view(np.uint64), 9) >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)


def slots(df: DataFrame, column: str) -> bytes:
    """A bitmap of ``SLOTS`` bits (1 MiB, whatever the input) of the hashes of a whole-number column."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.unique(_slot(b[column].to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array(s >> 6), pa.array(np.left_shift(np.int64(1), s & 63))], ["w", "bit"])
    words = df.select(column).mapInArrow(mark, "w long, bit long").groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(SLOTS // 64, np.int64)
    held[words["w"].to_numpy()] = words["bits"].to_numpy()
    return held.tobytes()


def hits(values: np.ndarray, held: bytes) -> np.ndarray:
    """False for values that are surely not in the column ``slots`` has seen."""
    s = _slot(values)
    return (np.frombuffer(held, np.int64)[s >> 6] >> (s & 63)) & 1 > 0


def keep(df: DataFrame, column: str, held: bytes) -> DataFrame:
    """The rows whose value passes ``hits``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(hits(b[column].to_numpy(zero_copy_only=False), held)))
    return df.mapInArrow(run, df.schema)


def bits(cells: np.ndarray, n: int, size: int) -> np.ndarray:
    """Pack ``n`` rows of ``size`` flags (a flat row-major array) into whole numbers of 64 bits."""
    return (cells.reshape(n, size // 64, 64).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)


def differ(size: int, name: str = "p") -> str:
    """How many bits the sketches p0, p1, .. of nodes a and b differ in: a lower bound of the number of tokens that one set has alone,
    as each such token turns one bit."""
    return "(" + " + ".join(f"bit_count({name}{i}_a ^ {name}{i}_b)" for i in range(size // 64)) + ")"


def near_enough(percent: int, size: int, name: str = "p") -> str:
    """Condition on n_a, n_b and the sketches without which two sets can't reach Jaccard ``percent`` / 100; it loses no pair."""
    return f"{100 + percent} * {differ(size, name)} <= {100 - percent} * (n_a + n_b)"


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node reaches over links (a, b); roots are left out.

    Alternating stars: each node hands its larger neighbours to its least neighbour, then its
    smaller ones; both steps are windows over links (16 bytes a row, in one pass, so a hub costs one pass over its own links), one shuffle
    each, and rounds grow with the logarithm of a chain.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "edges")
    while True:
        # done when every node has one edge and leads to a node without any
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        if ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("root")).where("n > 1 or (n = 1 and root = 0)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
        least = both.withColumn("m", F.least("x", F.min("y").over(Window.partitionBy("x"))))
        large = least.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))  # as many as edges at most
        low = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = low.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        old, edges = edges, cut(small.distinct(), "edges")
        drop(old)


def link(entries: DataFrame, verify: Callable[[DataFrame], DataFrame], may: str = "true",
         refine: Callable[[DataFrame], DataFrame] | None = None, later: str = "true",
         spent: DataFrame | None = None,
         describe: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Links and components among nodes that share a bucket.

    ``entries`` has (bucket, node) and columns that belong to the node; ``may`` is a condition on two nodes' columns, as x_a and x_b,
    without which they can't link; ``verify`` keeps the pairs (a, b) that really do.  In each
    bucket all nodes are compared with one: the first by the node's columns or, without any, the one with most
    buckets.  Where a bucket still holds several components, its nodes are compared across them: pair by pair if that is at
    most ``DENSE`` pairs for each row left, else with one more node first,
    ``STARS`` times at most.  ``describe`` gives a written table of the columns of the nodes that share a bucket, where ``entries`` has none; then all entries are
    shuffled once, a bucket is named by the set of its nodes (so buckets of the same nodes count once), its first node by number is the one
    that the others are compared with, and before all pairs of two components one pair of them is verified, as it mostly links.
    ``refine`` may give other columns for the nodes that get further, on which ``later`` is a condition in place of ``may``; it may give more nodes.
    ``spent`` is a table that ``cut`` wrote, which is deleted as soon as the entries that share a bucket are written, as are the steps between.
    So groups of copies cost rows in proportion to their size, and no pair that could join two components is left out.
    Returns the verified links (a, b) and (node, component) of all nodes but the roots.
    """
    side = lambda df, k: df.select("bucket", *[F.col(c).alias(f"{c}_{k}") for c in df.columns if c != "bucket"])

    def met(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        return side(left, "a").join(side(right, "b"), "bucket").where(" and ".join(f"({x})" for x in ("node_a <> node_b", *more)))

    def near(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        return met(left, right, *more).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()

    def one_each(df: DataFrame, *more: str) -> DataFrame:
        """One pair (a, b) of each two components (part_a, part_b): the last, as the first nodes have been compared."""
        pair = F.struct(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
        return met(df, df, "part_a < part_b", *more).groupBy("part_a", "part_b").agg(F.max(pair).alias("e")).select("part_a", "part_b", "e.*")

    def apart(each: DataFrame, parts: DataFrame) -> DataFrame:
        """The components (part) of which ``each`` has a pair that ``parts`` leaves in two."""
        for k in ("a", "b"):
            each = each.join(parts.select(F.col("node").alias(f"part_{k}"), F.col("component").alias(f"now_{k}")), f"part_{k}", "left")
        open_ = each.where("coalesce(now_a, part_a) <> coalesce(now_b, part_b)")
        return open_.select(F.explode(F.array("part_a", "part_b")).alias("part")).distinct()

    if describe is None:
        many = cut(entries.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("top")).where("low < top").select("bucket"), "buckets")
        live = cut(keep(entries, "bucket", slots(many, "bucket")).join(many, "bucket").distinct(), "live")
        drop(many)
        if spent is not None:
            drop(spent)
        extra = [c for c in live.columns if c not in ("bucket", "node")]
        ranked = live if extra else live.join(live.groupBy("node").agg((-F.count("*")).alias("order")), "node")
        pivots = ranked.groupBy("bucket").agg(F.min(F.struct(*(extra or ["order"]), "node")).alias("p"))
        tried = near(pivots.select("bucket", *[f"p.{c}" for c in [*extra, "node"]]), live, may)
    else:
        own = Window.partitionBy("bucket")
        ends = entries.withColumns({"low": F.min("node").over(own), "top": F.max("node").over(own)})
        shared = ends.where("low < top").select("bucket", "node").distinct()
        old = cut(shared.select(F.bit_xor(F.xxhash64("node")).over(own).alias("bucket"), "node"), "live")
        live = cut(old.distinct(), "once")
        drop(old)
        known = describe(live.select("node"))
        of = lambda k: known.select(*[F.col(c).alias(k if c == "node" else f"{c}_{k}") for c in known.columns])
        star = live.join(live.groupBy("bucket").agg(F.min("node").alias("a")), "bucket").where("a < node").select("a", F.col("node").alias("b")).distinct()
        tried = star.join(of("a"), "a").join(of("b"), "b").where(may).select("a", "b")
    found = cut(verify(tried), "links")
    parts = components(found)
    once, stars, old = describe is None, STARS - (describe is not None), live
    for k in range(1, STARS + 1):
        named = live.join(parts, "node", "left").select(*live.columns, F.coalesce("component", "node").alias("part"))
        split = named.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("_n"))
        split = split.where("p < q and _n > 2" if k == 1 else "p < q")  # of two nodes both have been compared
        named = cut(named.join(split.select("bucket", "_n"), "bucket"), "split")
        drop(old)
        old = named
        rows, pairs = named.agg(F.count("*"), F.sum("_n")).first()  # a bucket of n nodes counts n times n
        if not rows:
            break
        named = named.drop("_n")
        if describe is not None and k == 1:
            if refine is not None:
                known, may = cut(refine(named.select("node")), "fine"), later
            named = cut(named.join(known, "node"), "split")
            drop(old)
            old = named
        few = k >= stars or pairs <= 2 * DENSE * rows
        last = few and once
        if last:
            tried = near(named, named, "node_a < node_b and part_a <> part_b", may)
        elif few:
            each, once = cut(one_each(named, may), "each"), True
            tried = each.select("a", "b")
        else:
            turn = F.xxhash64("node", F.lit(k))
            at = named.groupBy("bucket").agg(F.min(turn).alias("turn"))
            tried = near(named.join(at, "bucket").where(turn == F.col("turn")).drop("turn"), named, "part_a <> part_b", may)
        more = cut(verify(tried), "links")
        found = found.union(more).distinct()
        if not more.isEmpty():
            parts = components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        if last:
            break
        if few:  # components without a pair in ``each`` have none that may link
            named = named.join(apart(each, parts), "part", "left_semi").select(*named.columns)
        live = named.drop("part")
    return found, parts
