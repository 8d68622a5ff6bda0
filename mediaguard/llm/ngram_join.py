"""Word n-gram Jaccard self-join by filters under several global token orders.

A document's set is its distinct shingles of ``size`` words (with fewer words the whole sequence is
one).  Two sets with Jaccard of at least ``percent`` / 100 share a token among the first
n - ceil(percent * n / 100) + 1 of each (the prefix), whatever global order the tokens stand in.  Four orders are used:

* First, tokens that one document alone holds come first, as far as their hash lies in the lowest ``LOW`` of the
  hash range; their counts cover all documents.  A document whose prefix is filled with tokens of its own has no
  partner and goes no further.
* A, rare first: among the documents left, all tokens by document frequency.  Passages that many documents share come
  last and fill no bucket; what still shares a prefix token is a candidate pair (``links.link``) if the tokens that either
  document has alone, and the bits in which parity sketches of the two sets differ, leave room for enough common ones.
* B and C, two hash orders: a candidate pair must share a prefix token under each of
  them as well before the sets are intersected.

Equal sets are one node, named by a 64-bit digest, before anything else.  Sets of candidates only are rebuilt from
their texts, found by two fixed-size bitmaps; to be intersected, sets travel only if a candidate pair names them.

Nulls: a null or empty text has an empty set, links with nothing and is its own component; a
row without doc_id keeps its count, links with nothing and has a null component.  Rows that repeat a doc_id have a set
each and share a component.  Other columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaguard.llm import tokens
from mediaguard.llm.common import cut, drop
from mediaguard.llm.links import bits, components, hits, keep, link, near_enough, slots

LOW = 0.3
_LOW = np.uint64(int(LOW * 2 ** 64))
SKETCH = 512
_P = [f"p{i}" for i in range(SKETCH // 64)]


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per row."""
    h, _, rows = tokens.words(texts)
    grams, at = tokens.windows(h, rows, size)
    first, g = tokens.row_starts(rows, len(texts)), tokens.row_starts(rows[at], len(texts))
    out = []
    for i in range(len(texts)):
        if g[i + 1] > g[i]:
            out.append(np.unique(grams[g[i]:g[i + 1]]))
        elif first[i + 1] > first[i]:
            whole = np.uint64(0)
            for w in h[first[i]:first[i + 1]]:
                whole = (whole * np.uint64(2654435761) + w).astype(np.uint64)
            out.append(tokens.mix(np.array([whole], np.uint64), 100 + int(first[i + 1] - first[i])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes())


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([_digest(s) for s in sets], np.uint64).view(np.int64)


def _summaries(size: int):
    """Per document: set size and digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in tokens.pieces(batches):
                sets = _sets(b["text"], size)
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(_nodes(sets))], ["doc_id", "n", "node"])
    return run


def _low(size: int):
    """(token, node) of the low tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in tokens.pieces(batches):
                sets = _sets(b["text"], size)
                low = [s[:np.searchsorted(s, _LOW)].view(np.int64) for s in sets]
                nodes = np.repeat(_nodes(sets), [len(x) for x in low])
                if len(nodes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(low)), pa.array(nodes)], ["token", "node"])
    return run


def _full(size: int, percent: int, held: bytes, named: bytes):
    """Per candidate (its id and its digest pass their bitmaps): its whole set and its prefixes under orders B and C (folded to 32 bits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in tokens.pieces(batches):
                b = b.filter(pa.array(hits(b["doc_id"].to_numpy(zero_copy_only=False), held)))
                sets = _sets(b["text"], size)
                nodes = _nodes(sets)
                ok = np.flatnonzero(hits(nodes, named))
                sets, nodes = [sets[i] for i in ok], nodes[ok]
                cols = [pa.array(nodes), tokens.lists([s.view(np.int64) for s in sets], pa.int64())]
                for order in (1, 2):
                    first = [np.sort(tokens.mix(s, order))[:_prefix(len(s), percent)] for s in sets]
                    cols.append(tokens.lists([(f >> np.uint64(32)).astype(np.uint32).view(np.int32) for f in first], pa.int32()))
                row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                cell = row * SKETCH + (tokens.mix(flat, 8) >> np.uint64(64 - (SKETCH.bit_length() - 1))).astype(np.int64)
                p = bits(np.bincount(cell, minlength=len(sets) * SKETCH) & 1, len(sets), SKETCH)  # an odd number of tokens in the cell
                cols += [pa.array(p[:, i]) for i in range(p.shape[1])]
                yield pa.RecordBatch.from_arrays(cols, ["node", "whole", "b", "c", *_P])
    return run


def join(docs: DataFrame, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_shingles, component_id), one row per row of ``docs``, and the
    verified links (a, b) that hold the components together, between the documents that stand for equal sets."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = cut(texts.mapInArrow(_summaries(size), "doc_id long, n long, node long"), "sets")
    full = seen.where("n > 0 and doc_id is not null")
    reps = cut(full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "reps")
    named = texts.where("doc_id is not null")
    prefix = f"n - (({percent} * n + 99) div 100) + 1"

    # tokens of one set only; its copies count as one
    alone = (named.mapInArrow(_low(size), "token long, node long").groupBy("token")
             .agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other"))
    own = alone.groupBy("node").agg(F.count("*").alias("own"))
    open_ = cut(reps.join(own, "node", "left").where(f"coalesce(own, 0) < {prefix}").select("node", "rep"), "open")
    # the few others that pass both bitmaps, and rows that repeat a document, cost work but make no link that is not there
    whole = cut(named.mapInArrow(_full(size, percent, slots(open_, "rep"), slots(open_, "node")),
                                 "node long, whole array<long>, b array<int>, c array<int>, " + ", ".join(f"{p} long" for p in _P)), "whole")
    drop(open_)

    flat = whole.select("node", F.explode("whole").alias("token"))
    often = flat.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = flat.join(often, "token").groupBy("node").agg(F.collect_set(F.struct("df", "token")).alias("shared"))
    entries = (whole.select("node", F.size("whole").cast("long").alias("n"), *_P).join(shared, "node")
               .withColumn("own", F.greatest(F.col("n") - F.size("shared"), F.lit(0)))
               .withColumn("short", F.expr(f"cast({prefix} - own as int)")).where("short > 0"))
    starts = cut(entries.select("node", "own", "n", *_P, F.expr("transform(slice(sort_array(shared), 1, short), x -> x.token)").alias("first")), "starts")
    entries = starts.select(F.explode("first").alias("bucket"), "node", "own", "n", *_P)
    may = f"{100 + percent} * least(n_a - own_a, n_b - own_b) >= {percent} * (n_a + n_b) and {near_enough(percent, SKETCH)}"

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "pairs")
        side = lambda k: keep(whole.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("whole", "b", "c")]), k, slots(pairs, k))
        near = "arrays_overlap(b_a, b_b) and arrays_overlap(c_a, c_b)"
        both = pairs.join(side("b"), "b").join(side("a"), "a").where(near)
        inter = "size(array_intersect(whole_a, whole_b))"
        return both.where(f"{100 + percent} * {inter} >= {percent} * (size(whole_a) + size(whole_b))").select("a", "b").distinct()

    links, parts = link(entries, verify, may, spent=starts)
    several = full.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc_id", "a")
    if not several.isEmpty():  # rows of one doc_id with different sets
        same = full.join(several, "doc_id").where("a <> node").select("a", F.col("node").alias("b"))
        parts = components(parts.select(F.col("component").alias("a"), F.col("node").alias("b")).union(same))
    member = cut(parts.union(parts.select("component", "component")).distinct(), "members")
    least = member.join(reps.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    found = seen.join(reps.select("node", "rep"), "node", "left").join(member.join(least, "component").select("node", "least"), "node", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("least", "rep"))
    side = lambda k: reps.select(F.col("node").alias(k), F.col("rep").alias(f"rep_{k}"))
    by_id = links.join(side("a"), "a").join(side("b"), "b").select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")), by_id


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents of ``docs`` that stand for their component (its least doc_id), once each.

    Rows without a doc_id all stay: nothing can be said of them.
    """
    parts, _ = join(docs, size, percent)
    gone = parts.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def oracle_sql(size: int, percent: int) -> str:
    """``join``'s documents as DuckDB SQL over ``documents``."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{low}'), '[^\x20\x09-\x0D]+') as ws from documents),
sh as (select distinct doc_id, list_slice(ws, i, i + {size} - 1) as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - {size} + 2, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
inter as (select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from inter join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= {percent} * (x.n + y.n - k)),
edges as (select a as u, b as v from links union select b, a from links),
reach as (select u, v from edges union select r.u, e.v from reach r join edges e on e.u = r.v)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) as component_id
from w left join n on n.doc_id = w.doc_id left join (select u, min(v) as m from reach group by u) c on c.u = w.doc_id"""
