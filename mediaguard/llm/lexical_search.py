"""Ranked lexical search by buckets of impact vectors in order of length.

A document's vector holds, for each of its terms, the impact (10^9 tf) div (1000 tf + 8 m); an item's holds the term's repeats;
a term weighs w.  The score is their product, a whole number.  Half of each weight (its root) is given to either side, so that
lengths and products agree:

* Documents stand in order of the length of their vectors, in buckets of ``BUCKET``.  An item whose length times the longest
  vector of a bucket stays below its own threshold (Cauchy-Schwarz) leaves the bucket out.
* Inside a bucket the coordinates bound the score: terms in less than one of ``COMMON`` documents count as they are, and
  the rest of the two vectors by the product of their lengths.  What stays below the threshold goes.
* Survivors are scored again in 64-bit integers.  The threshold is the score of the ``top``-th best document met so far.

A first pass looks at the longest bucket of every batch only, for thresholds that hold everywhere; the second goes over all
documents with them.  Nothing is shuffled but term counts and documents that beat a threshold.
Items are taken in blocks of ``BLOCK`` terms at most (or one item), so what travels to tasks is bounded whatever the number of items.

Nulls: a null text has no terms; rows without a doc_id or item_id are left out, before counting; rows that repeat a doc_id
are documents of their own, equal scores of one doc_id next to each other; rows that repeat an item_id are one item with the
terms of all.  Empty texts match nothing, very long ones are taken whole, equal scores rank by doc_id, an empty table gives an empty result and other
columns are ignored.  Terms are 64-bit hashes: two of n different ones meet with probability n^2 / 2^65.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaguard.llm import tokens
from mediaguard.llm.common import cut
from mediaguard.llm.links import hits, slots

TOP = 10
BUCKET = 1024
COMMON = 16
BLOCK = 1 << 17
_SLACK = 1 + 1e-9


def _counted(id_name: str, held: bytes | None):
    """Per row: id, n (terms with repeats), and the distinct terms that pass the bitmap with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in tokens.pieces(batches):
                h, _, rows = tokens.words(b["text"], gaps="term")
                n = np.bincount(rows, minlength=b.num_rows)
                h = h.view(np.int64)
                if held is not None:
                    ok = hits(h, held)
                    h, rows = h[ok], rows[ok]
                order = np.lexsort((h, rows))
                h, rows = h[order], rows[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])])) if len(h) else np.zeros(0, np.int64)
                tf = np.diff(np.concatenate([first, [len(h)]]))
                ends = pa.array(tokens.row_starts(rows[first], b.num_rows).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    b[id_name], pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(h[first])),
                    pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], [id_name, "n", "terms", "tfs"])
    return run


def vectors(df: DataFrame, id_name: str, held: bytes | None = None) -> DataFrame:
    """(id, n, terms, tfs) of rows (id, text)."""
    own = df.where(f"{id_name} is not null").select(F.col(id_name).cast("long").alias(id_name), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_counted(id_name, held), f"{id_name} long, n long, terms array<long>, tfs array<long>")


@dataclass
class Queries:
    """A block of items: places of their terms in ``terms`` (sorted), by item, with repeats and weights."""
    ids: np.ndarray
    at: np.ndarray       # where each item's terms begin; one more for the end
    place: np.ndarray
    times: np.ndarray
    terms: np.ndarray
    weight: np.ndarray   # of each term
    common: np.ndarray   # of each term: in many documents
    docs: int            # N
    total: int           # L

    def __post_init__(self):
        item = np.repeat(np.arange(len(self.ids)), np.diff(self.at))
        part = self.times ** 2 * self.weight[self.place]
        self.length = np.sqrt(np.bincount(item, part, len(self.ids)))
        self.rest = np.sqrt(np.bincount(item, part * self.common[self.place], len(self.ids)))
        order = np.argsort(self.place, kind="stable")
        self.by_item, self.by_times = item[order], self.times[order]
        self.by_at = np.searchsorted(self.place[order], np.arange(len(self.terms) + 1))


def _spread(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the lists that begin at ``at`` for the given lists, and which of them each belongs to."""
    size = at[rows + 1] - at[rows]
    which = np.repeat(np.arange(len(rows)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + at[rows][which], which


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, top: int) -> np.ndarray:
    """Which entries are among the first ``top`` of their item."""
    order = np.lexsort((doc, -score, item))
    begin = np.searchsorted(item[order], item[order])
    return np.sort(order[np.arange(len(order)) - begin < top])


def _search(q: Queries, least: np.ndarray, heads: bool, top: int):
    """(item_id, doc_id, score): of each partition, per item the best documents with scores not below ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64)] * 3  # item, score, doc
        floor = np.maximum(least.astype(np.float64), 1.0)
        for b in batches:
            docs = b["doc_id"].to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(b.num_rows), np.diff(b["terms"].offsets.to_numpy()))
            flat = lambda c: b[c].flatten().to_numpy(zero_copy_only=False)
            place = np.searchsorted(q.terms, flat("terms"))
            ok = q.terms[np.minimum(place, len(q.terms) - 1)] == flat("terms")
            rows, place, tf = rows[ok], place[ok], flat("tfs")[ok]
            m = 25 + (75 * b["n"].to_numpy(zero_copy_only=False) * q.docs) // max(q.total, 1)
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[rows])
            part = impact.astype(np.float64) ** 2 * q.weight[place]
            length = np.sqrt(np.bincount(rows, part, b.num_rows))
            rest = np.sqrt(np.bincount(rows, part * q.common[place], b.num_rows))
            order = np.argsort(-length, kind="stable")
            begin = tokens.row_starts(rows, b.num_rows)
            for lo in range(0, min(len(order), BUCKET) if heads else len(order), BUCKET):
                own = order[lo:lo + BUCKET]
                items = np.flatnonzero(q.length * length[own[0]] * _SLACK >= floor)
                if not len(items):
                    break  # the buckets that follow are no longer
                at, doc = _spread(begin, own)
                # coordinates of rarer terms as they are, the others by length
                rare = ~q.common[place[at]]
                hit, src = _spread(q.by_at, place[at][rare])
                src = np.flatnonzero(rare)[src]
                sure = np.bincount(q.by_item[hit] * len(own) + doc[src], q.by_times[hit] * q.weight[place[at[src]]] * impact[at[src]].astype(np.float64),
                                   len(q.ids) * len(own)).reshape(len(q.ids), -1)[items]
                bound = (sure + q.rest[items, None] * rest[own]) * _SLACK
                i, d = np.nonzero(bound >= floor[items, None])
                i = items[i]
                # exact scores of the survivors
                order_at = np.argsort(key := doc * len(q.terms) + place[at], kind="stable")
                key, gain = key[order_at], impact[at][order_at]
                it, pair = _spread(q.at, i)
                want = d[pair] * len(q.terms) + q.place[it]
                to = np.minimum(np.searchsorted(key, want), len(key) - 1)
                value = np.where(key[to] == want, q.times[it] * q.weight[q.place[it]] * gain[to], 0) if len(key) else np.zeros(len(want), np.int64)
                sums = np.concatenate([[0], np.cumsum(value)])
                edge = np.searchsorted(pair, np.arange(len(i) + 1))
                score = sums[edge[1:]] - sums[edge[:-1]]
                ok = score >= floor[i]
                best = [np.concatenate([x, y]) for x, y in zip(best, (i[ok], score[ok], docs[own[d[ok]]]))]
                keep = _best(best[0], best[1], best[2], top)
                best = [x[keep] for x in best]
                full = np.flatnonzero(np.bincount(best[0], minlength=len(q.ids)) == top)
                worst = np.full(len(q.ids), np.iinfo(np.int64).max)
                np.minimum.at(worst, best[0], best[1])
                floor[full] = np.maximum(floor[full], worst[full])
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[best[0]]), pa.array(best[2]), pa.array(best[1])], ["item_id", "doc_id", "score"])
    return run


def _blocks(items: DataFrame) -> Iterator[DataFrame]:
    """The items (item_id, ...) in blocks of up to ``BLOCK`` terms, by running sums of their sizes."""
    sizes = items.select("item_id", F.size("terms").alias("k")).orderBy("item_id")
    block: list[int] = []
    held = 0
    for r in sizes.toLocalIterator():
        if block and held + r.k > BLOCK:
            yield items.where(F.col("item_id").between(block[0], block[-1]))
            block, held = [], 0
        block = [block[0], r.item_id] if block else [r.item_id, r.item_id]
        held += r.k
    if block:
        yield items.where(F.col("item_id").between(block[0], block[-1]))


def ranked(found: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    once = (vectors(items, "item_id").select("item_id", F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
            .groupBy("item_id", F.col("t.terms").alias("term")).agg(F.sum("t.tfs").alias("times")))
    asked = cut(once, "asked")
    terms = asked.select("term").distinct()
    rows = cut(vectors(docs, "doc_id", slots(terms, "term")), "vectors")
    n, total = rows.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(terms, "term")
    weighed = asked.join(df, "term").withColumn("w", F.floor(1000 * F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long"))
    lists = cut(weighed.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "times", "w", (F.col("df") * COMMON >= n).alias("common")))).alias("terms")), "items")
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in _blocks(lists):
        q = _queries(block, n, total)
        run = lambda least, heads: rows.where("size(terms) > 0").mapInArrow(_search(q, least, heads, top), found.schema)  # noqa: E731, B023
        first = ranked(run(np.zeros(len(q.ids), np.int64), True), top).where(F.col("rank") == top).select("item_id", "score").toArrow()
        least = np.zeros(len(q.ids), np.int64)
        least[np.searchsorted(q.ids, first["item_id"].to_numpy())] = first["score"].to_numpy()
        found = found.union(run(least, False))
    return ranked(found, top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _queries(block: DataFrame, docs: int, total: int) -> Queries:
    got = block.orderBy("item_id").toArrow().combine_chunks()
    lists = got["terms"].combine_chunks()
    at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    flat = lists.flatten()
    term, times, w, common = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
    names, first, place = np.unique(term, return_index=True, return_inverse=True)
    return Queries(got["item_id"].to_numpy(), at, place, times, names, w[first], common[first].astype(bool), docs, total)


def oracle_sql(top: int = TOP) -> str:
    """``search`` of ``benchmark`` in ``documents`` as DuckDB SQL."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = rf"unnest(regexp_extract_all(translate(text, '{upper}', '{low}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return rf"""
with t as (select row_number() over () as r, doc_id, text from documents where doc_id is not null),
tf as (select r, doc_id, term, count(*) as tf from (select r, doc_id, {terms} as term from t) group by all),
len as (select r, sum(tf)::bigint as n from tf group by r),
tot as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from len),
df as (select term, count(*)::bigint as df from tf group by term),
w as (select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)::double))::bigint as w from df, tot),
q as (select item_id, term, count(*)::bigint as times from (select item_id, {terms} as term from benchmark where item_id is not null) group by all),
m as (select r, 25 + (75 * n * big_n) // big_l as m from len, tot),
s as (select item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
      from q join w using (term) join tf using (term) join m using (r) group by all)
select item_id, rank::integer as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= {top}"""
