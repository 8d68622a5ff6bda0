"""Benchmark decontamination: rare word-pair seeds, then Smith-Waterman alignment.

Words are lower-cased and stripped of ASCII punctuation.  Words and the item's are aligned locally (match 2,
mismatch and gap -1), and a pair is reported if the best score is at least ``SCORE`` of a full match and
matches ``LEAST`` words; an item under ``LEAST`` words must stand there whole.

The seeds lose no such pair.  An alignment of k matched words that scores m (half of an item of m words)
has at most 2k - m errors, so at least m / 2 - 1 of its k - 1 steps from match to match have at most one.
These steps are pairs of words at distance 1 or 2 in the item and in the text, so pairs of either
kind share one hash, and an item is a candidate where that many pairs of it start within 2m words.
Of an item's pairs those most frequent in the corpus are passed over, up to half of that number, which is taken off
the number asked for.  Pairs of documents are tested against a bitmap of the items' pairs first (1 MiB,
whatever its size); only the words around candidates are aligned.

Nulls: null texts have no words; rows without an id are left out on either side; items without words
are never found; repeated rows and items give one row per pair, an item_id with several
texts is found by any; empty tables give an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaguard.llm import tokens
from mediaguard.llm.common import cut
from mediaguard.llm.links import hits, keep, slots

LEAST = 3
SCORE = 0.5
CELLS = 1 << 21


def _pairs(h: np.ndarray, rows: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first word) of the word pairs at distance 1 or 2 in one row; of ``single`` words too."""
    grams, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if single:
        grams.append(tokens.mix(h, 1))
        at.append(np.arange(len(h)))
    for step in (1, 2):
        same = np.flatnonzero(rows[:-step] == rows[step:])
        grams.append(tokens.mix(h[same] * np.uint64(tokens._STEP) + h[same + step], 2))
        at.append(same)
    return np.concatenate(grams), np.concatenate(at)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, item, grams): the pairs of each item, repeated ones too; the word itself where it is the only one."""
    with np.errstate(over="ignore"):
        for b in tokens.pieces(batches):
            h, _, rows = tokens.words(b["text"], plain=True)
            w = tokens.row_starts(rows, b.num_rows)
            own = [h[w[i]:w[i + 1]] for i in range(b.num_rows)]
            grams = [_pairs(x, np.zeros(len(x), np.int64), len(x) == 1)[0].view(np.int64) for x in own]
            yield pa.RecordBatch.from_arrays([b["item_id"], tokens.lists([x.view(np.int64) for x in own], pa.int64()), tokens.lists(grams, pa.int64())],
                                             ["item_id", "item", "grams"])


def _hits(held: bytes, single: bool):
    """(doc_id, at, gram) of the pairs of documents that pass a bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in tokens.pieces(batches):
                h, _, rows = tokens.words(b["text"], plain=True)
                grams, at = _pairs(h, rows, single)
                hit = np.flatnonzero(hits(grams.view(np.int64), held))
                hit = hit[np.argsort(at[hit], kind="stable")]
                row = rows[at[hit]]
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(row)), pa.array(at[hit] - tokens.row_starts(rows, b.num_rows)[row]),
                                                  pa.array(grams[hit].view(np.int64))], ["doc_id", "at", "gram"])
    return run


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, num, begin, end): the words that hold every alignment with ``need`` pairs within twice the item's ``size``."""
    for b in batches:
        at, flat = b["ats"].offsets.to_numpy(), b["ats"].values.to_numpy(zero_copy_only=False)
        need, size = b["need"].to_numpy(), 2 * b["size"].to_numpy()
        row, begin, end = [], [], []
        for i in range(b.num_rows):
            own = np.unique(flat[at[i]:at[i + 1]])
            last = own[need[i] - 1:]
            dense = np.flatnonzero(last - own[:len(last)] < size[i])
            if not len(dense):
                continue
            lo, hi = np.maximum(last[dense] - size[i], 0), own[dense] + size[i] + 2
            new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
            row.append(np.full(len(new), i))
            begin.append(lo[new])
            end.append(hi[np.concatenate([new[1:] - 1, [len(hi) - 1]])])
        if row:
            to = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(to), b["num"].take(to), pa.array(np.concatenate(begin)), pa.array(np.concatenate(end))],
                                             ["doc_id", "num", "begin", "end"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, num, start, passage): the words of each region of the documents."""
    with np.errstate(over="ignore"):
        for b in tokens.pieces(batches):
            h, _, rows = tokens.words(b["text"], plain=True)
            starts = tokens.row_starts(rows, b.num_rows)
            for i in range(b.num_rows):
                own, found = h[starts[i]:starts[i + 1]].view(np.int64), b["regions"][i].values
                num, begin, end = found.flatten()
                begin, end = begin.to_numpy(), end.to_numpy()
                for k in range(0, len(num), 256):
                    text = tokens.lists([own[x:y] for x, y in zip(begin[k:k + 256], end[k:k + 256])], pa.int64())
                    doc = b["doc_id"].take(pa.array(np.full(len(text), i)))
                    yield pa.RecordBatch.from_arrays([doc, num[k:k + 256], pa.array(begin[k:k + 256]), text], ["doc_id", "num", "start", "passage"])


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair as a share of the item's full match."""
    return aligned(items, passages)[0]


def aligned(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``align`` and the most words that an alignment of the best score matches."""
    m, n = max(map(len, items)), max(map(len, passages))
    a = np.zeros((len(items), m), np.int64)
    p = np.ones((len(items), n), np.int64)
    for i, (x, y) in enumerate(zip(items, passages)):
        a[i, :len(x)], p[i, :len(y)] = x, y
    unit = m + 1  # a match counts one below the units of the score
    kind = np.int32 if (n + 2 * m + 2) * unit < 1 << 31 else np.int64
    held, best, step = np.zeros((len(items), n + 1), kind), np.zeros(len(items), kind), np.arange(n, dtype=kind) * kind(unit)
    for k in range(m):
        turn = held[:, :-1] + np.where(a[:, k:k + 1] == p, kind(2 * unit + 1), kind(-unit))
        turn = np.maximum(np.maximum(turn, held[:, 1:] - kind(unit)), 0)
        held[:, 1:] = np.maximum.accumulate(turn + step, axis=1) - step  # gaps in the item
        best = np.maximum(best, held.max(axis=1))
    score, matched = np.divmod(best, unit)
    return score / (2.0 * np.array([max(1, len(x)) for x in items])), matched


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        wide = big["passage"].value_lengths().to_numpy(zero_copy_only=False)
        order = np.argsort(wide, kind="stable")
        i = 0
        while i < len(order):  # passages of like length share a matrix of bounded size
            j = i + 1
            while j < len(order) and (j + 1 - i) * wide[order[j]] <= CELLS:
                j += 1
            b = big.take(pa.array(order[i:j]))
            items = [x.values.to_numpy(zero_copy_only=False) for x in b["item"]]
            size = np.array([len(x) for x in items])
            score, matched = aligned(items, [x.values.to_numpy(zero_copy_only=False) for x in b["passage"]])
            kept = pa.array((score >= np.where(size < LEAST, 1, SCORE)) & (matched >= np.minimum(size, LEAST)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["item_id"], b["start"], pa.array(score)], ["doc_id", "item_id", "start", "score"]).filter(kept)
            i = j


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, start) of every document that holds a benchmark item; ``start`` is the
    word (punctuation parts words) from which the best-scoring passage was read."""
    own = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    items = cut(own.mapInArrow(_items, "item_id long, item array<long>, grams array<long>").where("size(item) > 0")
                .withColumn("num", F.monotonically_increasing_id()), "items")
    flat = items.select("num", F.size("item").cast("long").alias("size"), F.explode("grams").alias("gram")).groupBy("num", "size", "gram").agg(F.count("*").alias("n"))
    held, single = slots(flat, "gram"), not items.where("size(item) = 1").isEmpty()
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = cut(texts.mapInArrow(_hits(held, single), "doc_id long, at long, gram long"), "hits")

    often = found.groupBy("gram").agg(F.count("*").alias("df"))
    steps = F.greatest(F.lit(1), F.ceil(F.col("size") * SCORE) - 1)
    passed = F.sum("n").over(Window.partitionBy("num").orderBy(F.desc("df"), "gram"))
    ranked = flat.join(often, "gram").withColumns({"steps": steps, "passed": passed}).withColumn("over", F.floor(F.col("steps") / 2))
    seeds = ranked.where("passed > over").select("gram", "num", "size", (F.col("steps") - F.col("over")).alias("need"))
    near = (found.join(seeds, "gram").groupBy("doc_id", "num", "size", "need").agg(F.collect_list("at").alias("ats")).where("size(ats) >= need")
            .select("doc_id", "num", "size", "need", "ats").mapInArrow(_regions, "doc_id long, num long, begin long, end long"))
    near = cut(near, "regions")
    regions = near.groupBy("doc_id").agg(F.collect_list(F.struct("num", "begin", "end")).alias("regions"))
    pairs = (keep(texts, "doc_id", slots(near, "doc_id")).join(regions, "doc_id").select("doc_id", "text", "regions")
             .mapInArrow(_passages, "doc_id long, num long, start long, passage array<long>").join(items.select("num", "item_id", "item"), "num"))
    scored = pairs.select("doc_id", "item_id", "start", "item", "passage").mapInArrow(_scores, "doc_id long, item_id long, start long, score double")
    return (scored.groupBy("doc_id", "item_id")
            .agg(F.max("score").alias("score"), F.max_by("start", F.struct("score", -F.col("start"))).alias("start")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item; rows without a doc_id stay."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
