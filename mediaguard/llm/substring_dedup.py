"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of each text (h = 2h + table[byte]); a chunk ends where ``BITS`` of
its bits, which depend on the last ``REACH`` bytes only, are zero and a character ends.  So the cuts of a passage
are the same wherever it stands, a few bytes after its start, and insertions elsewhere don't shift them.
Chunks below ``LEAST`` bytes are joined to the next cut, chunks stop at ``MOST`` bytes.
A chunk's key is its 64-bit digest with its length.  It repeats if it stood in the same text before, or
if a document with a smaller id holds it.  Adjacent repeats form spans; spans of ``SPAN`` characters or more are
reported and removed.

Nulls: null and empty texts have no chunks; rows without a doc_id are left out; rows that repeat a doc_id are one
document, whose text is the greatest of them (``clean`` leaves the others as they are); an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaguard.llm import tokens
from mediaguard.llm.common import cut

BITS, REACH = 5, 16
LEAST, MOST = 8, 1024
SPAN = 64
_GEAR = np.random.default_rng(17).integers(0, 1 << 16, 256, dtype=np.uint16)
_MASK = np.uint16(((1 << BITS) - 1) << (REACH - BITS))


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text's bytes."""
    if not len(data):
        return np.zeros(0, np.int64)
    h = _GEAR[data]
    step = 1
    while step < REACH:  # sums over 2, 4, 8, 16 bytes
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
        step *= 2
    head = np.ones(len(data) + 1, bool)
    head[:-1] = (data & 0xC0) != 0x80
    found = np.flatnonzero(((h & _MASK) == 0) & head[1:]) + 1
    out, last = [], 0
    for end in [*found.tolist(), len(data)]:
        while end - last > MOST:
            last += MOST - 3 + int(np.argmax(head[last + MOST - 3:last + MOST + 1]))
            out.append(last)
        if end - last >= LEAST or end == len(data):
            if end > last:
                out.append(end)
            last = end
    return np.array(out, np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, end, digest, size, again): chunks in characters; ``again`` if the text held it before."""
    with np.errstate(over="ignore"):
        for b in tokens.pieces(batches):
            data, at = tokens._buffers(b["text"])
            ids = b["doc_id"].to_numpy(zero_copy_only=False)
            cols: list[list] = [[], [], [], [], [], []]
            for i in range(b.num_rows):
                own = data[at[i]:at[i + 1]]
                ends = cuts(own)
                if not len(ends):
                    continue
                starts = np.concatenate([[0], ends[:-1]])
                raw = own.tobytes()
                digest = np.array([xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())], np.uint64)
                chars = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                again = np.ones(len(ends), bool)
                again[np.unique(digest, return_index=True)[1]] = False
                for c, v in zip(cols, (np.full(len(ends), ids[i]), chars[starts], chars[ends], digest.view(np.int64), ends - starts, again)):
                    c.append(v)
            if cols[0]:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(cols, kinds)], ["doc_id", "start", "end", "digest", "size", "again"])


def _texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) with one text per doc_id, the greatest where rows differ, and (doc_id, hash) of those chosen among several."""
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    rows = cut(rows, "several")
    if rows.isEmpty():
        return own, rows.withColumn("hash", F.lit(0).cast("long"))
    chosen = cut(own.join(rows, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")), "chosen")
    return own.join(rows, "doc_id", "left_anti").unionByName(chosen), chosen.select("doc_id", F.xxhash64("text").alias("hash"))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, first_doc_id): each repeated span in characters, end exclusive, and
    the least document that holds its first chunk."""
    return _spans(docs)[0]


def _spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    texts, chosen = _texts(docs)
    chunks = cut(texts.mapInArrow(_chunks, "doc_id long, start int, end int, digest long, size int, again boolean"), "chunks")
    first = (chunks.groupBy("digest", "size").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("again").alias("some"))
             .where("first < last or some").select("digest", "size", "first"))
    repeats = chunks.join(first, ["digest", "size"]).where("again or doc_id > first")
    runs = repeats.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end", "first"))).alias("c"))
    # a span starts where a chunk doesn't continue the one before it
    heads = "filter(sequence(0, size(c) - 1), i -> i = 0 or c[i].start > c[greatest(i - 1, 0)].end)"
    named = runs.select("doc_id", "c", F.expr(heads).alias("h"))
    pieces = F.expr("transform(h, (x, i) -> struct(c[x].start as start, c[if(i + 1 < size(h), h[least(i + 1, size(h) - 1)], size(c)) - 1].end as end, c[x].first as first_doc_id))")
    return named.select("doc_id", F.explode(pieces).alias("s")).select("doc_id", "s.*").where(f"end - start >= {SPAN}"), chosen


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated spans; ``n_chars``, where there is one, follows the text."""
    found, chosen = _spans(docs)
    gone = found.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_gone"))
    gone = gone.join(chosen.withColumnRenamed("hash", "_hash"), "doc_id", "left")
    kept = ("array_join(transform(sequence(0, size(_gone)), i -> substring(text, if(i = 0, 0, _gone[greatest(i - 1, 0)].end) + 1, "
            "if(i = size(_gone), length(text), _gone[least(i, size(_gone) - 1)].start) - if(i = 0, 0, _gone[greatest(i - 1, 0)].end))), '')")
    here = F.col("_hash").isNull() | (F.col("_hash") == F.xxhash64(F.col("text").cast("string")))
    out = docs.join(gone, "doc_id", "left").withColumn("_gone", F.when(here, F.col("_gone"))).withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.expr(kept)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
