"""Line dedup by MinHash, keeping one line of each group of near-equal lines.

Lines are split at newlines and compared lower-cased and trimmed; lines without a word are left alone.
Equal lines share a key.  The ``SIZE``-character shingles of a whole line fall into ``BINS`` bins by
hash and each bin keeps its least one (one-permutation MinHash; empty bins borrow along
fixed probes).  ``BANDS`` bands of ``BINS`` / ``BANDS`` values make the buckets: lines of
Jaccard 0.8 share one with probability 0.998, of 0.9 with 0.99999.  A pair of a bucket goes on only if the
``SKETCH`` parity bits of its shingles are near enough (``FINE`` bits once few lines are undecided; a bound that loses no
pair); sketches are made, and texts fetched, only for lines that share a bucket, once; candidates are verified by the exact Jaccard of their shingle sets, ``links.link`` finds components with distributed union-find,
and the first line of each component in order of (doc_id, line number) stays.

Nulls: a null text has no lines; rows without a doc_id are left as they are and removed from nothing; rows
that repeat a doc_id are one document; an empty table gives an empty result.  Lines shorter than a shingle
only match equal ones.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaguard.llm import tokens
from mediaguard.llm.common import BLANKS, cut
from mediaguard.llm.links import bits, hits, keep, link, near_enough, slots

SIZE = 8
SIMILAR = 0.8
BANDS, BINS = 12, 48
SKETCH, FINE = 384, 1024
_PROBE = np.random.default_rng(11).integers(0, BINS, (64, BINS))
_NONE = np.uint64(2 ** 64 - 1)
_MIXED = tokens.mix(np.arange(1 << 12, dtype=np.uint64))  # of the code points of most texts
RECENT = 1 << 16
PIECE = 1 << 17  # bytes of text at a time: what is made of them stays in a core's cache


def lowered(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in lower case; parting at newlines and trimming follow in the tasks, on Arrow arrays."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text")).alias("text"))


def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """Of rows (doc_id, text) in lower case, piece by piece: (doc_id, line) of every line with a word, the distinct lines, their keys, and which of these each line is."""
    for b in tokens.pieces(batches, "text", tokens.BLOCK):
        parts = pc.split_pattern(b["text"].fill_null(""), "\n")
        n = np.diff(parts.offsets.to_numpy())
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        norm = pc.ascii_trim(parts.flatten(), BLANKS)
        some = pc.greater(pc.binary_length(norm), 0)
        found = pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(np.repeat(np.arange(b.num_rows), n))), pa.array(place.astype(np.int32)), norm], ["doc_id", "line", "norm"])
        for q in tokens.pieces(iter([found.filter(some)]), "norm", PIECE):
            held = q["norm"].dictionary_encode()
            yield q.select(["doc_id", "line"]), held.dictionary, keys(held.dictionary), held.indices.to_numpy()


def keys(texts: pa.Array) -> np.ndarray:
    """64-bit hashes of texts that are not empty."""
    data, at = tokens._buffers(texts)
    data, at = data[at[0]:at[-1]], at - at[0]
    if not len(data):
        return np.zeros(0, np.int64)
    place = (np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))).view(np.uint64)
    place <<= np.uint64(8)
    place |= data
    with np.errstate(over="ignore"):
        return tokens.mix(np.add.reduceat(tokens.mix(place), at[:-1])).view(np.int64)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of SIZE characters."""
    data, at = tokens._buffers(texts)
    data = data[at[0]:at[-1]]
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    edges = heads[at - at[0]]
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    n = len(cp) - SIZE + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = _MIXED[cp] if cp.max() < len(_MIXED) else tokens.mix(cp.astype(np.uint64))
    step = 1
    while step < SIZE:  # hashes of runs of 2, 4, 8 characters
        left = h[:-step] * np.uint64(pow(0x9E3779B97F4A7C15, step, 2 ** 64))
        left += h[step:]
        h = left
        step *= 2
    row = np.repeat(np.arange(len(texts)), np.diff(edges))
    inside = row[:n] == row[SIZE - 1:]
    return tokens.mix(h)[inside], row[:n][inside]


def signatures(texts: pa.Array) -> np.ndarray:
    """BINS least shingle hashes per text; all ``_NONE`` where a text is shorter than a shingle."""
    out = np.full((len(texts), BINS), _NONE, np.uint64)
    h, row = shingles(texts)
    cell = row * BINS + (((h >> np.uint64(40)) * np.uint64(BINS)) >> np.uint64(24)).astype(np.int64)
    np.minimum.at(out.reshape(-1), cell, h & np.uint64(2 ** 40 - 1))
    own = out != _NONE
    some = own.any(axis=1)
    r, c = np.nonzero(some[:, None] & ~own)
    for probe in _PROBE:
        if not len(r):
            break
        hit = own[r, probe[c]]
        out[r[hit], c[hit]] = out[r[hit], probe[c[hit]]]
        r, c = r[~hit], c[~hit]
    return out


def _distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, in order; hashes of 43 bits, as one sort takes both."""
    h, row = shingles(texts)
    key = np.sort((row.astype(np.uint64) << np.uint64(43)) | (h >> np.uint64(21)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return (key >> np.uint64(43)).astype(np.int64), key & np.uint64(2 ** 43 - 1)


def sketches(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct shingles per text, and in which of ``size`` cells an odd number of them falls."""
    row, h = _distinct(texts)
    cell = row * size + ((h & np.uint64(2 ** 32 - 1)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
    return np.bincount(row, minlength=len(texts)), bits(np.bincount(cell, minlength=len(texts) * size) & 1, len(texts), size)


_NODE = [f"p{i}" for i in range(SKETCH // 64)]


def bands(texts: pa.Array) -> pa.ListArray:
    """The ``BANDS`` buckets of each text; none for one shorter than a shingle."""
    sig = signatures(texts)
    wide = sig.reshape(len(sig), BANDS, BINS // BANDS)
    h = np.full((len(sig), BANDS), 1, np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(wide.shape[2]):
        h = tokens.mix(h + wide[:, :, k] * np.uint64(0x9E3779B97F4A7C15))
    keep = (sig != _NONE).any(axis=1)
    ends = np.concatenate([[0], np.cumsum(keep * BANDS)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(h[keep].reshape(-1).view(np.int64)))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, node) of every line, node being its key; a line is left out if the task's ``RECENT`` last keys hold it."""
    last = np.zeros(RECENT, np.int64)
    last[0] = 1  # no key of this place
    with np.errstate(over="ignore"):
        for _, texts, key, _ in lines(batches):
            place = key & (RECENT - 1)
            new = last[place] != key
            last[place] = key
            own = bands(texts.filter(pa.array(new)))
            yield pa.RecordBatch.from_arrays([own.values, pa.array(np.repeat(key[new], np.diff(own.offsets.to_numpy())))], ["bucket", "node"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, line, key) of every line with a word."""
    with np.errstate(over="ignore"):
        for at, _, key, which in lines(batches):
            yield pa.RecordBatch.from_arrays([at["doc_id"], at["line"], pa.array(key[which])], ["doc_id", "line", "key"])


def _texts(held: bytes):
    """(key, norm) of the lines whose keys pass a bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, key, _ in lines(batches):
            ok = hits(key, held)
            yield pa.RecordBatch.from_arrays([pa.array(key[ok]), texts.filter(pa.array(ok))], ["key", "norm"])
    return run


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, norm, n, p0..) of lines (key, norm)."""
    with np.errstate(over="ignore"):
        for b in tokens.pieces(batches, "norm", PIECE):
            n, p = sketches(b["norm"], SKETCH)
            yield pa.RecordBatch.from_arrays([b["key"], b["norm"], pa.array(n, pa.int64()), *[pa.array(p[:, i]) for i in range(p.shape[1])]], ["key", "norm", "n", *_NODE])


def _fine(held: bytes):
    """(node, n, q0..) of the lines (key, norm, n) whose keys pass a bitmap: a longer sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                some = whole.filter(pa.array(hits(whole["key"].to_numpy(), held)))
                for b in tokens.pieces(iter([some]), "norm", PIECE):
                    _, q = sketches(b["norm"], FINE)
                    yield pa.RecordBatch.from_arrays([b["key"], b["n"], *[pa.array(q[:, i]) for i in range(q.shape[1])]],
                                                     ["node", "n", *[f"q{i}" for i in range(q.shape[1])]])
    return run


def jaccards(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Jaccard of the shingle sets of each pair of texts; texts shorter than a shingle are alike if they are equal."""
    held = pa.concat_arrays([a, b]).dictionary_encode()  # a line of many pairs is cut into shingles once
    row, h = _distinct(held.dictionary)
    starts = tokens.row_starts(row, len(held.dictionary))
    side, size = held.indices.to_numpy(), np.diff(starts)
    n = size[side]
    pair = np.repeat(np.tile(np.arange(len(a), dtype=np.uint64), 2), n)
    key = np.sort((pair << np.uint64(43)) | h[np.repeat(starts[side] - np.cumsum(n) + n, n) + np.arange(n.sum())])
    both = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(43)).astype(np.int64), minlength=len(a))
    na, nb = n[:len(a)], n[len(a):]
    equal = np.array(pc.equal(a, b).to_numpy(zero_copy_only=False), bool)
    return np.where((na == 0) | (nb == 0), equal.astype(float), both / np.maximum(na + nb - both, 1))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs (a, b, norm_a, norm_b) that are alike."""
    with np.errstate(over="ignore"):
        for whole in batches:
            for b in tokens.pieces(iter([whole]), "norm_a", PIECE):
                ok = pa.array(jaccards(b["norm_a"], b["norm_b"]) >= SIMILAR)
                yield pa.RecordBatch.from_arrays([b["a"].filter(ok), b["b"].filter(ok)], ["a", "b"])


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (doc_id, line, key, group), ``group`` being the least key of a line's component, and the verified links between keys."""
    flat = lowered(docs)
    entries = flat.mapInArrow(_entries, "bucket long, node long")

    known: list[DataFrame] = []  # texts and sketches of the lines that share a bucket, read from the documents once

    def describe(nodes: DataFrame) -> DataFrame:
        own = nodes.withColumnRenamed("node", "key")
        texts = flat.mapInArrow(_texts(slots(own, "key")), "key long, norm string").dropDuplicates(["key"]).join(own, "key", "left_semi")
        known.append(cut(texts.mapInArrow(_sketched, "key long, norm string, n long, " + ", ".join(f"{p} long" for p in _NODE)), "texts"))
        return known[0].drop("norm").withColumnRenamed("key", "node")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "pairs")
        side = lambda k: keep(known[0].select(F.col("key").alias(k), F.col("norm").alias(f"norm_{k}")), k, slots(pairs, k))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "norm_a", "norm_b").mapInArrow(_similar, "a long, b long")

    def refine(nodes: DataFrame) -> DataFrame:
        return known[0].select("key", "norm", "n").mapInArrow(_fine(slots(nodes, "node")), "node long, n long, " + ", ".join(f"q{i} long" for i in range(FINE // 64)))

    links, parts = link(entries, verify, near_enough(round(100 * SIMILAR), SKETCH), refine, near_enough(round(100 * SIMILAR), FINE, "q"), describe=describe)
    named = flat.mapInArrow(_keys, "doc_id long, line int, key long").join(parts.withColumnRenamed("node", "key"), "key", "left")
    return named.select("doc_id", "line", "key", F.coalesce("component", "key").alias("group")), links


def removed(docs: DataFrame) -> DataFrame:
    """Per document with a line with a word: doc_id, n_lines (such lines), removed (numbers of those that go, ascending) and
    kept, for each of them the (doc_id, line) that stays in its place."""
    held = cut(groups(docs)[0].select("doc_id", "line", "group"), "groups")
    first = held.groupBy("group").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")).where("n > 1").select("group", "first")
    gone = held.join(first, "group").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("line") != F.col("first.line")))
    gone = gone.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("line", F.col("first").alias("stays")))).alias("_gone"))
    size = held.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    several = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not several.isEmpty():
        again = held.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.countDistinct("line").alias("_n"))
        size = size.join(again, "doc_id", "left").select("doc_id", F.coalesce("_n", "n_lines").alias("n_lines"))
    out = size.join(gone, "doc_id", "left")
    none = F.array().cast(gone.schema["_gone"].dataType)
    return out.withColumn("_gone", F.coalesce("_gone", none)).select("doc_id", "n_lines", F.col("_gone.line").alias("removed"), F.col("_gone.stays").alias("kept"))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed lines; a document that loses all lines with words goes.

    ``n_chars``, where there is one, follows the text.
    """
    cuts = removed(docs).where("size(removed) > 0").select("doc_id", F.col("removed").alias("_removed"), (F.size("removed") == F.col("n_lines")).alias("_empty"))
    joined = docs.join(cuts, "doc_id", "left").where("not coalesce(_empty, false)")
    # array_except keeps the order of its left side
    left = ("array_join(transform(array(split(text, '\\n')), ls -> transform(array_except("
            "sequence(0, size(ls) - 1), _removed), i -> ls[i]))[0], '\\n')")
    text = F.when(F.col("_removed").isNotNull(), F.expr(left)).otherwise(F.col("text"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_removed").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
