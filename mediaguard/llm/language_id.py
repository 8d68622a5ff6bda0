"""Languages of texts, span by span.

* Words are runs of letters (with their marks).  The script of a word's first letter narrows its candidates: languages with at
  least ``SHARE`` of their letters in that script, by Unicode ranges; a script no language has narrows nothing.
* Each candidate scores the word by its letter pairs and triples, bounded below by ``FLOOR`` so that no word settles a text.  Their
  probabilities come from counts over all training texts, hashed to ``BINS`` bins.
* Viterbi over the words of a text, where a change of language costs ``SWITCH``, labels spans of mixed texts.

A text's language is the one with most letters in its spans (ties: the first by name); its score is that share times the
probability of the language over all words.

Learning: texts with a language outside the held-out quarter.  All of them count, and what comes to the driver is bounded by
``BINS`` for each of at most ``LANGS`` languages (those with most texts; a documented bound).

Nulls: null, empty and letterless texts are ``und`` with score 0; a row without a doc_id is not held out, but teaches nothing; rows that repeat are
rows of their own; without a row to learn from every text is ``und``; an empty table gives an empty result; other columns are
ignored.  Texts are decoded whole, those above ``STRETCH`` bytes in stretches that each start anew (spans join across them).
"""
from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaguard.llm import tokens

BINS = 1 << 17
LANGS = 512
SHARE = 0.01
FLOOR, SWITCH, NEVER = 6.0, 8.0, 60.0
PIECE, STRETCH = 1 << 21, 1 << 15
NONE = "und"

# fixed values: Unicode ranges of scripts, first and last code point
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("latin", 0x2C60, 0x2C7F), ("latin", 0xA720, 0xA7FF), ("latin", 0xFF21, 0xFF5A),
    ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F), ("cyrillic", 0x1C80, 0x1C8F), ("cyrillic", 0x2DE0, 0x2DFF),
    ("cyrillic", 0xA640, 0xA69F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F),
    ("arabic", 0x08A0, 0x08FF), ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF), ("syriac", 0x0700, 0x074F), ("thaana", 0x0780, 0x07BF), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("oriya", 0x0B00, 0x0B7F), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF),
    ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("georgian", 0x1C90, 0x1CBF), ("georgian", 0x2D00, 0x2D2F), ("hangul", 0x1100, 0x11FF),
    ("hangul", 0x3130, 0x318F), ("hangul", 0xAC00, 0xD7AF), ("ethiopic", 0x1200, 0x139F), ("cherokee", 0x13A0, 0x13FF), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF),
    ("kana", 0x3040, 0x30FF), ("kana", 0x31F0, 0x31FF), ("kana", 0xFF66, 0xFF9F), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x323AF),
]
NAMES = [*dict.fromkeys(s[0] for s in SCRIPTS), "other"]
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
SCHEMA = "doc_id long, spans array<struct<start: int, end: int, lang: string>>, lang_pred string, score double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: 2 for a letter and 1 for a mark, its lower case where that is one code point, its script."""
    n = sys.maxunicode + 1
    kind, low, script = np.zeros(n, np.uint8), np.arange(n, dtype=np.uint32), np.full(n, len(NAMES) - 1, np.uint8)
    for c in range(0x323B0):  # nothing above is a letter
        k = unicodedata.category(chr(c))[0]
        kind[c] = 2 if k == "L" else k == "M"
        if k == "L" and len(x := chr(c).lower()) == 1:
            low[c] = ord(x)
    for name, a, b in SCRIPTS:
        script[a:b + 1] = NAMES.index(name)
    return kind, low, script


@dataclass
class Words:
    """Words of a stretch of texts: code points [start, end) counted in their row, row, script, and their n-grams."""
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    bins: np.ndarray    # of all n-grams, word by word
    at: np.ndarray      # where each word's n-grams begin


def words(cp: np.ndarray, edges: np.ndarray) -> Words:
    """``cp`` holds the code points of rows that begin at ``edges`` (one more for the end)."""
    kind, low, script = _letters()
    k = kind[cp]
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    full = k > 0
    new = np.ones(len(cp), bool)
    new[1:] = ~full[:-1] | (row[1:] != row[:-1])
    first = np.flatnonzero(full & new)
    end = np.ones(len(cp), bool)
    end[:-1] = ~full[1:] | (row[1:] != row[:-1])
    last = np.flatnonzero(full & end) + 1
    letter = np.concatenate([[0], np.cumsum(k == 2)])
    ok = letter[last] > letter[first]  # marks alone are no word
    first, last = first[ok], last[ok]
    # every word once more with a gap before and after: " word "
    size = last - first
    at = np.concatenate([[0], np.cumsum(size + 2)])
    flat = np.full(at[-1], 32, np.uint64)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(at[:-1] + 1, size) + inner] = low[cp[np.repeat(first, size) + inner]]
    pair = flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:] if len(flat) else flat
    triple = pair[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[2:] if len(flat) else flat
    # a word of s letters has s + 1 pairs and s triples
    bins = np.zeros(int((2 * size + 1).sum()), np.int64)
    out = np.concatenate([[0], np.cumsum(2 * size + 1)])
    spread = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    shift = np.uint64(64 - (BINS.bit_length() - 1))
    i = spread(size + 1)
    bins[np.repeat(out[:-1], size + 1) + i] = (tokens.mix(pair, 2) >> shift).astype(np.int64)[np.repeat(at[:-1], size + 1) + i] if len(size) else 0
    i = spread(size)
    bins[np.repeat(out[:-1] + size + 1, size) + i] = (tokens.mix(triple, 3) >> shift).astype(np.int64)[np.repeat(at[:-1], size) + i] if len(size) else 0
    return Words(row[first], first - edges[row[first]], last - edges[row[first]], script[cp[first]], bins, out[:-1])


def stretches(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, edges, row, offset): the texts in groups of about ``PIECE`` bytes; those above ``STRETCH`` bytes are cut at a blank or
    punctuation where there is one.  ``offset`` is the place of a stretch in its text."""
    data, at = tokens._buffers(texts)
    gap = tokens.GAPS["plain"]
    parts: list[tuple[int, int, int]] = []  # row, first and last byte
    for i in range(len(texts)):
        a, b = int(at[i]), int(at[i + 1])
        while b - a > STRETCH:
            stop = a + STRETCH
            gaps = np.flatnonzero(gap[data[a:stop]])
            stop = a + int(gaps[-1]) + 1 if len(gaps) else stop
            while (data[stop] & 0xC0) == 0x80:
                stop -= 1
            parts.append((i, a, stop))
            a = stop
        parts.append((i, a, b))
    begun: dict[int, int] = {}
    i = 0
    while i < len(parts):
        j, held = i, 0
        while j < len(parts) and (j == i or held + parts[j][2] - parts[j][1] <= PIECE):
            held += parts[j][2] - parts[j][1]
            j += 1
        own = parts[i:j]
        raw = data[own[0][1]:own[-1][2]]  # parts follow each other
        cp = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        edges = np.array([heads[p[1] - own[0][1]] for p in own] + [len(cp)], np.int64)
        offset = []
        for p, n in zip(own, np.diff(edges)):
            offset.append(begun.get(p[0], 0))
            begun[p[0]] = offset[-1] + int(n)
        yield cp, edges, np.array([p[0] for p in own]), np.array(offset)
        i = j


class Model:
    """Log probabilities of n-grams per language, and the languages of each script."""

    def __init__(self, langs: list[str], counts: np.ndarray, letters: np.ndarray):
        self.langs = langs
        self.logp = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * BINS)).astype(np.float32) if langs else np.zeros((BINS, 0), np.float32)
        share = letters / np.maximum(letters.sum(axis=0), 1)
        self.may = share >= SHARE
        self.may[~self.may.any(axis=1)] = True

    def scores(self, w: Words) -> np.ndarray:
        """Log posterior of each word per language under equal priors; pairs and triples overlap, so each counts half."""
        sums = np.float32(0.5) * np.add.reduceat(self.logp[w.bins], w.at, axis=0)
        sums = np.where(self.may[w.script], sums, -np.inf)
        sums -= sums.max(axis=1, keepdims=True)
        sums -= np.log(np.exp(sums).sum(axis=1, keepdims=True))
        return np.where(self.may[w.script], np.maximum(sums, -FLOOR), -NEVER)

    def decode(self, s: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The best language of each word; the words of a row are in order."""
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        size = np.diff(np.concatenate([heads, [len(row)]]))
        order = np.argsort(-size, kind="stable")
        heads, size = heads[order], size[order]
        live = np.searchsorted(-size, -np.arange(size[0]), "left")  # rows with more than t words come first
        best, stay = np.zeros(len(row), np.int64), np.zeros(s.shape, bool)
        now = s[heads]
        for t in range(1, size[0]):
            at = heads[:live[t]] + t
            held = now[:live[t]]
            top = held.argmax(axis=1)
            change = held.max(axis=1, keepdims=True) - SWITCH
            best[at], stay[at] = top, held >= change
            now[:live[t]] = np.maximum(held, change) + s[at]
        out = np.zeros(len(row), np.int64)
        state = now.argmax(axis=1)
        for t in range(size[0] - 1, 0, -1):
            at = heads[:live[t]] + t
            own = state[:live[t]]
            out[at] = own
            state[:live[t]] = np.where(stay[at, own], own, best[at])
        out[heads] = state
        return out

    def label(self, texts: pa.Array) -> pa.RecordBatch:
        """(spans, lang_pred, score) of each text."""
        n, k = len(texts), len(self.langs)
        letters, total = np.zeros((n, max(k, 1)), np.int64), np.zeros((n, max(k, 1)))
        found: list[list] = [[], [], [], []]  # row, start, end, language
        for cp, edges, rows, offset in stretches(texts):
            w = words(cp, edges)
            if not len(w.row) or not k:
                continue
            s = self.scores(w)
            lang = self.decode(s, w.row)
            row, start, end = rows[w.row], w.start + offset[w.row], w.end + offset[w.row]
            letters += np.bincount(row * k + lang, end - start, n * k).astype(np.int64).reshape(n, k)
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            total[row[begin]] += np.add.reduceat(s, begin, axis=0)
            head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (lang[1:] != lang[:-1])]))
            tail = np.concatenate([head[1:], [len(row)]]) - 1
            for c, v in zip(found, (row[head], start[head], end[tail], lang[head])):
                c.append(v)
        row, start, end, lang = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in found)
        if len(row):  # join across stretches
            head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (lang[1:] != lang[:-1])]))
            tail = np.concatenate([head[1:], [len(row)]]) - 1
            row, start, end, lang = row[head], start[head], end[tail], lang[head]
        names = np.array(self.langs or [NONE], object)
        spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(names[lang] if len(lang) else [], pa.string())], ["start", "end", "lang"])
        ends = pa.array(tokens.row_starts(row, n).astype(np.int32))
        top = letters.argmax(axis=1)
        some = letters.any(axis=1)
        part = np.take_along_axis(letters, top[:, None], 1)[:, 0] / np.maximum(letters.sum(axis=1), 1)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        sure = np.take_along_axis(odds, top[:, None], 1)[:, 0] / odds.sum(axis=1)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, spans), pa.array(np.where(some, names[top], NONE), pa.string()), pa.array(np.where(some, part * sure, 0.0))],
                                          ["spans", "lang_pred", "score"])


def _count(langs: list[str]):
    """(lang, bin, n) of n-grams; letters of script i stand in bin ``BINS`` + i."""
    width = BINS + len(NAMES)

    def flush(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, c in sorted(held.items()):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "bin", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        number = {x: k for k, x in enumerate(langs)}
        with np.errstate(over="ignore"):
            for b in tokens.pieces(batches):
                own = np.array([number[x] for x in b["lang"].to_pylist()])
                for cp, edges, rows, _ in stretches(b["text"]):
                    w = words(cp, edges)
                    of = own[rows[w.row]]
                    per = np.repeat(of, np.diff(np.concatenate([w.at, [len(w.bins)]])))
                    for k in np.unique(of).tolist():
                        c = held.setdefault(k, np.zeros(width, np.int64))
                        c[:BINS] += np.bincount(w.bins[per == k], minlength=BINS)
                        mine = of == k
                        c[BINS:] += np.bincount(w.script[mine], (w.end - w.start)[mine], len(NAMES)).astype(np.int64)
                    if len(held) > 32:
                        yield from flush(held)
                        held = {}
        yield from flush(held)
    return run


def fit(docs: DataFrame) -> Model:
    """Learn from all rows with a language outside the held-out quarter."""
    own = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null")
    langs = sorted(r.lang for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect())
    got = own.where(F.col("lang").isin(langs)).mapInArrow(_count(langs), "lang int, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((BINS + len(NAMES), len(langs)))
    table[got["bin"].to_numpy(), got["lang"].to_numpy()] = got["n"].to_numpy()
    return Model(langs, table[:BINS], table[BINS:])


def label(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (start, end in code points, lang), lang_pred, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore", divide="ignore"):
            for b in tokens.pieces(batches):
                out = model.label(b["text"])
                yield pa.RecordBatch.from_arrays([b["doc_id"], *out.columns], ["doc_id", *out.schema.names])
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, SCHEMA)
