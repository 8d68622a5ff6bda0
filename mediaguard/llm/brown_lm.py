"""Language-model scores by a Brown class bigram: p(word | previous) = p(class | previous class) p(word | class).

Tokens are the ASCII-lowered words of a text and one end.  Counts cover all training documents.  Every word has a class of its own,
found in two steps.  First, words are clustered in units: the ``CORE`` most frequent words each, all others by their last three
bytes in ``ENDINGS`` groups, the end alone; the bigram counts of units fit in (CORE + ENDINGS + 1)^2 cells whatever the corpus.  The exchange
algorithm moves one unit at a time to the class that most raises the likelihood of the class
bigram, until no unit moves or ``SWEEPS`` are over.  Then each word beyond the core, however rare, leaves its group: its
neighbours' classes are counted over all its occurrences, and it moves to the class that most raises that likelihood while all others
stay (the distributed exchange of Uszkoreit and Brants: all words move at once, against the classes of the step before).
Transitions are counted between the final classes of all tokens and Witten-Bell smoothed with class frequencies;
emissions add ``ADD`` to each word of the class and to one unseen word.  A word that training has not seen has the class of its ending.

Tasks know the counts and classes of the words above a frequency that leaves at most ``HEAD`` of them; the rest of each
text is joined with the table of all words, so all counts and classes are exact.

Nulls: a null text is empty (one token, the end); rows without a doc_id are learnt from and
scored.  Repeated rows count and are scored each.  Without training documents all counts are 0 and one class remains.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaguard.llm import tokens
from mediaguard.llm.common import cut, drop
from mediaguard.llm.quality import bucket

CORE, ENDINGS, CLASSES, SWEEPS = 768, 256, 64, 12
END = CORE + ENDINGS
UNITS = END + 1
HEAD = 1 << 18
ADD = 0.5
FLUSH = 1 << 20
TAIL = 255  # marks a token whose class is still to be joined
SMALL, ROWS = 16, 1 << 16


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(7)) == 2, F.lit(False))


def _distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes, their ending groups, and per token its distinct word and row; counts."""
    data, _ = tokens._buffers(texts)
    h, a, b, rows = tokens.spans(texts)
    word, first, which, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    a, b = a[first], b[first]
    code = np.zeros(len(word), np.uint64)
    for k in (3, 2, 1):
        at = b - k
        byte = tokens._LOWER[data[np.maximum(at, 0)]].astype(np.uint64) if len(data) else np.zeros(len(word), np.uint64)
        code = code * np.uint64(257) + np.where(at >= a, byte + np.uint64(1), np.uint64(0))
    return word, (tokens.mix(code, 3) % np.uint64(ENDINGS)).astype(np.int64), which, rows, n


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, ending, n) of a task's texts, merged before they leave it."""
    held, total = [], 0

    def merged() -> tuple:
        word, at, back = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
        n = np.zeros(len(word), np.int64)
        np.add.at(n, back, np.concatenate([x[2] for x in held]))
        return word, np.concatenate([x[1] for x in held])[at], n

    def rows(x: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1], pa.int32()), pa.array(x[2])], ["word", "ending", "n"])
    with np.errstate(over="ignore"):
        for b in tokens.pieces(batches):
            word, ending, _, _, n = _distinct(b["text"])
            held.append((word, ending, n.astype(np.int64)))
            total += len(word)
            if total > 2 * FLUSH:
                held = [merged()]
                total = len(held[0][0])
                if total > FLUSH:
                    yield rows(held[0])
                    held, total = [], 0
        if held:
            yield rows(merged())


def _units(word: np.ndarray, ending: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Unit of each word; ``core`` holds the frequent words' hashes, sorted."""
    at = np.minimum(np.searchsorted(core, word), max(len(core) - 1, 0))
    return np.where(core[at] == word, at, CORE + ending) if len(core) else CORE + ending


def _chains(unit: np.ndarray, rows: np.ndarray, n_rows: int, end: int = END) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous unit, unit, row) of every token with an end before and after each row's words."""
    starts = tokens.row_starts(rows, n_rows)
    at = starts[1:] + np.arange(n_rows)  # place of each row's end among all tokens
    full = np.insert(unit, starts[1:], end)
    before = np.concatenate([[end], full[:-1]]) if len(full) else full
    return before, full, np.repeat(np.arange(n_rows), np.diff(np.concatenate([[-1], at])))


def _bigrams(core: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(UNITS * UNITS, np.int64)
        with np.errstate(over="ignore"):
            for b in tokens.pieces(batches):
                word, ending, which, rows, _ = _distinct(b["text"])
                before, unit, _ = _chains(_units(word, ending, core)[which], rows, b.num_rows)
                cells += np.bincount(before * UNITS + unit, minlength=len(cells))
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], ["cell", "n"])
    return run


def exchange(counts: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit; ``counts`` are unit bigrams.  The last unit keeps class 0 for itself."""
    f = lambda x: x * np.log(np.maximum(x, 1))
    n = len(counts)
    often = np.argsort(-(counts.sum(0) + counts.sum(1))[:-1], kind="stable")
    of = np.zeros(n, np.int64)
    of[often] = 1 + np.arange(n - 1) % max(classes - 1, 1)
    hot = np.zeros((n, classes))
    hot[np.arange(n), of] = 1
    rows, cols = counts @ hot, counts.T @ hot  # unit to class, class to unit
    cells = hot.T @ rows
    for _ in range(sweeps):
        moved = 0
        for u in often:
            own, r, c, s = of[u], rows[u].copy(), cols[u].copy(), counts[u, u]
            if not r.sum() + c.sum():
                continue
            r[own] -= s
            c[own] -= s
            cells[own] -= r
            cells[:, own] -= c
            cells[own, own] -= s
            gain = f(cells + r[None, :]).sum(1) - f(cells).sum(1) + f(cells.T + c[None, :]).sum(1) - f(cells.T).sum(1)
            d = np.diagonal(cells)
            gain += f(d + r + c + s) - f(d + r) - f(d + c) + f(d)
            left, right = cells.sum(1) + c, cells.sum(0) + r  # neighbours keep their bigrams with the unit
            gain -= f(left + r.sum() + s) - f(left) + f(right + c.sum() + s) - f(right)
            gain[0] = -np.inf
            to = int(np.argmax(gain + 1e-9 * (np.arange(classes) == own)))
            cells[to] += r
            cells[:, to] += c
            cells[to, to] += s
            if to != own:
                of[u], moved = to, moved + 1
                rows[:, own] -= counts[:, u]
                rows[:, to] += counts[:, u]
                cols[:, own] -= counts[u]
                cols[:, to] += counts[u]
        if not moved:
            break
    return of


def _contexts(core: np.ndarray, of: np.ndarray):
    """(word, code, n) of each word beyond the core: how often it stands between two classes; ``code`` holds its own class and those."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in tokens.pieces(batches):
                word, ending, which, rows, _ = _distinct(b["text"])
                unit = np.append(_units(word, ending, core), END)
                before, full, _ = _chains(which, rows, b.num_rows, len(word))
                own = np.flatnonzero((unit >= CORE)[full] & (full < len(word)))  # an end follows, at least
                left, right = of[unit[before[own]]], of[unit[full[np.minimum(own + 1, len(full) - 1)]]]
                key, n = np.unique((full[own] << 18) | (of[unit[full[own]]] << 12) | (left << 6) | right, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word[key >> 18].view(np.int64)), pa.array(key & (1 << 18) - 1, pa.int32()), pa.array(n, pa.int64())], ["word", "code", "n"])
    return run


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best(at: np.ndarray, code: np.ndarray, n: np.ndarray, cells: np.ndarray, tables: tuple | None = None) -> np.ndarray:
    """The class that most raises the likelihood for each of several words, all others staying where they are.

    Rows are (number of the word, ascending; code; occurrences), ``cells`` the class bigrams, the words in their own class included.
    """
    into, out = tables or _tables(cells)
    classes, words = len(cells), int(at[-1]) + 1
    own = np.zeros(words, np.int64)
    own[at] = code >> 12
    gain, sides = np.zeros((words, classes)), []
    for side, near in enumerate((code & 63, code >> 6 & 63)):  # neighbours after and before
        key, back = np.unique(at * 64 + near, return_inverse=True)
        v = np.bincount(back, n).astype(np.int64)
        w, j = key >> 6, key & 63
        few = np.minimum(v, SMALL)
        term = into[side][few, j]
        mine = out[side][few, j, own[w]]
        big = np.flatnonzero(v > SMALL)
        if len(big):
            line = (cells.T if side == 0 else cells)[j[big]]  # bigrams of each class with the neighbour's
            term[big] = _f(line + v[big, None]) - _f(line)
            was = line[np.arange(len(big)), own[w[big]]]
            mine[big] = _f(was) - _f(was - v[big])
        term[np.arange(len(w)), own[w]] = mine
        first = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[first]] += np.add.reduceat(term, first, axis=0)
        sides.append((key, v))
    # a class that stands on both sides of a word: its bigram with itself gets both counts
    key, a, b = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
    w, j, x, y = key >> 6, key & 63, sides[0][1][a], sides[1][1][b]
    d, sign = np.diagonal(cells)[j], np.where(own[w] == j, -1, 1)
    gain[w, j] += sign * (_f(d + sign * (x + y)) - _f(d + sign * x) - _f(d + sign * y) + _f(d))
    total, line = np.bincount(at, n, words), np.arange(words)
    for margin in (cells.sum(1), cells.sum(0)):
        cost = _f(margin[None, :] + total[:, None]) - _f(margin)[None, :]
        cost[line, own] = _f(margin[own]) - _f(margin[own] - total)
        gain -= cost
    gain[:, 0] = -np.inf
    gain[line, own] += 1e-9
    return np.argmax(gain, axis=1)


def _tables(cells: np.ndarray) -> tuple:
    """What up to ``SMALL`` more, or fewer, bigrams of a class with a neighbour's class change: [side][count, neighbour, class]."""
    v = np.arange(SMALL + 1)[:, None, None]
    lines = cells.T[None], cells[None]
    return [_f(x + v) - _f(x) for x in lines], [_f(x) - _f(np.maximum(x - v, 0)) for x in lines]


def _moving(cells: np.ndarray):
    """(word, n, cls) of the words of rows (word, code, n) that come sorted by word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(cells)
        held = [np.zeros(0, np.int64)] * 3

        def done(word: np.ndarray, code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.diff(word, prepend=word[0]) != 0
            at = np.cumsum(new)
            names = word[np.flatnonzero(np.append(True, new[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(at, n).astype(np.int64)), pa.array(best(at, code, n, cells, tables), pa.int32())], ["word", "n", "cls"])
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                word, code, n = (np.concatenate([h, b[c].to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, ("word", "code", "n")))
                last = int(np.flatnonzero(word != word[-1])[-1]) + 1 if word[0] != word[-1] else 0
                if last:
                    yield from done(word[:last], code[:last], n[:last])
                codes, back = np.unique(code[last:], return_inverse=True)  # a word has few codes, however often it occurs
                held = [np.full(len(codes), word[-1]), codes, np.bincount(back, n[last:]).astype(np.int64)]
        if len(held[0]):
            yield from done(*held)
    return run


class Model:
    """Units' classes, emission totals per class, and the counts and classes of frequent words; a few MB, bounded by HEAD."""

    def __init__(self, core, head, head_n, head_of, of, room, size, kinds, docs):
        self.core, self.head, self.head_n, self.head_of, self.of, self.room = core, head, head_n, head_of, of, room
        self.size, self.total, self.kinds, self.docs = size, int(size.sum()), kinds, docs


def fit(docs: DataFrame) -> tuple[Model, DataFrame, int]:
    """The model, the table (word, n, cls) of all training words, and the count from which the model knows words itself."""
    train = docs.where(~held_out(F.col("doc_id"))).select(F.col("text").cast("string").alias("text"))
    parts = train.mapInArrow(_counting, "word long, ending int, n long")
    counts = cut(parts.groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("n")), "counts")
    texts = train.count()
    hist = counts.groupBy(F.expr(bucket("n")).cast("long").alias("b")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("b")).collect()
    know, room = 1 << 62, HEAD
    for r in hist:
        if r.k > room:
            break
        know, room = r.least, room - r.k
    first = counts.orderBy(F.desc("n"), "word").limit(CORE).toArrow()
    drop(counts)
    core_word, core_n = first["word"].to_numpy().view(np.uint64), first["n"].to_numpy()
    core = np.sort(core_word)
    found = train.mapInArrow(_bigrams(core), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(UNITS * UNITS)
    cells[found["cell"].to_numpy()] = found["n"].to_numpy()
    cells = cells.reshape(UNITS, UNITS)
    of = exchange(cells)
    hot = np.zeros((UNITS, CLASSES))
    hot[np.arange(UNITS), of] = 1
    # each word beyond the core by itself
    around = train.mapInArrow(_contexts(core, of), "word long, code int, n long").repartition("word").sortWithinPartitions("word")
    moved = around.mapInArrow(_moving(hot.T @ cells @ hot), "word long, n long, cls int")
    unit = np.searchsorted(core, core_word)
    kept = docs.sparkSession.createDataFrame(list(zip(core_word.view(np.int64).tolist(), core_n.tolist(), of[unit].tolist())), "word long, n long, cls int")
    classes = cut(moved.union(kept), "classes")
    size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classes.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        size[r.cls], kinds[r.cls] = r.n, r.k
    size[0], kinds[0] = texts, min(texts, 1)
    free = np.log10(size + ADD * (kinds + 1))
    free[0] = np.log10(max(texts, 1) + ADD) if texts else 0.0  # the end is alone in its class
    top = classes.where(F.col("n") >= know).toArrow().sort_by("word")
    order = np.argsort(top["word"].to_numpy().view(np.uint64))
    head, head_n, head_of = (top[c].to_numpy()[order] for c in ("word", "n", "cls"))
    return Model(core, head.view(np.uint64), head_n, head_of.astype(np.uint8), of, free, size, int(kinds.sum()), texts), classes, know


def _reading(m: Model):
    """Per text its tokens' classes as bytes (``TAIL`` where the model doesn't know the word), and those words in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in tokens.pieces(batches):
                word, ending, which, rows, _ = _distinct(b["text"])
                at = np.minimum(np.searchsorted(m.head, word), max(len(m.head) - 1, 0))
                known = m.head[at] == word if len(m.head) else np.zeros(len(word), bool)
                n = np.where(known, m.head_n[at], 0) if len(m.head) else np.zeros(len(word), np.int64)
                code = np.where(known, m.head_of[at], TAIL) if len(m.head) else np.full(len(word), TAIL)
                size = b.num_rows
                _, place, row = _chains(which, rows, size, len(word))  # distinct word, or the end
                sure = np.append(known, True)[place]
                c = np.append(n, m.docs)[place]
                add = lambda v: np.bincount(row, v, size)
                tail = np.flatnonzero(~sure)
                ends = lambda r: pa.array(np.searchsorted(r, np.arange(size + 1)), pa.int32())
                split = lambda v, kind: pa.ListArray.from_arrays(ends(row[tail]), pa.array(v, kind))
                seq = np.append(code, 0).astype(np.uint8)[place]
                yield pa.RecordBatch.from_arrays([
                    b["rid"], b["doc_id"], pa.array(np.bincount(row, minlength=size), pa.int64()),
                    pa.array(add((sure & (c > 0)).astype(float)).astype(np.int64)), pa.array(add(np.where(sure, np.log10(c + 1.0), 0))),
                    pa.array(add(np.where(sure, np.log10(c + ADD), 0))),
                    pa.Array.from_buffers(pa.binary(), size, [None, ends(row).buffers()[1], pa.py_buffer(seq.tobytes())]),
                    split(word[place[tail]].view(np.int64), pa.int64()), split(m.of[CORE + ending[place[tail]]], pa.int32())],
                    ["rid", "doc_id", "n_tokens", "n_known", "s1", "s2", "seq", "tail", "other"])
    return run


def _flat(seq: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens of several rows (a copy), and their rows."""
    at = np.frombuffer(seq.buffers()[1], np.int32)[seq.offset:seq.offset + len(seq) + 1].astype(np.int64)
    return np.frombuffer(seq.buffers()[2], np.uint8)[at[0]:at[-1]].copy(), np.repeat(np.arange(len(seq)), np.diff(at))


def _filling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the joined classes, in order, where ``TAIL`` stands."""
    for b in batches:
        if not b.num_rows:
            continue
        full, _ = _flat(b["seq"])
        full[full == TAIL] = b["fill"].flatten().to_numpy(zero_copy_only=False)
        at = pa.array(np.concatenate([[0], np.cumsum(b["n_tokens"].to_numpy())]), pa.int32())
        seq = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, at.buffers()[1], pa.py_buffer(full.tobytes())])
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_tokens"], b["n_known"], b["s1"], b["s2"], seq], ["doc_id", "n_tokens", "n_known", "s1", "s2", "seq"])


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(CLASSES * CLASSES, np.int64)
    for b in batches:
        if b.num_rows:
            full = _flat(b["seq"])[0].astype(np.int64)  # each row ends with the end, class 0, which so precedes the next
            cells += np.bincount(np.concatenate([[0], full[:-1]]) * CLASSES + full, minlength=len(cells))
    some = np.flatnonzero(cells)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], ["cell", "n"])


def _scoring(move: np.ndarray, room: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                full, row = _flat(b["seq"])
                chain = np.bincount(row, move[np.concatenate([[0], full[:-1]]), full] - room[full], b.num_rows)
                yield pa.RecordBatch.from_arrays([*[b[c] for c in ("doc_id", "n_tokens", "n_known", "s1")], pa.array(b["s2"].to_numpy() + chain)],
                                                 ["doc_id", "n_tokens", "n_known", "s1", "score"])
    return run


def classed(docs: DataFrame, model: Model, classes: DataFrame, know: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, s1 and s2 (sums over tokens of the logarithms of counts), seq (the class of each token)."""
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sums = "n_tokens long, n_known long, s1 double, s2 double, seq binary"
    seen = cut(own.mapInArrow(_reading(model), f"rid long, doc_id long, {sums}, tail array<long>, other array<int>"), "tokens")
    flat = seen.select("rid", F.posexplode(F.arrays_zip("tail", "other")).alias("i", "t")).select("rid", "i", F.col("t.tail").alias("word"), F.col("t.other").alias("other"))
    n = F.coalesce("n", F.lit(0))
    rare = flat.join(classes.where(F.col("n") < know), "word", "left").select("rid", "i", F.coalesce("cls", "other").alias("cls"), n.alias("n"))
    more = rare.groupBy("rid").agg(F.count(F.when(F.col("n") > 0, 1)).alias("k"), F.sum(F.log10(F.col("n") + 1)).alias("t1"),
                                   F.sum(F.log10(F.col("n") + ADD)).alias("t2"), F.sort_array(F.collect_list(F.struct("i", "cls"))).alias("fill"))
    z = lambda c: F.coalesce(c, F.lit(0))
    both = seen.drop("tail", "other").join(more, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + z("k")).alias("n_known"), (F.col("s1") + z("t1")).alias("s1"), (F.col("s2") + z("t2")).alias("s2"), "seq",
        F.coalesce("fill.cls", F.array().cast("array<int>")).alias("fill"))
    out = cut(both.mapInArrow(_filling, f"doc_id long, {sums}"), "classed")
    drop(seen)
    return out


def score(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    model, classes, know = fit(docs)
    rows = classed(docs, model, classes, know)
    found = rows.where(~held_out(F.col("doc_id"))).mapInArrow(_transitions, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    moves = np.zeros(CLASSES * CLASSES)
    moves[found["cell"].to_numpy()] = found["n"].to_numpy()
    moves = moves.reshape(CLASSES, CLASSES)
    new = (moves > 0).sum(1, keepdims=True) + 1.0
    back = (model.size + 1) / (model.total + CLASSES)
    move = np.log10((moves + new * back) / (moves.sum(1, keepdims=True) + new))
    out = rows.mapInArrow(_scoring(move, model.room), "doc_id long, n_tokens long, n_known long, s1 double, score double")
    base = F.col("s1") - F.col("n_tokens") * F.lit(float(np.log10(model.total + model.kinds + 1)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
                      base.alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
