"""Spelling variants, language spans and ranked search beside brute force, and their edge cases."""
import collections
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from mediaguard.llm import language_id, lexical_search, queries, spelling

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)
CLASH = "term string, word string, n long, rank int, score double, bucket int, spans string, terms string, role int, item_id long"
EXTRA = ("t", "w", 5, 1, 0.5, 2, "s", "x", 3, 9)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"doc_id long, text string, lang string, source string, {CLASH}")


# ---------------------------------------------------------------- spelling variants

def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(docs):
    n = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def grouped(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and within_one(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("dense", [512, 2])
def test_spelling_against_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(spelling, "DENSE", dense)
    r = random.Random(dense)
    stems = ["".join(r.choice("abé") for _ in range(r.randint(7, 12))) for _ in range(12)]

    def variant(w):
        i = r.randrange(len(w))
        return r.choice([w, w, w, w[:i] + w[i + 1:], w[:i] + r.choice("abé") + w[i:], w[:i] + r.choice("abé") + w[i + 1:]])
    docs = [(i, " ".join(variant(r.choice(stems)) for _ in range(60)).upper() if i % 3 else " ".join(r.choice(stems[:2]) for _ in range(300))) for i in range(60)]
    docs += [(None, " ".join(stems)), (90, None), (91, ""), (3, docs[3][1]), (92, "x" * 3000 + "  " + "x" * 3000 + " " + "x" * 2999 + "," + "x" * 2999)]
    got = spelling.group(frame(spark, [(i, t, "en", "s") for i, t in docs])).collect()
    want = grouped(counted(docs))
    assert {tuple(x) for x in got} == want and len(got) == len(want) and any(x.form for x in got)


def test_forms_are_followed_to_the_root(spark):
    text = " ".join(["aaaaaaab"] * 2 + ["aaaaaabb"] * 30 + ["aaaaabbb"] * 400 + ["aaaabbbb"] * 5000)
    got = {x.word: x for x in spelling.group(spark.createDataFrame([(2, text)], "doc_id long, text string")).collect()}
    want = {x[0]: x for x in grouped(counted([(2, text)]))}
    assert {k: tuple(v) for k, v in got.items()} == want and len({v.root for v in got.values()}) == 1


def test_spelling_of_nothing(spark):
    assert spelling.group(frame(spark, [])).count() == 0
    assert spelling.group(frame(spark, [(1, None, None, None), (2, "short words only", "en", "s")])).count() == 0


# ---------------------------------------------------------------- language spans

def test_languages_of_the_given_tables(spark, sf):
    rows = {x.doc_id: x for x in queries.op12_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    assert len(rows) == len(docs)
    for d in docs:
        assert rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) and 0 <= rows[d.doc_id].score <= 1
    held = [d for d in docs if rows[d.doc_id].held_out and d.lang and d.text]
    assert len(held) > 20 and sum(rows[d.doc_id].lang_pred == d.lang for d in held) >= 0.98 * len(held)


GREEK, RUSSIAN, ENGLISH, GERMAN = "αυτός είναι ένας λόγος", "это просто слова здесь", "these are just some words and the others", "das sind nur einige Wörter und die anderen"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t * 5, lang, "s") for i in range(24) for t, lang in ((GREEK + " ", "el"), (RUSSIAN + " ", "ru"), (ENGLISH + " ", "en"), (GERMAN + " ", "de"))]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    return language_id.fit(frame(spark, [*rows, (500, "tests", None, None), (None, RUSSIAN, "en", "s"), (501, None, "en", "s")]))


def test_spans_of_mixed_texts(model):
    text = f"{ENGLISH} {ENGLISH} {GERMAN} {GERMAN}. {RUSSIAN}! {GREEK}"
    out = model.label(pa.array([text, None, "", "123 -- 456", "日本", text + " " + text, ENGLISH]))
    spans = out["spans"][0].as_py()
    assert [s["lang"] for s in spans] == ["en", "de", "ru", "el"]
    for s, own in zip(spans, (f"{ENGLISH} {ENGLISH}", f"{GERMAN} {GERMAN}", RUSSIAN, GREEK)):
        assert text[s["start"]:s["end"]] == own
    assert out["lang_pred"].to_pylist()[1:5] == ["und", "und", "und", out["lang_pred"][4].as_py()] and out["lang_pred"][4].as_py() in model.langs
    assert out["score"].to_pylist()[1:4] == [0, 0, 0] and out["lang_pred"][6].as_py() == "en" and out["score"][6].as_py() > 0.9


def test_viterbi_is_the_best_path(model):
    import itertools

    import numpy as np
    rng = np.random.default_rng(1)
    s, row = np.log(rng.dirichlet(np.ones(3) * 0.05, 21) + 1e-5), np.repeat([0, 1, 2], [7, 6, 8])
    got = model.decode(s, row)
    for k in range(3):
        own = s[row == k]
        cost = lambda p: sum(own[i, x] for i, x in enumerate(p)) - language_id.SWITCH * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(cost(p) for p in itertools.product(range(3), repeat=len(own)))
        assert math.isclose(cost(got[row == k].tolist()), best, rel_tol=1e-9)


def test_stretches_hold_every_character_once(monkeypatch):
    monkeypatch.setattr(language_id, "STRETCH", 64)
    monkeypatch.setattr(language_id, "PIECE", 200)
    texts = ["", "héllo wörld " * 40, "x" * 500, None, "é" * 333, "ok"]
    seen = collections.defaultdict(str)
    for cp, edges, rows, offset in language_id.stretches(pa.array(texts)):
        for a, b, i, o in zip(edges, edges[1:], rows.tolist(), offset.tolist()):
            assert len(seen[i]) == o
            seen[i] += "".join(map(chr, cp[a:b]))
    assert [seen[i] for i in range(len(texts))] == [t or "" for t in texts]


def test_languages_at_the_edges(spark, model):
    got = language_id.label(frame(spark, [(1, ENGLISH, None, None), (1, ENGLISH, "ru", "s"), (None, GERMAN, "de", "s"), (2, None, "en", "s"), (3, ENGLISH * 30000, "en", "s")]), model)
    assert sorted((x.doc_id or 0, x.lang_pred) for x in got.collect()) == [(0, "de"), (1, "en"), (1, "en"), (2, "und"), (3, "en")]
    assert language_id.label(frame(spark, []), model).count() == 0
    none = language_id.fit(frame(spark, []))
    assert [x.lang_pred for x in language_id.label(frame(spark, [(1, ENGLISH, "en", "s")]), none).collect()] == ["und"]


# ---------------------------------------------------------------- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def searched(docs, items, top=10):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    bags = [(i, collections.Counter(terms(t))) for i, t in docs if i is not None]
    big_n, big_l = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(x for _, b in bags for x in b)
    asked = collections.defaultdict(collections.Counter)
    for i, t in items:
        if i is not None:
            asked[i].update(terms(t))
    out = []
    for q, want in asked.items():
        scores = []
        for i, b in bags:
            m = 25 + (75 * sum(b.values()) * big_n) // big_l if big_l else 0
            s = sum(k * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[x] + 1))) * ((1000000000 * b[x]) // (1000 * b[x] + 8 * m)) for x, k in want.items() if b[x])
            if s > 0:
                scores.append((-s, i))
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(out)


@pytest.mark.parametrize("bucket, block", [(1024, 1 << 17), (4, 12)])
def test_search_against_brute_force(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(lexical_search, "BUCKET", bucket)
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    r = random.Random(bucket)
    vocab = [f"W{i}" for i in range(200)] + ["the"] * 60 + ["Été", "naïve", "日本"]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 5, 40, 300])))) for i in range(200)]
    docs += [(i + 200, docs[i % 7][1]) for i in range(30)] + [(7, docs[9][1]), (None, "the W1 W2"), (900, None), (901, ""), (902, "-- !!"), (903, "W3 " * 5000)]
    items = [(i, ", ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 12])))) for i in range(25)] + [(3, "W5 W5"), (None, "W1"), (50, None), (51, "..."), (52, "unknown words"), (53, docs[4][1])]
    got = lexical_search.search(frame(spark, [(i, t, "en", "s") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == searched(docs, items)


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(frame(spark, []), items).count() == 0
    assert lexical_search.search(frame(spark, [(1, "a b", "en", "s")]), items.where("item_id = 2")).count() == 0
    assert lexical_search.search(frame(spark, [(1, None, "en", "s")]), items).count() == 0
