"""Inputs that must neither hang nor grow without bound, and rows that repeat a doc_id with another text."""
import collections
import random
import re
import time
import tracemalloc

import pytest

from mediaguard.llm import line_dedup, pii, queries, substring_dedup, warc


@pytest.mark.parametrize("page", [
    "<" + "a" * 1_000_000, "<a " * 300_000, "<!" + "x" * 1_000_000, "<script>" * 100_000, "<script>" + "</script " * 100_000, "<a href='" * 100_000, "</" + "b" * 1_000_000,
    "<style>x</style>" * 60_000])
def test_long_runs_of_markup_take_linear_time(page):
    began = time.time()
    warc.visible(page)
    assert time.time() - began < 5


def test_zones_of_any_stride_give_the_same_spans(monkeypatch):
    field = pii.Field().fit(pii.generated(200))
    r = random.Random(4)
    words = ["call", "415-555-0134", "x@y.org", "a", "@", "b.com", "password:", "correcthorsebattery", "12", "-", "10.0.0.7", "2024-05-06", "4111", "1111", "1111", "1111,", "(020)"]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([3, 40, 200]))) for _ in range(12)]
    whole = [pii.find(t, field) for t in texts]
    for stride in (1, 7, 64):
        monkeypatch.setattr(pii, "STRIDE", stride)
        assert [pii.find(t, field) for t in texts] == whole
    for base, every in whole:  # none of the added spans overlaps a base one
        added = [s for s in every if s not in base]
        assert not [1 for a, b, _ in added for x, y, _ in base if a < y and x < b]


def test_a_zone_of_a_whole_text_is_bounded_in_memory():
    field = pii.Field().fit(pii.generated(60))
    text = " ".join(str(i * 37 % 1000) for i in range(6000))
    tracemalloc.start()
    pii.find(text, field)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6  # 512 tokens of candidates at a time, not 6,000


def test_candidates_of_long_tokens_are_kept():
    z = pii.Zone("key= " + "a1" * 600, [(0, 4), (5, 1205)], ["", "", ""])
    assert (0, 2) in z.bounds


def test_spans_of_one_row_are_not_cut_from_another_of_its_document(spark):
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    p, a, b = words(60), words(30), words(80)
    docs = spark.createDataFrame([(1, p), (2, a + " " + p), (2, b)], "doc_id long, text string")
    got = substring_dedup.clean(docs).collect()
    texts = sorted(x.text for x in got if x.doc_id == 2)
    assert b in texts and len(got) == 3
    cut = next(t for t in texts if t != b)
    assert max([a + " " + p, b]) == a + " " + p and len(cut) < len(a + " " + p) - 250 or cut == a + " " + p


def test_every_repeated_stretch_is_found_and_no_other(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    shared = [" ".join(word() for _ in range(50)) for _ in range(4)]
    docs = {i: " ".join([*(word() for _ in range(r.randint(10, 40))), shared[i % 4], *(word() for _ in range(r.randint(10, 40)))]) for i in range(16)}
    found = collections.defaultdict(list)
    for x in substring_dedup.spans(spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")).collect():
        found[x.doc_id].append((x.start, x.end))
    for i, t in docs.items():
        at = t.index(shared[i % 4])
        covered = {c for s, e in found[i] for c in range(s, e)}
        inside = set(range(at, at + len(shared[i % 4])))
        assert covered <= inside  # nothing that stands once
        assert not covered if i < 4 else len(covered) > 0.6 * len(inside)


def test_removed_lines_name_the_line_that_stays(spark, sf):
    rows = queries.op8_line_dedup(spark, sf).collect()
    texts = {r.doc_id: (r.text or "").split("\n") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts) and {r.doc_id for r in rows} == set(texts)
    gone = {(r.doc_id, x) for r in rows for x in r.removed}
    assert len(gone) > 20
    for r in rows:
        assert r.n_lines == sum(bool(x.strip("\x20\x09\x0a\x0b\x0c\x0d")) for x in texts[r.doc_id]) and r.n_removed == len(r.removed) == len(r.kept_doc_id)
        for line, d, k in zip(r.removed, r.kept_doc_id, r.kept_line):
            assert (d, k) < (r.doc_id, line) and (d, k) not in gone
    exact = collections.defaultdict(list)
    for i, lines in sorted(texts.items()):
        for k, x in enumerate(lines):
            key = x.strip("\x20\x09\x0a\x0b\x0c\x0d").lower()
            if key:
                exact[key].append((i, k))
    assert all(p in gone for same in exact.values() for p in same[1:])


def test_many_lines_below_the_cutoff_are_left_alone(spark):
    base = "a template line whose middle part is another each time it stands somewhere: {} and then it goes on as before"
    r = random.Random(6)
    lines = [base.format("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(34))) for _ in range(1500)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    shingles = lambda t: {t[i:i + 8] for i in range(len(t) - 7)}
    assert len(shingles(lines[0]) & shingles(lines[1])) / len(shingles(lines[0]) | shingles(lines[1])) < 0.8
    assert line_dedup.removed(docs).where("size(removed) > 0").count() == 0


def test_words_are_clustered_when_none_is_frequent(spark, monkeypatch):
    from mediaguard.llm import brown_lm
    monkeypatch.setattr(brown_lm, "HEAD", 100)  # less than the words that occur once
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(60)], "doc_id long, text string")
    model, _, know = brown_lm.fit(docs)
    assert len(model.core) == brown_lm.CORE and know == 1 << 62 and len(model.head) == 0
    assert len(set(model.of[:brown_lm.CORE].tolist())) > 10
    rows = brown_lm.score(docs).collect()
    n = sum(not r.held_out for r in rows) * 21
    assert all(r.train_tokens == n and r.n_tokens == 21 and (r.held_out or r.n_known == 21) for r in rows)


def test_rare_words_of_one_ending_have_classes_of_their_own(spark):
    from mediaguard.llm import brown_lm, tokens
    import pyarrow as pa
    r = random.Random(12)
    a, b = [f"a{i}x" for i in range(400)], [f"b{i}y" for i in range(400)]  # the most frequent words take turns
    often = [" ".join(r.choice((a, b)[k % 2]) for k in range(60)) for _ in range(2000)]
    # rare words with one ending, one third of them between words of a kind
    rare = [" ".join(x for k in range(12) for x in (r.choice(a), r.choice(b), r.choice(a), f"p{r.randrange(30)}ing")) for _ in range(60)]
    rare += [" ".join(x for k in range(12) for x in (r.choice(b), r.choice(a), r.choice(b), f"q{r.randrange(30)}ing")) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(often + rare)), "doc_id long, text string")
    model, classes, _ = brown_lm.fit(docs)
    of = {x.word: x.cls for x in classes.collect()}
    code = lambda w: int(tokens.words(pa.array([w]))[0].view("int64")[0])
    p, q = [of[code(f"p{i}ing")] for i in range(30)], [of[code(f"q{i}ing")] for i in range(30)]
    core = set(model.core.view("int64").tolist())
    assert not core & {code(f"{k}{i}ing") for k in "pq" for i in range(30)}
    assert not set(p) & set(q)
    assert classes.count() == 860 and 0 not in of.values()


def test_class_of_a_rare_word_is_the_likeliest():
    import numpy as np
    from mediaguard.llm import brown_lm
    r = np.random.default_rng(4)
    cells = np.zeros((64, 64))
    cells[:9, :9] = r.integers(40, 400, (9, 9))
    f = lambda x: x * np.log(np.maximum(x, 1))
    value = lambda m: f(m).sum() - f(m.sum(0)).sum() - f(m.sum(1)).sum()
    for many in (1, 3, 30):
        own, pairs = 4, [(int(x), int(y), int(n)) for x, y, n in zip(r.permutation([0, 1, 2, 3, 5, 6, 7]), r.permutation([0, 1, 2, 3, 5, 6, 7]), r.integers(1, many + 1, 5))]
        was = cells.copy()
        for x, y, n in pairs:
            was[x, own] += n
            was[own, y] += n
        want = []
        for to in range(1, 64):
            now = cells.copy()
            for x, y, n in pairs:
                now[x, to] += n
                now[to, y] += n
            want.append(value(now))
        code = np.array([own << 12 | x << 6 | y for x, y, _ in pairs])
        to = brown_lm.best(np.zeros(5, np.int64), code, np.array([n for _, _, n in pairs]), was)[0]
        assert want[to - 1] == pytest.approx(max(want), abs=1e-6)  # unused classes are alike
