"""Nulls, empty and very long texts, repeated rows, empty tables and extra columns with clashing names."""
import math
import random

import pytest

from mediaguard.llm import brown_lm, decontaminate, line_dedup, mixing, ngram_join, pii, quality, substring_dedup, toxicity

CLASH = "rank long, size string, h int, tokens string, copies int, `key` string, line string, `group` int, node string, score double, start int, n long, target string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
EXTRA = (1, "a", 2, "b", 3, "c", "d", 4, "e", 0.5, 6, 7, "t")
LONG = " ".join(["alpha", "beta", "gamma", "delta 12", "mail@x.org"][i * i % 7 % 5] + str(i % 997) for i in range(60000))
COPY = "the first of many lines with enough words in it to be compared with another of its kind\nand a second one that is just as long as the first"
ROWS = [
    (1, COPY, "en", "a", 10), (2, COPY, "en", None, 10), (2, COPY, "en", None, 10), (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \n\t", "de", "", 3),
    (6, LONG, "en", "a", len(LONG)), (None, "no id here", "en", "b", 10), (None, None, None, None, None), (7, "x", "fr", "é", 1), (8, "reach me at a.b@c.example.org", "en", "b", 5),
    (-9, "x", "fr", "zz", 1)]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame([r + EXTRA for r in ROWS], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0, "x"), (1, 0, 0, "x"), (6, 1, 1, "x"), (3, None, None, "x"), (None, 1, 1, "x"), (8, 0, 0, "x")],
                                 "doc_id long, quality int, toxic int, text string")


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


ALL = sorted((r[0] for r in ROWS), key=str)


def test_ngram_join(messy, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(messy, 4, 85)[0].where("doc_id is not null").collect()}
    assert got[1][1] == got[2][1] == 1 and got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 5) and got[7] == got[-9] == (1, -9)
    kept = ngram_join.one_of_each(messy)
    assert kept.columns == messy.columns and ids(kept) == sorted([1, 3, 4, 5, 6, 8, -9, None, None], key=str)
    assert ngram_join.join(none)[0].count() == 0


def test_mixing(messy, none):
    rows = mixing.copies(messy).collect()
    assert sorted((r.doc_id for r in rows), key=str) == ALL and all(0 <= r.copies <= 2 for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 2 * max(r.size for r in own)
    assert rows and sorted(map(str, mixing.copies(messy).collect())) == sorted(map(str, rows))
    assert mixing.mix(messy).columns == [*messy.columns, "copy"]
    assert mixing.copies(none).count() == 0 and mixing.mix(none).count() == 0


def test_toxicity(messy, none, labels):
    model = toxicity.fit(messy, labels)
    rows = toxicity.score(messy, model).collect()
    assert sorted((r.doc_id for r in rows), key=str) == ALL and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.clean(messy, labels).columns == messy.columns
    assert toxicity.score(none, model).count() == 0
    assert {r.score for r in toxicity.score(messy, toxicity.fit(messy, labels.limit(0))).collect()} == {0.5}


def test_toxicity_is_learnt_in_a_task(messy, labels, monkeypatch):
    def here(self, texts, label):
        raise AssertionError("the driver has no room for this")
    monkeypatch.setattr(toxicity.Model, "fit", here)
    model = toxicity.fit(messy, labels)
    assert model.base is not None or len(model.odds) == 2


def test_brown(messy, none):
    rows = brown_lm.score(messy).collect()
    assert sorted((r.doc_id for r in rows), key=str) == ALL
    by = {r.doc_id: r for r in rows}
    assert by[3].n_tokens == by[4].n_tokens == by[5].n_tokens == 1 and by[6].n_tokens > 60000
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) and r.score <= 0 for r in rows)
    assert brown_lm.score(none).count() == 0


def test_decontamination(messy, none, spark):
    bench = spark.createDataFrame([(1, COPY, 1), (1, COPY, 1), (2, None, 1), (3, "", 1), (None, COPY, 1), (4, "one two", 1)], "item_id long, text string, start int")
    assert sorted({(r.doc_id, r.item_id) for r in decontaminate.leaks(messy, bench).collect()}) == [(1, 1), (2, 1)]
    kept = decontaminate.clean(messy, bench)
    assert kept.columns == messy.columns and ids(kept) == sorted([r[0] for r in ROWS if r[0] not in (1, 2)], key=str)
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(messy, bench.limit(0)).count() == 0


def test_edited_benchmark_copies(spark):
    r = random.Random(2)
    vocab = ["w%d" % i for i in range(500)]
    items = [[r.choice(vocab) for _ in range(40)] for _ in range(10)]
    docs, want = [], set()
    for i in range(60):
        head, tail = ([r.choice(vocab) for _ in range(r.randint(0, 200))] for _ in range(2))
        w = list(items[i % 10])
        if i < 30:
            for k in range(3, 40, 6):
                w[k] = r.choice(vocab)
            want.add((i, i % 10))
        docs.append((i, " ".join(head + (w if i < 30 else []) + tail)))
    docs += [(100 + i, " ".join(items[0])) for i in range(30)]
    want |= {(100 + i, 0) for i in range(30)}
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, ", ".join(w).upper()) for i, w in enumerate(items)], "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want


def test_mix_hands_out_what_was_drawn(spark):
    docs = [(None if i % 2 else i // 6, "w " * (i % 5 + 1), "a" if i % 3 else "b") for i in range(240)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string")
    want = {}
    for r in mixing.copies(docs).collect():
        want[r.source, r.doc_id is None] = want.get((r.source, r.doc_id is None), 0) + r.copies
    got = {}
    for r in mixing.mix(docs).collect():
        got[r.source, r.doc_id is None] = got.get((r.source, r.doc_id is None), 0) + 1
    assert {k[0]: v for k, v in got.items() if k[1]} and sum(got.values()) == sum(want.values())
    target = {r.source: r.target for r in mixing.copies(docs).collect()}
    for s, aim in target.items():
        taken = sum(len(r.text.split()) for r in mixing.mix(docs).where(f"source = '{s}'").collect())
        assert abs(taken - aim) <= 10


def best_share(a, b):
    """Best local alignment of words: its share of a full match."""
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(max(0, old[j] + (2 if x == y else -1), old[j + 1] - 1, row[j] - 1))
        best = max(best, *row)
    return best / (2 * len(a))


def test_heavily_edited_copies_beside_exact_ones(spark):
    r = random.Random(5)
    vocab = ["v%d" % i for i in range(800)]
    items = [[r.choice(vocab) for _ in range(n)] for n in (15, 15, 22, 38, 60)]
    docs = [" ".join(w) for w in items for _ in range(3)]
    for i in range(200):
        w = []
        for x in items[i % 5]:
            turn = r.random() / r.choice([0.2, 0.25, 0.3])
            w += [x] if turn >= 1 else [[r.choice(vocab)], [r.choice(vocab)], [], [x, r.choice(vocab)]][r.randrange(4)]
        head, tail = ([r.choice(vocab) for _ in range(r.randint(0, 60))] for _ in range(2))
        docs.append(" ".join(head + w + tail))
    third = list(items[0])
    third[2::3] = ["other"] * 5  # no run of three words stays
    docs.append(" ".join(third))
    docs.append(" ".join(x for w in items[3] for x in (w, "between")))  # no two words stay together
    want = {(d, i): s for d, text in enumerate(docs) for i, w in enumerate(items) if (s := best_share(w, text.split())) >= 0.5}
    got = decontaminate.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"),
                              spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"))
    assert {(x.doc_id, x.item_id): x.score for x in got.collect()} == want
    assert {(len(docs) - 2, 0), (len(docs) - 1, 3)} <= set(want)


def test_short_benchmark_items(spark):
    items = ["Paris", "forty two", "the red fox", "one small step forward", "a bird in the hand sings"]
    docs = ["they went to paris in may", "answer: forty two.", "forty times two", "see the red fox run", "the red wolf", "one small step back", "small step", "x in the hand y",
            "nothing of the kind"]
    got = decontaminate.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"),
                              spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == {(0, 0), (1, 1), (3, 2), (5, 3), (7, 4)}


def test_substrings(messy, none):
    rows = substring_dedup.spans(messy).collect()
    assert {(r.doc_id, r.first_doc_id) for r in rows if r.doc_id == 2} == {(2, 1)} and not any(r.doc_id == 1 for r in rows)
    kept = substring_dedup.clean(messy)
    assert kept.columns == messy.columns and ids(kept) == ALL
    assert substring_dedup.spans(none).count() == 0


def test_pii(messy, none):
    field = pii.fit(messy)
    rows = pii.scan(messy, field).collect()
    assert sorted((r.doc_id for r in rows), key=str) == ALL
    by = {r.doc_id: r for r in rows}
    assert by[8].spans == "email:12:29" and by[8].n_email == 1 and by[3].spans == "" and by[6].n_email > 1000
    assert pii.scan(none, pii.fit(none)).count() == 0


def test_line_dedup(messy, none):
    gone = {r.doc_id: r.removed for r in line_dedup.removed(messy).collect()}
    assert gone[1] == [] and gone[2] == [0, 1] and gone[7] == [0] and gone[-9] == [] and 4 not in gone
    kept = line_dedup.clean(messy)
    assert kept.columns == messy.columns and ids(kept) == sorted([x for x in ALL if x not in (2, 7)], key=str)
    assert line_dedup.removed(none).count() == 0


def test_quality(messy, none):
    rows = quality.judge(messy).collect()
    assert sorted((r.doc_id for r in rows), key=str) == ALL
    by = {r.doc_id: r for r in rows}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].base_failed and not by[3].kept and by[6].n_words >= 60000
    assert quality.judge(none).count() == 0


def test_ngram_join_of_different_rows_of_one_document(spark):
    w, u = [f"w{i}" for i in range(300)], [f"u{i}" for i in range(300)]
    rows = [(1, " ".join(w[:32])), (2, " ".join([*w[:31], "zz"])), (2, " ".join(u[:203])), (2, " ".join(u[:203])), (3, " ".join(u[:201])), (4, None), (5, "")]
    out, pairs = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert sorted(map(tuple, out.collect())) == [(1, 29, 1), (2, 29, 1), (2, 200, 1), (2, 200, 1), (3, 198, 1), (4, 0, 4), (5, 0, 5)]
    assert {tuple(r) for r in pairs.collect()} == {(1, 2), (2, 3)}
