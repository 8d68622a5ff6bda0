import itertools
import random

import pytest
from pyspark.sql import functions as F

from mediaguard.llm import line_dedup, links, ngram_join
from mediaguard.llm.common import cut, drop


def jaccard(a, b):
    """Of the character shingles of two lines, by Python sets."""
    k = line_dedup.SIZE
    if min(len(a), len(b)) < k:
        return float(a == b)
    x, y = ({t[i:i + k] for i in range(len(t) - k + 1)} for t in (a, b))
    return len(x & y) / len(x | y)



def reach(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {x.node: x.component for x in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = reach({n for p in pairs for n in p}, pairs)
    assert got == {n: c for n, c in want.items() if n != c}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_link_loses_no_component(spark, monkeypatch):
    monkeypatch.setattr(links, "DENSE", 0)  # all rounds
    r = random.Random(2)
    entries = {(r.randrange(12), r.randrange(60)) for _ in range(200)}
    true = {(a, b) for a, b in itertools.combinations(range(60), 2) if (a * 7 + b * 13) % 11 == 0}

    def verify(pairs):
        return pairs.where((F.col("a") * 7 + F.col("b") * 13) % 11 == 0)
    _, parts = links.link(spark.createDataFrame(sorted(entries), "bucket long, node long"), verify)
    shared = {tuple(sorted((a, b))) for (x, a), (y, b) in itertools.product(entries, entries) if x == y and a != b}
    want = reach(range(60), true & shared)
    assert {x.node: x.component for x in parts.collect()} == {n: c for n, c in want.items() if n != c}


def test_ngram_join_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for g in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([6, 20, 60, 150]))]
        for _ in range(r.choice([1, 2, 9])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w) + r.choice(["", " ", "\n tail"]))
    shared = " ".join(r.choice(vocab) for _ in range(25))
    texts += [shared + " " + " ".join(r.choice(vocab) for _ in range(30)) for _ in range(15)] + ["", None, "One two", "one  TWO", "x"]
    rows = [(i * 3 % 1009, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, "one two", "x")], "doc_id long, text string, node string")
    parts, found = ngram_join.join(docs, 4, 85)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in parts.collect()}

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    sets = {i: grams(t) for i, t, _ in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = reach(sets, pairs)
    assert len(pairs) > 30
    assert got == {**{i: (len(s), want[i]) for i, s in sets.items()}, None: (1, None)}
    assert {(x.a, x.b) for x in found.collect()} <= set(pairs)
    kept = ngram_join.one_of_each(docs, 4, 85)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted(set(want.values()))


def test_line_dedup_against_brute_force(spark):
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(200)]
    bases = [" ".join(r.choice(vocab) for _ in range(r.choice([2, 8, 30]))) for _ in range(30)]

    def line():
        w = r.choice(bases).split()
        if len(w) > 20 and r.random() < 0.5:
            w[r.randrange(len(w))] = r.choice(vocab)
        return r.choice(["", " "]) + " ".join(w).capitalize()
    rows = [(i, "\n".join(line() if r.random() < 0.8 else "" for _ in range(r.randint(1, 6))), 5) for i in range(50)] + [(90, "", 0), (91, None, None), (None, bases[0], 1)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, n_chars long")
    lines = [(i, k, x.strip().lower()) for i, t, _ in rows if t and i is not None for k, x in enumerate(t.split("\n")) if x.strip()]
    norms = sorted({x for *_, x in lines})
    near = [(a, b) for a, b in itertools.combinations(norms, 2) if jaccard(a, b) >= line_dedup.SIMILAR]
    part = reach(norms, near)
    first, gone = {}, {}
    for i, k, x in lines:
        if first.setdefault(part[x], (i, k)) != (i, k):
            gone.setdefault(i, []).append(k)
    got = {x.doc_id: x.removed for x in line_dedup.removed(docs).collect() if x.removed}
    assert got == gone
    want = []
    for i, t, n in [*rows, rows[3]]:
        left = [x for k, x in enumerate((t or "").split("\n")) if k not in gone.get(i, [])]
        if i not in gone:
            want.append((i, t, n))
        elif len(gone[i]) < len([1 for d, *_ in lines if d == i]):
            want.append((i, "\n".join(left), len("\n".join(left))))
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in line_dedup.clean(docs).collect())


def test_spent_tables_are_dropped_and_others_stay(spark, tmp_path):
    own = cut(spark.range(20), "starts")
    other = str(tmp_path / "starts-of-others")
    spark.range(3).write.parquet(other)
    drop(own.select("id").where("id > 3"))
    drop(spark.read.parquet(other))
    drop(spark.range(2))
    assert spark.read.parquet(other).count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        own.collect()


def test_sets_that_no_pair_names_do_not_travel(spark, monkeypatch):
    r = random.Random(21)
    common = [f"c{i}" for i in range(40)]  # each text shares a few shingles with others, so all are candidates; two texts are near
    texts = [" ".join([*[f"w{k}x{j}" for j in range(r.randrange(3, 6))], *r.sample(common, 3), *common[k % 30:k % 30 + 5]]) for k in range(150)]
    base = " ".join(f"b{i}" for i in range(80))
    docs = spark.createDataFrame([*enumerate(texts), (200, base), (201, base + " tail")], "doc_id long, text string")
    sizes, real = [], ngram_join.keep

    def keep(df, column, held):
        out = real(df, column, held)
        sizes.append((df.count(), out.count()))
        return out
    monkeypatch.setattr(ngram_join, "keep", keep)
    found = {x.doc_id: x.component_id for x in ngram_join.join(docs, 4, 85)[0].collect()}
    assert {k for k, v in found.items() if k != v} == {201} and found[201] == 200
    assert sizes and all(kept <= 2 and kept < all_ for all_, kept in sizes)


def test_bitmaps_that_let_everything_pass_change_nothing(spark, monkeypatch):
    import numpy as np
    r = random.Random(22)
    texts = [" ".join(r.choice("abcdefgh") + str(r.randrange(9)) for _ in range(30)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts[:20])] + [(200 + i, t + " more") for i, t in enumerate(texts[10:30])]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    want = sorted(tuple(x) for x in ngram_join.join(docs, 4, 85)[0].collect())
    assert sum(c != d for d, _, c in want) == 40
    monkeypatch.setattr(ngram_join, "hits", lambda values, held: np.ones(len(values), bool))
    assert sorted(tuple(x) for x in ngram_join.join(docs, 4, 85)[0].collect()) == want


def test_sketches_are_made_for_lines_that_share_a_bucket_only(spark, monkeypatch):
    r = random.Random(23)
    lines = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60)).strip() for _ in range(100)]
    lines += [lines[0] + "x", lines[1] + "yz"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    real, described = links.link, []

    def link(*args, describe, **more):
        def counted(nodes):
            out = describe(nodes)
            described.append(out.count())
            return out
        return real(*args, describe=counted, **more)
    monkeypatch.setattr(line_dedup, "link", link)
    assert {x.doc_id for x in line_dedup.removed(docs).where("size(removed) > 0").collect()} == {100, 101}
    assert described and all(4 <= n < 20 for n in described)


def test_buckets_of_the_same_lines_count_once(spark, monkeypatch):
    r = random.Random(24)
    lines = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)).strip() for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(lines + [x + "y" for x in lines])), "doc_id long, text string")
    rows, real = {}, links.cut

    def counted(df, name):
        out = real(df, name)
        rows.setdefault(name, out.count())
        return out
    monkeypatch.setattr(links, "cut", counted)
    assert {x.doc_id for x in line_dedup.removed(docs).where("size(removed) > 0").collect()} == set(range(30, 60))
    assert rows["once"] <= 2 * 30 * 2 and rows["live"] > 3 * rows["once"]  # a pair shares most of its 12 buckets


def test_lines_and_their_keys_are_those_of_spark(spark):
    from mediaguard.llm.common import BLANKS
    texts = ["A b\n\n \tC  \x0b\r\n\u03a3\u0391\u03a3\nÀ\u00a0", None, "", "\n", "same\nSAME \nsame", "x" * 300_000 + "\ny", "\u0130 i\n\u039f\u03a3 \n\u03a3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    flat = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).select("doc_id", "line", F.lower(F.btrim("raw", F.lit(BLANKS))).alias("norm")).where("norm <> ''")
    want = sorted((x.doc_id, x.line, x.norm) for x in flat.collect())
    got, of = [], {}
    for at, norm, key, which in line_dedup.lines(iter(line_dedup.lowered(docs).toArrow().to_batches())):
        norm = norm.to_pylist()
        for d, k, w in zip(at["doc_id"].to_pylist(), at["line"].to_pylist(), which):
            got.append((d, k, norm[w]))
            assert of.setdefault(norm[w], key[w]) == key[w]
    assert sorted(got) == want and len(set(of.values())) == len(of)


@pytest.mark.parametrize("linked", ["all", "one"])
def test_two_components_of_a_bucket_cost_one_pair_if_it_links(spark, linked):
    entries = spark.createDataFrame([(1, i) for i in range(60)] + [(2, i) for i in range(30, 60)], "bucket long, node long")
    within = "(a < 30) = (b < 30)"
    across = {"all": "a > 0", "one": "a = 14 and b = 45"}[linked]  # never the node that the others are compared with first
    tried = []

    def verify(pairs):
        tried.append(pairs.count())
        return pairs.where(f"{within} or ({across})")
    found, parts = links.link(entries, verify, "n_a = n_b", describe=lambda nodes: cut(nodes.distinct().withColumn("n", F.lit(1)), "nodes"))
    assert {x.node: x.component for x in parts.collect()} == {i: 0 for i in range(1, 60)}
    assert sum(tried) < 200 if linked == "all" else sum(tried) > 900
    assert found.where(f"not ({within})").count() == 1


def test_buckets_of_lines_are_shuffled_and_not_written(spark, monkeypatch):
    r = random.Random(25)
    lines = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)).strip() for _ in range(30)]
    docs = spark.createDataFrame([*enumerate(lines + [x + "y" for x in lines[:3]]), (40, "one\ntwo"), (40, "three\nfour\nfive")], "doc_id long, text string")
    kinds = []
    for part in (links, line_dedup):
        monkeypatch.setattr(part, "cut", lambda df, name: kinds.append((name, df.dtypes)) or cut(df, name))
    got = {x.doc_id: (x.n_lines, x.removed) for x in line_dedup.removed(docs).collect()}
    assert got == {i: (1, [0] if i >= 30 else []) for i in range(33)} | {40: (3, [])}
    assert kinds and not any(t.startswith("array") for _, of in kinds for _, t in of)


def test_a_line_that_a_task_has_just_seen_gives_no_buckets(spark):
    r = random.Random(26)
    lines = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)) for _ in range(200)] + ["short", ""]
    batch = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").toArrow().to_batches()[0]
    got = [b.num_rows for b in line_dedup._entries(iter([batch, batch]))]
    assert 200 * line_dedup.BANDS <= sum(got) <= 210 * line_dedup.BANDS  # two keys may have one place
