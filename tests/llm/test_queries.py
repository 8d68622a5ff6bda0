"""Queries with SQL beside DuckDB; base columns of the others by brute force; the pipeline stage by stage."""
import collections
import math
import re
import zlib

import check
import pytest

import corpus_pipeline
from mediaguard.llm import decontaminate, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_beside_sql(spark, sf, name):
    status, n, _, message = check.compare(spark, check.connect(sf), queries.queries()[name], queries.oracle_sql()[name], sf)
    assert status == "ok" and n, message


def texts(sf):
    return dict(check.connect(sf).execute("select doc_id, text from documents").fetchall())


def test_lm_base_by_counting(spark, sf):
    docs = {i: [*WORD.findall("".join(c.lower() if c.isascii() else c for c in t)), None] for i, t in texts(sf).items()}
    train = collections.Counter(w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    rows = queries.op4_lm_scoring(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(ws), sum(train[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_repeated_passages_are_found(spark, sf):
    docs, found = texts(sf), collections.defaultdict(list)
    for r in queries.op6_substring_dedup(spark, sf).collect():
        found[r.doc_id].append((r.start, r.end))
        assert r.first_doc_id <= r.doc_id and r.end - r.start >= 64
    seen, tried = {}, 0
    for i in sorted(docs):
        for j in range(0, len(docs[i]) - 299, 300):
            if docs[i][j:j + 300] in seen:
                tried += 1
                assert any(a < j + 300 and b > j for a, b in found[i])
        for j in range(len(docs[i]) - 299):
            seen.setdefault(docs[i][j:j + 300], i)
    assert tried > 20


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = {(r.doc_id, r["copy"] if "copy" in r else 1): r for r in stage(spark, before, sf).collect()}
        if name != "mixing":
            before = spark.createDataFrame(list(kept[name].values()), docs.schema)
    plain = lambda t: " ".join(w for w in re.split(r"[\s!-/:-@\[-`{-~]+", t.lower()) if w)
    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [i for i, t in truth.items() if not t]
    assert len([1 for i in clean if (i, 1) in kept["toxicity"]]) >= 0.95 * len(clean)
    seen = set()
    for i, _ in sorted(kept["line_dedup"]):
        for line in kept["line_dedup"][i, 1].text.split("\n"):
            assert not line.strip() or line.strip().lower() not in seen
            seen.add(line.strip().lower())

    def grams(t):
        w = t.lower().split()
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    sets = {i: grams(r.text) for (i, _), r in kept["ngram_jaccard"].items()}
    ids = sorted(sets)
    assert not [1 for x, i in enumerate(ids) for j in ids[:x] if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    leaked = {i for (i, _), r in kept["ngram_jaccard"].items() if any(x in plain(r.text) for x in items)}
    assert leaked.isdisjoint(i for i, _ in kept["decontamination"])
    assert len(kept["ngram_jaccard"]) - len(kept["decontamination"]) <= len(leaked) + 3
    assert {i for i, _ in kept["mixing"]} <= {i for i, _ in kept["decontamination"]}
    assert decontaminate.SCORE < 1
