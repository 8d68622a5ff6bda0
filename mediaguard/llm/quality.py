"""Quality rules with thresholds that follow each language and source.

Per document four shares are measured.  Every (language, source) keeps a mergeable quantile
sketch of each: counts per bucket, where a bucket holds one value below 64 and values within
1/32 of each other above (an HDR layout).  Sketches add up, so a small source uses the merged
sketch of its language and a small language that of all documents.  A document stays if each
share lies within its group's quartiles widened by ``WIDTH`` quartile distances and the
share's least spread ``SLACK``.

Nulls: a null text has no words and fails; null languages and sources are groups of their own.
Only DataFrame functions are used.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaguard.llm.common import cut, words

MIN_WORDS, MAX_REPEAT = 20, 30
MIN_DOCS = 100
WIDTH = 3
# share -> (expression over the counts, is it bounded below as well, least spread)
SHARES = {
    "word_length": ("100 * word_chars div greatest(n_words, 1)", True, 250),
    "symbols": ("1000 * n_symbols div greatest(n_words, 1)", False, 250),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", False, 300),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", False, 150),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

# Words covered by the windows whose hash occurs again: sort (hash, place), keep the equal
# neighbours, sort their places and add up the steps between them, eight at most each.
_COVERED = """
  transform(array(sort_array(transform(wins, (h, i) -> struct(h as h, i as i)))), p ->
    transform(array(sort_array(transform(filter(p, (x, i) ->
        (i > 0 and p[greatest(i - 1, 0)].h = x.h) or (i < size(p) - 1 and p[least(i + 1, size(p) - 1)].h = x.h)), x -> x.i))), q ->
      aggregate(sequence(1, size(q) - 1), 8L, (s, i) -> s + least(8, q[i] - q[i - 1])))[0])[0]"""


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text; empty and null texts give zeros."""
    text = F.coalesce("text", F.lit(""))
    blank = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    held = docs.select(
        "doc_id", "lang", "source", words(F.col("text")).alias("words"), lines.alias("lines"),
        F.length(blank).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    wins = F.expr("case when size(words) < 8 then cast(array() as array<bigint>) "
                  "else transform(sequence(1, size(words) - 7), i -> xxhash64(slice(words, i, 8))) end")
    held = held.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), wins.alias("wins"))
    again = F.when(F.size(F.array_distinct("wins")) < F.size("wins"), F.expr(_COVERED)).otherwise(0)
    return held.select("doc_id", "lang", "source", "n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines",
                       again.cast("long").alias("n_repeat_words"))


def bucket(v: str) -> str:
    """SQL of the sketch bucket of a whole number."""
    e = f"(length(bin({v})) - 6)"
    return f"case when {v} < 64 then {v} else {e} * 32 + shiftright({v}, {e}) end"


def _top(b: str) -> str:
    """SQL of the largest value in a bucket."""
    return f"case when {b} < 64 then {b} else shiftleft({b} % 32 + 33, cast({b} div 32 - 1 as int)) - 1 end"


def sketches(rows: DataFrame) -> DataFrame:
    """Counts per (level, lang, source, share, bucket); level 0 is the source, 1 its language, 2 all."""
    each = F.array(*[F.struct(F.lit(k).alias("share"), F.expr(e).alias("v")) for k, (e, _, _) in SHARES.items()])
    flat = rows.select("lk", "sk", F.explode(each).alias("m")).select("lk", "sk", "m.share", "m.v")
    by_source = (flat.select("lk", "sk", "share", F.expr(bucket("v")).cast("long").alias("b"))
                 .groupBy("lk", "sk", "share", "b").agg(F.count("*").alias("n")))
    group = lambda k, *g: F.struct(F.lit(k).alias("level"), *[F.col(c).alias(n) if c else F.lit("").alias(n) for n, c in zip(("g1", "g2"), g)])
    level = F.explode(F.array(group(0, "lk", "sk"), group(1, "lk", ""), group(2, "", "")))
    return (by_source.select(level.alias("g"), "share", "b", "n").select("g.*", "share", "b", "n")
            .groupBy("level", "g1", "g2", "share", "b").agg(F.sum("n").alias("n")))


def thresholds(sketch: DataFrame) -> DataFrame:
    """Lower and upper bound of each share per group, and the documents behind it."""
    group = Window.partitionBy("level", "g1", "g2", "share")
    run = sketch.withColumns({"cum": F.sum("n").over(group.orderBy("b")), "all": F.sum("n").over(group)})
    q = lambda p: F.expr(_top("b_%d" % p))
    found = run.groupBy("level", "g1", "g2", "share").agg(
        F.max("all").alias("docs"),
        *[F.min(F.when(F.col("cum") * 4 >= F.col("all") * k, F.col("b"))).alias(f"b_{k}") for k in (1, 3)])
    found = found.withColumns({"q1": q(1), "q3": q(3)})
    slack = F.element_at(F.create_map(*[x for k, (_, _, s) in SHARES.items() for x in (F.lit(k), F.lit(s))]), F.col("share"))
    reach = WIDTH * (F.col("q3") - F.col("q1")) + slack
    return found.groupBy("level", "g1", "g2").agg(
        F.max("docs").alias("docs"),
        *[F.max(F.when(F.col("share") == k, F.col("q1") - reach)).alias(f"lo_{k}") for k in SHARES],
        *[F.max(F.when(F.col("share") == k, F.col("q3") + reach)).alias(f"hi_{k}") for k in SHARES])


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, ``base_failed`` and ``kept``.

    An empty table gives an empty result; repeated rows count as often as they occur.
    """
    rows = cut(counts(docs).withColumns({
        "lk": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null")),
        "sk": F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))}), "quality")
    bounds = cut(thresholds(sketches(rows)), "thresholds")
    names = [f"{x}_{k}" for k in SHARES for x in ("lo", "hi")]
    own = bounds.where("level = 0").select(F.col("g1").alias("lk"), F.col("g2").alias("sk"), "docs", *names)
    lang = bounds.where("level = 1").select(F.col("g1").alias("lk"), F.col("docs").alias("docs_1"), *[F.col(n).alias(f"{n}_1") for n in names])
    every = bounds.where("level = 2").first()  # one row, none for an empty table
    pick = lambda n: (F.when(F.col("docs") >= MIN_DOCS, F.col(n)).when(F.col("docs_1") >= MIN_DOCS, F.col(f"{n}_1"))
                      .otherwise(F.lit(every[n] if every else None)).alias(n))
    groups = own.join(lang, "lk").select("lk", "sk", *[pick(n) for n in names])
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words")
    inside = F.lit(True)
    for k, (e, low, _) in SHARES.items():
        inside = inside & (F.expr(e) <= F.col(f"hi_{k}"))
        if low:
            inside = inside & (F.expr(e) >= F.col(f"lo_{k}"))
    return rows.join(groups, ["lk", "sk"]).select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & inside).alias("kept"))


def oracle_sql() -> str:
    """The same result as DuckDB SQL over ``documents``."""
    share = {k: e.replace(" div ", " // ") for k, (e, _, _) in SHARES.items()}
    b = "case when v < 64 then v else (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) end"
    top = "case when {b} < 64 then {b} else (({b} % 32 + 33) << ({b} // 32 - 1)::int) - 1 end"
    flat = " union all ".join(f"select lk, sk, '{k}' as share, {e} as v from feats" for k, e in share.items())
    slack = "case share " + " ".join(f"when '{k}' then {s}" for k, (_, _, s) in SHARES.items()) + " end"
    inside = " and ".join([f"({e}) <= (select max(hi) from picked p where p.lk = f.lk and p.sk = f.sk and share = '{k}')" for k, e in share.items()]
                          + [f"({share[k]}) >= (select max(lo) from picked p where p.lk = f.lk and p.sk = f.sk and share = '{k}')" for k, (_, low, _) in SHARES.items() if low])
    failed = f"(n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words)"
    return rf"""
with t as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
grams as (select r, i, list_slice(ws, i, i + 7) as g from (select r, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
again as (select r, i from (select r, i, count(*) over (partition by r, g) as n from grams) where n > 1),
cover as (select r, sum(least(8, coalesce(nxt - i, 8)))::bigint as n from (select r, i, lead(i) over (partition by r order by i) as nxt from again) group by r),
feats as (select t.r, doc_id, len(ws)::bigint as n_words, len(ls)::bigint as n_lines,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(cover.n, 0)::bigint as n_repeat_words, coalesce('=' || lang, 'null') as lk, coalesce('=' || source, 'null') as sk
  from t join w on t.r = w.r left join cover on t.r = cover.r),
flat as ({flat}),
cells as (select lk, sk, share, {b} as b from flat),
levels as (select 0 as level, lk as g1, sk as g2, share, b from cells union all select 1, lk, '', share, b from cells union all select 2, '', '', share, b from cells),
sk as (select level, g1, g2, share, b, count(*) as n from levels group by all),
cum as (select *, sum(n) over (partition by level, g1, g2, share order by b) as cum, sum(n) over (partition by level, g1, g2, share) as docs from sk),
q as (select level, g1, g2, share, max(docs) as docs, min(case when cum * 4 >= docs then b end) as b1, min(case when cum * 4 >= docs * 3 then b end) as b3 from cum group by all),
v as (select level, g1, g2, share, docs, {top.format(b='b1')} as q1, {top.format(b='b3')} as q3 from q),
f0 as (select *, q1 - ({WIDTH} * (q3 - q1) + {slack}) as lo, q3 + ({WIDTH} * (q3 - q1) + {slack}) as hi from v),
picked as (select a.g1 as lk, a.g2 as sk, a.share,
    case when a.docs >= {MIN_DOCS} then a.lo when l.docs >= {MIN_DOCS} then l.lo else e.lo end as lo,
    case when a.docs >= {MIN_DOCS} then a.hi when l.docs >= {MIN_DOCS} then l.hi else e.hi end as hi
  from f0 a join f0 l on l.level = 1 and l.g1 = a.g1 and l.share = a.share join f0 e on e.level = 2 and e.share = a.share where a.level = 0)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} as base_failed,
  not {failed} and {inside} as kept
from feats f"""
