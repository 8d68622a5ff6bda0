"""Spelling variants of words by asymmetric chunks.

Words within one edit of each other are found with two roles.  The shorter word (of equal ones the first in order) has chunks: its
two halves, at their places.  The other word has all the positional grams that could be such a chunk.  One edit leaves one
half whole, in its place or shifted by one; so a chunk joins grams of the same text within shift one.  Halves of short words are
common, so the same rule is applied once more to the half with the edit: one of its two chunks stands too.  A bucket is thus the
length of the word with chunks, the quarter that holds the edit, and the texts left and right of it.
Buckets above ``DENSE`` words are split by the same rule within that quarter.  No bucket is capped or paired blindly: a pair is met once, in
the quarter of its first difference, and verified.

A word's form is its most frequent near word (ties: the first in code-point order) if ``RATIO`` times as frequent; forms are followed
to the root by doubling, as counts grow at each step the chains are short and have no rings.

Nulls: a null text has no runs; a null doc_id counts as an empty one in the noise of ``words``.  Empty texts have no words, very long
texts and runs are taken whole; rows that repeat are counted as often as they stand; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaguard.llm.common import cut

LEAST, TWICE, NOISE, RATIO = 7, 2, 31, 10
DENSE = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = rf"[A-Za-zÀ-ÿ]{{{LEAST},}}"


def words(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters, one of ``NOISE`` with a letter lost by a hash of document and run, that occur ``TWICE`` or more.

    Shorter runs than ``LEAST`` can't become words and are not looked at.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    h = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    place = "cast(h % length(run) as int)"
    word = F.when(F.col("h") % NOISE == 0, F.expr(f"concat(left(run, {place}), substring(run, {place} + 2))")).otherwise(F.col("run"))
    return h.select(word.alias("word")).where(f"length(word) >= {LEAST}").groupBy("word").agg(F.count("*").alias("n")).where(f"n >= {TWICE}")


def _cuts(length: Column, begin: Column) -> list[Column]:
    """Where the four quarters of a stretch begin, and its end."""
    half = F.floor(length / 2).cast("int")
    return [begin, begin + F.floor(half / 2).cast("int"), begin + half, begin + half + F.floor((length - half) / 2).cast("int"), begin + length]


def _quarters(df: DataFrame, length: Column, begin: Column, shift: int, key: list[Column]) -> DataFrame:
    """One row per quarter: (lo, hi), the stretch of the word with chunks that holds the edit, and the bucket of what is left and right of it."""
    c = _cuts(length, begin)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), c[i].alias("lo"), c[i + 1].alias("hi")) for i in range(4)])
    # a quarter of a short stretch may be empty: it holds no letter of the shorter word and only the last may hold an addition
    out = df.withColumn("_c", F.explode(cells)).where("_c.hi > _c.lo or _c.i = 3")
    left = F.expr("left(word, _c.lo)")
    right = F.expr(f"substring(word, _c.hi + 1 + {shift})")
    return out.withColumn("bucket", F.xxhash64(*key, "_c.lo", "_c.hi", left, right)).withColumns({"lo": F.col("_c.lo"), "hi": F.col("_c.hi")}).drop("_c")


def _entries(own: DataFrame) -> DataFrame:
    """(bucket, role, word, n, lo, hi, size): role 0 has the chunks of its own length, role 1 the grams of a word one letter shorter.

    Words of one length have the same places in both roles, so their rows of role 0 serve as grams too.
    """
    zero = F.lit(0)
    def rows(shift: int) -> DataFrame:
        size = F.length("word") - shift
        some = own.where(F.length("word") > LEAST) if shift else own
        return _quarters(some, size, zero, shift, [size]).withColumns({"role": F.lit(shift), "size": size})
    return rows(0).unionByName(rows(1)).select("bucket", "role", "word", "n", "lo", "hi", "size")


def _pairs(entries: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): the pairs within one edit, each once."""
    x = entries.where("role = 0").select("bucket", "lo", "hi", "size", F.col("word").alias("a"), F.col("n").alias("n_a"))
    y = entries.select("bucket", "role", F.col("word").alias("b"), F.col("n").alias("n_b"))
    once = "(role = 0 and a < b) or (role = 1 and (hi = size or left(a, hi) <> left(b, hi)))"
    return x.join(y, "bucket").where(once).where("levenshtein(a, b, 1) = 1").select("a", "n_a", "b", "n_b")


def near(own: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): the pairs of distinct words (word, n) that one inserted, deleted or replaced code point parts, each once."""
    entries = cut(_entries(own), "grams")
    dense = cut(entries.groupBy("bucket").agg(F.count("*").alias("k")).where(f"k > {DENSE}").select("bucket"), "dense")
    if dense.isEmpty():
        return _pairs(entries)
    often = entries.join(dense, "bucket")
    finer = None
    for role in (0, 1):
        part = _quarters(often.where(f"role = {role}").withColumnsRenamed({"bucket": "outer", "lo": "lo0", "hi": "hi0"}),
                         F.col("hi0") - F.col("lo0"), F.col("lo0"), role, [F.col("outer")]).drop("outer", "lo0", "hi0")
        finer = part if finer is None else finer.unionByName(part)
    # a finer cell must still be the one of the first difference
    return _pairs(entries.join(dense, "bucket", "left_anti")).unionByName(_pairs(finer.select(*entries.columns)))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) over (word, form): the last of each chain."""
    out = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if out.join(on, "root", "left_semi").isEmpty():
            return out
        out = cut(out.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def group(docs: DataFrame) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of the words of ``docs``."""
    own = cut(words(docs), "words")
    pairs = near(own)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    named = cut(own.join(best, "word", "left").withColumn("ok", F.expr(f"-best.m >= {RATIO} * n"))
                .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.expr("if(ok, best.other, null)").alias("form"), F.expr("if(ok, -best.m, null)").alias("form_n")), "near")
    return (named.join(roots(named.where("form is not null")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def oracle_sql() -> str:
    """``group`` over ``documents`` as DuckDB SQL; crc32 is worked out from its table, as runs hold one- and two-byte characters only."""
    return rf"""
with recursive bits as (select c::bigint as v, c::bigint as c, 0 as k from range(256) t(c)
  union all select v, xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end), k + 1 from bits where k < 8),
tab as (select list(c order by v) as t from bits where k = 8),
runs as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]{{{LEAST},}}')) as run from documents),
once as (select id, run, count(*) as k from runs group by all),
crc as (select run, k, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(id || ':' || run, ''),
    lambda ch: case when unicode(ch) < 128 then [unicode(ch)::bigint] else [195::bigint, (unicode(ch) - 64)::bigint] end))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::bigint) as h from once, tab),
noisy as (select case when h % {NOISE} = 0 then run[:(h % length(run))] || run[(h % length(run)) + 2:] else run end as word, k from crc),
w as (select word, sum(k)::bigint as n from noisy where length(word) >= {LEAST} group by word having sum(k) >= {TWICE}),
pos as (select word, n, unnest(range(1, length(word) + 1)) as i from w),
del as (select distinct word, n, word[:i - 1] || word[i + 1:] as d from pos),
sub as (select word, n, i, word[:i - 1] || '*' || word[i + 1:] as d from pos),
pairs as (select a.word, b.word as other, b.n as m from sub a join sub b on a.d = b.d and a.word <> b.word
  union all select a.word, b.word, b.n from del a join w b on a.d = b.word
  union all select b.word, a.word, a.n from del a join w b on a.d = b.word),
best as (select word, count(*) as n_near, arg_min(other, (-m, other)) as other, max(m) as m from pairs group by word),
named as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when m >= {RATIO} * w.n then other end as form, case when m >= {RATIO} * w.n then m end as form_n
  from w left join best using (word)),
chain as (select word, word as tip, 0 as k from named union all select c.word, x.form, k + 1 from chain c join named x on x.word = c.tip where x.form is not null)
select word, form, root, n, n_near, form_n from named join (select word, arg_max(tip, k) as root from chain group by word) using (word)"""
