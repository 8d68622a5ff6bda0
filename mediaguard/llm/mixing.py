"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) weigh ``WEIGHTS``, repeating, and share ``SHARE`` of all
words.  A target stops at ``CAP`` times its source's words; what is left over goes to the others
by weight, which is filling all sources to one level (words per weight).  Inside a source every
document expects target / words copies.  The documents stand in order of size, so the
prefix sums of expected copies meet long and short texts evenly; one offset per source, drawn from a
hash of the seed and the source's name, is added, and a document comes once for each whole
number its prefix sum crosses.  Reruns agree.

Nulls: a null text has no words and is drawn like any document of size 0; null sources form a source; an empty
table gives an empty result; repeated rows are drawn each for itself.
Only DataFrame functions are used; orders over all documents or sources are dealt out by range.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaguard.llm.common import cut, ordered, running, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix"
_HASH = "cast(conv(substr(md5({0}), 1, 13), 16, 10) as bigint)"


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Add ``target`` to rows (sk, source_size, ...), one per source."""
    ranked = ordered(sources, "sk")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    held = cut(ranked.withColumn("weight", weight).withColumn("cap", cap * F.col("source_size"))
               .withColumn("level", F.col("cap") / F.col("weight")), "weights")
    total, weighed = held.agg(F.sum("source_size"), F.sum("weight")).first()
    run = running(held, ["level", "sk"], {"caps": "cap", "weighed": "weight"})
    asked = float((total or 0) * share)
    full = F.col("caps") + F.col("level") * (F.lit(weighed or 0) - F.col("weighed")) <= asked
    run = cut(run.withColumn("full", full), "levels")
    used, still = run.agg(F.sum(F.when(F.col("full"), F.col("cap"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
    share_of = F.lit(asked - (used or 0)) * F.col("weight") / F.lit(still or 1)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(share_of, F.col("cap").cast("double")))
    return run.select(*sources.columns, target.alias("target"))


def copies(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies."""
    return _drawn(docs, [], seed, **how)


def _drawn(docs: DataFrame, number: list[str], seed: str = SEED, **how) -> DataFrame:
    """``copies``, with the columns ``number`` of ``docs`` before them."""
    own = docs.select(
        *number, "doc_id", "source", F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("sk"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
        F.expr(_HASH.format("coalesce(cast(doc_id as string), '')")).alias("h"))
    placed = cut(ordered(own, "sk", "size", "h", "doc_id", *number), "placed")
    sources = placed.groupBy("sk").agg(F.sum("size").alias("source_size"), F.min("rank").alias("first"))
    aims = targets(sources, **how)
    offset = F.expr(_HASH.format(f"concat('{seed}:', sk)")) / F.lit(float(2 ** 52))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mixed = placed.join(aims.withColumn("rate", rate).withColumn("offset", offset), "sk").withColumn("k", F.col("rank") - F.col("first"))
    crossed = F.floor((F.col("k") + 1) * F.col("rate") + F.col("offset")) - F.floor(F.col("k") * F.col("rate") + F.col("offset"))
    return mixed.select(*number, "doc_id", "source", "size", "source_size", "target", F.least(crossed, F.lit(how.get("cap", CAP))).cast("long").alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: every row as often as it is drawn, with ``copy`` from 1 on.

    Rows are numbered in a written table and meet their own draws by number, so those without a
    doc_id come too, and rows that repeat one come each as often as drawn.
    """
    held = cut(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    drawn = _drawn(held, ["_row"], **how).where("copies > 0").select("_row", F.col("copies").alias("_copies"))
    return held.join(drawn, "_row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_row", "_copies")


def oracle_sql(docs: str = "documents", seed: str = SEED) -> str:
    """The contract's columns as DuckDB SQL."""
    h = "('0x' || substr(md5({0}), 1, 13))::bigint"
    return rf"""
with t as (select doc_id, coalesce('0' || source, '1') as sk, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    {h.format("coalesce(doc_id::varchar, '')")} as h from {docs}),
placed as (select *, row_number() over (partition by sk order by size, h, doc_id) - 1 as k from t),
src as (select sk, sum(size)::bigint as source_size, row_number() over (order by sk) - 1 as r from t group by sk),
w as (select *, {list(WEIGHTS)}[(r % {len(WEIGHTS)} + 1)::int] as weight, {CAP} * source_size as cap from src),
l as (select *, cap / weight::double as level from w),
run as (select *, sum(cap) over (order by level, sk) as caps, sum(weight) over (order by level, sk) as weighed,
    sum(weight) over () as weights, sum(source_size) over () as total from l),
f as (select *, caps + level * (weights - weighed) <= total * {SHARE}::double as filled from run),
rest as (select coalesce(sum(case when filled then cap end), 0) as used, sum(case when not filled then weight end) as open_weights from f),
aims as (select sk, source_size, case when filled then cap::double else least((total * {SHARE}::double - used) * weight / open_weights, cap::double) end as target from f, rest),
m as (select *, case when source_size > 0 then target / source_size else 0.0::double end as rate,
    {h.format(f"'{seed}:' || sk")} / 4503599627370496.0::double as off from placed join aims using (sk))
select doc_id, size, source_size::bigint as source_size, target,
    (size * least({CAP}, floor((k + 1) * rate + off) - floor(k * rate + off)))::bigint as taken from m"""
