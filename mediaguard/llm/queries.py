"""The queries of this subpackage and the SQL they must agree with."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaguard.llm import (
    brown_lm, decontaminate, language_id, lexical_search, line_dedup, mixing, ngram_join, pii, quality, spelling, substring_dedup, toxicity, warc)
from mediaguard.llm.common import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), 4, 85)[0]


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.copies(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.spans(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.scan(docs, pii.fit(docs))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines with a word, the numbers of those that go, and for each the document and line that stay."""
    docs = table(spark, sf_dir, "documents")
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    found = ids.join(line_dedup.removed(docs), "doc_id", "left")
    none = F.array().cast("array<int>")
    return found.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.size(F.coalesce("removed", none)).cast("long").alias("n_removed"),
                        F.coalesce("removed", none).alias("removed"), F.coalesce("kept.doc_id", F.array().cast("array<bigint>")).alias("kept_doc_id"),
                        F.coalesce("kept.line", none).alias("kept_line"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.label(docs, language_id.fit(docs)).select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_mixing": op2_mixing,
        "op3_toxicity": op3_toxicity,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_decontamination": op5_decontamination,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_pii": op7_pii,
        "op8_line_dedup": op8_line_dedup,
        "op9_warc": op9_warc,
        "op10_quality_rules": op10_quality_rules,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_language_id": op12_language_id,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": ngram_join.oracle_sql(4, 85), "op2_mixing": mixing.oracle_sql(), "op10_quality_rules": quality.oracle_sql(),
            "op11_spelling_variants": spelling.oracle_sql(), "op13_lexical_search": lexical_search.oracle_sql()}
