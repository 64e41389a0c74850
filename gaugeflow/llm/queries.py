"""The registered queries of the subpackage and the SQL that some are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.llm import comparison_sql
from gaugeflow.llm.common import parquet
from gaugeflow.llm.decontamination import leak_report
from gaugeflow.llm.language import language_report
from gaugeflow.llm.line_dedup import line_report
from gaugeflow.llm.ngram_join import jaccard_report
from gaugeflow.llm.pii import pii_report
from gaugeflow.llm.sentencepiece_fst import encoding_report
from gaugeflow.llm.source_audit import audit_sources
from gaugeflow.llm.spelling import spelling_variants
from gaugeflow.llm.substring_dedup import passage_report
from gaugeflow.llm.token_counts import count_tokens
from gaugeflow.llm.topk import search
from gaugeflow.llm.urls import judge_urls, rules_table
from gaugeflow.llm.vector_groups import similar_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_pii", comparison_sql.PII)
def op1_pii(spark, sf_dir):
    return pii_report(parquet(spark, sf_dir, "documents"))


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query("op2_url_filters", comparison_sql.URLS)
def op2_url_filters(spark, sf_dir):
    return judge_urls(parquet(spark, sf_dir, "pages"), rules_table(spark, URL_RULES))


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir):
    return encoding_report(parquet(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    return count_tokens(parquet(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"))


@query("op5_topk", comparison_sql.TOPK)
def op5_topk(spark, sf_dir):
    return search(parquet(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op6_decontamination", comparison_sql.LEAKS)
def op6_decontamination(spark, sf_dir):
    return leak_report(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "benchmark"))


@query("op7_line_dedup", comparison_sql.LINES)
def op7_line_dedup(spark, sf_dir):
    return line_report(parquet(spark, sf_dir, "documents"))


@query("op8_substring_dedup")
def op8_substring_dedup(spark, sf_dir):
    return passage_report(parquet(spark, sf_dir, "documents"))


@query("op9_language")
def op9_language(spark, sf_dir):
    return language_report(parquet(spark, sf_dir, "documents"))


@query("op10_ngram_jaccard", comparison_sql.JACCARD)
def op10_ngram_jaccard(spark, sf_dir):
    return jaccard_report(parquet(spark, sf_dir, "documents"))


@query("op11_vector_groups", comparison_sql.VECTORS)
def op11_vector_groups(spark, sf_dir):
    return similar_vectors(parquet(spark, sf_dir, "embeddings"))


@query("op12_source_audit", comparison_sql.SOURCES)
def op12_source_audit(spark, sf_dir):
    return audit_sources(parquet(spark, sf_dir, "documents"))


@query("op13_spelling_variants", comparison_sql.SPELLING)
def op13_spelling_variants(spark, sf_dir):
    return spelling_variants(parquet(spark, sf_dir, "documents"))
