"""A training-data pipeline over ``documents``.

Language ID drops texts without a language, line dedup deletes later copies of
repeated line runs, the n-gram join keeps one document of each group of
similar ones, decontamination drops texts with passages of ``benchmark``, and
SentencePiece encodes what is left. Every stage works on all rows that the one
before kept, and is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.llm.common import parquet, written
from gaugeflow.llm.decontamination import without_leaks
from gaugeflow.llm.language import UNKNOWN, fit, held_out, predict, sample
from gaugeflow.llm.line_dedup import drop_repeated_lines
from gaugeflow.llm.ngram_join import one_of_each
from gaugeflow.llm.queries import tokenizer_file
from gaugeflow.llm.sentencepiece_fst import encode

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language has a lower mean probability over its words than this is in no language.
LEAST_SCORE = 0.25
#: A line of so many words is a run by itself.
LINE_WORDS = 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language: NULL texts, texts without letters, and scores under the least."""
    model = fit(sample(docs.where(~held_out(F.col("doc_id")))))
    found = predict(docs.select(COLUMNS), model, label_into="__label", score_into="__score")
    return found.where((F.col("__label") != UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs and of single long lines; a document of which nothing is left goes, and n_chars follows the text."""
    found = drop_repeated_lines(docs.select(COLUMNS), removed="__removed", line_words=LINE_WORDS)
    changed = F.size("__removed") > 0
    kept = found.where(~changed | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones."""
    return one_of_each(docs.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return without_leaks(docs.select(COLUMNS), parquet(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    rows = encode(docs.select(COLUMNS), tokenizer_file("piece_bpe_32k.model"), check="round_trip")
    return rows.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the language model nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
