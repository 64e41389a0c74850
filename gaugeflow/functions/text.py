"""Text statistics and references in chat texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gaugeflow.functions.topics import as_col


def text_stats(text) -> Column:
    """``struct<word_count, sentence_count, character_count, average_word_length, text_preview>``."""
    text = as_col(text)
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    sentences = F.size(F.filter(F.split(text, r"\."), lambda s: s.rlike(r"\S")))
    chars = F.length(text)
    return F.struct(
        words.alias("word_count"),
        sentences.alias("sentence_count"),
        chars.alias("character_count"),
        F.when(words > 0, F.round(chars / words, 2)).otherwise(F.lit(0.0)).alias("average_word_length"),
        F.when(chars > 100, F.concat(F.substring(text, 1, 100), F.lit("..."))).otherwise(text).alias("text_preview"),
    )


def extract_references(text) -> Column:
    """Distinct ``@name`` references in order of appearance; a name takes all following words and blanks."""
    found = F.regexp_extract_all(as_col(text), F.lit(r"@([a-zA-Z0-9_\s]+)"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda r: F.regexp_replace(r, r"^\s+|\s+$", "")), lambda r: r != ""))
