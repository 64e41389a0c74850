"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are sets of words that must all occur, in order, in a
document. Ordered by rarity in the documents, the first word of a window is
enough as its prefix: without it the window can't occur. Documents are joined
with these prefix words only; the word's place in the window gives the place
where the window would begin, which has to lie inside the document, and the
words there are compared with the whole window.

A document's words are read where they are: the join with a prefix table of
proven size happens in the scan's own stage, and only hits are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.llm.common import ascii_lower, written

#: Fixed value: what a word is, after A-Z is lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table is broadcast up to this many rows and bytes of text; both are counted first.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """Distinct windows with the ids of their items; an item of fewer words, but not none, is one window."""
    words = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where("item is not null and size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    each = words.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), window).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items"))


def _fits(table: DataFrame, text_bytes: Column) -> bool:
    """Whether a table's counted rows and bytes are below what may be broadcast."""
    rows, size = table.agg(F.count("*"), F.coalesce(F.sum(text_bytes), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def prefixes(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    """Of each window that can occur, its rarest word, that word's place, and the window.

    Rarity is counted over all words of all documents; of equally rare words
    the smaller one is taken.
    """
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    if _fits(vocabulary, F.octet_length("word")):
        vocabulary = F.broadcast(vocabulary)
    counts = docs.select(F.explode(words_of(F.col(f"`{text}`"))).alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("n"))
    numbered = windows.withColumn("key", F.array_join("window", " "))
    counted = numbered.select("key", F.explode(F.array_distinct("window")).alias("word")).join(counts, "word", "left")
    rarest = counted.groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("rarest"))
    return (
        numbered.join(rarest.where("rarest.n > 0"), "key")
        .select(F.col("rarest.word").alias("word"), (F.array_position("window", F.col("rarest.word")) - 1).cast("int").alias("offset"), "window", "items")
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, hits (sorted array of start and length of the windows found) and items (sorted array of ids).

    Words are compared after lower-casing A-Z. NULL and empty texts have no
    words; items without words or without id fit nothing; items of one id
    count once. An empty benchmark gives no hits. Repeated rows of documents
    stay repeated, told apart by their place in the input, which therefore has
    to be a table or another input with a fixed order. Other columns of either
    table are not looked at.
    """
    windows = written(item_windows(benchmark, window, item_id, text), "windows")
    table = written(prefixes(docs, windows, text), "prefixes")
    small = _fits(table, F.expr("aggregate(window, 0L, (n, w) -> n + octet_length(w)) + 16 * size(items)"))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    # The empty word ends every document: it brings along the number of words.
    each = rows.select("row", "doc_id", "words", F.posexplode(F.array_append("words", F.lit(""))).alias("pos", "word"))
    ends = docs.sparkSession.range(1).select(
        F.lit("").alias("word"), F.lit(0).alias("offset"), F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast("array<string>").alias("items")
    )
    table = table.union(ends)
    if small:
        found = each.join(F.broadcast(table), "word")
        there = F.slice("words", F.col("start") + 1, F.size("window"))
    else:
        # The words around a place travel with it; the end row alone needs none.
        before = F.least(F.col("pos"), F.lit(window - 1))
        around = each.select("row", "doc_id", "pos", "word", before.alias("before"), F.slice("words", F.col("pos") - before + 1, F.lit(2 * window - 1)).alias("words"))
        found = around.join(table, "word")
        there = F.slice("words", F.greatest(F.col("before") - F.col("offset"), F.lit(0)) + 1, F.size("window"))
    found = found.withColumn("start", F.col("pos") - F.col("offset"))
    hits = found.where((F.col("word") == "") | ((F.col("start") >= 0) & (there == F.col("window"))))
    real = F.col("window").isNotNull()
    return (
        hits.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.max(F.when(~real, F.col("pos"))).cast("long").alias("n_words"),
            F.array_sort(F.collect_set(F.when(real, F.struct("start", F.size("window").alias("length"))))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(real, F.col("items")))))).alias("items"),
        )
        .select("doc_id", "n_words", "hits", "items")
    )


def covered(hits: Column) -> Column:
    """Words in the union of sorted spans."""
    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))

    def add(acc, h):
        end = (h["start"] + h["length"]).cast("long")
        more = F.greatest(end - F.greatest(h["start"].cast("long"), acc["end"]), F.lit(0).cast("long"))
        return F.struct(F.greatest(end, acc["end"]).alias("end"), (acc["total"] + more).alias("total"))

    return F.aggregate(hits, none, add, lambda acc: acc["total"])


def leak_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    found = find_leaks(docs, benchmark, window)
    return found.select(
        "doc_id",
        "n_words",
        covered(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no window of the benchmark, unchanged and in all columns.

    Contaminated texts are told by a digest, so equal texts share a verdict
    and no row number is needed.
    """
    digest = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)
    named = docs.select(digest.alias("doc_id"), F.col(f"`{text}`").alias("text"))
    bad = written(find_leaks(named, benchmark, window).where(F.size("hits") > 0).select(F.col("doc_id").alias("__digest")).distinct(), "leaks")
    if _fits(bad, F.octet_length("__digest")):
        bad = F.broadcast(bad)
    return docs.withColumn("__digest", digest).join(bad, "__digest", "left_anti").drop("__digest")
