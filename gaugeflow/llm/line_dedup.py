"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

Every text is a sequence of its lines that aren't blank. A line's first rank
is its place in a range-sorted table of the distinct repeated lines. From
ranks of prefixes of w lines come ranks of prefixes of up to 2w lines: the
distinct pairs of the ranks at a line and w lines behind it are sorted and
numbered again. Equal ranks are an interval of the suffix array whose longest
common prefix has at least that many lines. Doubling ends at ``min_lines``:
longer common prefixes lie inside the union of these intervals, and the union
is what the deletion of later copies needs. Where a single line with many words
counts as a run, too, its copies have the same rank of width one.

A rank that occurs once ends there, as a repeated run can't begin at it, so
most lines leave after the first counting. Counting, numbering and the search
for the first copy are aggregations with map-side combination; the joins back
have one side with distinct keys, which adaptive execution splits at hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeflow.llm.common import bound, written


def _blank(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s+", " ")) == ""


def _words(line: Column) -> Column:
    return F.size(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _row() -> Column:
    return F.monotonically_increasing_id().alias("__row")


def _ranked(names: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks of distinct keys: range-sorted, their numbers ascend with them."""
    ordered = names.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def repeated_suffixes(docs: DataFrame, min_lines: int, doc_id: str, text: str, line_words: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """row, doc_id, at (place in the row's sequence) and rank of all suffixes whose first ``min_lines`` lines occur more than once.

    The second table has those whose first line has ``line_words`` words and occurs more than once.
    """
    long = [] if line_words is None else [(_words(F.col("line")) >= line_words).alias("long")]
    kept = ["long"] * len(long)
    numbered = docs.select(_row(), F.col(doc_id).alias("doc_id"), F.filter(_lines(F.col(text)), lambda x: ~_blank(x)).alias("lines"))
    lines = numbered.select(F.col("__row").alias("row"), "doc_id", F.posexplode("lines").alias("at", "line"))
    lines = lines.select("row", "doc_id", "at", F.xxhash64("line").alias("a"), F.hash("line").alias("b"), *long)
    names = lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    suffixes = written(lines.join(_ranked(names, ["a", "b"]), ["a", "b"]).select("row", "doc_id", "at", "rank", *kept), "suffixes")
    width, alone = 1, suffixes.where("long").drop("long") if long else None
    while width < min_lines:
        step = min(width, min_lines - width)
        ahead = F.lead(F.struct("at", "rank"), step).over(Window.partitionBy("row").orderBy("at"))
        pairs = suffixes.withColumn("next", ahead).where(F.col("next.at") == F.col("at") + step).select("row", "doc_id", "at", F.col("rank").alias("a"), F.col("next.rank").alias("b"))
        names = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
        suffixes = written(pairs.join(_ranked(names, ["a", "b"]), ["a", "b"]).select("row", "doc_id", "at", "rank"), "suffixes")
        width += step
    return suffixes.select("row", "doc_id", "at", "rank"), alone


def _later(suffixes: DataFrame, name: str) -> DataFrame:
    """Places of each row at which an earlier rank occurs again."""
    first = suffixes.groupBy("rank").agg(F.min(F.struct("doc_id", "row", "at")).alias("first"))
    later = suffixes.join(first, "rank").where((F.col("first.row") != F.col("row")) | (F.col("first.at") != F.col("at")))
    return later.groupBy(F.col("row").alias("__row")).agg(F.collect_set("at").alias(name))


def drop_repeated_lines(
    docs: DataFrame, min_lines: int = 2, doc_id: str = "doc_id", text: str = "text", removed: str = "removed_lines", line_words: int | None = None
) -> DataFrame:
    """``docs`` with all runs of at least ``min_lines`` lines gone that occur earlier; ``removed`` has their line numbers, from 0.

    If ``line_words`` is given, a single line of at least so many words, parted
    by white space, is such a run, too. Earlier is by doc_id (NULL first), row and line. Lines are equal if their
    characters are; blank lines are no part of a run and stay. The first copy
    of a run stays unless it is part of a longer one's later copy. NULL and
    empty texts stay as they are. Repeated rows are copies of each other. An
    input column named ``removed`` is replaced; other columns stay.

    Lines are told apart by 96 bits of two hashes. Rows are told apart by
    their place in the input, which therefore has to be a table or another
    input with a fixed order.
    """
    suffixes, alone = repeated_suffixes(docs, min_lines, doc_id, text, line_words)
    rows = docs.withColumn("__row", _row()).join(_later(suffixes, "__starts"), "__row", "left")
    either = F.col("__starts").isNotNull()
    if alone is not None:
        rows = rows.join(_later(alone, "__alone"), "__row", "left")
        either = either | F.col("__alone").isNotNull()

    def gone(lines):
        # Line numbers of the lines that aren't blank; the places in a run point into them.
        filled = F.filter(F.transform(lines, lambda x, i: F.when(~_blank(x), i)), lambda i: i.isNotNull())
        inside = F.flatten(F.transform("__starts", lambda s: F.sequence(s, s + (min_lines - 1))))
        if alone is not None:
            inside = F.concat(*[F.coalesce(x, F.array().cast("array<int>")) for x in (inside, F.col("__alone"))])
        inside = F.array_distinct(inside)
        return bound(filled, lambda f: F.array_sort(F.transform(inside, lambda i: F.get(f, i))))

    def left(lines):
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    body = F.col(f"`{text}`")
    rows = rows.withColumn("__gone", F.when(either, bound(_lines(body), gone)))
    shortened = F.when(F.col("__gone").isNull(), body).otherwise(bound(_lines(body), left))
    none = F.array().cast("array<int>")
    return rows.select(
        *[shortened.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != removed],
        F.coalesce("__gone", none).alias(removed),
    )


def line_report(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """Lines, removed lines and a digest of what is left of every document; NULL texts have no lines."""
    found = drop_repeated_lines(docs.select("doc_id", "text", F.size(_lines(F.coalesce("text", F.lit("")))).alias("lines")), min_lines)
    return found.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.col("lines")).cast("long").alias("n_lines"),
        F.size("removed_lines").cast("long").alias("n_removed"),
        F.array_join("removed_lines", ",").alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
