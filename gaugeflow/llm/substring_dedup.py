"""Substring dedup by hashing of normalised pieces of lines.

A line is cut into clauses at sentence and clause signs, so that a passage that
was put into the middle of a line still has clauses of its own, normalised to
their lower-cased words. Units are clauses and whole lines of at least
``unit_words`` words, and, where shorter clauses lie between, the shortest
windows of clauses from each one on and up to each one that have ``run_words``
words. Units are hashed and their digests grouped over all documents; the
earliest ranked occurrence stays, and clauses inside later ones are marked. A
task sends one unit of a digest for every ``HELD_UNITS``: its others are later
copies already, so that no digest is hot, and travel as lists of their rows.
Marked clauses are a run as long as no unmarked one of at least ``unit_words``
words lies between. Of runs of at least ``run_words`` marked words the marked
clauses are removed, and their offsets in the original text are kept. Shorter
unmarked clauses stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from gaugeflow.llm.common import free_name

#: Words of the runs that are removed.
RUN_WORDS = 12
#: Units of which a task looks for copies before they are shuffled, in whole batches of texts.
HELD_UNITS = 500_000
UNIT = re.compile(r"[^\n.!?,;:]+")
WORD = re.compile(r"\w+")
HALF = 1 << 63


def pieces_of(text: str) -> list[tuple[int, int, list[str], int]]:
    """start, end, lower-cased words and line of all clauses that have words."""
    out, line, at = [], 0, 0
    for m in UNIT.finditer(text):
        words = WORD.findall(m[0].lower())
        if words:
            line, at = line + text.count("\n", at, m.start()), m.start()
            out.append((m.start() + len(m[0]) - len(m[0].lstrip()), m.start() + len(m[0].rstrip()), words, line))
    return out


def _ranges(pieces: list, unit_words: int, run_words: int) -> list[tuple[int, int]]:
    """First and last piece of the units: long clauses, long lines, and the shortest windows with short clauses that are a run."""
    sizes, found = [len(p[2]) for p in pieces], {}
    start = 0
    for i, n in enumerate(sizes):
        if n >= unit_words:
            found[i, i] = True
        if i + 1 == len(pieces) or pieces[i + 1][3] != pieces[i][3]:
            if sum(sizes[start : i + 1]) >= unit_words:
                found[start, i] = True
            start = i + 1
    if min(sizes, default=unit_words) < unit_words:
        # A copy that is a run lies inside its windows, as one begins at its first piece and one ends at its last.
        sums, shorts = [0], [0]
        for n in sizes:
            sums.append(sums[-1] + n), shorts.append(shorts[-1] + (n < unit_words))
        for i in range(len(pieces)):
            after, before = bisect_left(sums, sums[i] + run_words), bisect_right(sums, sums[i + 1] - run_words) - 1
            if after < len(sums) and shorts[after] > shorts[i]:
                found[i, after - 1] = True
            if before >= 0 and shorts[i + 1] > shorts[before]:
                found[before, i] = True
    return list(found)


def units_of(text: str, unit_words: int, run_words: int = RUN_WORDS) -> Iterator[tuple[int, int, list[str]]]:
    """start, end and lower-cased words of the units that are hashed."""
    pieces = pieces_of(text)
    for i, j in _ranges(pieces, unit_words, run_words):
        yield pieces[i][0], pieces[j][1], [w for p in pieces[i : j + 1] for w in p[2]]


def _digest(words: list[str]) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))
    return (d >> 64) - HALF, (d & (2 * HALF - 1)) - HALF


def removable(text: str, later: list[int], unit_words: int, run_words: int) -> list[tuple[int, int]]:
    """Spans of the runs of later copies that are long enough; ``later`` are numbers of hashed units."""
    pieces, marked = pieces_of(text), set(later)
    copied, first = [False] * len(pieces), {}
    for n, (i, j) in enumerate(_ranges(pieces, unit_words, run_words)):
        words = " ".join(w for p in pieces[i : j + 1] for w in p[2])
        if n not in marked:
            first[words] = j + 1
            continue
        for k in range(max(i, first.get(words, 0)), j + 1):  # a first copy that it overlaps stays
            copied[k] = True
    out, run, total = [], [], 0
    for k, (start, end, words, _) in enumerate(pieces):
        if copied[k]:
            if run and copied[k - 1]:
                run[-1] = (run[-1][0], end)
            else:
                run.append((start, end))
            total += len(words)
        elif len(words) >= unit_words:
            out += run * (total >= run_words)
            run, total = [], 0
    return out + run * (total >= run_words)


def _combined(units: pa.Table) -> Iterator[pa.RecordBatch]:
    """The first unit of each digest, and the numbers of each row's other units, which are later copies whatever other tasks have."""
    doc_id, a, b = units["doc_id"].combine_chunks(), units["a"].to_numpy(), units["b"].to_numpy()
    # Units of equal digest and doc_id stay in order of row and number, as they came.
    order = np.lexsort((doc_id.fill_null(0).to_numpy(), doc_id.is_valid().to_numpy(zero_copy_only=False), b, a))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    first, copies = units.take(order[fresh]), units.take(np.sort(order[~fresh]))
    kind = pa.list_(pa.int32())
    yield from first.append_column("later", pa.nulls(len(first), kind)).combine_chunks().to_batches()
    rows, starts = np.unique(copies["row"].to_numpy(), return_index=True)
    numbers = pa.ListArray.from_arrays(pa.array([*starts, len(copies)], pa.int32()), copies["n"].combine_chunks())
    none = pa.nulls(len(rows), pa.int64())
    sure = [pa.array(rows), none, none.cast(pa.int32()), pa.array(rows), none, numbers]
    yield pa.RecordBatch.from_arrays(sure, names=["row", "doc_id", "n", "a", "b", "later"])


def drop_repeated_passages(
    docs: DataFrame, unit_words: int = 5, run_words: int = RUN_WORDS, doc_id: str = "doc_id", text: str = "text", removed: str = "removed"
) -> DataFrame:
    """``docs`` without later copies of passages; ``removed`` has their spans (start, end) in the original text, in code points.

    Earlier is by doc_id (NULL first), row and place. NULL and empty texts and
    texts without units stay as they are, with no spans. Repeated rows
    are copies of each other. An input column named ``removed``, in upper
    or lower case, is replaced; all others stay. Digests have 128 bits. Rows are told apart by their place
    in the input, which therefore has to be a table or another input with a
    fixed order.
    """
    row = F.monotonically_increasing_id()
    place, marks = free_name(docs, "row"), free_name(docs, "later")

    def hash_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            places, numbers, first, second = [], [], [], []
            for i, t in enumerate(batch.column(2)):
                for n, (_, _, words) in enumerate(units_of(t.as_py() or "", unit_words, run_words)):
                    a, b = _digest(words)
                    places.append(i), numbers.append(n), first.append(a), second.append(b)
            at = pa.array(places, pa.int64())
            columns = [pa.array(x, k) for x, k in ((numbers, pa.int32()), (first, pa.int64()), (second, pa.int64()))]
            held.append(pa.table([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["row", "doc_id", "n", "a", "b"]))
            total += len(at)
            if total >= HELD_UNITS:
                yield from _combined(pa.concat_tables(held))
                held, total = [], 0
        if held:
            yield from _combined(pa.concat_tables(held))

    slim = docs.select(row.alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    units = slim.mapInArrow(hash_units, "row long, doc_id long, n int, a long, b long, later array<int>")
    copy = F.row_number().over(Window.partitionBy("a", "b").orderBy("doc_id", "row", "n"))
    later = units.withColumn("copy", copy).where(F.col("later").isNotNull() | (F.col("copy") > 1))
    numbers = F.flatten(F.collect_list(F.coalesce("later", F.array("n"))))
    marked = later.groupBy(F.col("row").alias(place)).agg(numbers.alias(marks))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts, spans = [], []
            for t, later in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                t, later = t.as_py(), later.as_py()
                found = removable(t, later, unit_words, run_words) if later else []
                spans.append([{"start": s, "end": e} for s, e in found])
                if found:
                    edges = [0, *(x for span in found for x in span), len(t)]
                    t = "".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))
                texts.append(t)
            columns = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(spans, kind)], names=[*batch.schema.names[:-2], text, removed])

    others = [c for c in docs.columns if c.lower() != removed.lower()]
    kept = [c for c in others if c != text]
    joined = docs.withColumn(place, row).join(marked, place, "left")
    rows = joined.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`"), F.col(marks))
    none = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))).alias(removed)
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`"), none).schema
    return rows.mapInArrow(remove, schema).select(*[f"`{c}`" for c in others], f"`{removed}`")


def passage_report(docs: DataFrame) -> DataFrame:
    """Removed spans of every document, their number and length, and a digest of what is left."""
    found = drop_repeated_passages(docs.select("doc_id", "text"))
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id",
        F.size("removed").cast("long").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("chars_removed"),
        F.concat_ws(",", spans).alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
