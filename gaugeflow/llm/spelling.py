"""Spelling variants: words one edit apart, each led to the most frequent of its neighbours.

One edit leaves the first or the second half of a word as it is, so words
meet in blocks: those of one length, and of that length and one more, that
share their first half, or read backwards their second one. A block is a
sorted list. Each of its words walks the list behind it by dynamic
programming: the edit matrix is a band of three columns, its rows are kept by
depth, and the next word of the list goes on from the row at the prefix that
it shares with the one before. When a row has no value of at most one edit,
all words that share the prefix so far are skipped. All words of a part of the
list walk at once, one step each time.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeflow.llm.common import written

#: One in so many words of a document loses a letter; words need so many letters and occurrences; a form is so many times as frequent.
THINNED, LEAST_LETTERS, LEAST_COUNT, TIMES = 31, 7, 2, 10
#: Distinct words of a task before they are passed on, and characters of text that are cut at once.
HELD, PIECE = 400_000, 1 << 20
#: Words of a block; larger blocks are cut into slices by a hash, and each two slices meet in a task.
BLOCK_WORDS, HOT_BLOCKS = 100_000, 40_000
#: Bytes of the rows of all walks, words that are walked together, and bytes of their letters.
ROW_BYTES, WALK_WORDS, LETTER_BYTES = 1 << 25, 100_000, 1 << 26
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def _row_table() -> np.ndarray:
    """The next row of the band for every row and every set of matching letters; a value of 2 stands for more than one edit.

    A row holds the columns at depth - 1, depth and depth + 1 as three digits to the base 3.
    """
    table = np.zeros((27, 8), np.uint8)
    for row in range(27):
        old = [row // 9, row // 3 % 3, row % 3]
        for match in range(8):
            new, before = 0, 2
            for k in range(3):
                before = min(old[k] + 1 - (match >> k & 1), (old[k + 1] if k < 2 else 2) + 1, before + 1, 2)
                new = new * 3 + before
            table[row, match] = new
    return table


ROWS = _row_table()
#: The row at a depth to which two words are the same, the one without any value left, and the values of a row.
SAME, DEAD = 9 + 1, 26
VALUES = np.array([[r // 9, r // 3 % 3, r % 3] for r in range(27)], np.uint8)


def runs(text: str) -> Iterator[list[bytes]]:
    """The letter runs of a text in pieces, A-Z lower-cased, one byte for each letter; pieces end outside runs."""
    raw, at = text.encode("latin-1", "replace").translate(_LETTERS), 0
    while len(raw) - at > PIECE:
        end = raw.find(b" ", at + PIECE)
        if end < 0:
            break
        yield raw[at:end].split()
        at = end
    yield raw[at:].split()


def thinned(doc_id: str, run: bytes) -> bytes:
    """The run, or the run without one letter if its hash with the document's id asks for that."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(f"{doc_id}:".encode()))
    if h % THINNED:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def counted_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n of the words with enough letters and occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed() -> Iterator[pa.RecordBatch]:
            words = list(held)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part], pa.string()), pa.array([held[w] for w in part], pa.int64())], names=["word", "n"])
            held.clear()

        for batch in batches:
            for own_id, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                found: Counter = Counter()
                for piece in runs(own.as_py() or ""):
                    found.update(piece)
                for run, n in found.items():
                    if len(run) >= LEAST_LETTERS:
                        word = thinned(own_id, run)
                        if len(word) >= LEAST_LETTERS:
                            held[word] += n
                if len(held) > HELD:
                    yield from passed()
        yield from passed()

    named = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return named.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def shared_prefixes(letters: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length of the prefix that each word shares with the one before; 0 where a block begins."""
    n, out = len(letters), np.zeros(len(letters) + 1, np.int32)
    for at in range(1, n, 20_000):
        end = min(n, at + 20_000)
        other = letters[at:end] != letters[at - 1 : end - 1]
        out[at:end] = np.minimum(np.where(other.any(axis=1), other.argmax(axis=1), letters.shape[1]), np.minimum(sizes[at:end], sizes[at - 1 : end - 1]))
    out[:n][first] = 0
    return out


def next_shorter(shared: np.ndarray) -> np.ndarray:
    """For each place of the list the next one whose shared prefix is shorter; the end for 0."""
    out, open_ = [len(shared) - 1] * len(shared), []
    for i, depth in enumerate(shared.tolist()):
        while open_ and open_[-1][1] > depth:
            out[open_.pop()[0]] = i
        open_.append((i, depth))
    return np.array(out)


def walk(letters: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of words with one edit between them, each pair once; ``letters`` are sorted inside blocks, ``first`` marks where one begins."""
    n = len(letters)
    shared = shared_prefixes(letters, sizes, first)
    jump = next_shorter(shared)
    padded = np.zeros((n, letters.shape[1] + 3), np.uint8)
    padded[:, 1:-2] = letters
    one, other = [], []
    lanes = max(1, ROW_BYTES // (letters.shape[1] + 2))
    for start in range(0, n, lanes):
        q = np.arange(start, min(n, start + lanes))
        rows = np.full((len(q), letters.shape[1] + 2), SAME, np.uint8)
        at = q + 1
        depth = shared[at].astype(np.int64)
        alive = depth > 0
        q, at, depth = q[alive], at[alive], depth[alive]
        while len(q):
            letter = padded[at, depth + 1]
            match = (padded[q, depth] == letter) | (padded[q, depth + 1] == letter) << 1 | (padded[q, depth + 2] == letter) << 2
            row = ROWS[rows[q - start, depth], match]
            depth += 1
            rows[q - start, depth] = row
            dead = row == DEAD
            ended = ~dead & (depth == sizes[at])
            if ended.any():
                e = np.flatnonzero(ended)
                k = sizes[q[e]] - depth[e] + 1
                near = (k >= 0) & (k <= 2)
                near[near] = VALUES[row[e][near], k[near]] == 1
                one.append(q[e[near]])
                other.append(at[e[near]])
            moved = np.flatnonzero(dead | ended)
            if not len(moved):
                continue
            to, reach = at[moved] + 1, np.where(dead[moved], depth[moved], sizes[at[moved]] + 1)
            far = np.flatnonzero(shared[to] >= reach)
            while len(far):
                to[far] = jump[to[far]]
                far = far[shared[to[far]] >= reach[far]]
            at[moved], depth[moved] = to, shared[to]
            over = depth[moved] == 0
            if over.any():
                stay = np.ones(len(q), bool)
                stay[moved[over]] = False
                q, at, depth = q[stay], at[stay], depth[stay]
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *one]), np.concatenate([empty, *other])


def _near_in(part: pa.Table) -> pa.RecordBatch | None:
    """word, near (number of words found near), best_n and best of a part of whole blocks."""
    way, size, s1, s2, own = (part.column(c).to_numpy() for c in ("way", "size", "s1", "s2", "own"))
    n = part.column("n").to_numpy()
    words = part.column("form").to_pylist()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max())
    letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    half = np.where(way == 0, size // 2, size - size // 2)
    first = np.ones(len(words), bool)
    same = np.ones(len(words) - 1, bool)
    for c in (way, size, s1, s2):
        same &= c[1:] == c[:-1]
    same &= shared_prefixes(letters, sizes, np.zeros(len(words), bool))[1:-1] >= half[1:]
    first[1:] = ~same
    a, b = walk(letters, sizes, first)
    # Of two longer words the block of their own length takes care; of two in one slice their own slice's task.
    right = (sizes[a] == size[a]) | (sizes[b] == size[a])
    right &= (s1[a] == s2[a]) | (own[a] != own[b])
    a, b = a[right], b[right]
    # Read backwards, pairs that share their first half have been found forwards.
    back, forth = np.flatnonzero(way[a] == 1), size[a] // 2
    different = np.zeros(len(back), bool)
    for k in range(int(forth[back].max()) if len(back) else 0):
        x, y = a[back], b[back]
        different |= (k < forth[back]) & (letters[x, np.maximum(sizes[x] - 1 - k, 0)] != letters[y, np.maximum(sizes[y] - 1 - k, 0)])
    keep = np.ones(len(a), bool)
    keep[back] = different
    a, b = np.concatenate([a[keep], b[keep]]), np.concatenate([b[keep], a[keep]])
    if not len(a):
        return None
    read = lambda i: (words[i] if way[i] == 0 else words[i][::-1]).decode("latin-1")
    order = np.lexsort((-n[b], a))
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    counts = np.diff(np.r_[starts, len(a)])
    best = []
    for at, count in zip(starts.tolist(), counts.tolist()):
        most, end = n[b[at]], at + 1
        while end < at + count and n[b[end]] == most:
            end += 1
        best.append(min(map(read, b[at:end].tolist())))
    return pa.RecordBatch.from_arrays(
        [pa.array([read(i) for i in a[starts].tolist()], pa.string()), pa.array(counts, pa.int64()), pa.array(n[b[starts]], pa.int64()), pa.array(best, pa.string())],
        names=["word", "near", "best_n", "best"],
    )


def _even(table: pa.Table) -> Iterator[pa.Table]:
    """Parts of whole blocks whose words fill a matrix well: very long words are held apart from others."""
    size = table.column("size").to_numpy()
    if len(table) * (int(size.max()) + 1) <= LETTER_BYTES:
        yield table
        return
    number = table.column("block").to_numpy()
    starts = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (size[1:] != size[:-1])]).tolist() + [len(table)]
    alike: dict[int, list[pa.Table]] = {}
    for at, end in zip(starts, starts[1:]):
        alike.setdefault(int(size[at]).bit_length(), []).append(table[at:end])
    for bits, parts in alike.items():
        held: list[pa.Table] = []
        for part in parts:
            if held and (sum(map(len, held)) + len(part)) << bits > LETTER_BYTES:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
        yield pa.concat_tables(held)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts a sorted partition into parts of whole blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if sum(map(len, held)) < WALK_WORDS:
            held.append(batch)
            continue
        table = pa.Table.from_batches(held)
        # A block's rows have one number, so the part ends where the number changes.
        last = table.column("block")[-1].as_py()
        numbers = batch.column(batch.schema.get_field_index("block")).to_numpy()
        more = np.flatnonzero(numbers != last)
        if not len(more):
            held.append(batch)
            continue
        if more[0]:
            table = pa.concat_tables([table, pa.Table.from_batches([batch[: more[0]]])])
        yield from (x for x in map(_near_in, _even(table)) if x is not None)
        held = [batch[more[0] :]]
    if sum(map(len, held)):
        yield from (x for x in map(_near_in, _even(pa.Table.from_batches(held))) if x is not None)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n and best (the most frequent near word, the smallest of several) of the words that have a near one. ``words``: word, n."""
    size = F.length("word")
    seat = lambda way, shift: F.struct(F.lit(way).alias("way"), (size - shift).alias("size"))
    seats = F.filter(F.array(*[seat(way, shift) for way in (0, 1) for shift in (0, 1)]), lambda s: s["size"] >= LEAST_LETTERS)
    rows = words.select("word", "n", F.explode(seats).alias("seat")).select("word", "n", "seat.*")
    form = F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word"))
    half = F.when(F.col("way") == 0, F.floor(F.col("size") / 2)).otherwise(F.col("size") - F.floor(F.col("size") / 2))
    rows = rows.withColumn("half", F.substring(form, F.lit(1), half.cast("int"))).withColumn("form", F.encode(form, "ISO-8859-1")).drop("word")
    count = words.count()
    most = max(BLOCK_WORDS, -(-4 * count // HOT_BLOCKS))
    # There are at most HOT_BLOCKS blocks of more words than that, so the list is bounded.
    hot = rows.groupBy("way", "size", "half").count().where(F.col("count") > most) if count > most else None
    if hot is not None and (found := hot.collect()):
        hot = words.sparkSession.createDataFrame([(r["way"], r["size"], r["half"], -(-r["count"] // most)) for r in found], "way int, size int, half string, slices int")
        rows = rows.join(F.broadcast(hot), ["way", "size", "half"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    else:
        rows = rows.withColumn("slices", F.lit(1))
    own = F.pmod(F.xxhash64("form"), F.col("slices")).cast("int")
    rows = rows.withColumn("own", own).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.select("way", "size", "half", "n", "form", "own", F.least("own", "t").alias("s1"), F.greatest("own", "t").alias("s2"))
    rows = rows.withColumn("block", F.xxhash64("way", "size", "half", "s1", "s2"))
    dealt = rows.repartition("block").sortWithinPartitions("block", "way", "size", "s1", "s2", "form").drop("half")
    found = dealt.mapInArrow(_scan, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("found")).select("word", "n_near", (-F.col("found.less")).alias("best_n"), F.col("found.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of all words that have a form (word, n, form, form_n): each round doubles the steps.

    A form has TIMES the count of its word, so a way has no more steps than the largest count has digits.
    """
    paths = written(forms.select("word", F.col("form").alias("root")), "roots")
    top = forms.agg(F.max("form_n")).first()[0] or 1
    steps, done = len(str(top)), 1
    while done < steps:
        further = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        paths = written(paths.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        done *= 2
    return paths


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    Words are runs of Latin letters (up to U+00FF), A-Z lower-cased; one in
    THINNED runs of a document loses the letter that the hash of id and run
    names; at least 7 letters and 2 occurrences are left. Two words are near
    if one inserted, deleted or replaced letter lies between them. ``form`` is
    the near word with the most occurrences, the smallest of several, if these
    are at least 10 times the word's own; ``root`` is the last on the way of
    forms.

    NULL texts have no words; a NULL id counts as an empty string. Repeated
    rows count as often as they stand there. A word may have any length.
    Without words there are no rows. Other columns are not looked at.
    """
    words = written(counted_words(docs, doc_id, text), "words")
    near = near_words(words)
    joined = words.join(near, "word", "left")
    led = F.col("best_n") >= TIMES * F.col("n")
    joined = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(led, F.col("best")).alias("form"), F.when(led, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(joined.where("form IS NOT NULL"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
