"""N-gram Jaccard join as a blocked product of the document by n-gram incidence matrix with itself.

Columns (n-grams) are dealt into blocks by their hash. Sums over column groups
give an order by rarity; of each row only the columns that can't all be missed
by a similar row enter the product (the first 25 % plus one in that order, for
a bound of 75 %). A block's task turns its part into lists of rows that share
a column; equal lists are kept once, with a count, so that a group of near
copies gives few lists.

Two rows share at most the columns that lie in both prefixes and those behind
one of them, the longer rest, and no more than the smaller row has; of the
first there are no more than either row has in any list. Pairs whose sizes ask
for more are never made. Overlaps are
accumulated in rounds. First each row is held against the one row that shares most
lists with it, and links join rows to components. Then one member of
each component of a list is held against one row of the list. At last rows of
the product are accumulated for the pairs that still lie in different
components, each at its row in the smaller one; pairs whose count can't reach
the overlap that their sizes ask for are discarded, then those whose parity
maps differ in too many bits, and the others are compared whole. A pair inside a component needs no comparison, so
the work inside a group of copies is linear, and no link between different
components is missed.

Rows with equal n-gram sets are one node of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.llm.common import shuffle_partitions, worker_store, written
from gaugeflow.llm.components import components

#: Numbers of the column sums, of the pieces they travel in, and of the first-level sums of a piece.
SUMS, PIECES, FIRST_SUMS = 1 << 20, 16, 64
#: Ranks of column sums that differ by the factor two.
RANKS = 64
#: Entries of a block, and rows of a list that are paired at once.
BLOCK_ENTRIES, LIST_ROWS = 2_000_000, 2000
KEPT_WORDS = 150_000
#: Pairs of a list that are looked at, and entries of partial rows that are held, at once.
PAIRS = 200_000
#: Bits of a set's parity map: a power of two, not below four times the set's size, between these bounds.
LEAST_BITS, MOST_BITS = 256, 1 << 18
#: Nodes whose texts are found through a broadcast, 16 bytes each; more are joined by a shuffle.
BROADCAST_NODES = 500_000
#: The similarity bound is SHARED / WHOLE.
SHARED, WHOLE = 75, 100
ENTRY = np.dtype([("column", "<u4"), ("node", "<i8")])


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams; of fewer words the whole sequence is one, no words give none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    factor, out = np.uint64(0x9E3779B97F4A7C15), np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * factor + h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def node_of(columns: np.ndarray) -> int:
    """The id of a row of the matrix: a hash of its columns."""
    return xxhash.xxh3_64_intdigest(columns.tobytes()) - (1 << 63)


def parity(columns: np.ndarray) -> bytes:
    """A map in which each column of a set flips one bit."""
    bits = LEAST_BITS
    while bits < min(4 * len(columns), MOST_BITS):
        bits *= 2
    return np.packbits(np.bincount((columns & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def most_shared(p: bytes, q: bytes, n: int, m: int) -> float:
    """How many columns two sets of n and m columns can share at most.

    Every column in one set alone flips a bit of the maps' difference, so the
    sets differ in at least as many columns as the difference has bits. Of maps
    of two sizes the longer one is folded, as it would be with fewer bits.
    """
    x, y = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return (n + m - int(np.bitwise_count(x ^ y).sum())) / 2


def prefix_length(n):
    """Columns of which a row with enough overlap must share one: n - ceil(bound * n) + 1."""
    return n - (-(-SHARED * n // WHOLE)) + 1


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def measured(rows: DataFrame, size: int) -> DataFrame:
    """One row per document with its number of n-grams and node, and the column sums of each task in pieces."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("ngram_join")  # what an operator before kept goes
        names = ["row", "doc_id", "n", "node", "bits", "piece", "part", "sums"]
        hashes, sums, part = WordHashes(), np.zeros(SUMS, np.int64), 0
        for batch in batches:
            counts, nodes, bits = [], [], []
            for x in batch.column(2):
                columns = shingles(x.as_py() or "", hashes, size)
                counts.append(len(columns))
                nodes.append(node_of(columns) if len(columns) else None)
                bits.append(parity(columns) if len(columns) else None)
                np.add.at(sums, (columns >> np.uint64(44)).astype(np.int64), 1)
            part = (counts and nodes[0] or 0) % FIRST_SUMS
            empty = pa.nulls(len(counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bits, pa.binary()), empty.cast(pa.int32()), empty.cast(pa.int32()), empty.cast(pa.binary())],
                names=names,
            )
        if sums.any():
            pieces = [p.tobytes() for p in np.minimum(sums, 65535).astype(np.uint16).reshape(PIECES, -1)]
            none = pa.nulls(PIECES, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.nulls(PIECES, pa.binary()), pa.array(range(PIECES), pa.int32()), pa.array([part] * PIECES, pa.int32()), pa.array(pieces, pa.binary())], names=names
            )

    return written(rows.mapInArrow(measure, "row long, doc_id long, n long, node long, bits binary, piece int, part int, sums binary"), "measured")


def rarity(table: DataFrame) -> np.ndarray:
    """Ranks of the column sums on a scale of powers, two bytes for each of the fixed number of column groups.

    The scale is fine, as a column that occurs a few times hardly raises the sum of its group.
    """

    def add(kind):
        def run(t: pa.Table) -> pa.Table:
            total = sum((np.frombuffer(x.as_py(), kind).astype(np.uint64) for x in t.column("sums")), np.zeros(SUMS // PIECES, np.uint64))
            return pa.table({"piece": t.column("piece")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

        return run

    tasks = table.where("piece is not null").select("piece", "part", "sums")
    first = tasks.groupBy("piece", "part").applyInArrow(add(np.uint16), "piece int, sums binary")
    pieces = first.groupBy("piece").applyInArrow(add(np.uint64), "piece int, sums binary").orderBy("piece").collect()
    if not pieces:
        return np.zeros(SUMS, np.uint16)
    return (RANKS * np.log2(np.concatenate([np.frombuffer(p["sums"], np.uint64) for p in pieces]).astype(np.float64) + 1)).astype(np.uint16)


def shared_lists(rows: DataFrame, order: np.ndarray, size: int, blocks: int) -> DataFrame:
    """Lists of nodes that share a column of their prefixes, with the number of such columns and the node in most lists of a block."""
    sent = rows.sparkSession.sparkContext.broadcast(order)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("ngram_join")
        hashes, seen, order = WordHashes(), set(), sent.value
        for batch in batches:
            columns, nodes = [], []
            for x in batch.column(0):
                all_columns = shingles(x.as_py() or "", hashes, size)
                node = node_of(all_columns)
                if not len(all_columns) or node in seen:
                    continue
                seen.add(node)
                rank = order[(all_columns >> np.uint64(44)).astype(np.int64)]
                first = all_columns[np.argsort(rank, kind="stable")[: prefix_length(len(all_columns))]]
                columns.append(first)
                nodes.append(np.full(len(first), node, np.int64))
            if not columns:
                continue
            columns, nodes = np.concatenate(columns), np.concatenate(nodes)
            block = ((columns >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
            by_block = np.argsort(block, kind="stable")
            data = np.empty(len(columns), ENTRY)
            data["column"], data["node"] = columns[by_block] & np.uint64(0xFFFFFFFF), nodes[by_block]
            numbers, starts = np.unique(block[by_block], return_index=True)
            parts = [p.tobytes() for p in np.split(data, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(parts, pa.binary())], names=["block", "entries"])

    def lists(table: pa.Table) -> pa.Table:
        worker_store("ngram_join")
        data = np.concatenate([np.frombuffer(x.as_py(), ENTRY) for x in table.column("entries")])
        data = data[np.lexsort((data["node"], data["column"]))]
        column, node = data["column"], data["node"]
        fresh = np.ones(len(data), bool)
        fresh[1:] = (column[1:] != column[:-1]) | (node[1:] != node[:-1])
        column, node = column[fresh], node[fresh]
        starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
        ends = np.concatenate([starts[1:], [len(column)]])
        several = ends - starts > 1
        found: dict[bytes, int] = {}
        for s, e in zip(starts[several].tolist(), ends[several].tolist()):
            key = node[s:e].tobytes()
            found[key] = found.get(key, 0) + 1
        members = [np.frombuffer(k, np.int64) for k in found]
        counts = list(found.values())
        degree: dict[int, int] = {}
        for nodes, n in zip(members, counts):
            for v in nodes.tolist():
                degree[v] = degree.get(v, 0) + n
        out: tuple[list, list, list] = ([], [], [])
        for nodes, n in zip(members, counts):
            hub = max(nodes.tolist(), key=lambda v: (degree[v], -v))
            for part in _parts(nodes):
                out[0].append(part), out[1].append(hub), out[2].append(n)
        return pa.table({"nodes": pa.array(out[0], pa.list_(pa.int64())), "hub": pa.array(out[1], pa.int64()), "n_columns": pa.array(out[2], pa.int64())})

    parts = rows.select("text").mapInArrow(entries, "block int, entries binary")
    each = parts.groupBy("block").applyInArrow(lists, "nodes array<long>, hub long, n_columns long")
    return written(each.groupBy("nodes").agg(F.max("hub").alias("hub"), F.sum("n_columns").alias("n_columns")), "lists")


def _parts(nodes: np.ndarray) -> Iterator[np.ndarray]:
    """A list of bounded size as it is; a longer one as all pairs of its chunks, so that no pair is lost."""
    if len(nodes) <= LIST_ROWS:
        yield nodes
        return
    chunks = np.array_split(nodes, -(-2 * len(nodes) // LIST_ROWS))
    for i, a in enumerate(chunks):
        for b in chunks[i + 1 :]:
            yield np.concatenate([a, b])


def _rest(n: Column) -> Column:
    """Columns behind the prefix."""
    return F.ceil(n * SHARED / WHOLE) - 1


def _can_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parity maps leave enough shared columns open."""
    for batch in batches:
        keep = [WHOLE * (most := most_shared(*x)) >= SHARED * (x[2] + x[3] - most) for x in zip(*(batch.column(c).to_pylist() for c in ("p", "q", "n", "m")))]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def linked(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose whole n-gram sets are similar enough.

    An exact bound by parity maps, about four bits for each column, leaves few
    pairs; only the texts of these are looked at.
    """
    maps = nodes.select("node", "n", "bits")
    bounded = pairs.select("a", "b").join(maps.toDF("a", "n", "p"), "a").join(maps.toDF("b", "m", "q"), "b")
    pairs = written(bounded.mapInArrow(_can_link, "a long, b long"), "pairs")
    needed = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select("node", "row"), "needed")
    if needed.count() <= BROADCAST_NODES:
        needed = F.broadcast(needed)
    texts = rows.join(needed, "row").select("node", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("ngram_join")
        hashes = WordHashes()

        @lru_cache(maxsize=64)
        def columns(node, text):
            return shingles(text, hashes, size)

        for batch in batches:
            keep = []
            for a, x, b, y in zip(*(batch.column(i) for i in range(4))):
                p, q = columns(a.as_py(), x.as_py()), columns(b.as_py(), y.as_py())
                shared = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(WHOLE * shared >= SHARED * (len(p) + len(q) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(2).filter(mask)], names=["a", "b"])

    whole = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return written(whole.select("a", "x", "b", "y").mapInArrow(compare, "a long, b long"), "links")


def _allowed(n, m, columns):
    """Whether rows of n and m columns that share at most these prefix columns can be linked.

    A column of one row's prefix can lie behind the other's prefix, so the
    rest is that of the pair and not of a row. The longer rest alone may hold
    more columns than the smaller row, which shares no more than it has.
    """
    rest = np.maximum(n - prefix_length(n), m - prefix_length(m))
    return np.minimum(columns + rest, np.minimum(n, m)) * (SHARED + WHOLE) >= (n + m) * SHARED


def _members(batch: pa.RecordBatch) -> Iterator[tuple]:
    for members, columns in zip(batch.column(0), batch.column(1)):
        yield (*(x.to_numpy() for x in members.values.flatten()), columns.as_py())


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each component in a list the member with the most columns in lists, paired with the best of them all."""
    for batch in batches:
        found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for node, n, matched, label, _, _ in _members(batch):
            most = matched + n - prefix_length(n)
            best = np.lexsort((node, -most))
            kept = best[np.unique(label[best], return_index=True)[1]]
            hub = kept[np.lexsort((node[kept], -most[kept]))[0]]
            # Only a guess, as columns may lie behind the other's prefix; what it leaves out comes with the whole product.
            likely = np.minimum(most[kept], most[hub]) * (SHARED + WHOLE) >= (n[kept] + n[hub]) * SHARED
            other = kept[(kept != hub) & likely]
            found[0].append(np.minimum(node[hub], node[other]))
            found[1].append(np.maximum(node[hub], node[other]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in found], names=["a", "b"])


def _partial_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each member of a list the members of larger components it could be linked with, as one partial row of the product."""

    def rows(found):
        a, n, columns, counts, others, sizes = (np.concatenate(f) for f in zip(*found))
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        arrays = [pa.array(a), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(others)), pa.ListArray.from_arrays(ends, pa.array(sizes)), pa.array(columns)]
        return pa.RecordBatch.from_arrays(arrays, names=["a", "n", "others", "sizes", "n_columns"])

    for batch in batches:
        found, held = [], 0
        for node, n, matched, label, weight, columns in _members(batch):
            by_weight = np.lexsort((node, label, weight))
            node, n, matched, label = (x[by_weight] for x in (node, n, matched, label))
            step, places = PAIRS // len(node) + 1, np.arange(len(node))
            for low in range(0, len(node), step):
                i = places[low : low + step, None]
                row, other = np.nonzero((places > i) & (label != label[i]) & _allowed(n[i], n, np.minimum(matched[i], matched)))
                first, counts = np.unique(row + low, return_counts=True)
                found.append((node[first], n[first], np.full(len(first), columns, np.int64), counts, node[other], n[other]))
                held += len(other)
                if held >= PAIRS:
                    yield rows(found)
                    found, held = [], 0
        if held:
            yield rows(found)


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the partial rows of a node, which follow each other, and keeps the columns that reach the bound."""
    node, n, parts, held, most = None, 0, [], 0, PAIRS

    def added():
        others, first, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        return others, np.concatenate([p[1] for p in parts])[first], np.bincount(inverse, np.concatenate([p[2] for p in parts])).astype(np.int64)

    def kept():
        others, m, columns = added()
        b = others[_allowed(n, m, columns)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), node)), pa.array(b)], names=["a", "b"])

    for batch in batches:
        for a, size, others, sizes, columns in zip(*batch.columns):
            if a.as_py() != node:
                if parts:
                    yield kept()
                node, n, parts, held, most = a.as_py(), size.as_py(), [], 0, PAIRS
            parts.append((others.values.to_numpy(), sizes.values.to_numpy(), np.full(len(others), columns.as_py())))
            held += len(others)
            if held >= most:
                parts = [added()]
                held = len(parts[0][0])
                most = PAIRS + 2 * held
    if parts:
        yield kept()


def _candidates(each: DataFrame, labels: DataFrame, whole: bool) -> DataFrame:
    """Pairs (a, b) of members of lists that lie in several components: stars, or all whose accumulated overlap reaches the bound."""
    weights = labels.groupBy("label").agg(F.count("*").alias("weight"))
    placed = each.join(labels.join(weights, "label"), "node", "left").withColumns({"label": F.coalesce("label", "node"), "weight": F.coalesce("weight", F.lit(1).cast("long"))})
    mixed = placed.groupBy("list").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("list")
    split = placed.join(mixed, "list").groupBy("list", "n_columns").agg(F.collect_list(F.struct("node", "n", "matched", "label", "weight")).alias("members"))
    split = split.select("members", "n_columns")
    if not whole:
        return split.mapInArrow(_stars, "a long, b long").distinct()
    rows = split.mapInArrow(_partial_rows, "a long, n long, others array<long>, sizes array<long>, n_columns long")
    return rows.repartition("a").sortWithinPartitions("a").mapInArrow(_accumulate, "a long, b long")


def similar_documents(docs: DataFrame, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document: the smallest doc_id that links lead to, itself included.

    Also its row and its component's own label, as ids may be repeated or NULL.

    Words are runs of characters other than blanks and U+0009 to U+000D, A-Z
    lower-cased; a document's set holds its distinct n-grams of ``size``
    words, or its whole word sequence if it has fewer. Two documents link when
    their sets' Jaccard similarity is at least 0.75. Documents without words
    link with nothing. NULL ids take part; a component of only such rows has a
    NULL id. Repeated rows stay, each with its result. Other columns are not
    looked at. Sets are told apart by 64-bit hashes. Rows are told apart by
    their place in the input, which therefore has to be a table or another
    input with a fixed order.
    """
    spark, rows = docs.sparkSession, _rows(docs, doc_id, text)
    table = measured(rows, size)
    members = table.where("piece is null").select("row", "doc_id", "n", "node")
    by_set = table.where("node is not null").groupBy("node")
    nodes = written(by_set.agg(F.min("row").alias("row"), F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("bits").alias("bits")), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    blocks = max(shuffle_partitions(spark), int(total * (WHOLE - SHARED) / WHOLE / BLOCK_ENTRIES) + 1)
    lists = shared_lists(rows, rarity(table), size, blocks)

    numbered = lists.withColumn("list", F.monotonically_increasing_id())
    each = numbered.select("list", "hub", "n_columns", F.explode("nodes").alias("node"))
    # Columns of a row's prefix that lie in lists; rows of long lists come several times.
    matched = each.groupBy("node").agg(F.sum("n_columns").alias("matched")).join(nodes.select("node", "n"), "node")
    sizes = written(matched.select("node", "n", F.least(F.col("matched"), F.col("n") - _rest(F.col("n"))).alias("matched")), "sizes")
    each = written(each.join(sizes, "node"), "members")

    hubs = sizes.select(F.col("node").alias("hub"), F.col("n").alias("m"), F.col("matched").alias("hub_matched"))
    with_hub = each.where("node != hub").groupBy("node", "n", "matched", "hub").agg(F.sum("n_columns").alias("n_columns")).join(hubs, "hub")
    # Guesses, by the rows or by the lists of this hub; what they leave out comes with the whole product.
    rest, other_rest = _rest(F.col("n")), _rest(F.col("m"))
    likely = F.greatest(F.least(F.col("matched") + rest, F.col("hub_matched") + other_rest), F.col("n_columns") + F.greatest(rest, other_rest))
    fits = F.least(likely, "n", "m") * (SHARED + WHOLE) >= (F.col("n") + F.col("m")) * SHARED
    best = with_hub.where(fits).groupBy("node").agg(F.max(F.struct("n_columns", "hub")).alias("best"))
    each = each.select("list", "n_columns", "node", "n", "matched")
    links = linked(best.select(F.col("node").alias("a"), F.col("best.hub").alias("b")), rows, nodes, size)
    labels = components(links)
    for whole in (False, True):
        more = linked(_candidates(each, labels, whole), rows, nodes, size)
        if more.limit(1).count():
            links = links.union(more)
            labels = components(links)

    named = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_node = named.select("node", "label").join(smallest, "label").select("node", F.col("label").alias("component"), "component_id")
    return members.join(by_node, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "row", "component"
    )


def jaccard_report(docs: DataFrame) -> DataFrame:
    return similar_documents(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component, in all columns.

    The row with the smallest doc_id stays; of several rows with that id, as
    of a component without ids, the first one. Documents without words stay.
    """
    found = similar_documents(docs, size, doc_id, text)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    kept = found.where("n_shingles > 0").groupBy("component").agg(least.alias("least")).select(F.col("least.row").alias("__row"))
    kept = written(kept.union(found.where("n_shingles = 0").select("row")), "kept")
    return docs.withColumn("__row", F.monotonically_increasing_id()).join(kept, "__row", "left_semi").drop("__row")
