"""Near-duplicates among embeddings: spherical k-means cells, cosine products inside cells, one vector of each group.

The cells are fitted on a bounded sample. A pair of similar vectors may lie on
both sides of a border between two cells; one of the two is then no farther
from the border than half the angle that the bound allows, so vectors that
near to a border are also copied into the cell behind it, and no pair is
missed. The sample also shows dense directions (cores): vectors within half
the allowed angle of a core's pivot are all similar to each other, so a group
of copies is counted, never multiplied out; only vectors around a core are
compared with its members. Cells and cores of any size are dealt into blocks,
and each pair of blocks is one task's product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.llm.common import written
from gaugeflow.llm.components import components

BOUND = 0.95
#: Cells at most; the fit's sample has eight rows for each cell, SAMPLE_ROWS at least, and so many components in all at most.
CELLS, SAMPLE_ROWS, SAMPLE_COMPONENTS = 4096, 4096, 1 << 23
ROUNDS = 6
#: Sample rows in which cores are looked for, and those that a core must cover.
CORE_SAMPLE, CORE_LEAST = 4096, 4
#: Rows of a block, and of the part of it that is multiplied at once.
BLOCK_ROWS, TILE = 4096, 256
#: Angles and margins nearer than this to a border count as beyond it, which adds work and no result.
SLACK = 1e-6


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; also of components whose squares would leave the range."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors without NULLs as rows; the missing components of shorter ones are 0."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def fit_cells(sample: np.ndarray, k: int) -> np.ndarray:
    """Centroids of spherical k-means on unit rows; an empty cell starts again at the row that fits worst."""
    centroids = sample[np.random.default_rng(0).permutation(len(sample))[:k]]
    for _ in range(ROUNDS):
        cosines = sample @ centroids.T
        cell = cosines.argmax(axis=1)
        fits = cosines[np.arange(len(sample)), cell]
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        lengths = np.sqrt((sums * sums).sum(axis=1))
        empty = np.flatnonzero(lengths < SLACK)
        sums[empty] = sample[np.argsort(fits)[: len(empty)]]
        lengths[empty] = 1
        centroids = sums / lengths[:, None]
    return np.unique(centroids, axis=0)


def fit_cores(sample: np.ndarray, bound: float) -> np.ndarray:
    """Pivots of dense directions: means of sample rows that lie within the bound of one of them, most covered rows first."""
    cosines = sample @ sample.T
    counts = (cosines >= bound).sum(axis=1)
    covered, pivots = np.zeros(len(sample), bool), []
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] < CORE_LEAST:
            break
        own = (cosines[i] >= bound) & ~covered
        if not covered[i] and own.sum() >= CORE_LEAST:
            mean = sample[own].sum(axis=0)
            pivots.append(mean / np.sqrt(mean @ mean))
            covered |= sample @ pivots[-1] >= bound
    return np.array(pivots).reshape(len(pivots), sample.shape[1])


def place(x: np.ndarray, centroids: np.ndarray, pivots: np.ndarray, bound: float):
    """Of unit rows: core or -1, home cell or -1, and the groups where each is a guest: cells by number, cores behind them."""
    angle = math.acos(bound)
    k, core, home = len(centroids), np.full(len(x), -1), np.full(len(x), -1)
    guests: list[list[int]] = [[] for _ in range(len(x))]
    if len(pivots):
        away = np.arccos(np.clip(x @ pivots.T, -1, 1))
        nearest = away.argmin(axis=1)
        core = np.where(away[np.arange(len(x)), nearest] <= angle / 2 - SLACK, nearest, -1)
        # A vector meets the members of all cores around it; between two cores those of the later one are the guests.
        asked = (away <= 1.5 * angle + SLACK) & ((core < 0)[:, None] | (np.arange(len(pivots)) < core[:, None]))
        for i, p in np.argwhere(asked).tolist():
            guests[i].append(k + p)
    loose = np.flatnonzero(core < 0)
    cosines = x[loose] @ centroids.T
    home[loose] = own = cosines.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * np.clip(centroids @ centroids.T, -1, 1), SLACK * SLACK))
    margin = (cosines[np.arange(len(loose)), own][:, None] - cosines) / apart[own]
    near = margin <= math.sin(angle / 2) + SLACK
    near[np.arange(len(loose)), own] = False
    for i, c in np.argwhere(near).tolist():
        guests[loose[i]].append(c)
    return core, home, guests


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of ``n`` nodes' components, for links ``a`` to ``b``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def similar_in(left: np.ndarray, right: np.ndarray | None, bound: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with enough cosine, tile by tile; without ``right`` the pairs among ``left``, each once."""
    for at in range(0, len(left), TILE):
        tile = left[at : at + TILE]
        if right is None:
            a, b = np.nonzero(tile @ left[at:].T >= bound)
            once = a < b
            yield a[once] + at, b[once] + at
        else:
            a, b = np.nonzero(tile @ right.T >= bound)
            yield a + at, b


def compare(table: pa.Table, dtype: str, cells: int, bound: float) -> pa.Table:
    """Link counts by row, and edges that span the components, of one pair of blocks."""
    rows = table.column("row").to_numpy()
    nodes = table.column("node").to_numpy()
    vectors = table.column("vector").combine_chunks()
    x = units(np.frombuffer(b"".join(vectors.to_pylist()), dtype).reshape(len(rows), -1)) if len(rows) else np.zeros((0, 1))
    guest = table.column("guest").to_numpy(zero_copy_only=False).astype(bool)
    left = np.flatnonzero(~guest)
    right = np.flatnonzero(guest)
    between = bool(table.column("between")[0].as_py())
    group = table.column("group")[0].as_py()
    home = table.column("home").to_numpy()
    asked = table.column("guests").combine_chunks()
    counts, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for a, b in similar_in(x[left], x[right] if between else None, bound):
        a, b = left[a], (right if between else left)[b]
        if between and group < cells and len(a) and table.column("visit")[0].as_py():
            # A pair of which each is a guest of the other's cell is found there, too; the smaller cell counts it.
            first = np.array([group < home[j] or home[j] not in asked[int(i)].as_py() for i, j in zip(a, b)], bool)
            a, b = a[first], b[first]
        counts += np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
        if len(a):
            label = forest(np.concatenate([a, np.arange(len(rows))]), np.concatenate([b, label]), len(rows))
    hit, edge = np.flatnonzero(counts), np.flatnonzero(nodes[label] != nodes)
    none = np.zeros(len(hit) + len(edge), bool)
    none[: len(hit)] = True
    spread = lambda values, at, away: pa.array(np.concatenate([values, np.zeros(len(edge), np.int64)] if at else [np.zeros(len(hit), np.int64), values]), pa.int64(), mask=away)
    return pa.table({"row": spread(rows[hit], True, ~none), "links": spread(counts[hit], True, ~none), "a": spread(nodes[edge], False, none), "b": spread(nodes[label[edge]], False, none)})


def _usable(vector: Column) -> Column:
    """Vectors that can be similar to others: not NULL, not zero, without NULL or non-finite components."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def _numbered(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    x = F.col(vector_column)
    if rows.schema[vector_column].dataType.simpleString() not in ("array<float>", "array<double>"):
        x = x.cast("array<double>")
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("vec_id"), F.when(_usable(x), x).alias("vector"))


def placed_vectors(table: DataFrame, bound: float) -> tuple[DataFrame, int, str]:
    """Every row with its core, home cell, the groups it is a guest of, and its components as bytes; the number of cells; the components' type."""
    n, width = table.where("vector IS NOT NULL").agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    size = max(64, min(max(SAMPLE_ROWS, 8 * min(CELLS, math.isqrt(n) // 2)), SAMPLE_COMPONENTS // width))
    k = max(1, min(CELLS, math.isqrt(n) // 2, size // 8))
    chosen = table.where("vector IS NOT NULL").where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) <= math.ceil(size / max(n, 1) * (1 << 30)))
    sample = matrix(chosen.limit(2 * size).select("vector").toArrow().column(0).combine_chunks(), width)
    sample = units(sample) if len(sample) else np.eye(1, width)
    centroids, pivots = fit_cells(sample, k), fit_cores(sample[:CORE_SAMPLE], bound)
    dtype = "<f4" if "float" in table.schema["vector"].dataType.simpleString() else "<f8"

    def placing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            there = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
            core, home = np.full(len(batch), -1), np.full(len(batch), -1)
            guests, raw = [[]] * len(batch), [None] * len(batch)
            if len(there):
                own = matrix(vectors.take(pa.array(there)), width).astype(dtype)
                core[there], home[there], asked = place(units(own), centroids, pivots, bound)
                for i, g, v in zip(there.tolist(), asked, own):
                    guests[i], raw[i] = g, v.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(core, pa.int32()), pa.array(home, pa.int32()), pa.array(guests, pa.list_(pa.int32())), pa.array(raw, pa.binary())],
                names=["row", "vec_id", "core", "home", "guests", "vector"],
            )

    schema = "row long, vec_id long, core int, home int, guests array<int>, vector binary"
    return written(table.mapInArrow(placing, schema), "placed"), len(centroids), dtype


def links_found(placed: DataFrame, cells: int, dtype: str, bound: float) -> DataFrame:
    """row and links, and edges a to b between nodes: rows, and -1 - core for all members of a core."""
    node = F.when(F.col("core") >= 0, -1 - F.col("core").cast("long")).otherwise(F.col("row"))
    own = F.when(F.col("core") >= 0, F.col("core") + cells).otherwise(F.col("home"))
    member = F.concat(F.array(F.struct(own.alias("group"), F.lit(False).alias("guest"))), F.transform("guests", lambda g: F.struct(g.alias("group"), F.lit(True).alias("guest"))))
    seats = placed.where("vector IS NOT NULL").select("row", node.alias("node"), "home", "guests", "vector", F.explode(member).alias("seat")).select("*", "seat.*").drop("seat")
    # At most one row for each cell and core, so this side is small whatever the input.
    blocks = lambda guest: F.ceil(F.count_if(F.col("guest") == guest) / BLOCK_ROWS)
    sizes = placed.where("vector IS NOT NULL").select(F.explode(member).alias("seat")).select("seat.*").groupBy("group").agg(blocks(False).alias("homes"), blocks(True).alias("visits"))
    seats = seats.join(F.broadcast(sizes), "group").withColumn("place", F.pmod(F.xxhash64("row"), F.when(F.col("guest"), F.col("visits")).otherwise(F.col("homes"))))
    task = lambda i, j, between, as_guest: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(between).alias("between"), as_guest.alias("guest"))
    every = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<long>"))
    p = F.col("place")
    # Blocks of a cell meet themselves, each other and the guests'; those of a core only the guests'.
    at_home = F.when(F.col("group") < cells, F.transform(every(F.col("homes")), lambda j: task(F.least(p, j), F.greatest(p, j), False, p > j))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,between:boolean,guest:boolean>>"))
    met = F.transform(every(F.col("visits")), lambda j: task(p, j, True, F.lit(False)))
    visiting = F.transform(every(F.col("homes")), lambda i: task(i, p, True, F.lit(True)))
    tasks = F.when(F.col("guest"), visiting).otherwise(F.concat(at_home, met))
    dealt = seats.select("row", "node", "home", "guests", "vector", "group", F.explode(tasks).alias("task")).select("row", "node", "home", "guests", "vector", "group", "task.*")
    dealt = dealt.withColumn("visit", F.col("between")).withColumn("between", F.col("between") | (F.col("i") != F.col("j")))
    return written(dealt.groupBy("group", "i", "j", "visit").applyInArrow(lambda t: compare(t, dtype, cells, bound), "row long, links long, a long, b long"), "found")


def _grouped(rows: DataFrame, id_column: str, vector_column: str, bound: float) -> DataFrame:
    """row, vec_id, n_links, component_id and the component's own number of every row."""
    placed, cells, dtype = placed_vectors(_numbered(rows, id_column, vector_column), bound)
    found = links_found(placed, cells, dtype, bound)
    label = components(found.where("a IS NOT NULL").select("a", "b"))
    node = F.when(F.col("core") >= 0, -1 - F.col("core").cast("long")).otherwise(F.col("row"))
    base = placed.select("row", "vec_id", "core", node.alias("node"))
    smallest = base.groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("members"))
    labelled = smallest.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    nodes = labelled.join(groups, "label").select("node", "label", "members", "component_id")
    # Cores are at most CORE_SAMPLE / CORE_LEAST nodes; those of single rows share the row's number.
    cores = F.broadcast(nodes.where("node < 0").select((-1 - F.col("node")).cast("int").alias("core"), F.col("members").alias("core_size"), F.col("label").alias("core_label"), F.col("component_id").alias("core_id")))
    own = found.where("row IS NOT NULL").select("row", "links", F.lit(None).cast("long").alias("label"), F.lit(None).cast("long").alias("component_id"))
    own = own.unionByName(nodes.where("node >= 0").select(F.col("node").alias("row"), F.lit(0).cast("long").alias("links"), "label", "component_id"))
    own = own.groupBy("row").agg(F.sum("links").alias("links"), F.max("label").alias("label"), F.max("component_id").alias("component_id"))
    return (
        base.join(own, "row", "left")
        .join(cores, "core", "left")
        .select(
            "row",
            "vec_id",
            (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("core_size") - 1, F.lit(0))).alias("n_links"),
            F.coalesce("core_id", "component_id").alias("component_id"),
            F.coalesce("core_label", "label").alias("label"),
        )
    )


def similar_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", bound: float = BOUND) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Two vectors are linked if their cosine, in double precision, is at least
    ``bound``; ``n_links`` counts a row's links, ``component_id`` is the
    smallest id that links reach, and ``kept`` says that it is the row's own.
    Every row is a vector of its own, also under a repeated id. Vectors that
    are NULL, empty, zero, or hold NULL or non-finite components link with
    nothing. Missing components of shorter vectors count as 0. Rows without id
    are linked like others but never kept; a component of such rows alone has
    no id. Other columns are not looked at. The input has to be a table or
    another source with a fixed order of rows.
    """
    return _grouped(rows, id_column, vector_column, bound).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def one_of_each(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", bound: float = BOUND) -> DataFrame:
    """The rows, with all their columns, of which one stays for each group: the smallest id, then the first row; rows without id come last."""
    first = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "row")).alias("first")
    stay = _grouped(rows, id_column, vector_column, bound).groupBy("label").agg(first).select(F.col("first.row").alias("row"))
    number = "row"
    while number in {c.lower() for c in rows.columns}:
        number += "_"
    return rows.withColumn(number, F.monotonically_increasing_id()).join(stay.withColumnRenamed("row", number), number, "left_semi").select(*[F.col(f"`{c}`") for c in rows.columns])
