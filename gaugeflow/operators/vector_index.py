"""An inverted-file index over chunk vectors: cells around centroids, one partition folder for each cell.

The centroids are fitted on a bounded sample; every vector goes into the cell
of its nearest centroid, and the chunks are written partitioned by cell. A
small table beside them has the rows and the radius of each cell and project,
and the number of cells to read is measured on sample queries. A search looks
at that table alone to choose cells: the nearest ones, and further ones until
they hold enough rows, so that it finds ``k`` chunks wherever the project has
them. Only these cells' folders are read. No vector of a cell is nearer to the
query than the centroid's distance less the radius, so an exact search knows
which cells it may leave out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from gaugeflow.functions.documents import squared_l2
from gaugeflow.functions.joins import join_keys
from gaugeflow.operators.knowledge import scored
from gaugeflow.session import work_folder

#: Cells at most, rows of the fit's sample for each cell, and rounds of the fit.
CELLS, SAMPLE_ROWS, ROUNDS = 4096, 64, 8
#: Sample queries that the cells to read are measured with, their neighbours, and the share of them that has to be found.
QUERIES, NEIGHBOURS, RECALL = 64, 10, 0.95
#: Rows of a part file of a cell.
FILE_ROWS = 1_000_000
#: Allowance for rounding where cells are left out by their radius.
SLACK = 1e-6
#: Numbers in the vectors of a tile's rows, and of its queries, and distances that are held at once.
TILE, AT_ONCE = 1 << 19, 1 << 21
#: The cell of chunks without a vector that can be searched; no search reads it.
NOWHERE = -1


@dataclass(frozen=True)
class VectorIndex:
    """An index in a folder: the fitted ``model``, ``chunks`` by cell, ``cells`` with counts and radii, and ``probes``."""

    spark: SparkSession
    path: str

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks")

    def centroids(self) -> np.ndarray:
        """One row for each cell; at most CELLS rows."""
        return np.array(KMeansModel.load(f"{self.path}/model").clusterCenters())

    def probes(self) -> int:
        return self.spark.read.parquet(f"{self.path}/probes").agg(F.max("probes")).first()[0]

    def cells(self, project: str | None = None) -> dict[int, tuple[int, float]]:
        """Rows and radius of the cells with rows of the project, or of any; at most CELLS entries."""
        rows = self.spark.read.parquet(f"{self.path}/cells").filter(F.col("cell") != NOWHERE)
        rows = rows if project is None else rows.filter(F.col("project_id") == project)
        found = rows.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()
        return {r["cell"]: (r["n"], r["radius"]) for r in found}


def _searchable(width: int) -> Column:
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce((F.size(x) == width) & finite, F.lit(False))


def _assigned(chunks: DataFrame, model: KMeansModel) -> DataFrame:
    """Adds ``cell`` and ``from_centroid``; chunks without a usable vector of the index's length get NOWHERE."""
    spark, centers = chunks.sparkSession, model.clusterCenters()
    fits = _searchable(len(centers[0]))
    vectors = chunks.filter(fits).withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    placed = model.transform(vectors).drop("_v")
    # one row for each centroid, at most CELLS
    known = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cell int, _centroid array<double>")
    placed = placed.join(F.broadcast(known), "cell").withColumn("from_centroid", F.sqrt(squared_l2("embedding", "_centroid"))).drop("_centroid")
    rest = chunks.filter(~fits).withColumns({"cell": F.lit(NOWHERE), "from_centroid": F.lit(None).cast("double")})
    return placed.unionByName(rest)


def _append(index: VectorIndex, chunks: DataFrame, model: KMeansModel) -> None:
    """Adds the chunks, then the counts and radii of what was added.

    The rows are assigned once and staged. Cells of any size are split over
    tasks before they are written, and their files hold a bounded number of rows.
    """
    staged = work_folder(index.spark, "assigned")
    _assigned(chunks, model).write.parquet(staged)
    rows = index.spark.read.parquet(staged)
    rows.hint("rebalance", "cell").write.mode("append").partitionBy("cell").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{index.path}/chunks")
    cells = rows.groupBy("cell", "project_id").agg(F.count(F.lit(1)).alias("n"), F.max("from_centroid").alias("radius"))
    cells.coalesce(1).write.mode("append").parquet(f"{index.path}/cells")


def build_vector_index(chunks: DataFrame, path: str, recall: float = RECALL, seed: int = 7) -> VectorIndex:
    """Writes the index of ``(chunk_id, project_id, embedding, …)`` into an empty folder.

    Vectors of the most common length are indexed. ``recall`` is the share of
    the nearest neighbours of sample queries that a search has to find; it
    decides how many cells are read.
    """
    spark = chunks.sparkSession
    index = VectorIndex(spark, path)
    width = chunks.filter(F.size("embedding") > 0).agg(F.mode(F.size("embedding"), True)).first()[0] or 1
    usable = chunks.filter(_searchable(width)).select(F.col("embedding").cast("array<double>").alias("embedding"))
    n = usable.count()
    k = max(2, min(CELLS, math.isqrt(n)))
    sample = usable.sample(fraction=min(1.0, SAMPLE_ROWS * k / n), seed=seed) if n else spark.createDataFrame([([0.0] * width,)], "embedding array<double>")
    fit = KMeans(k=k, seed=seed, initMode="random", maxIter=ROUNDS, featuresCol="_v", predictionCol="cell")
    model = fit.fit(sample.select(array_to_vector("embedding").alias("_v")))
    model.write().save(f"{path}/model")
    _append(index, chunks, model)
    probes = _measured_probes(index, model.clusterCenters(), recall, seed) if n else 1
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.parquet(f"{path}/probes")
    return index


def add_to_index(index: VectorIndex, incoming: DataFrame) -> None:
    """Adds the chunks whose project and id are not in the index yet; centroids stay as they are.

    If it is stopped between the chunks and their counts, ``refresh_cells``
    completes it.
    """
    new = join_keys(incoming.dropDuplicates(["project_id", "chunk_id"]), index.chunks().select("project_id", "chunk_id"), ["project_id", "chunk_id"], "left_anti")
    _append(index, new, KMeansModel.load(f"{index.path}/model"))


def refresh_cells(index: VectorIndex) -> None:
    """Counts and radii anew from the chunks; reads three narrow columns."""
    cells = index.chunks().groupBy("cell", "project_id").agg(F.count(F.lit(1)).alias("n"), F.max("from_centroid").alias("radius"))
    staged = work_folder(index.spark, "cells")
    cells.write.parquet(staged)
    index.spark.read.parquet(staged).coalesce(1).write.mode("overwrite").parquet(f"{index.path}/cells")


def _nearest(queries: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of queries to centroids."""
    return ((queries[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2) if len(queries) * centers.size <= 1 << 24 else np.array([((q - centers) ** 2).sum(axis=1) for q in queries])


def _measured_probes(index: VectorIndex, centers: list, recall: float, seed: int) -> int:
    """Cells that sample queries have to read for the wanted share of their nearest neighbours.

    One scan keeps the nearest rows of each query and task; a bounded number
    of queries and neighbours reaches the driver.
    """
    rows = index.chunks().filter(F.col("cell") != NOWHERE)
    chosen = rows.select("embedding").orderBy(F.xxhash64(F.lit(seed), "embedding")).limit(QUERIES).collect()
    queries, centers = np.array([r[0] for r in chosen], np.float64), np.array(centers)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = np.array(part["embedding"].tolist(), np.float64)
            apart = (x * x).sum(axis=1)[None, :] - 2 * queries @ x.T + (queries * queries).sum(axis=1)[:, None]
            kept = np.argsort(apart, axis=1, kind="stable")[:, :NEIGHBOURS]
            yield pd.DataFrame(
                {"query": np.repeat(np.arange(len(queries)), kept.shape[1]), "distance": np.take_along_axis(apart, kept, 1).ravel(), "cell": part["cell"].to_numpy()[kept].ravel()}
            )

    found = rows.select("embedding", "cell").mapInPandas(near, "query int, distance double, cell int")
    place = F.row_number().over(W.partitionBy("query").orderBy("distance", "cell"))
    found = found.withColumn("place", place).filter(F.col("place") <= NEIGHBOURS).collect()
    ranks = _nearest(queries, centers).argsort(axis=1, kind="stable").argsort(axis=1)
    needed = np.sort([ranks[r["query"], r["cell"]] + 1 for r in found])
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])


def chosen_cells(index: VectorIndex, query: list[float], k: int, project: str | None = None, probes: int | None = None) -> list[int]:
    """The nearest cells with rows of the project: ``probes`` of them, and further ones until they hold ``k`` rows."""
    sizes, centers = index.cells(project), index.centroids()
    apart = _nearest(np.array([query], np.float64), centers)[0]
    wanted, chosen, rows = probes or index.probes(), [], 0
    for cell in sorted(sizes, key=lambda c: (apart[c], c)):
        if len(chosen) >= wanted and rows >= k:
            break
        chosen.append(cell)
        rows += sizes[cell][0]
    return chosen


def _best_in(index: VectorIndex, query: list[float], k: int, project: str | None, cells: list[int]) -> DataFrame:
    """The ``k`` nearest chunks of some cells; the cells are partition folders, so the scan opens no others."""
    rows = index.chunks().filter(F.col("cell").isin(cells) if cells else F.lit(False))
    rows = rows if project is None else rows.filter(F.col("project_id") == project)
    return scored(rows, query).drop("cell", "from_centroid").orderBy("distance", "chunk_id").limit(k)


def approx_vector_topk(index: VectorIndex, query: list[float], k: int = 5, project: str | None = None, probes: int | None = None) -> DataFrame:
    """``k`` near chunks, the nearest of those in the cells that are read.

    There are ``k`` rows whenever the project has so many, also for a query
    far from every vector.
    """
    return _best_in(index, query, k, project, chosen_cells(index, query, k, project, probes))


def indexed_vector_topk(index: VectorIndex, query: list[float], k: int = 5, project: str | None = None) -> DataFrame:
    """The ``k`` nearest chunks, exactly: after a first search, the cells that can hold a nearer vector are read."""
    first = chosen_cells(index, query, k, project)
    found = [r[0] for r in _best_in(index, query, k, project, first).select("distance").collect()]
    sizes, centers = index.cells(project), index.centroids()
    apart = np.sqrt(_nearest(np.array([query], np.float64), centers)[0])
    reach = math.sqrt(found[-1]) if len(found) == k else math.inf
    reach += SLACK * (1 + reach)
    return _best_in(index, query, k, project, [c for c, (_, radius) in sizes.items() if apart[c] - radius <= reach])


def search_index(index: VectorIndex, queries: DataFrame, k: int = 5, project: str | None = None, probes: int | None = None) -> DataFrame:
    """Near chunks of many queries ``(query_id, embedding)``: query_id, rank, chunk_id, distance.

    Rows and queries meet in tiles of bounded size: small cells share a tile,
    large ones are cut into several, and a query is sent once to each tile that
    holds one of its cells, not once to each cell. A tile is a matrix product;
    ``k`` rows of each query leave it. Folders of blocks that no query
    asks for are not read. NULL vectors and those of another length find nothing.
    """
    spark = index.spark
    centers, sizes, wanted = index.centroids(), index.cells(project), probes or index.probes()
    held = np.array(sorted(sizes), np.int64)
    counts = np.array([sizes[c][0] for c in held.tolist()], np.int64)
    size = max(1, TILE // centers.shape[1])
    block, slices = _blocks(counts.tolist(), size)
    n_blocks = len(slices)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            order = _nearest(np.array(part["embedding"].tolist(), np.float64).reshape(len(part), -1), centers[held]).argsort(axis=1, kind="stable")
            full = (np.cumsum(counts[order], axis=1) < k).sum(axis=1) + 1
            last = np.minimum(np.maximum(full, wanted), len(held))
            asked = np.zeros(order.shape, bool)
            np.put_along_axis(asked, order, np.arange(len(held))[None, :] < last[:, None], 1)
            n_asked = np.stack([np.bincount(block[row], minlength=n_blocks) for row in asked]) if len(part) else np.zeros((0, n_blocks), np.int64)
            query, to = np.nonzero(n_asked)
            whole = n_asked[query, to] == np.bincount(block, minlength=n_blocks)[to]
            # no list stands for all cells of a block
            cells = [None if w else held[asked[q] & (block == b)].tolist() for q, b, w in zip(query.tolist(), to.tolist(), whole.tolist())]
            out = part.iloc[query].reset_index(drop=True)
            yield out.assign(block=to.astype(np.int32), cells=pd.Series(cells, dtype=object))

    asked = queries.filter(_searchable(centers.shape[1])).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    if not len(held):
        asked = asked.limit(0)
    kind, id_kind = asked.schema["query_id"].dataType, index.chunks().schema["chunk_id"].dataType
    sent = asked.mapInPandas(send, f"query_id {kind.simpleString()}, embedding array<double>, block int, cells array<bigint>")
    # at most CELLS rows in each of these
    parts = {r["block"]: -(-r["n"] // size) for r in sent.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = spark.createDataFrame([(b, slices[b], n) for b, n in parts.items()], "block int, slices int, parts int")
    known = [(c, b, slices[b], parts[b]) for c, b in zip(held.tolist(), block.tolist()) if b in parts]
    counted = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = F.pmod(F.xxhash64("query_id", "embedding"), "parts").cast("int")
    sent = sent.join(F.broadcast(cut), "block").withColumn("part", part).withColumn("slice", counted("slices"))
    rows = index.chunks().filter(F.col("cell").isin([c for c, *_ in known]) if known else F.lit(False))
    rows = rows if project is None else rows.filter(F.col("project_id") == project)
    rows = rows.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("cell").cast("int").alias("cell"), F.monotonically_increasing_id().alias("place"))
    rows = rows.join(F.broadcast(spark.createDataFrame(known, "cell int, block int, slices int, parts int")), "cell")
    rows = rows.withColumn("slice", F.pmod("place", "slices").cast("int")).withColumn("part", counted("parts")).drop("place")
    tile = ["block", "slice", "part"]

    def meet(asking: pa.Table, held: pa.Table) -> pa.Table:
        return _tile_nearest(asking, held, k)

    met = (
        sent.groupBy(*tile)
        .cogroup(rows.groupBy(*tile))
        .applyInArrow(meet, f"query_id {kind.simpleString()}, chunk_id {id_kind.simpleString()}, distance double")
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "distance")


def _blocks(counts: list[int], size: int) -> tuple[np.ndarray, list[int]]:
    """The block of each cell, and the slices of each block: cells share a block of up to ``size`` rows, a larger cell has one of its own."""
    block, slices, rows = [], [], size
    for n in counts:
        if rows + n > size:
            slices.append(max(1, -(-n // size)))
            rows = 0
        rows += n
        block.append(len(slices) - 1)
    return np.array(block, np.int64), slices


def _matrix(vectors: pa.ChunkedArray, rows: int) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _tile_nearest(asking: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """The ``k`` nearest rows of a tile for each of its queries, those of the cells a query asks for.

    A matrix product leaves the rows whose distance may be among the ``k``
    least; theirs is then summed as ``squared_l2`` sums it, place by place.
    """
    if not (asking.num_rows and held.num_rows):
        return pa.table({"query_id": asking["query_id"].slice(0, 0), "chunk_id": held["chunk_id"].slice(0, 0), "distance": pa.array([], pa.float64())})
    queries, x = _matrix(asking["embedding"], asking.num_rows), _matrix(held["embedding"], held.num_rows)
    cells = held["cell"].to_numpy()
    ids = held["chunk_id"].combine_chunks()
    by_id = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
    wanted = asking["cells"].to_pylist()
    found = []
    with np.errstate(over="ignore", invalid="ignore"):
        norms, by_place = (x * x).sum(axis=1), np.ascontiguousarray(x.T)
        step = max(1, AT_ONCE // len(x))
        for start in range(0, len(queries), step):
            q = queries[start : start + step]
            own = (q * q).sum(axis=1)
            apart = own[:, None] - 2 * (q @ x.T) + norms[None, :]
            lists = wanted[start : start + step]
            some = [i for i, c in enumerate(lists) if c is not None]
            allowed = np.ones(apart.shape, bool) if some else None
            for i in some:
                allowed[i] = np.isin(cells, lists[i])
                apart[i, ~allowed[i]] = np.inf
            # twice the rounding that the product can have
            slack = 16 * (x.shape[1] + 4) * np.finfo(np.float64).eps * (own + norms.max())
            least = np.partition(apart, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
            near = ~(apart > (least + slack)[:, None])
            if some:
                near &= allowed
            at, row = np.nonzero(near)
            distance = np.zeros(len(at))
            columns = np.ascontiguousarray(q.T)
            for c, r in zip(columns, by_place):
                gap = r[row] - c[at]
                distance += gap * gap
            order = np.lexsort((by_id[row], distance, at))
            sorted_at = at[order]
            order = order[np.arange(len(at)) - np.searchsorted(sorted_at, sorted_at) < k]
            found.append((at[order] + start, row[order], distance[order]))
    at, row, distance = (np.concatenate(parts) for parts in zip(*found))
    return pa.table({"query_id": asking["query_id"].take(pa.array(at)), "chunk_id": ids.take(pa.array(row)), "distance": distance})
