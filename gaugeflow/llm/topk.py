"""Exact top-k search: every query against every row, one term after the other.

Queries and rows are dealt into blocks of bounded size; each pair of a query
block and a row block is one task's group. There each sparse query row scatters
its weighted postings into a dense array of scores, a partition selection
keeps the best k of the block, and the blocks' winners are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a block at most; small inputs get smaller blocks, down to a 16th of the rows, so that all cores work.
BLOCK_ROWS, QUERY_BLOCK_ROWS, LEAST_BLOCK, BLOCKS = 8192, 2048, 128, 16
LONG_MAX = (1 << 63) - 1


def _vectors(column: pd.Series, exact) -> np.ndarray:
    """Integer rows as one matrix; shorter vectors are filled with zeros, which have no posting."""
    width = max((len(v) for v in column), default=0)
    out = np.zeros((len(column), width), dtype=exact)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def accumulate(query: np.ndarray, terms: np.ndarray, postings: list[np.ndarray], scores: np.ndarray, room: np.ndarray) -> None:
    """Scores of one query, term by term, in an array that stays in the cache; ``terms`` has one row for each term.

    A term that most rows have is added to all scores, another one is
    scattered to the rows of its postings.
    """
    scores[:] = 0
    for term in np.flatnonzero(query[: len(terms)]).tolist():
        rows = postings[term]
        if 4 * len(rows) >= len(scores):
            np.multiply(terms[term], query[term], out=room)
            scores += room
        elif len(rows):
            scores[rows] += terms[term, rows] * query[term]


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """The k best columns, ties to the smaller id, without the query's own id. ``ids`` ascend."""
    allowed = np.flatnonzero(ids != own)
    if len(allowed) > k:
        values = scores[allowed]
        least = np.partition(values, len(values) - k)[len(values) - k]
        above = allowed[values > least]
        allowed = np.concatenate([above, allowed[values == least][: k - len(above)]])
    return allowed


def block_winners(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(queries) or not len(rows):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    rows = rows.sort_values("vec_id", kind="stable")
    most = [max((max(map(abs, map(int, (v.min(), v.max())))) for v in side["vector"] if len(v)), default=0) for side in (queries, rows)]
    bound = most[0] * most[1] * max(max(map(len, queries["vector"])), 1)
    # no sum of products leaves the bound, nor does a component
    exact = np.int32 if max(bound, *most) < 1 << 31 else np.int64 if bound <= LONG_MAX else object
    q, terms = _vectors(queries["vector"], exact), np.ascontiguousarray(_vectors(rows["vector"], exact).T)
    postings = [np.flatnonzero(x) for x in terms]
    ids, scores, room = rows["vec_id"].to_numpy(), np.zeros(len(rows), exact), np.zeros(len(rows), exact)
    found, values, counts = [], [], []
    for query, own in zip(q, queries["vec_id"].tolist()):
        accumulate(query, terms, postings, scores, room)
        best = select(scores, ids, own, k)
        found.append(ids[best])
        values.append(np.clip(scores[best], -LONG_MAX - 1, LONG_MAX).astype(np.int64))
        counts.append(len(best))
    return pd.DataFrame({"query_id": np.repeat(queries["vec_id"].to_numpy(), counts), "vec_id": np.concatenate(found), "score": np.concatenate(values)})


def integer_vectors(rows: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """vec_id and floor(scale * x) of every component; vectors that are NULL or hold NULL or a non-finite component go, as do NULL ids."""
    x = F.col(vector_column)

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    whole = rows.where(F.col(id_column).isNotNull() & x.isNotNull() & F.forall(x, finite))
    return whole.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("vector"))


def search(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` best rows for every row that is a query: query_id, rank from 1, vec_id, score.

    Scores are inner products of floor(``scale`` * component), in whole
    numbers; ties go to the smaller id. A query's own row, and any other row
    of its id, is no candidate. ``is_query`` is a condition on vec_id. Repeated
    rows count once; of different vectors under one id the smallest counts.
    Vectors that are NULL or hold NULL or non-finite components, and rows
    without id, take no part. Missing components of shorter vectors count as
    0. Scores outside the range of a long end at its limits. Empty vectors
    score 0. Other columns are not looked at.
    """
    table = integer_vectors(rows, id_column, vector_column, scale).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n, n_queries = table.agg(F.count("*"), F.count_if(is_query)).first()
    row_blocks = -(-n // min(BLOCK_ROWS, max(LEAST_BLOCK, n // BLOCKS))) or 1
    query_blocks = -(-n_queries // QUERY_BLOCK_ROWS) or 1

    def block(count):
        return F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")

    queries = table.where(is_query).select("vec_id", "vector", block(query_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"))
    others = table.select("vec_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), block(row_blocks).alias("rb"))
    winners = (
        queries.groupBy("qb", "rb")
        .cogroup(others.groupBy("qb", "rb"))
        .applyInPandas(lambda q, r: block_winners(q, r, k), "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return winners.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
