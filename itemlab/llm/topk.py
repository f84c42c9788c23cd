"""Exact search for the k largest inner products by the threshold algorithm.

Vectors are dealt into blocks. A block has, for each dimension, the list of its vectors sorted by
that component. A group of queries goes down all lists at once, from both ends, since a query
favours high components where its own is above zero and low ones where it is below. What is met
for the first time is scored for the queries that still search. What has not been met can at most
reach the sum, over the dimensions, of the query's component times the list's value at the depth
reached on its favoured side; once that bound is below a query's k-th best score, its search in
the block ends. Depths grow by a factor, which costs some lookups and changes no result. The best
of all blocks are merged per query.

A query group meets a candidate block in one task, both of bounded size; queries and candidates
are repeated once for each block of the other side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemlab.plans.staging import stage

CANDIDATES = 4096
QUERIES = 512
FIRST_DEPTH = 16
DEEPER = 4


def to_integers(vector: str | Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: str) -> Column:
    """Neither NULL nor empty, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def threshold_search(
    queries: np.ndarray, own: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the k best of each query in one block, ties to smaller ids.

    `own` has the queries' ids, which are not found. Entries must be exact in the arrays' type.
    """
    n, dims = matrix.shape
    never = -np.inf if matrix.dtype == np.float64 else -(2**62) if matrix.dtype == np.int64 else -(10**40)
    order = np.argsort(matrix, axis=0, kind="stable")
    each = np.arange(dims)
    scores = np.full((len(queries), n), never, matrix.dtype)
    least = np.full(len(queries), never, matrix.dtype)
    met = np.zeros(n, bool)
    searching = np.arange(len(queries))
    depth = min(FIRST_DEPTH, n)
    while True:
        here = np.zeros(n, bool)
        here[order[:depth].ravel()] = True
        here[order[n - depth :].ravel()] = True
        new = np.flatnonzero(here & ~met)
        met[new] = True
        reached = queries[searching] @ matrix[new].T
        reached[own[searching, None] == ids[new]] = never
        scores[np.ix_(searching, new)] = reached
        if met.sum() >= k:
            seen = scores[np.ix_(searching, np.flatnonzero(met))]
            least[searching] = np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k]
        low, high = matrix[order[depth - 1], each], matrix[order[n - depth], each]
        asked = queries[searching]
        bound = np.maximum(asked, 0) @ high + np.minimum(asked, 0) @ low
        searching = searching[least[searching] <= bound]
        if met.all() or not len(searching):
            break
        depth = min(depth * DEEPER, n)
    row, column = np.nonzero((scores >= least[:, None]) & (scores != never))
    found = scores[row, column]
    rank = np.lexsort((ids[column], -found, row))
    row, column, found = row[rank], column[rank], found[rank]
    first = np.searchsorted(row, np.arange(len(queries)))
    best = np.arange(len(row)) - first[row] < k
    return row[best], ids[column[best]], found[best]


def _search_block(k: int):
    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or block.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        matrix = np.array(block["vector"].tolist(), np.int64)
        asked = np.array(queries["vector"].tolist(), np.int64)
        most = float(np.abs(matrix).max()) * float(np.abs(asked).max()) * matrix.shape[1]
        # Products of doubles are exact as long as every sum fits 53 bits.
        kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
        own = queries["id"].to_numpy(np.int64)
        row, ids, scores = threshold_search(
            asked.astype(kind), own, matrix.astype(kind), block["id"].to_numpy(np.int64), k
        )
        return pd.DataFrame({"query_id": own[row], "vec_id": ids, "score": scores.astype(np.int64)})

    return search


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    id: str = "vec_id",
    vector: str = "embedding",
    candidates: int = CANDIDATES,
    queries: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query among all other rows.

    Rows with a NULL id, a NULL vector, or a component that is NULL or not finite take no part.
    Vectors of different lengths are not compared. All rows with the query's id count as its own;
    a query that is repeated with an equal vector is asked once. A table without queries gives
    no rows.
    """
    clean = vectors.where(F.col(id).isNotNull() & usable(vector)).select(
        F.col(id).cast("long").alias("id"), to_integers(vector, scale).alias("vector"), is_query.alias("_asks")
    )
    clean = stage(clean.withColumn("dims", F.size("vector")), "vectors")
    n, asking = clean.agg(F.count("*"), F.count(F.when(F.col("_asks"), 1))).first()
    blocks, groups = max(1, -(-n // candidates)), max(1, -(-asking // queries))
    mixed = F.xxhash64("id", "vector")
    asked = (
        clean.where("_asks")
        .select("id", "vector", "dims")
        .distinct()
        .withColumns({"group": F.pmod(mixed, F.lit(groups)), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
    )
    held = clean.select("id", "vector", "dims").withColumns(
        {"block": F.pmod(mixed, F.lit(blocks)), "group": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))}
    )
    pair = ["group", "block", "dims"]
    found = (
        asked.groupBy(*pair)
        .cogroup(held.groupBy(*pair))
        .applyInPandas(_search_block(k), "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
