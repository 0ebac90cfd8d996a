"""Nearest neighbours by a block matrix join (operator 2).

Candidates and queries are dealt into blocks of about ``block_bytes`` of vectors; a task joins one block of each. Within it, tiles of
``query_tile`` by ``candidate_tile`` vectors are quantised to int8 with a scale of their own for each vector, and one matrix product of the
int8 values gives all distances of the tile with an error of at most the sum of the two quantisation errors. (Their product is taken in float32 where
all sums of products of such integers are exact in it, that is up to 1,040 components, and in double beyond: matrix libraries have no integer product.) A pair
survives when its smallest possible distance is above neither the k-th smallest largest-possible one of its query in the tile nor the k-th best
distance that earlier tiles of the block left; survivors are recomputed in double precision from the original vectors and enter
the query's heap. The heaps of blocks are merged by query, in a tree of at most ``fan`` at a time. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "query_id long, vec_id long, score double, block long"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scale, norm of the quantisation error) of each row."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # components too small to divide by 127
    q = np.rint(x / scale[:, None])
    return q.astype(np.int8), scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))


def exact_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, components summed in their order."""
    s = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        s += d * d
    return np.sqrt(s)


def tile_survivors(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query number, candidate number) of the pairs of a tile that may be among the k nearest, whose distance has to be ``bound`` at most."""
    with np.errstate(all="ignore"):
        q8, qs, qe = quantise(q)
        c8, cs, ce = quantise(c)
        exact_type = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # int8 products sum exactly in it
        dot = (q8.astype(exact_type) @ c8.astype(exact_type).T).astype(np.float64) * qs[:, None] * cs[None, :]
        qn, cn = (np.square(a.astype(np.float64) * s[:, None]).sum(axis=1) for a, s in ((q8, qs), (c8, cs)))
        square = qn[:, None] + cn[None, :]
        near = np.sqrt(np.maximum(square - 2 * dot, 0.0))
        slack = qe[:, None] + ce[None, :] + 1e-7 * np.sqrt(square)  # the last term covers rounding
        low, high = near - slack, near + slack
    own = qid[:, None] == cid[None, :]
    low[~np.isfinite(low)] = -np.inf  # sums that overflow bound nothing: such pairs are recomputed
    high[~np.isfinite(high) | own] = np.inf
    kth = min(k, len(cid)) - 1
    limit = np.minimum(np.partition(high, kth, axis=1)[:, kth], bound)
    return np.nonzero((low <= limit[:, None]) & ~own)


def block_nearest(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, query_tile: int, candidate_tile: int) -> list[tuple[int, int, float]]:
    """The k nearest of each query within a block, exact: (query, candidate, distance)."""
    out = []
    for i in range(0, len(qid), query_tile):
        ids, rows = qid[i : i + query_tile], q[i : i + query_tile]
        heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        bound = np.full(len(ids), np.inf)
        for j in range(0, len(cid), candidate_tile):
            part = c[j : j + candidate_tile]
            a, b = tile_survivors(ids, rows, cid[j : j + candidate_tile], part, k, bound)
            with np.errstate(over="ignore"):
                d = exact_distance(rows[a], part[b])
            for r, dist, vec in zip(a.tolist(), d.tolist(), cid[j + b].tolist()):
                _offer(heaps[r], k, dist, vec)
            bound = np.array([-h[0][0] if len(h) == k else np.inf for h in heaps])
        out += [(int(ids[r]), -v, -s) for r, heap in enumerate(heaps) for s, v in heap]
    return out


def _offer(heap: list[tuple[float, int]], k: int, dist: float, vec: int) -> None:
    item = (-dist, -vec)
    if len(heap) < k:
        heapq.heappush(heap, item)
    elif item > heap[0]:
        heapq.heapreplace(heap, item)


def _tile(k: int, query_tile: int, candidate_tile: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, queries: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(cands):
            found = block_nearest(queries["qid"].to_numpy(), np.stack(queries["qv"]), cands["id"].to_numpy(), np.stack(cands["v"]), k, query_tile, candidate_tile)
        return pd.DataFrame([(*r, key[1]) for r in found], columns=["query_id", "vec_id", "score", "block"])

    return run


def _merge(k: int, fan: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(df: pd.DataFrame) -> pd.DataFrame:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for q, v, s in zip(df["query_id"].tolist(), df["vec_id"].tolist(), df["score"].tolist()):
            _offer(heaps.setdefault(q, []), k, s, v)
        rows = [(q, -v, -s, int(df["block"].iloc[0]) // fan, rank + 1) for q, heap in heaps.items() for rank, (s, v) in enumerate(sorted(heap, reverse=True))]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "block", "rank"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, block_bytes: int = 16 << 20, query_tile: int = 1024, candidate_tile: int = 4096, fan: int = 32) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> query_id, rank (from 1), vec_id, score (Euclidean), ties to the smaller vec_id.

    Queries are the rows where ``is_query`` holds, candidates all rows but those with the query's own vec_id. Rows without vec_id or
    embedding, or whose embedding is empty, zero or has a null or non-finite component, take no part. Vectors are
    compared with those of their own length only. A candidate row that is repeated counts each time; a repeated
    query has one answer. Empty tables give no rows; other columns don't matter. A candidate is sent once for each block of queries and
    a query once for each block of candidates, so larger blocks move less.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    v = v.filter(
        F.col("id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    ).withColumn("dim", F.size("v"))
    size = F.sum(8 * (F.col("dim") + 2))
    of_all, of_queries, nq = v.agg(size, F.sum(F.when(F.col("q"), 8 * (F.col("dim") + 2))), F.count(F.when(F.col("q"), 1))).first()
    blocks = lambda x, least: max(1, -(-x // block_bytes), min(least, -(-x // (1 << 20))))
    nc, nqb = blocks(of_all or 0, v.sparkSession.sparkContext.defaultParallelism), blocks(of_queries or 0, 1)  # enough tasks, of a megabyte at least
    spread = lambda seed, blocks: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks).cast("long"))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    cands = v.select("dim", spread(1, nc).alias("c"), every(nqb).alias("b"), "id", "v")
    queries = v.filter("q").dropDuplicates(["id"]).select(F.col("dim").alias("qdim"), every(nc).alias("qc"), spread(2, nqb).alias("qb"), F.col("id").alias("qid"), F.col("v").alias("qv"))
    found = queries.groupBy("qdim", "qc", "qb").cogroup(cands.groupBy("dim", "c", "b")).applyInPandas(_tile(k, query_tile, candidate_tile), FOUND)
    group = F.pmod(F.xxhash64("query_id"), F.lit(max(1, nq // 64)).cast("long")).alias("g")  # about 64 queries, each with k rows of at most ``fan`` blocks
    while True:
        found = found.groupBy(group, F.floor(F.col("block") / fan).alias("f")).applyInPandas(_merge(k, fan), FOUND + ", rank int")
        nc = -(-nc // fan)
        if nc == 1:
            return found.select("query_id", "rank", "vec_id", "score")
