"""Exact top-k by inner product with Fagin's threshold algorithm over sorted per-dimension lists.

Queries and candidates are dealt into blocks; every query block meets every candidate block once. Inside a
pair of blocks, each dimension has its candidates sorted by value. All queries of the block read the lists
together, each from the top where a query's component is positive and from the bottom where it is negative;
every round goes deeper into the lists that the queries' bounds owe most to. What a round newly uncovers is
scored whole (random access). A query stops when its bound, the best score that a candidate not yet seen can
have, is below its kth score; equal bounds go on, so ties stay exact. Every query first meets one block, and
the kth score found there is its floor in all others, so a block that holds nothing better is left early.
The k best of each block then meet per query, at most k a block. Each candidate is sent once to every block
of queries, so what is shuffled is the vectors times the number of query blocks, and no pair is a row.

Every vector component x counts as floor(scale * x). Scores are exact integers: float64 products while no
partial sum can leave 2**53, int64 within 2**63, Python integers (held at the limits of a long) beyond.

Edge cases: vectors null, empty, or holding null or non-finite components, and rows with a null id, take no part; vectors of another
length than the query's are not its candidates; repeated ids are candidates each, and all rows with the
query's own id are left out; ties go to the smaller id; fewer than k candidates give fewer rows; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 20
SCALE = 64
QUERY_BLOCK = 2_048
BLOCK = 16_384
FIRST_DEPTH = 32
STEP = 1_024  # candidates scored at once


def _dot(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products (queries x candidates)."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return q.astype(np.int64) @ c.astype(np.int64).T
    exact = np.array([[int(v) for v in r] for r in q], dtype=object) @ np.array([[int(v) for v in r] for r in c], dtype=object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def threshold_top_k(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int = K, first_depth: int = FIRST_DEPTH, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query position, candidate id, score) of the k best candidates of each query, of those that reach its floor, and how many products were made; c's rows lie in order of id."""
    n, dims = c.shape
    order = np.argsort(c, axis=0, kind="stable")  # per dimension, ascending: its bottom and, reversed, its top list
    sorted_values = np.take_along_axis(c, order, axis=0).astype(float)
    seen = np.zeros(n, bool)
    best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(len(q))]  # positions, scores
    kth = np.full(len(q), -np.inf) if floor is None else floor.astype(float)
    active = np.arange(len(q))
    depth, step, made = np.zeros(dims, int), first_depth, 0
    at_all = np.arange(dims)
    while n and len(active):
        # the best that an unseen candidate can have: every component between the two lists' depths
        low, high = sorted_values[np.maximum(depth - 1, 0), at_all], sorted_values[np.minimum(n - depth, n - 1), at_all]
        parts = np.where(q[active] > 0, q[active] * high, q[active] * low)
        stays = parts.sum(axis=1) >= kth[active] - 0.5
        active, parts = active[stays], parts[stays]
        if not len(active) or seen.all():
            break
        # the lists that the bounds owe most to
        owed = np.where(depth < n, (parts - q[active] * sorted_values[n // 2]).max(axis=0), -np.inf)
        fresh = np.zeros(n, bool)
        for d in np.flatnonzero(owed >= min(owed.max() / 2, owed.max())):
            stop = min(n, depth[d] + step)
            fresh[order[depth[d] : stop, d]] = True
            fresh[order[n - stop : n - depth[d], d]] = True
            depth[d] = stop
        fresh &= ~seen
        seen |= fresh
        new = np.flatnonzero(fresh)
        for at in range(0, len(new), STEP):
            some = new[at : at + STEP]
            scores = _dot(q[active], c[some])
            made += scores.size
            hits = scores >= kth[active][:, None]
            hits &= query_ids[active][:, None] != ids[some][None, :]
            for row in np.flatnonzero(hits.any(axis=1)):
                i = active[row]
                cols = np.flatnonzero(hits[row])
                pos, val = np.concatenate([best[i][0], some[cols]]), np.concatenate([best[i][1], scores[row, cols]])
                if len(pos) > k:
                    keep = np.lexsort((ids[pos], -val))[:k] if len(pos) < 4 * k else _cut(val, ids[pos], k)
                    pos, val = pos[keep], val[keep]
                best[i] = (pos, val)
                if len(pos) >= k:
                    kth[i] = max(kth[i], val.min())
        step *= 2
    rows = np.concatenate([np.full(len(p), i) for i, (p, _) in enumerate(best)]) if best else np.empty(0, int)
    return rows.astype(int), ids[np.concatenate([p for p, _ in best])] if best else ids[:0], np.concatenate([v for _, v in best]) if best else np.empty(0, np.int64), made


def _cut(val: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest, ties to the smaller id, without sorting all."""
    least = np.partition(val, len(val) - k)[len(val) - k]
    over = np.flatnonzero(val > least)
    level = np.flatnonzero(val == least)
    need = k - len(over)
    if need < len(level):
        level = level[np.argpartition(ids[level], need - 1)[:need]] if need else level[:0]
    return np.concatenate([over, level])


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: float = SCALE, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score; ``is_query`` is a condition on id_col."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).select("id", "v", F.size("v").alias("dims"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    return _search(rows, k, scale, query_block, block)


def _search(rows: DataFrame, k: int, scale: float, query_block: int, block: int) -> DataFrame:
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    n_blocks, n_query_blocks = max(1, -(-n // block)), max(1, -(-asking // query_block))
    spread = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    numbers = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    placed = rows.select("id", "v", "dims", "asks", spread(n_blocks).alias("b"), spread(n_query_blocks).alias("qb"))
    queries = placed.filter("asks").select("id", "v", "dims", "qb")
    home = F.pmod("qb", F.lit(n_blocks))  # the block that a block of queries meets first

    def pair(asked: pa.Table, given: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if asked.num_rows and given.num_rows:
            dims = asked["dims"][0].as_py()
            given = given.sort_by("id")
            q, c = (np.floor(scale * _matrix(x["v"], dims)) for x in (asked, given))
            query_ids = asked["id"].to_numpy()
            floor = np.asarray([-np.inf if x is None else x for x in asked["floor"].to_pylist()])
            at, ids, scores, _ = threshold_top_k(query_ids, q, given["id"].to_numpy(), c, k, floor=floor)
            out = {"query_id": query_ids[at], "vec_id": ids, "score": scores}
        return pa.table({n: pa.array(x, pa.int64()) for n, x in out.items()})

    def met(asked: DataFrame, given: DataFrame) -> DataFrame:
        key = ["dims", "qb", "b"]
        given = given.select(*[F.col(c).alias(c) for c in given.columns])  # columns of its own
        return asked.groupBy(*key).cogroup(given.groupBy(*key)).applyInArrow(pair, "query_id long, vec_id long, score long")

    every = placed.select("id", "v", "dims", "b", F.explode(numbers(n_query_blocks)).alias("qb"))
    found = met(queries.select("*", home.cast("int").alias("b"), F.lit(None).cast("long").alias("floor")), every.filter(F.col("b") == home))
    if n_blocks > 1:
        first = written(found, "topk-first")
        # repeated ids are one query to the ranks, so a floor of either holds for both
        floors = first.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("floor")).filter(F.col("c") == k).select(F.col("query_id").alias("id"), "floor")
        asked = queries.join(floors, "id", "left").select("id", "v", "dims", "qb", F.explode(numbers(n_blocks)).alias("b"), "floor")
        found = first.unionByName(met(asked.filter(F.col("b") != home), every.filter(F.col("b") != home)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
