"""Exact top-k inner-product search with multi-resolution segment statistics.

Components become integers, floor(256 x). For a segment of length w with mean m
and deviation s the inner product of two vectors is at most the sum over
segments of w (m m' + s s'), and so |q - v|^2 at least |q|^2 + |v|^2 less twice
that. The bound is taken with 1, 4, 16, ... segments; a candidate whose bound
falls below the k-th best score found so far goes no further, and survivors
get their exact score. Queries and rows are split by hash into blocks; every
block of queries meets every block of rows in a group of its own, which keeps
k rows for each query, and these are ranked at the end. Nothing but the
numbers of blocks is counted before, and no vector comes to the driver.

Vectors that are null, or hold null or non-finite components, take no part, nor
do rows without an id. Vectors of different lengths aren't compared. Ties go to
the smaller id. Rows that repeat an id are all candidates, except for queries
of that id; a repeated query row counts once. An empty table yields no rows.
Components too large for exact 64-bit floats are scored in whole numbers, pair
by pair; what a long can't hold comes as the nearest long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapfeed.llm._common import materialize, ship, sized_broadcast

SCALE = 256.0
#: Queries and rows of a block (about).
QUERY_ROWS, BLOCK_ROWS = 2048, 16_384
#: Rows whose bounds are taken at once.
ROWS = 2048


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def levels(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine; segments of two components at least."""
    out, n = [], 1
    while n <= dim // 2:
        out.append(n)
        n *= 4
    return out


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """For each vector sqrt(w) * mean and sqrt(w) * deviation of its segments, side by side."""
    edges = np.linspace(0, v.shape[1], segments + 1).astype(np.int64)
    w = np.diff(edges)
    total = np.add.reduceat(v, edges[:-1], axis=1)
    square = np.add.reduceat(v * v, edges[:-1], axis=1)
    return np.concatenate([total / np.sqrt(w), np.sqrt(np.maximum(square - total * total / w, 0))], axis=1)


def best(queries: np.ndarray, query_ids: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query over all blocks of (ids, vectors): (query row, id, score)."""
    plan = levels(queries.shape[1])
    known = [statistics(queries, n) for n in plan]
    lengths = np.sqrt((queries * queries).sum(axis=1))
    least = np.full(len(queries), -np.inf)
    who, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    exact_floats = True
    for block_ids, v in blocks:
        alive = np.ones((len(queries), len(v)), dtype=bool)
        # what rounding may take from a bound, whatever its sign
        slack = 1e-9 * lengths[:, None] * np.sqrt((v * v).sum(axis=1))[None, :] + 1e-6
        for n, known_stats in zip(plan, known):
            if not np.isfinite(least).any():
                break
            bound = known_stats @ statistics(v, n).T
            alive &= bound + slack >= least[:, None]
            if not alive.any():
                break
        alive &= query_ids[:, None] != block_ids[None, :]
        if not alive.any():
            continue
        exact_floats = exact_floats and float(np.abs(v).max(initial=0)) * float(np.abs(queries).max(initial=0)) * v.shape[1] < 2**53
        if not exact_floats:
            who, ids, scores = _whole_numbers(queries, query_ids, (who, ids, scores), block_ids, v, k)
            least = np.full(len(queries), -np.inf)  # no float bound holds for them
            continue
        if alive.mean() > 0.05:
            score = np.where(alive, queries @ v.T, -np.inf)
            if len(v) > k:
                cut = np.partition(score, len(v) - k, axis=1)[:, len(v) - k]
                alive &= score >= np.maximum(cut, least)[:, None]
            q, c = np.nonzero(alive)
            s = score[q, c]
        else:
            q, c = np.nonzero(alive)
            s = np.einsum("ij,ij->i", queries[q], v[c])
        who, ids, scores = np.concatenate([who, q]), np.concatenate([ids, block_ids[c]]), np.concatenate([scores, s])
        order = np.lexsort((ids, -scores, who))
        who, ids, scores = who[order], ids[order], scores[order]
        first = np.searchsorted(who, who, side="left")
        keep = np.arange(len(who)) - first < k
        who, ids, scores = who[keep], ids[keep], scores[keep]
        full = np.bincount(who, minlength=len(queries)) == k
        last = np.searchsorted(who, np.arange(len(queries)), side="right") - 1
        least = np.where(full, scores[np.maximum(last, 0)] if len(scores) else -np.inf, -np.inf)
    most = np.iinfo(np.int64)
    return who, ids, np.array([min(max(int(x), most.min), most.max) for x in scores], dtype=np.int64)


def _whole_numbers(queries: np.ndarray, query_ids: np.ndarray, found: tuple[np.ndarray, ...], block_ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query among those found and a block, scored in Python's integers."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for q, i, score in zip(*(x.tolist() for x in found)):
        rows.setdefault(q, []).append((-int(score), i))
    block = [list(map(int, x)) for x in v]
    for q, x in enumerate(queries):
        x = list(map(int, x))
        rows[q] = heapq.nsmallest(k, rows.get(q, []) + [(-sum(map(mul, x, y)), i) for i, y in zip(block_ids.tolist(), block) if i != query_ids[q]])
    flat = [(q, i, -score) for q, best_of in rows.items() for score, i in best_of]
    return np.array([r[0] for r in flat], dtype=np.int64), np.array([r[1] for r in flat], dtype=np.int64), np.array([r[2] for r in flat], dtype=object)



def quantized(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part; components as doubles floor(256 x)."""
    used = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col)))
    return used.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def grid(rows: DataFrame, queries: DataFrame, query_rows: int, block_rows: int) -> DataFrame:
    """(dim, qb, cb, side, id, v): blocks of queries (side 1) beside blocks of rows (side 0), for every pair of blocks of one length of vectors."""

    def sizes(of: DataFrame, most: int, name: str) -> DataFrame:
        return of.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count("*") / most).cast("int").alias(name))

    plan = sizes(rows, block_rows, "nc").join(sizes(queries, query_rows, "nq"), "dim")
    plan = materialize(plan, "grid")  # one row for each length of vectors

    def placed(of: DataFrame) -> DataFrame:
        return of.withColumn("dim", F.size("v")).join(sized_broadcast(plan), "dim").withColumn("h", F.xxhash64("id", "v"))

    each_query_block = F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb")
    each_row_block = F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("cb")
    left = placed(rows).select("dim", each_query_block, F.pmod("h", "nc").cast("int").alias("cb"), F.lit(0).alias("side"), "id", "v")
    right = placed(queries).select("dim", F.pmod("h", "nq").cast("int").alias("qb"), each_row_block, F.lit(1).alias("side"), "id", "v")
    return left.unionByName(right)


def _best_of_group(k: int):
    def run(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        side, ids = group.column("side").to_numpy(), group.column("id").to_numpy()
        v = _matrix(group.column("v").combine_chunks(), dim) if dim else np.zeros((group.num_rows, 0))
        asked, rows = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        parts = ((ids[rows[a : a + ROWS]], v[rows[a : a + ROWS]]) for a in range(0, len(rows), ROWS))
        who, found, score = best(v[asked], ids[asked], parts, k)
        return pa.table({"query_id": pa.array(ids[asked][who], pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query row."""
    ship(vectors.sparkSession)
    rows = quantized(vectors, id_col, vec_col)
    queries = quantized(vectors.where(is_query), id_col, vec_col).dropDuplicates(["id", "v"])
    found = grid(rows, queries, query_rows, block_rows).groupBy("dim", "qb", "cb").applyInArrow(_best_of_group(k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: pd.DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> pd.DataFrame:
    """The same by scoring all pairs; for tests."""
    out = []
    good = [(int(i), np.floor(np.asarray(v, dtype=np.float64) * SCALE)) for i, v in zip(vectors[id_col], vectors[vec_col]) if v is not None and np.all(np.isfinite(np.asarray(v, dtype=np.float64)))]
    for q, x in good:
        if q % every == 0:
            scored = sorted((-int(x @ y), i) for i, y in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
