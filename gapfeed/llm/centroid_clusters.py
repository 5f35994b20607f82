"""Centroid clustering with exact integers and Walsh-Hadamard progressive search.

Components become integers, floor(scale x). The Walsh-Hadamard transform of an
integer vector is an integer vector, and the squared distance of two transforms
is `dim` times that of the vectors. For each vector the differences of the
coefficients are squared and added coarse to fine (sequency order: coefficients
that change sign rarely come first). After each step the centroid nearest so far
is followed to its full distance, and centroids whose part sum alone is already
strictly greater are out; those that stay are finished over all coefficients, so
the nearest is exact, and of equally near ones the smaller number wins.

Each round is one map over the vectors: a task keeps one exact sum and count for
each centroid, sums meet by aggregation, and only the centroids (k x dim numbers)
come to the driver. A cluster that holds most rows is k sums in each task like any other.

Vectors that are null, of another length, or hold null or non-finite components
are left out. Repeated rows count each on their own. Starts are the rows of the
smallest hash, ties by their components; rows without an id are clustered, but start no
centroid. With fewer than k starts there are fewer centroids; with none, an
empty result. Components of any size are taken: those beyond 2^24 in whole
numbers of any length; what a long can't hold comes as the nearest long. Only
the id and the vector are read of the input's columns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfeed.llm._common import ship
from gapfeed.shipping import Scratch, materialize

#: Integers below this stay exact in 64 bits through transform, squares and sums (for up to 2^12 components).
EXACT = 1 << 24
#: Sums of integers of any size are kept in signed digits of this many bits, so that 2^39 rows fit a long.
DIGIT = 24
MOST = np.iinfo(np.int64).max
#: Vectors whose distances are taken at once.
ROWS = 4096


def hadamard(dim: int) -> np.ndarray:
    """The Walsh-Hadamard matrix, rows by number of sign changes."""
    h = np.ones((1, 1), dtype=np.int64)
    while len(h) < dim:
        h = np.block([[h, h], [h, -h]])
    if len(h) != dim:
        raise ValueError("the number of components must be a power of two")
    return h[np.argsort(np.count_nonzero(np.diff(h, axis=1), axis=1), kind="stable")]


def transform(v: np.ndarray) -> np.ndarray:
    """The transform of each row, in sequency order; exact for integers of either kind."""
    return v @ hadamard(v.shape[1]).astype(v.dtype).T


def steps(dim: int) -> list[tuple[int, int]]:
    """Ranges of coefficients, coarse to fine: 4, then twice as many as before."""
    out, at = [], 0
    while at < dim:
        to = min(dim, max(4, 2 * at))
        out.append((at, to))
        at = to
    return out


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; rows and centroids are integers of one dtype."""
    n, dim = v.shape
    a, c = transform(v), transform(centroids)
    part = np.zeros((n, len(c)), dtype=v.dtype)
    alive = np.ones((n, len(c)), dtype=bool)
    rows = np.arange(n)
    for at, to in steps(dim):
        for j in range(len(c)):
            some = np.flatnonzero(alive[:, j])
            if len(some):
                d = a[some, at:to] - c[j, at:to]
                part[some, j] += (d * d).sum(axis=1)
        if to == dim:
            break
        # the most promising centroid's full distance is an upper bound of the least
        open_parts = np.where(alive, part, part.max() + 1 if n else 0)
        guess = open_parts.argmin(axis=1)
        d = a[:, to:] - c[guess][:, to:]
        bound = part[rows, guess] + (d * d).sum(axis=1)
        alive &= part <= bound[:, None]
    final = np.where(alive, part, part.max() + 1 if n else 0)
    number = final.argmin(axis=1)  # the first of equal ones
    return number, part[rows, number] // dim


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x) of doubles: 64-bit where that is exact for all, else whole numbers of any length."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not len(scaled) or np.abs(scaled).max() < EXACT:
        return scaled.astype(np.int64)
    flat = [int(s) if math.isfinite(s) else int(x) * scale for s, x in zip(scaled.ravel().tolist(), values.ravel().tolist())]
    return np.array(flat, dtype=object).reshape(values.shape)


def _vectors(batches: Iterator[pa.RecordBatch], at: int, dim: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            some = batch.slice(a, ROWS)
            yield some, integers(some.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim), scale)


def _same_kind(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    small = v.dtype != object and all(abs(x) < EXACT for c in centroids for x in c)
    kind = np.int64 if small else object
    return (v if v.dtype == kind else v.astype(object)), np.array(centroids, dtype=kind)


def _digits(x: int) -> list[int]:
    """Signed digits of an integer, smallest first."""
    sign, x, out = (-1 if x < 0 else 1), abs(x), []
    while x:
        out.append(sign * (x & ((1 << DIGIT) - 1)))
        x >>= DIGIT
    return out or [0]


def _partial_sums(centroids: list[list[int]], dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * dim for _ in centroids]
        counts = [0] * len(centroids)
        for _, ints in _vectors(batches, 0, dim, scale):
            v, c = _same_kind(ints, centroids)
            number, _ = nearest(v, c)
            for j in np.unique(number):
                mine = v[number == j]
                counts[j] += len(mine)
                sums[j] = [a + b for a, b in zip(sums[j], mine.sum(axis=0).tolist())]
        rows = [(j, -1, counts[j]) for j in range(len(centroids)) if counts[j]]
        for j, total in enumerate(sums):
            for i, x in enumerate(total):
                rows += [(j, i + dim * k, d) for k, d in enumerate(_digits(x)) if d]
        cluster, slot, part = ([r[k] for r in rows] for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(slot, pa.int32()), pa.array(part, pa.int64())], names=["cluster", "slot", "part"])

    return run


def next_centroids(kept: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """One round: floors of the exact means of the vectors nearest to each centroid; empty ones stay."""
    dim = len(centroids[0])
    parts = kept.select("v").mapInArrow(_partial_sums(centroids, dim, scale), "cluster int, slot int, part long")
    # at most k x (dim x digits + 1) rows, whatever the input's size
    got = parts.groupBy("cluster", "slot").agg(F.sum("part").alias("part")).collect()
    counts = {r.cluster: r.part for r in got if r.slot < 0}
    out = [list(c) if j not in counts else [0] * dim for j, c in enumerate(centroids)]
    for r in got:
        if r.slot >= 0:
            out[r.cluster][r.slot % dim] += r.part << (DIGIT * (r.slot // dim))
    return [[x // counts[j] for x in c] if j in counts else c for j, c in enumerate(out)]


def usable(vector: Column, dim: int) -> Column:
    return vector.isNotNull() & (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = vectors.sparkSession
    ship(spark)
    id_type = vectors.schema[id_col].dataType.simpleString()
    with Scratch(spark) as scratch:
        kept = vectors.where(usable(F.col(vec_col), dim)).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        kept = scratch.table(kept, "vectors")
        hashed = kept.where("id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
        starts = hashed.orderBy("h", "v").limit(k).collect()
        centroids = [integers(np.array([r.v]), scale)[0].tolist() for r in starts]
        for _ in range(rounds):
            if not centroids:
                break
            moved = next_centroids(kept, centroids, scale)
            if moved == centroids:
                break  # every further round gives the same
            centroids = moved
        hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, ints in _vectors(batches, 1, dim, scale):
                v, c = _same_kind(ints, centroids)
                number, distance = nearest(v, c)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array([min(int(d), MOST) for d in distance], pa.int64())], names=["id", "cluster", "distance"])

        schema = f"id {id_type}, cluster int, distance long"
        found = scratch.table(kept.mapInArrow(run, schema) if centroids else kept.limit(0).selectExpr("id", "0 as cluster", "0L as distance"), "assigned")
        # k rows: every cluster's distances summed, and all of them
        sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
        of = {r.cluster: min(int(r.s), MOST) for r in sums}
        all_of = min(sum(int(r.s) for r in sums), MOST)
        table = spark.createDataFrame([(j, of.get(j, 0), all_of, hashes[j]) for j in range(len(centroids))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        joined = found.join(F.broadcast(table), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
        return materialize(joined, "clusters")


def brute_force(vectors: pd.DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3") -> pd.DataFrame:
    """The same with Python's integers and every distance in full; for tests."""
    kept = []
    for i, v in zip(vectors["vec_id"], vectors["embedding"]):
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(int(x) * scale if abs(x) > 2**60 else float(x) * scale) for x in v]))
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in order[:k]]

    def assign() -> list[tuple[int, int]]:
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, to) in zip(kept, near) if to == j]
            if mine:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine)]
    near = assign()
    of = {j: sum(d for d, to in near if to == j) for j in range(len(centroids))}
    rows = [(i, to, d, of[to], sum(of.values()), hashlib.sha256(",".join(map(str, centroids[to])).encode()).hexdigest()) for (i, _), (d, to) in zip(kept, near)]
    return pd.DataFrame(rows, columns=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
