"""Near duplicates of embeddings: spherical k-means cells, blocked cosine products within them.

* Equal vectors are one class with a weight, so copies are never compared with each other.
* Spherical k-means (cosine; about the square root of the number of classes many cells, so that
  assigning and comparing cost alike) is fitted in rounds over at most about `fit_rows` classes,
  those of the smallest hash shares; every class is then assigned. Sums are of integers, so
  reruns find the same cells.
* A class is at home in the cell of its nearest centroid. It also visits each
  cell of a smaller number whose border is nearer than `margin` (the sine of the
  angle to the plane between the two centroids). Two linked classes of
  different cells therefore meet once, in the cell of the smaller number, unless
  the one from the greater lies deeper than `margin` behind the border. With
  `margin` at sqrt(1 - similarity^2) no link is lost at all; smaller margins
  visit far fewer cells. The README gives the measured recall.
* A cell's homes and visitors are split by hash into blocks of about `block`
  rows; a task compares two blocks (homes with homes, homes with visitors), so a hot
  cell is many tasks. A comparison returns for each class the weight of
  its links, and a spanning forest of them: never all pairs.

Cosine is taken in double precision; products within 1e-9 of the bound are
taken again from exactly rounded sums. Vectors that are null, zero, empty or
hold null or non-finite components link with nothing; vectors of different
lengths aren't compared. Repeated rows link with each other. Null ids take part;
a component's id is its smallest id that isn't null (null if all are), and a row
without an id is never kept. An empty table yields no rows. Only the id and
the vector are read of the input's columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfeed.llm._common import ship, sized_broadcast
from gapfeed.llm.components import components
from gapfeed.llm.topk_search import usable
from gapfeed.shipping import Scratch, materialize

#: Classes that the cells are fitted on (about), rounds of fitting, classes each centroid should have at least.
FIT_ROWS, ROUNDS, FIT_EACH = 1_000_000, 8, 30
#: Visits up to this sine of the angle to a border.
MARGIN = 0.1
#: Rows of a block.
BLOCK = 4096
#: Numbers in one product of a chunk of rows with the centroids.
PRODUCT = 4 << 20
#: Unit vectors' components as integers, so that sums don't depend on their order.
FIXED = 1 << 30


def units(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by the largest component first, so that none overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return units(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def _chunks(batches: Iterator[pa.RecordBatch], at: int, dim: int, cells: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, PRODUCT // max(cells, dim))
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            some = batch.slice(a, rows)
            yield some, _matrix(some.column(at), dim)


def fit_cells(classes: DataFrame, count: int, dim: int, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of the cells, by spherical k-means rounds over a bounded share of the classes."""
    cells = max(1, min(math.isqrt(max(count - 1, 0)) + 1, fit_rows // FIT_EACH))
    share = min(1.0, fit_rows / max(count, 1))
    sample = classes.where(F.pmod("k2", F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else classes
    starts = sample.orderBy("k1", "k2").select("v").limit(cells).toArrow()  # fit_rows / FIT_EACH vectors at most
    centroids = _matrix(starts.column(0).combine_chunks(), dim) if starts.num_rows else np.zeros((0, dim))
    for _ in range(rounds if len(centroids) > 1 else 0):

        def run(batches: Iterator[pa.RecordBatch], centroids=centroids) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(centroids.shape, dtype=np.int64)
            for _, x in _chunks(batches, 0, dim, len(centroids)):
                near = (x @ centroids.T).argmax(axis=1)
                np.add.at(sums, near, np.rint(x * FIXED).astype(np.int64))
            cell, slot = np.nonzero(sums)
            for a in range(0, len(cell), 100_000):
                part = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(cell[part], pa.int64()), pa.array(slot[part], pa.int64()), pa.array(sums[cell[part], slot[part]])], names=["cell", "slot", "part"])

        got = sample.select("v").mapInArrow(run, "cell long, slot long, part long").groupBy("cell", "slot").agg(F.sum("part").alias("part")).toArrow()
        sums = np.zeros(centroids.shape)
        sums[got.column(0).to_numpy(), got.column(1).to_numpy()] = got.column(2).to_numpy()
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        moved = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def assign(classes: DataFrame, centroids: np.ndarray, margin: float) -> DataFrame:
    """(node, weight, v, home, visits) of every class."""
    dim = centroids.shape[1]
    item = classes.schema["v"].dataType.simpleString()
    gaps = np.sqrt(np.maximum(2 - 2 * np.clip(centroids @ centroids.T, -1, 1), 0)) if len(centroids) <= 4096 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _chunks(batches, 2, dim, len(centroids)):
            near = x @ centroids.T
            home = near.argmax(axis=1)
            apart = gaps[home] if gaps is not None else np.sqrt(np.maximum(2 - 2 * np.clip(centroids[home] @ centroids.T, -1, 1), 0))
            visits = (near.max(axis=1)[:, None] - near <= margin * apart) & (np.arange(len(centroids)) < home[:, None])
            row, cell = np.nonzero(visits)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), lists], names=["node", "weight", "v", "home", "visits"])

    return classes.select("node", "weight", "v").mapInArrow(run, f"node long, weight long, v {item}, home int, visits array<int>")


def blocks(assigned: DataFrame, block: int) -> DataFrame:
    """(cell, i, j, side, node, weight, v): every class in all the pairs of blocks that it is compared in."""
    homes = assigned.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("homes"))
    visiting = assigned.select("node", "weight", "v", F.explode("visits").alias("cell"))
    visitors = visiting.groupBy("cell").agg(F.count("*").alias("visitors"))
    plan = homes.join(visitors, "cell", "left").select("cell", F.ceil(F.col("homes") / block).cast("int").alias("nh"), F.ceil(F.coalesce("visitors", F.lit(0)) / block).cast("int").alias("nv"))
    plan = F.broadcast(plan)  # one row for each cell, at most fit_rows / FIT_EACH
    at_home = assigned.withColumnRenamed("home", "cell").join(plan, "cell").withColumn("b", F.pmod(F.xxhash64("node"), "nh").cast("int"))
    at_home = at_home.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("nh") + F.col("nv") - 1)))
    guest = F.col("with") >= F.col("nh")
    at_home = at_home.select("cell", F.when(guest, F.col("b")).otherwise(F.least("b", "with")).alias("i"), F.when(guest, F.col("with")).otherwise(F.greatest("b", "with")).alias("j"), F.when(guest | (F.col("b") <= F.col("with")), 0).otherwise(1).alias("side"), "node", "weight", "v")
    guests = visiting.join(plan, "cell").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)))
    guests = guests.select("cell", "i", (F.col("nh") + F.pmod(F.xxhash64("node"), "nv")).cast("int").alias("j"), F.lit(1).alias("side"), "node", "weight", "v")
    return at_home.unionByName(guests)


def exact_at_least(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    return math.fsum((x * y).tolist()) >= similarity * math.sqrt(math.fsum((x * x).tolist())) * math.sqrt(math.fsum((y * y).tolist()))


def compare(x: np.ndarray, y: np.ndarray | None, similarity: float) -> tuple[Iterator[tuple[int, np.ndarray]], int]:
    """Strips (first row, matrix of links) of x against y, or against itself (y None), and their number of columns."""
    own, y = y is None, x if y is None else y

    def strips() -> Iterator[tuple[int, np.ndarray]]:
        rows = max(1, PRODUCT // max(1, len(y)))
        for a in range(0, len(x), rows):
            product = x[a : a + rows] @ y.T
            linked = product >= similarity
            for i, j in zip(*np.nonzero(np.abs(product - similarity) < 1e-9)):
                linked[i, j] = exact_at_least(x[a + i], y[j], similarity)
            if own:
                here = np.arange(len(linked))
                linked[here, a + here] = False
            yield a, linked

    return strips(), len(y)


def _compare_group(similarity: float, dim: int):
    def run(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        side = group.column("side").to_numpy()
        v = group.column("v").combine_chunks()
        x = _matrix(v, dim)
        nodes, weights = group.column("node").to_numpy(), group.column("weight").to_numpy()
        own = i == j
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if own else 1))
        total = np.zeros(len(nodes), dtype=np.int64)
        label = np.arange(len(nodes))
        strips, _ = compare(x[left], None if own else x[right], similarity)
        for at, linked in strips:
            total[left[at : at + len(linked)]] += linked @ weights[right]
            if not own:
                total[right] += weights[left[at : at + len(linked)]] @ linked
            for r in np.flatnonzero(linked.any(axis=1)):
                met = label[right[linked[r]]]
                mine = label[left[at + r]]
                if (met != mine).any():
                    joined = np.unique(np.append(met, mine))
                    label[np.isin(label, joined)] = joined[0]
        counted, tied = np.flatnonzero(total), np.flatnonzero(label != np.arange(len(nodes)))
        return pa.table(
            {
                "a": pa.array(np.concatenate([nodes[counted], nodes[label[tied]]])),
                "b": pa.array([None] * len(counted) + nodes[tied].tolist(), pa.int64()),
                "n": pa.array(np.concatenate([total[counted], np.zeros(len(tied), np.int64)])),
            }
        )

    return run


def near_components(vectors: DataFrame, similarity: float = 0.9, margin: float = MARGIN, block: int = BLOCK, fit_rows: int = FIT_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vec_col)
    part = F.coalesce(usable(v) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"), part.alias("part"))
    keyed = rows.where("part").select("id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("second"), "v").alias("k2"))
    with Scratch(spark) as scratch:
        classes = keyed.groupBy("k1", "k2").agg(F.min("id").alias("min_id"), F.count("*").alias("weight"), F.first("v").alias("v"))
        classes = scratch.table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        found = None
        for dim, count in sorted((r[0], r[1]) for r in classes.groupBy(F.size("v")).count().collect()):
            same = classes.where(F.size("v") == dim)
            assigned = scratch.table(assign(same, fit_cells(same, count, dim, fit_rows), margin), "assigned")
            here = blocks(assigned, block).groupBy("cell", "i", "j").applyInArrow(_compare_group(similarity, dim), "a long, b long, n long")
            here = scratch.table(here, "found")
            found = here if found is None else found.unionByName(here)
        if found is None:
            found = classes.selectExpr("node a", "node b", "weight n").limit(0)
        links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
        reached = components(found.where("b is not null").select("a", "b"))
        smallest = reached.join(classes.select("node", "min_id"), "node").groupBy("component").agg(F.min("min_id").alias("component_id"))
        named = reached.join(smallest, "component").select("node", "component_id")
        facts = classes.select("k1", "k2", "node", "min_id", "weight").join(links, "node", "left").join(named, "node", "left")
        facts = facts.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "min_id").alias("component_id"))
        facts = scratch.table(facts, "facts")
        linked = keyed.drop("v").join(sized_broadcast(facts), ["k1", "k2"]).select("id", "n_links", "component_id")
        others = rows.where(~F.col("part")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        out = linked.unionByName(others).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
        return materialize(out, "embedding-dedup")


def keep_one(vectors: DataFrame, id_col: str = "vec_id", **how) -> DataFrame:
    """Rows of the smallest id of each group (rows that repeat an id all stay), and all rows without an id."""
    dropped = near_components(vectors, id_col=id_col, **how).where(~F.col("kept") & F.col(id_col).isNotNull()).select(id_col)
    return vectors.join(sized_broadcast(dropped.distinct()), id_col, "left_anti")


def brute_force(vectors: pd.DataFrame, similarity: float = 0.9) -> pd.DataFrame:
    """The same by all pairs; for tests and recall."""
    ids = [None if pd.isna(i) else int(i) for i in vectors["vec_id"]]
    rows: list[np.ndarray | None] = []
    for x in vectors["embedding"]:
        x = np.zeros(0) if x is None else np.array([math.nan if c is None else c for c in x], dtype=np.float64)
        rows.append(units(x[None])[0] if len(x) and np.isfinite(x).all() and x.any() else None)
    n_links, parent = [0] * len(ids), list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(rows):
        for j in range(i):
            y = rows[j]
            if x is not None and y is not None and len(x) == len(y) and float(x @ y) >= similarity:
                n_links[i] += 1
                n_links[j] += 1
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    named = [least.get(root(i)) for i in range(len(ids))]
    return pd.DataFrame({"vec_id": pd.Series(ids, dtype=object), "n_links": n_links, "component_id": pd.Series(named, dtype=object), "kept": [k is not None and k == c for k, c in zip(ids, named)]})
