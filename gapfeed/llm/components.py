"""Connected components of a link table, by contraction rounds on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfeed.shipping import Scratch, materialize


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's links as a star forest: (node, smallest node it reaches here)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([root(x) for x in part], pa.int64()), pa.array(part, pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in `links` (a, b: long): component is the smallest node reached.

    Each round points every node at its smallest neighbour, follows the
    pointers twice, and contracts; nodes that keep links at least halve in
    number each round. Only counts come to the driver. Null ends are dropped;
    an empty table yields no rows; repeated links and self-links do no harm.
    """
    with Scratch(links.sparkSession) as scratch:
        return materialize(_contracted(links, scratch), "components")


def _contracted(links: DataFrame, scratch: Scratch) -> DataFrame:
    links = links.where("a is not null and b is not null and a != b").select("a", "b")
    edges = scratch.table(links.mapInArrow(_forest, "a long, b long"), "cc-edges")
    nodes = None
    while True:
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        p1 = scratch.table(near, "cc-near")
        hop = p1.select(F.col("u").alias("p"), F.col("p").alias("q"))
        p2 = scratch.table(p1.join(hop, "p").select("u", F.col("q").alias("p")), "cc-hop")
        hop = p2.select(F.col("u").alias("p"), F.col("p").alias("q"))
        step = scratch.table(p2.join(hop, "p").select("u", F.col("q").alias("p")), "cc-step")
        to = step.select(F.col("u").alias("component"), F.col("p").alias("to"))
        nodes = step.select(F.col("u").alias("node"), F.col("p").alias("component")) if nodes is None else nodes.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        nodes = scratch.table(nodes, "cc-nodes")
        pa_, pb = step.select(F.col("u").alias("a"), F.col("p").alias("x")), step.select(F.col("u").alias("b"), F.col("p").alias("y"))
        edges = scratch.table(edges.join(pa_, "a").join(pb, "b").where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "cc-edges")
    if nodes is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return nodes
