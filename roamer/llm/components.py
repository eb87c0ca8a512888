"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamer.llm.store import lean, written


#: Up to so many edges (16 bytes each) one task joins them; more are joined by rounds of stars.
SMALL = 1 << 20


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task."""
    a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*((r.column(0).to_numpy(), r.column(1).to_numpy()) for r in batches), strict=True)) if (batches := list(batches)) else (np.empty(0, np.int64), np.empty(0, np.int64))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[[root(x) for x in range(len(nodes))]] if len(nodes) else nodes)], names=["node", "root"])


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node reachable.

    A graph of at most ``SMALL`` edges, by count, is joined in one task. Else each round links every node to the smallest neighbour it has and is written
    to the shared folder; the number of rounds grows with the logarithm of the
    longest path. Minima are aggregated before the shuffle. Nothing but a count
    and a checksum of the edges comes to the driver.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    if edges.count() <= SMALL:
        return edges.coalesce(1).mapInArrow(lean(_joined), "node long, root long")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(_least(large), "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        edges = written(small, "cc-edges")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == last:
            break
        last = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
