"""Connected components of very large graphs, and union-find for the small ones inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``edges (a, b)`` to node, component (its smallest node), for all nodes that have an edge to another.

    Alternates large-star and small-star steps until nothing changes: every step only groups by node for a minimum, and
    joins that minimum back, so a node with very many edges is never gathered.
    """
    edges = stored(_descending(edges.select("a", "b")), "edges")
    state = _state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _descending(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(_descending(moved.unionByName(least.select("a", F.col("m").alias("b")))), "edges")
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
    raise RuntimeError(f"no stable components after {rounds} rounds")


def _descending(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index in the component of each of ``n`` nodes."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        lower = np.minimum(x, y)
        np.minimum.at(root, x, lower)
        np.minimum.at(root, y, lower)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root
