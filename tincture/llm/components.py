"""Connected components of an edge table by alternating large-star and small-star steps.

Nothing but one convergence figure of each round comes to the driver. Each round is written to the shared folder, so
that lineage stays short and a lost executor costs one round's tasks at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 50) -> DataFrame:
    """(node, component) for each node with a link to another: ``component`` is the smallest node reachable.

    ``edges``: columns ``a`` and ``b`` (long). Self-links, nulls and repeats are ignored; nodes without links are absent.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = scratch.save(links)
    state = _figure(links)
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        following = scratch.save(small.where("a <> b").distinct())
        scratch.drop(links)
        links, before, state = following, state, _figure(following)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _figure(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())


class Forest:
    """Union by smallest label over array positions, for links found inside one task."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        parent = self.parent
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self, x: np.ndarray) -> np.ndarray:
        parent = self.parent
        r = parent[x]
        while True:
            up = parent[r]
            if np.array_equal(up, r):
                parent[x] = r
                return r
            r = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, root) of each position that is not its own root: the same components with one link for each position."""
        every = np.arange(len(self.parent))
        roots = self.roots(every)
        return every[roots != every], roots[roots != every]
