"""Embedding near-deduplication by a forest of random-projection trees with spill overlap.

Trees are fitted on a bounded sample: each split projects on a random direction and cuts at the sample's median, and
vectors near the cut go to both sides. Every vector is then put into its leaves of every tree; vectors are compared by
exact cosine within leaves. A pair is counted only in the first leaf that both share (each vector carries the list of its
leaves), so no pair is ever stored, shuffled or deduplicated: a leaf returns one row for each member. A node in which a
quarter of the sampled pairs are links is not split, as that would lose them: comparing all its pairs takes at most about four
times as many steps as there are links to count. Large leaves are dealt into parts, and each pair of
parts is a task. Vectors of each length have a forest of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hash_bound, tune
from .components import Forest, components


@dataclass
class Tree:
    """Inner nodes by index: direction, lower and upper border of the overlap, children; a child below zero is leaf ``-1 - child``."""

    directions: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int

    @classmethod
    def fit(cls, sample: np.ndarray, rng: np.random.Generator, least: float, overlap: float, first_leaf: int, threshold: float) -> Tree:
        nodes: list[list] = []
        leaves = 0

        def dense(rows: np.ndarray) -> bool:
            some = sample[rows if len(rows) <= 256 else rng.choice(rows, 256, replace=False)]
            return np.count_nonzero(some @ some.T >= threshold) - len(some) >= len(some) * (len(some) - 1) / 4

        def grow(rows: np.ndarray) -> int:
            nonlocal leaves
            if len(rows) <= least or dense(rows):
                leaves += 1
                return -first_leaf - leaves
            direction = rng.standard_normal(sample.shape[1])
            at = sample[rows] @ direction
            low, middle, high = np.quantile(at, [0.5 - overlap, 0.5, 0.5 + overlap])
            if at.min() == at.max():
                leaves += 1
                return -first_leaf - leaves
            mine = len(nodes)
            nodes.append([direction, low, high, 0, 0])
            nodes[mine][3] = grow(rows[at <= middle]) if (at <= middle).any() and not (at <= middle).all() else grow(rows[at < middle])
            nodes[mine][4] = grow(rows[at > middle]) if (at > middle).any() else grow(rows[at >= middle])
            return mine

        grow(np.arange(len(sample)))
        parts = [np.array([n[i] for n in nodes]) for i in range(5)] if nodes else [np.zeros((0, sample.shape[1]))] + [np.zeros(0)] * 4
        return cls(*parts, leaves)

    def place(self, vectors: np.ndarray, first_leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs: a vector within the overlap of a cut goes both ways."""
        if not len(self.directions):
            return np.arange(len(vectors)), np.full(len(vectors), first_leaf)
        rows, leaves = [], []
        stack = [(0, np.arange(len(vectors)))]
        while stack:
            node, own = stack.pop()
            if not len(own):
                continue
            if node < 0:
                rows.append(own)
                leaves.append(np.full(len(own), -1 - node))
                continue
            at = vectors[own] @ self.directions[node]
            stack.append((int(self.left[node]), own[at <= self.upper[node]]))
            stack.append((int(self.right[node]), own[at >= self.lower[node]]))
        return np.concatenate(rows), np.concatenate(leaves)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lengths(column: pa.Array) -> np.ndarray:
    return column.value_lengths().to_numpy(zero_copy_only=False)


#: What fills up a vector's list of leaves.
_NO_LEAF = np.iinfo(np.int32).min


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    trees: int = 10,
    leaf: int = 800,
    overlap: float = 0.04,
    largest_part: int = 8000,
    sample_rows: int = 20_000,
    seed: int = 11,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Trees are fitted on about ``sample_rows`` distinct vectors at most (a documented bound); all rows are indexed and compared, with
    those of their own length. ``n_links`` counts the other rows linked directly, exact copies included; ``component_id`` is
    the smallest id reachable; ``kept`` is whether that is the row's own. Null, empty or zero vectors and those with null or
    non-finite components link with nothing: n_links 0, their own id, kept. Rows with a null id have a null component unless a
    copy or link has an id, and are not kept. Equal vectors are one node, however many there are. Leaves of over
    ``largest_part`` vectors are cut into parts of about that size.
    """
    spark = df.sparkSession
    tune(spark, 2000)
    scratch = Scratch(spark, "embeddings")
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).withColumn(
        "ok",
        F.coalesce(
            (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)
        ),
    )
    rows = scratch.save(rows)
    points = scratch.save(rows.where("ok").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("h", F.xxhash64("v")))
    counts = dict(points.groupBy(F.size("v")).count().where(F.col("count") > leaf).collect())  # other lengths are one leaf each
    share = min(1.0, sample_rows / max(1, sum(counts.values())))
    drawn = points.where(F.size("v").isin(list(counts)) & (F.col("h") <= F.lit(hash_bound(share)))).select("v").limit(2 * sample_rows).toArrow().column("v").combine_chunks()
    if isinstance(drawn, pa.ChunkedArray):
        drawn = pa.array([], pa.list_(pa.float64()))
    rng, forests, first, widths = np.random.default_rng(seed), {}, 0, _lengths(drawn)
    for width, count in sorted(counts.items()):
        own = drawn.take(pa.array(np.flatnonzero(widths == width)))
        sample = _unit(_matrix(own, width)) if len(own) else np.ones((1, width))
        sample = sample[np.lexsort(sample.T)]
        forests[width] = []
        for _ in range(trees):
            tree = Tree.fit(sample, rng, max(8.0, leaf * len(sample) / count), overlap, first, threshold)
            forests[width].append((tree, first))
            first += tree.leaves
    shared = spark.sparkContext.broadcast(forests)  # bounded by the sample

    def leaves_of(column):
        """For the vectors of each length: (their rows in the batch, vectors, (vector, leaf) pairs in order)."""
        lengths = _lengths(column)
        for width in np.unique(lengths).tolist():
            pick = np.flatnonzero(lengths == width)
            vectors = _unit(_matrix(column.take(pa.array(pick)), width))
            placed = [tree.place(vectors, start) for tree, start in shared.value.get(width, ())] or [(np.arange(len(pick)), np.full(len(pick), -1 - width))]
            row, to = (np.concatenate(x) for x in zip(*placed, strict=True))
            order = np.lexsort((to, row))
            yield pick, vectors, row[order], to[order]

    def count_leaves(batches):
        for batch in batches:
            for _, _, _, to in leaves_of(batch.column("v")):
                found, n = np.unique(to, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n.astype(np.int64))], names=["leaf", "n"])

    large = points.select("v").mapInArrow(count_leaves, "leaf int, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") > largest_part)
    parts_of = spark.sparkContext.broadcast({r["leaf"]: -(-r["n"] // largest_part) for r in large.collect()})  # a row for each ``largest_part`` placed vectors at most

    def place(batches):
        for batch in batches:
            hashes = batch.column("h").to_numpy().view(np.uint64)
            for pick, vectors, row, to in leaves_of(batch.column("v")):
                ends = np.searchsorted(row, np.arange(len(vectors) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(to.astype(np.int32)))
                packed = pa.array([x.tobytes() for x in vectors], pa.binary())
                parts = np.array([parts_of.value.get(x, 1) for x in to.tolist()], np.int64)
                own = (hashes[pick[row]] % parts.astype(np.uint64)).astype(np.int64)
                row, to, own, other = (np.repeat(x, parts) for x in (row, to, own, np.zeros(len(row), np.int64)))
                other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                part = np.maximum(own, other) << 32 | np.minimum(own, other)
                for at in range(0, len(row), 20_000):
                    cut = slice(at, at + 20_000)
                    rows_of, here = pa.array(pick[row[cut]]), pa.array(row[cut])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to[cut].astype(np.int32)), pa.array(part[cut]), pa.array(own[cut]), *(batch.column(c).take(rows_of) for c in ("rep", "h", "n")), packed.take(here), lists.take(here)],
                        names=["leaf", "part", "own", "rep", "h", "n", "v", "leaves"])

    def compare(table: pa.Table) -> pa.Table:
        vectors = np.frombuffer(b"".join(table.column("v").to_pylist())).reshape(table.num_rows, -1)
        n, leaf_id, part, side = table.column("n").to_numpy(), table.column("leaf")[0].as_py(), table.column("part")[0].as_py(), table.column("own").to_numpy()
        lists = table.column("leaves").to_pylist()
        leaves = np.full((len(lists), max(map(len, lists))), _NO_LEAF, np.int32)
        for i, x in enumerate(lists):
            leaves[i, : len(x)] = x
        degree, groups = np.zeros(len(n), np.int64), Forest(len(n))
        for at in range(0, len(n), 512):
            i, j = np.nonzero(vectors[at : at + 512] @ vectors[at:].T >= threshold)
            i, j = i + at, j + at
            live = (i < j) & ((part >> 32 == part & 0xFFFFFFFF) | (side[i] != side[j]))  # pairs inside a part belong to that part's own task
            i, j = i[live], j[live]
            for k in range(0, len(i), 20_000):
                a, b = i[k : k + 20_000], j[k : k + 20_000]
                common = (leaves[a][:, :, None] == leaves[b][:, None, :]) & (leaves[a] != _NO_LEAF)[:, :, None]
                first_shared = np.where(common.any(axis=2), leaves[a], np.iinfo(np.int32).max).min(axis=1)
                own = first_shared == leaf_id
                np.add.at(degree, a[own], n[b[own]])
                np.add.at(degree, b[own], n[a[own]])
                groups.link(a, b)
        reps = table.column("rep")
        roots = groups.roots(np.arange(len(n)))
        return pa.table({"rep": reps, "h": table.column("h"), "links": pa.array(degree), "root": reps.take(pa.array(roots))})

    placed = points.mapInArrow(place, "leaf int, part bigint, own bigint, rep bigint, h bigint, n bigint, v binary, leaves array<int>")
    compared = scratch.save(placed.groupBy("leaf", "part").applyInArrow(compare, "rep bigint, h bigint, links bigint, root bigint").where("links > 0 or not (rep <=> root)"))
    groups = components(compared.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    degrees = compared.groupBy("rep", "h").agg(F.sum("links").alias("links"))
    nodes = points.join(degrees.withColumnsRenamed({"rep": "_rep", "h": "_h"}), F.col("rep").eqNullSafe(F.col("_rep")) & (F.col("h") == F.col("_h")), "left").join(
        groups.withColumnRenamed("node", "rep"), "rep", "left")
    nodes = nodes.select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    judged = rows.withColumn("key", F.when(F.col("ok"), F.col("v"))).join(nodes.withColumnRenamed("v", "key"), "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return judged.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
