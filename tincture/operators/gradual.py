"""Gradual Weisfeiler-Leman: inside each colour, k-means over the neighbours' colour histograms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ColoredGraph, GraphSet
from ..runtime import cut, ranked, ship, small, stored
from .coloring import neighbour_counts
from .kmeans import METHODS, cluster, cluster_tables

#: Colours with more distinct histograms than this are clustered by joins and aggregations instead of in one task; results are the same.
SPREAD_OVER = 20_000


def histograms(graph: GraphSet, own: DataFrame, use_edge_labels: bool) -> DataFrame:
    """(vid, gid, color, hist) of (vid, gid, color): sorted (key, n) lists, empty for vertices without neighbours."""
    counts = neighbour_counts(graph, own, use_edge_labels)
    lists = counts.groupBy(F.col("src").alias("vid")).agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("hist"))
    kind = "struct<color:bigint,label:string>" if use_edge_labels else "struct<color:bigint>"
    return own.join(lists, "vid", "left").withColumn("hist", F.coalesce("hist", F.array().cast(f"array<struct<key:{kind},n:bigint>>")))


def split_colors(graph: GraphSet, own: DataFrame, use_edge_labels: bool, options: dict, spread_over: int) -> DataFrame:
    """(vid, gid, color, cluster): the vertices of each colour clustered by their neighbours' histograms. ``options`` are those of ``cluster``."""

    def split(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = [{(x["key"]["color"], x["key"].asDict().get("label") if hasattr(x["key"], "asDict") else x["key"].get("label")): x["n"] for x in h} for h in group["hist"]]
        keys = sorted({k for r in rows for k in r}, key=lambda k: (k[0], k[1] or ""))
        points = np.array([[r.get(k, 0) for k in keys] for r in rows], dtype=np.int64).reshape(len(rows), len(keys))
        order = np.lexsort(points.T[::-1]) if len(keys) else np.arange(len(rows))
        members = np.empty(len(rows), dtype=np.int64)
        members[order] = cluster(points[order], group["weight"].to_numpy()[order], ids=group["hid"].to_numpy()[order], **options)
        return pd.DataFrame({"color": group["color"], "hid": group["hid"], "cluster": members})

    vertices = stored(histograms(graph, own, use_edge_labels))
    kinds = cut(vertices.groupBy("color", "hist").agg(F.count("*").alias("weight"), F.min("vid").alias("hid")))
    large = cut(kinds.groupBy("color").count().where(F.col("count") > spread_over).select("color"))
    found = kinds.select("color", "hid", "weight", "hist").join(large, "color", "left_anti").groupBy("color").applyInPandas(split, "color long, hid long, cluster long")
    if large.limit(1).count():
        found = found.unionByName(cluster_tables(kinds.join(large, "color", "left_semi"), **options))
    # Colours of few histograms are named where their vertices lie; only vertices of the others move.
    named = cut(kinds.select("color", "hist", "hid").join(found, ["color", "hid"]).select("color", "hist", "cluster"))
    parts = []
    for how in ("left_anti", "left_semi"):
        names = named.join(F.broadcast(large), "color", how)
        parts.append(vertices.join(F.broadcast(large), "color", how).join(small(names, names.count()), ["color", "hist"]).select("vid", "gid", "color", "cluster"))
    return stored(parts[0].unionByName(parts[1]))


class GradualRefinement:
    """``refine`` makes ``refinement_steps`` levels; there is no stop on stability.

    Histograms are keyed by colour, or by (colour, edge label) if any edge has a label. What goes to Python is one row for each
    distinct histogram of a colour, with how many vertices have it, so a colour that holds a third of all vertices is as large as
    its number of different neighbourhoods; with over ``spread_over`` of them it is spread over tasks. ``first_seen_ids`` numbers new colours by first vertex instead of by (old colour,
    cluster), and continues after the largest colour in use.
    """

    def __init__(
        self,
        colored: ColoredGraph,
        refinement_steps: int,
        n_cluster: int,
        cluster_initialization_method: str = "kmeans++",
        num_forgy_iterations: int = 15,
        seed: int = 4321,
        truncate_centers: bool = True,
        first_seen_ids: bool = False,
        spread_over: int = SPREAD_OVER,
    ):
        if cluster_initialization_method not in METHODS:
            raise ValueError(f"unknown initialisation {cluster_initialization_method!r}")
        self.colored, self.refinement_steps = colored, refinement_steps
        self.options = {"k": n_cluster, "method": cluster_initialization_method, "restarts": num_forgy_iterations, "seed": seed, "truncate_centers": truncate_centers}
        self.first_seen_ids, self.spread_over = first_seen_ids, spread_over
        self.use_edge_labels = colored.graph.has_edge_labels()
        ship(colored.graph.vertices.sparkSession)

    def refine_one_step(self) -> int:
        own = self.colored.levels[-1].colors()
        classes = split_colors(self.colored.graph, own, self.use_edge_labels, self.options, self.spread_over)
        order = ["first"] if self.first_seen_ids else ["color", "cluster"]
        distinct = classes.groupBy("color", "cluster").agg(F.min("vid").alias("first"))
        count = distinct.count()
        numbered = ranked(distinct, order, "cls", 0, count)
        refined = cut(classes.join(small(numbered.drop("first"), count), ["color", "cluster"]).select("vid", "gid", "cls"))
        self.colored.push(refined, count)
        return count

    def refine(self) -> ColoredGraph:
        for _ in range(self.refinement_steps):
            self.refine_one_step()
        return self.colored


class StackRefinement:
    """Gradual refinement of a table of colour stacks (vid, gid, stack), without levels or a tree: ``refine`` appends one colour to each
    stack for each step. Clusters start by ``kmeans++`` only.

    A vertex belongs to the group of its stack's last colour. Groups go by their first vertex, inside them by cluster, and new colours
    follow the largest last colour in use. A vertex without a stack (no row, null or empty) is an error, and so are stacks that differ in height.
    """

    def __init__(self, graph: GraphSet, stacks: DataFrame, refinement_steps: int, n_cluster: int, seed: int = 4321, truncate_centers: bool = True, spread_over: int = SPREAD_OVER):
        self.graph, self.refinement_steps, self.spread_over = graph, refinement_steps, spread_over
        self.options = {"k": n_cluster, "method": "kmeans++", "seed": seed, "truncate_centers": truncate_centers}
        self.stacks = cut(graph.vertices.select("vid", "gid").join(stacks.select("vid", "stack"), "vid", "left"))
        seen = self.stacks.agg(F.min(F.coalesce(F.size("stack"), F.lit(0))).alias("low"), F.max(F.size("stack")).alias("high")).first()
        if seen["low"] is not None and seen["low"] <= 0:
            raise ValueError("some vertices have no colour stack")
        if seen["low"] != seen["high"]:
            raise ValueError("colour stacks differ in height")
        self.use_edge_labels = graph.has_edge_labels()
        ship(graph.vertices.sparkSession)

    def refine_one_step(self) -> int:
        own = self.stacks.select("vid", "gid", F.element_at("stack", -1).alias("color"))
        classes = split_colors(self.graph, own, self.use_edge_labels, self.options, self.spread_over)
        heads = own.groupBy("color").agg(F.min("vid").alias("head"))
        groups = cut(classes.select("color", "cluster").distinct().join(heads, "color"))
        seen = groups.agg(F.count("*").alias("n"), F.max("color").alias("top")).first()
        if not seen["n"]:
            return 0
        numbered = ranked(groups, ["head", "cluster"], "new", seen["top"] + 1, seen["n"])
        fresh = classes.join(small(numbered, seen["n"]), ["color", "cluster"]).select("vid", "new")
        self.stacks = cut(self.stacks.join(fresh, "vid").select("vid", "gid", F.array_append("stack", F.col("new")).alias("stack")))
        return seen["n"]

    def refine(self) -> DataFrame:
        for _ in range(self.refinement_steps):
            self.refine_one_step()
        return self.stacks
