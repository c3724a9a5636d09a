"""Statistics of graph collections and of levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ColoredGraph, GraphSet


def analyze(graph: GraphSet) -> DataFrame:
    """One row: graphs, nodes, edges (each once), their averages (0 without graphs), and distinct graph, node and edge labels."""
    nodes = graph.vertices.agg(F.count_distinct("gid").alias("graphs"), F.count("*").alias("nodes"), F.count_distinct("label").alias("node_labels"))
    edges = graph.edges.where("src <= dst").agg(F.count("*").alias("edges"), F.count_distinct("label").alias("edge_labels"))
    out = nodes.crossJoin(edges)  # one row each
    if graph.graphs is None:
        out = out.withColumn("graph_labels", F.lit(0).cast("long"))
    else:
        live = graph.graphs.join(graph.vertices.select("gid").distinct(), "gid", "left_semi")
        out = out.crossJoin(live.agg(F.count_distinct("graph_label").alias("graph_labels")))
    mean = lambda c: F.when(F.col("graphs") > 0, F.col(c) / F.col("graphs")).otherwise(F.lit(0.0))
    return out.select("graphs", "nodes", "edges", mean("nodes").alias("mean_nodes"), mean("edges").alias("mean_edges"), "graph_labels", "node_labels", "edge_labels")


def degree_histogram(graph: GraphSet) -> DataFrame:
    """(degree, n): how many vertices have each degree, isolated ones included. Edges are not looked at where the collection knows its degrees."""
    if graph.degrees is not None:
        return graph.degrees.groupBy("degree").agg(F.count("*").alias("n"))
    degrees = graph.edges.groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("degree"))
    return graph.vertices.select("vid").join(degrees, "vid", "left").groupBy(F.coalesce("degree", F.lit(0)).cast("long").alias("degree")).agg(F.count("*").alias("n"))


def class_sizes(colored: ColoredGraph, level: int = -1) -> DataFrame:
    """(color, n) at a level."""
    return colored.level(level).colors().groupBy("color").agg(F.count("*").alias("n"))
