"""Graph collections from in-memory edges and from tables of a warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import GraphSet
from ..runtime import cut, meet, numbered, ranged, small, stored


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of undirected edges (src, dst, gid, label, weight)."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "gid", "label", "weight")
    return edges.select("src", "dst", "gid", "label", "weight").unionByName(back.where("src <> dst"))


def bipartite(links: DataFrame, labels: DataFrame, right_label: str, graphs: DataFrame | None = None, n_links: int | None = None) -> GraphSet:
    """Graphs of two kinds of nodes from ``links`` (gid, a, b), which may repeat; vertices go by (gid, side, key). ``labels``: (a, label) of the left side.
    ``n_links``: about how many links, if known.

    The links move twice, by their left and by their right ends. Each time all links of an end become one row, so that its number is the row's
    place and no join looks it up; such a row is as long as a node has neighbours in its graph.
    """
    by = lambda rows, end, near: numbered(ranged(rows, n_links, "gid", end).groupBy("gid", end).agg(near.alias("near")).withColumn("links", F.size("near")).sortWithinPartitions("gid", end), "n")
    left = by(links.where("gid is not null and a is not null and b is not null"), "a", F.collect_set("b"))
    right = by(left.select("gid", F.explode("near").alias("b"), F.col("n").alias("a")), "b", F.collect_list("a"))
    # Of a graph's vertices the left ones follow all right ones of the graphs before, the right ones all left ones up to its own.
    ahead = cut(left.groupBy("gid").agg(F.max("n").alias("lefts"), F.sum("links").alias("links")).join(right.groupBy("gid").agg(F.min("n").alias("rights")), "gid"))
    graphs_in, links_in = ahead.agg(F.count("*"), F.coalesce(F.sum("links"), F.lit(0))).first()
    ahead = small(ahead.drop("links"), graphs_in)
    left, right = left.join(ahead, "gid"), right.join(ahead, "gid")
    of_left, of_right = F.col("n") + F.col("rights"), F.col("n") + F.col("lefts") + 1
    degree = F.col("links").cast("long").alias("degree")
    vertices = stored(left.select(of_left.alias("vid"), "gid", "a", degree).join(labels, "a").select("vid", "gid", F.col("a").cast("string").alias("orig_id"), "label", "degree").unionByName(
        right.select(of_right.alias("vid"), "gid", F.col("b").cast("string").alias("orig_id"), F.lit(right_label).alias("label"), degree)))
    ends = right.select("gid", of_right.alias("dst"), "rights", F.explode("near").alias("at"))
    edges = ends.select((F.col("at") + F.col("rights")).alias("src"), "dst", "gid", F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("weight"))
    return GraphSet(vertices.drop("degree"), symmetric(edges), graphs, 2 * links_in, vertices.select("vid", "degree"))


def _paths(rows: DataFrame) -> GraphSet:
    """Paths through rows (gid, order columns o1, o2, key, label) of each graph; single rows vanish. The rows move once."""
    along = Window.partitionBy("gid").orderBy("o1", "o2")
    placed = rows.where("gid is not null").repartitionByRange("gid").sortWithinPartitions("gid", "o1", "o2")
    placed = placed.select("gid", "key", "label", F.lag(F.lit(True)).over(along).alias("before"), F.lead(F.lit(True)).over(along).alias("ahead"))
    vertices = numbered(placed.where("before or ahead").select("gid", "key", "label", F.coalesce("ahead", F.lit(False)).alias("ahead")), "vid")
    # Numbers are dense within a graph, so the next vertex is the next number.
    edges = vertices.where("ahead").select(F.col("vid").alias("src"), (F.col("vid") + 1).alias("dst"), "gid", F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("weight"))
    return GraphSet(vertices.select("vid", "gid", F.col("key").cast("string").alias("orig_id"), "label"), symmetric(edges), n_edges=2 * vertices.count())


def event_paths(spark: SparkSession, sf_dir: str) -> GraphSet:
    """EP: a graph for each user, consecutive events linked; label: the event's type; graph label: more purchases than errors."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    own = _paths(events.select(F.col("user_id").alias("gid"), F.col("ts").alias("o1"), F.col("event_id").alias("o2"), F.col("event_id").alias("key"), F.col("event_type").alias("label")))
    sign = F.sum(F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0))
    graphs = events.groupBy(F.col("user_id").alias("gid")).agg((sign > 0).cast("int").cast("string").alias("graph_label"))
    return GraphSet(own.vertices, own.edges, graphs, own.n_edges)


def conversation_paths(spark: SparkSession, sf_dir: str) -> GraphSet:
    """CP: a graph for each conversation, consecutive turns linked; label: the role; graph label: parity of the number of turns."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    own = _paths(turns.select(F.col("conv_id").alias("gid"), F.col("turn").alias("o1"), F.col("role").alias("o2"), F.col("turn").alias("key"), F.col("role").alias("label")))
    return GraphSet(own.vertices, own.edges, turns.groupBy(F.col("conv_id").alias("gid")).agg((F.count("*") % 2).cast("string").alias("graph_label")), own.n_edges)


def order_stars(spark: SparkSession, sf_dir: str) -> GraphSet:
    """OS: a star for each order over its distinct parts; labels: brands and return flags; graph label: the priority. The lines move by part
    and then by order; a leaf's place among its order's leaves tells how far before it the centre has its number."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").where("l_orderkey is not null").join(read("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    leaves = lines.groupBy(F.col("l_orderkey").alias("gid"), F.col("l_partkey").alias("key"), F.col("p_brand").alias("label")).agg(F.max("l_returnflag").alias("flag"))
    placed = leaves.repartitionByRange("gid").sortWithinPartitions("gid", "key")
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("gid").orderBy("key")))
    leaf = F.struct("key", "label", "flag", "place")
    centre = F.struct(F.col("gid").alias("key"), F.lit("order").alias("label"), F.lit(None).cast("string").alias("flag"), F.lit(0).alias("place"))
    rows = numbered(placed.select("gid", F.explode(F.when(F.col("place") == 1, F.array(centre, leaf)).otherwise(F.array(leaf))).alias("x")).select("gid", "x.*"), "vid")
    edges = rows.where("place > 0").select((F.col("vid") - F.col("place")).alias("src"), F.col("vid").alias("dst"), "gid", F.col("flag").alias("label"), F.lit(1.0).alias("weight"))
    return GraphSet(rows.select("vid", "gid", F.col("key").cast("string").alias("orig_id"), "label"), symmetric(edges), read("orders").select(F.col("o_orderkey").alias("gid"), F.col("o_orderpriority").alias("graph_label")), 2 * rows.count())


def customer_suppliers(spark: SparkSession, sf_dir: str) -> GraphSet:
    """CS: a bipartite graph for each customer nation; labels: market segments, one for all suppliers; graph label: the region."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    customers = read("customer").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").cast("long").alias("gid"), F.col("c_mktsegment").alias("label"))
    orders, lines = read("orders").select("o_orderkey", F.col("o_custkey").alias("a")), read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("b"))
    n_orders, n_lines = orders.count(), lines.count()  # read from the files' footers
    ordered = meet(orders, n_orders, customers.drop("label"), "a")
    links = meet(lines, n_lines, ordered, "o_orderkey").select("gid", "a", "b")
    graphs = read("nation").select(F.col("n_nationkey").cast("long").alias("gid"), F.col("n_regionkey").cast("string").alias("graph_label"))
    return bipartite(links, customers.select("a", "label"), "supplier", graphs, n_lines)


def _path_labels(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    ends = rows.where("gid is not null").groupBy("gid").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("n > 1")
    return ends.select(F.explode(F.array("low", "high")).alias("label")), ends.limit(0).select(F.lit(None).cast("string").alias("label"))


def _star_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").where("l_orderkey is not null").join(read("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.explode(F.array("p_brand", F.lit("order"))).alias("label")), lines.groupBy("l_orderkey", "l_partkey").agg(F.max("l_returnflag").alias("label")).select("label")


def _supplied_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    ordered = read("orders").join(read("lineitem").where("l_suppkey is not null"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    customers = read("customer").where("c_nationkey is not null").join(ordered.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return customers.select(F.explode(F.array("c_mktsegment", F.lit("supplier"))).alias("label")), customers.limit(0).select(F.lit(None).cast("string").alias("label"))


#: What labels the vertices and the edges of each collection have, without the collection: enough of their rows (for paths a graph's smallest and
#: largest label) to tell whether there are two different ones.
LABELS = {
    "ep": lambda s, d: _path_labels(s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("gid"), F.col("event_type").alias("label"))),
    "cp": lambda s, d: _path_labels(s.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("gid"), F.col("role").alias("label"))),
    "os": _star_labels,
    "cs": _supplied_labels,
}


def from_edges(spark: SparkSession, edges: list[tuple], node_labels: dict | None = None, gid: int = 0) -> GraphSet:
    """One graph from edges (a, b) or (a, b, label). Vertices are numbered as they appear first; reverse and repeated edges are
    one, and the last label given wins."""
    order, links = {}, {}
    for a, b, *label in edges:
        for x in (a, b):
            order.setdefault(x, len(order))
        links[tuple(sorted((order[a], order[b])))] = str(label[0]) if label else None
    vertices = spark.createDataFrame([(i, gid, str(x), None if node_labels is None else str(node_labels[x])) for x, i in order.items()], "vid long, gid long, orig_id string, label string")
    rows = spark.createDataFrame([(a, b, gid, x, 1.0) for (a, b), x in links.items()], "src long, dst long, gid long, label string, weight double")
    return GraphSet(vertices, symmetric(rows), spark.createDataFrame([(gid, None)], "gid long, graph_label string"))


def disjoint_union(*sets: GraphSet) -> GraphSet:
    """All graphs of several collections as one; graphs and vertices are numbered on in order."""
    out = None
    for s in sets:
        if out is None:
            out = s
            continue
        vid, gid = out.vertices.agg(F.max("vid"), F.max("gid")).first()
        shift, last = (0 if x is None else x + 1 for x in (vid, gid))
        base = s.vertices.agg(F.min("gid")).first()[0] or 0
        move = F.col("gid") - base + last
        vertices = out.vertices.unionByName(s.vertices.withColumns({"vid": F.col("vid") + shift, "gid": move}))
        edges = out.edges.unionByName(s.edges.withColumns({"src": F.col("src") + shift, "dst": F.col("dst") + shift, "gid": move}))
        graphs = out.graphs.unionByName(s.graphs.withColumn("gid", move)) if out.graphs is not None and s.graphs is not None else None
        out = GraphSet(vertices, edges, graphs)
    return out
