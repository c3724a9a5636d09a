"""The colour hierarchy of a colouring, and colours to draw it with."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ColoredGraph
from ..runtime import cut, ranked

#: The palette by position; two codes occur twice.
PALETTE = (
    "#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf",
    "#aec7e8", "#ffbb78", "#98df8a", "#ff9896", "#c5b0d5", "#c49c94", "#f7b6d2", "#c7c7c7", "#dbdb8d", "#9edae5",
    "#1b9e77", "#d95f02", "#7570b3", "#e7298a", "#66a61e", "#e6ab02", "#a6761d", "#666666", "#17becf", "#bcbd22",
    "#f781bf", "#999999", "#386cb0", "#f0027f", "#fdc086", "#beaed4", "#7fc97f", "#ffff99", "#fdcdac", "#b3cde3",
)
#: Colours of the tree's nodes by position (four public colour maps of 12, 8, 20 and 8 entries), and the one for larger trees.
TREE_PALETTE = (
    "#a6cee3", "#1f78b4", "#b2df8a", "#33a02c", "#fb9a99", "#e31a1c", "#fdbf6f", "#ff7f00", "#cab2d6", "#6a3d9a", "#ffff99", "#b15928",
    "#1b9e77", "#d95f02", "#7570b3", "#e7298a", "#66a61e", "#e6ab02", "#a6761d", "#666666",
    "#1f77b4", "#aec7e8", "#ff7f0e", "#ffbb78", "#2ca02c", "#98df8a", "#d62728", "#ff9896", "#9467bd", "#c5b0d5",
    "#8c564b", "#c49c94", "#e377c2", "#f7b6d2", "#7f7f7f", "#c7c7c7", "#bcbd22", "#dbdb8d", "#17becf", "#9edae5",
    "#7fc97f", "#beaed4", "#fdc086", "#ffff99", "#386cb0", "#f0027f", "#bf5b17", "#666666",
)
UNIFORM = "#87ceeb"
#: Fixed value: what vertices get whose colour is beyond the palette.
NO_COLOR = "#cccccc"


def tree_edges(colored: ColoredGraph) -> DataFrame:
    """(level, parent, child): each colour under the one that its vertices had a level before. If level 0 has not exactly one
    colour, an artificial root 0 stands above it at level 0."""
    first = colored.levels[0]
    step = Window.partitionBy("vid").orderBy("step")
    pairs = colored.colors().withColumn("parent", F.lag("color").over(step)).where("parent is not null").select(F.col("step").alias("level"), "parent", F.col("color").alias("child")).distinct()
    if first.n_colors == 1:
        return pairs.select(F.col("level").cast("int").alias("level"), "parent", "child")
    top = first.colors().select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("parent"), F.col("color").alias("child")).distinct()
    return top.unionByName(pairs).select(F.col("level").cast("int").alias("level"), "parent", "child")


def tree_nodes(colored: ColoredGraph) -> DataFrame:
    """(level, color, vertices): every node of the tree with the number of its vertices; the artificial root has all of them."""
    own = colored.colors().groupBy(F.col("step").alias("level"), "color").agg(F.count("*").alias("vertices"))
    deeper = 0 if colored.levels[0].n_colors == 1 else 1
    out = own.select((F.col("level") + deeper).cast("int").alias("level"), "color", "vertices")
    if deeper:
        out = out.unionByName(colored.levels[0].frame.agg(F.lit(0).alias("level"), F.lit(0).cast("long").alias("color"), F.count("*").alias("vertices")))
    return out


def leaves(colored: ColoredGraph) -> DataFrame:
    return colored.level().colors().select("color").distinct()


def last_color(colored: ColoredGraph) -> int:
    """The largest colour among the leaves."""
    return leaves(colored).agg(F.max("color")).first()[0]


def levels(colored: ColoredGraph) -> DataFrame:
    """(level, colors): the colours of each level of the tree, ascending."""
    return tree_nodes(colored).groupBy("level").agg(F.array_sort(F.collect_list("color")).alias("colors"))


def preorder(colored: ColoredGraph) -> DataFrame:
    """(path, level, parent, child) of tree edges; ``path`` sorts them as a walk from the root does, children ascending."""
    pad = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    first = colored.levels[0].n_colors != 1
    rows = colored.colors().select("vid", "step", "color")
    upto = Window.partitionBy("vid").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = rows.withColumn("path", F.array_join(F.collect_list(pad("color")).over(upto), "/")).withColumn("parent", F.lag("color").over(Window.partitionBy("vid").orderBy("step")))
    if first:
        walked = walked.withColumn("parent", F.coalesce("parent", F.lit(0).cast("long")))
    return walked.where("parent is not null").select("path", F.col("step").alias("level"), "parent", F.col("color").alias("child")).distinct()


def lines(colored: ColoredGraph) -> DataFrame:
    """(path, line): the tree as indented lines, to be ordered by ``path``."""
    return preorder(colored).select("path", F.concat(F.repeat(F.lit("  "), F.col("level")), F.col("child").cast("string")).alias("line"))


def printed(colored: ColoredGraph) -> Iterator[str]:
    """The lines in order, one partition of them on the driver at a time."""
    for r in lines(colored).orderBy("path").toLocalIterator():
        yield r["line"]


def tree_colors(colored: ColoredGraph) -> DataFrame:
    """(color, hex) of the tree's nodes when drawn: by the node's own number if there are at most as many nodes as colours, else one
    colour for all; an artificial root is white."""
    nodes = tree_nodes(colored).select("color").distinct()
    own = F.try_element_at(F.array(*[F.lit(c) for c in TREE_PALETTE]), F.when(F.col("color") < len(TREE_PALETTE), F.col("color") + 1).cast("int"))
    hexes = F.lit(UNIFORM) if nodes.count() > len(TREE_PALETTE) else F.coalesce(own, F.lit(UNIFORM))
    if colored.levels[0].n_colors != 1:
        hexes = F.when(F.col("color") == 0, F.lit("#ffffff")).otherwise(hexes)
    return nodes.select("color", hexes.alias("hex"))


def layout(colored: ColoredGraph) -> DataFrame:
    """(level, color, x, y): nodes of a level evenly from -level to level, one level below the other. Places in a level are places among all
    nodes less the level's first one, so a wide level is numbered by range partitions and is no single task."""
    nodes = cut(tree_nodes(colored).select("level", "color"))
    placed = ranked(nodes, ["level", "color"], "place", 0, nodes.count())
    sizes = placed.groupBy("level").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    x = F.when(F.col("n") == 1, -F.col("level")).otherwise(-F.col("level") + 2 * F.col("level") * (F.col("place") - F.col("first")) / (F.col("n") - 1))
    return placed.join(sizes, "level").select("level", "color", x.cast("double").alias("x"), (-F.col("level")).cast("double").alias("y"))


def _palette_at(position: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(c) for c in PALETTE]), position.cast("int") + 1)


def palette_by_frequency(counts: DataFrame) -> DataFrame:
    """(color, hex) from (color, n): the most frequent colour gets the palette's first entry, of equal counts the smaller colour
    goes first; null beyond the palette."""
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "color")) - 1
    top = counts.orderBy(F.desc("n"), "color").limit(len(PALETTE)).withColumn("hex", _palette_at(rank)).select("color", "hex")
    return counts.select("color").join(top, "color", "left")


def palette_consecutively(colors: DataFrame) -> DataFrame:
    """(color, hex): the palette's entry at the colour's own number; null beyond the palette."""
    return colors.select("color", F.when(F.col("color") < len(PALETTE), _palette_at(F.col("color"))).alias("hex"))


def drawing(colored: ColoredGraph, level: int = -1, show_color_id: bool = True, show_node_id: bool = True, true_coloring: bool = False) -> DataFrame:
    """(vid, color, hex, text) of a level; ``true_coloring`` takes palette entries by colour number instead of by frequency."""
    own = colored.level(level).colors()
    if true_coloring:
        chosen = palette_consecutively(own.select("color").distinct())
    else:
        chosen = palette_by_frequency(own.groupBy("color").agg(F.count("*").alias("n")))
    parts = [F.col("vid").cast("string")] * show_node_id + [F.concat(F.lit("["), F.col("color").cast("string"), F.lit("]"))] * show_color_id
    return own.join(chosen, "color").select("vid", "color", F.coalesce("hex", F.lit(NO_COLOR)).alias("hex"), F.concat_ws(" ", *parts).alias("text"))
