"""The data model: a collection of labelled undirected graphs as three tables, colourings as one row for each vertex and level."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAPHS = "gid long, graph_label string"
VERTICES = "vid long, gid long, orig_id string, label string"
EDGES = "src long, dst long, gid long, label string, weight double"
COLORS = "step int, vid long, gid long, color long"
STEPS = "algo string, step int, feature_dim long, n_colors long, n_features long, max_q_error double, witness_pair_count long, seconds double"
CV = "phase string, trial int, fold int, C double, param int, accuracy double"


@dataclass(frozen=True)
class GraphSet:
    """``vertices`` in node order (``vid`` dense from 0), ``edges`` in both directions, ``graphs`` with their labels. ``n_edges``: about how many edges, if known.
    ``degrees``: (vid, degree) of all vertices, where the rows that edges come from tell them."""

    vertices: DataFrame
    edges: DataFrame
    graphs: DataFrame | None = None
    n_edges: int | None = None
    degrees: DataFrame | None = None

    def without_node_labels(self) -> GraphSet:
        return replace(self, vertices=self.vertices.withColumn("label", F.lit(None).cast("string")))

    def neighbours(self, of: DataFrame, *columns: str) -> DataFrame:
        """``columns`` of each edge with those of its end in ``of`` (dst, ...). Edges of a hub lie together, others in tasks of bounded size."""
        from .runtime import meet

        return meet(self.edges.select("dst", *columns), self.n_edges, of, "dst")

    def has_distinct_node_labels(self) -> bool:
        return self.vertices.agg(F.count_distinct("label") > 1).first()[0]

    def has_distinct_edge_labels(self) -> bool:
        return self.edges.agg(F.count_distinct("label") > 1).first()[0]

    def has_edge_labels(self) -> bool:
        return self.edges.where("label is not null").limit(1).count() > 0


@dataclass(frozen=True)
class Level:
    """One level of a colouring: (vid, gid, cls), where ``cls`` sorts classes in colour order, and how many there are."""

    frame: DataFrame
    n_colors: int
    start: int

    def colors(self) -> DataFrame:
        """(vid, gid, color): colours are numbered from ``start`` in the order of ``cls``."""
        from .runtime import ranked, small

        if self.n_colors == 1:
            return self.frame.select("vid", "gid", F.lit(self.start).cast("long").alias("color"))
        numbers = ranked(self.frame.select("cls").distinct(), ["cls"], "color", self.start, self.n_colors)
        return self.frame.join(small(numbers, self.n_colors), "cls").select("vid", "gid", "color")


@dataclass
class ColoredGraph:
    """A graph collection with its colour stack. Levels are immutable tables, so a copy shares them."""

    graph: GraphSet
    levels: list[Level] = field(default_factory=list)
    next_color_id: int = 0

    @staticmethod
    def from_stacks(graph: GraphSet, stacks: DataFrame) -> ColoredGraph:
        """The colouring that stacks (vid, gid, stack) of one height tell. The colours of each level must be consecutive numbers."""
        entries = stacks.select("vid", "gid", F.posexplode("stack").alias("step", "cls"))
        out = ColoredGraph(graph)
        for r in entries.groupBy("step").agg(F.count_distinct("cls").alias("n"), F.min("cls").alias("low"), F.max("cls").alias("high")).orderBy("step").collect():
            if r["high"] - r["low"] + 1 != r["n"]:
                raise ValueError(f"colours of level {r['step']} are not consecutive")
            out.push(entries.where(F.col("step") == r["step"]).select("vid", "gid", "cls"), r["n"], r["low"])
        return out

    @property
    def height(self) -> int:
        return len(self.levels)

    def push(self, frame: DataFrame, n_colors: int, start: int | None = None) -> None:
        start = self.next_color_id if start is None else start
        self.levels.append(Level(frame, n_colors, start))
        self.next_color_id = max(self.next_color_id, start + n_colors)

    def level(self, at: int = -1) -> Level:
        if not (at == -1 or 0 <= at < self.height):
            raise ValueError(f"level {at} of a colouring of {self.height} levels")
        return self.levels[at]

    def num_colors(self, at: int = -1) -> int:
        return self.level(at).n_colors

    def colors(self, upto: int | None = None) -> DataFrame:
        """(step, vid, gid, color) of all levels, or of those up to one."""
        every = None
        for step, level in enumerate(self.levels if upto is None else self.levels[: upto + 1]):
            own = level.colors().select(F.lit(step).alias("step"), "vid", "gid", "color")
            every = own if every is None else every.unionByName(own)
        return every

    def stacks(self) -> DataFrame:
        """(vid, gid, stack): a vertex's colours from level 0 up; a stack is as long as the colouring is high."""
        ordered = F.array_sort(F.collect_list(F.struct("step", "color")))
        return self.colors().groupBy("vid", "gid").agg(F.transform(ordered, lambda x: x["color"]).alias("stack"))

    def palette(self, at: int = -1) -> DataFrame:
        """Distinct colours up to a level, ascending."""
        at = self.height - 1 if at == -1 else at
        self.level(at)
        return self.colors(at).select("color").distinct().orderBy("color")

    def heights(self) -> DataFrame:
        """(height, n): how many vertices have a stack of each height."""
        return self.colors().groupBy("vid").agg(F.count("*").alias("height")).groupBy("height").agg(F.count("*").alias("n"))

    def assert_consistent_height(self) -> None:
        wrong = self.heights().where(F.col("height") != self.height)
        if wrong.limit(1).count() or self.levels[0].frame.count() != self.graph.vertices.count():
            raise AssertionError("colour stacks differ in height")

    def copy(self) -> ColoredGraph:
        return ColoredGraph(self.graph, list(self.levels), self.next_color_id)
