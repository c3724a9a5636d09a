"""Initial colours and the Weisfeiler-Leman refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ColoredGraph, GraphSet
from ..runtime import cut, small


def initial_coloring(graph: GraphSet) -> ColoredGraph:
    """Colours 1, 2, ... by the first vertex with each label if there are two labels or more (0 is kept for a root); else all 0.

    Some vertices without a label while others have different ones is an error: such vertices would have no colour.
    """
    seen = graph.vertices.agg(F.count_distinct("label").alias("labels"), F.count("*").alias("n"), F.count("label").alias("labelled")).first()
    out = ColoredGraph(graph)
    if seen["labels"] > 1:
        if seen["labelled"] < seen["n"]:
            raise ValueError("some vertices have no label")
        first = graph.vertices.groupBy("label").agg(F.min("vid").alias("cls"))
        out.push(cut(graph.vertices.join(small(first, seen["labels"]), "label").select("vid", "gid", "cls")), seen["labels"], 1)
    else:
        out.push(cut(graph.vertices.select("vid", "gid", F.lit(0).cast("long").alias("cls"))), 1, 0)
    return out


def neighbour_counts(graph: GraphSet, colors: DataFrame, labelled: bool) -> DataFrame:
    """(src, key, n): how many neighbours each vertex has of each colour, or (colour, edge label). Counted before it is gathered, so
    that a vertex with very many neighbours is a list of at most as many entries as there are colours."""
    key = F.struct("color", "label") if labelled else F.struct("color")
    near = graph.neighbours(colors.select(F.col("vid").alias("dst"), "color"), "src", "label")
    return near.groupBy("src", key.alias("key")).agg(F.count("*").alias("n"))


class WeisfeilerLeman:
    """Refine by (own colour, multiset of neighbours' colours) until the number of colours stops changing.

    Edge labels count if there are two or more. ``signature="concat"`` writes signatures as one text without delimiters, as
    the original formulation does; texts of different multisets can then be equal, so the default keeps their structure.
    """

    def __init__(self, colored: ColoredGraph, refinement_steps: float = 1, signature: str = "exact"):
        if signature not in ("exact", "concat"):
            raise ValueError(f"unknown signature {signature!r}")
        self.colored, self.refinement_steps, self.signature = colored, refinement_steps, signature
        self.current_step, self.is_stable = 0, False
        self.previous_num_colors = colored.num_colors()
        self.use_edge_labels = colored.graph.has_distinct_edge_labels()

    def refine_one_step(self) -> tuple[int, int]:
        """(colours, step). When their number stays, the colouring is stable and no level is added, though ids were used up."""
        if self.is_stable:
            return self.previous_num_colors, self.current_step
        level = self.colored.levels[-1]
        own = level.frame.withColumnRenamed("cls", "color") if self.signature == "exact" else level.colors()
        # A digest of 128 bits stands for a signature, so neighbours are shuffled no further.
        signed = cut(self._signed(own))
        first = cut(signed.groupBy("key").agg(F.min("vid").alias("cls")))
        count = first.count()
        refined = cut(signed.join(small(first, count), "key").select("vid", "gid", "cls"))
        if count == self.previous_num_colors:
            self.is_stable = True
            self.colored.next_color_id += count
            return count, self.current_step
        self.colored.push(refined, count)
        self.current_step += 1
        self.previous_num_colors = count
        return count, self.current_step

    def _signed(self, own: DataFrame) -> DataFrame:
        """(vid, gid, key): of each vertex of ``own`` (vid, gid, color), a digest of its signature.

        An exact signature is the own colour with the sums, over all neighbours, of four 32-bit parts of two hashes of (colour, edge label):
        different multisets agree in 128 bits with a chance of 2^-128. Sums are added up before and after one shuffle by vertex,
        whatever a vertex has of neighbours and colours.
        """
        digest = lambda *text: F.unhex(F.substring(F.sha2(F.concat(*text), 256), 1, 32)).alias("key")
        if self.signature == "concat":
            signed = own.join(self._texts(own), "vid", "left")
            return signed.select("vid", "gid", digest(F.col("color").cast("string"), F.coalesce("sig", F.lit(""))))
        label = ["label"] if self.use_edge_labels else []
        near = self.colored.graph.neighbours(own.select(F.col("vid").alias("dst"), "color"), "src", *label).withColumnRenamed("src", "vid")
        # xxhash64 passes over nulls, so whether there is a label is hashed with it.
        hashes = [F.xxhash64(F.lit(k), "color", *([F.col("label").isNull(), "label"] if label else [])) for k in (1, 2)]
        parts = [part for h in hashes for part in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
        rows = near.select("vid", *(F.lit(None).cast("long").alias(c) for c in ("gid", "color")), *(p.alias(f"s{k}") for k, p in enumerate(parts))).unionByName(
            own.select("vid", "gid", "color", *(F.lit(0).cast("long").alias(f"s{k}") for k in range(4))))
        sums = rows.groupBy("vid").agg(F.max("gid").alias("gid"), F.max("color").alias("color"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(4)))
        return sums.select("vid", "gid", digest(F.concat_ws(":", "color", *(f"s{k}" for k in range(4)))))

    def _texts(self, own: DataFrame) -> DataFrame:
        near = self.colored.graph.neighbours(own.select(F.col("vid").alias("dst"), "color"), "src", "label").withColumnRenamed("src", "vid")
        text = F.concat(F.col("color").cast("string"), F.coalesce("label", F.lit(""))) if self.use_edge_labels else F.col("color").cast("string")
        return near.groupBy("vid").agg(F.array_join(F.array_sort(F.collect_list(text)), "").alias("sig"))

    def refine(self) -> ColoredGraph:
        while self.current_step < self.refinement_steps and not self.is_stable:
            self.refine_one_step()
        return self.colored

    def refine_until_stable(self) -> ColoredGraph:
        while not self.is_stable:
            self.refine_one_step()
        return self.colored
