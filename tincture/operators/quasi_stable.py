"""Quasi-stable colouring: split the blocks with the widest spread of degrees at their mean degree."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ColoredGraph, GraphSet
from ..runtime import cut, ranked, small, spread


def block_degrees(graph: GraphSet, blocks: DataFrame) -> DataFrame:
    """(vid, bj, d): each vertex's total edge weight into each block; pairs without an edge are absent."""
    into = blocks.select(F.col("vid").alias("dst"), F.col("block").alias("bj"))
    # Dealt by vertex, so that the degrees lie where their vertices' blocks come to; in bounded tasks sums before the shuffle would save little.
    near = graph.neighbours(into, "src", "weight").select(F.col("src").alias("vid"), "bj", "weight")
    return spread(near, graph.n_edges, "vid").groupBy("vid", "bj").agg(F.sum("weight").alias("d"))


def block_statistics(degrees: DataFrame, blocks: DataFrame, size_weighted: bool = False) -> DataFrame:
    """(bi, bj, n, s, upper, lower, error): spread of the degrees of block bi's vertices into block bj.

    Vertices without an edge into bj count as degree 0; pairs of blocks without any edge have error 0 and are absent.
    """
    sizes = blocks.groupBy(F.col("block").alias("bi")).agg(F.count("*").alias("n"))
    stats = degrees.join(blocks.select("vid", F.col("block").alias("bi")), "vid").groupBy("bi", "bj").agg(
        F.max("d").alias("hi"), F.min("d").alias("lo"), F.count("*").alias("c"), F.sum("d").alias("s"))
    short = F.col("c") < F.col("n")
    upper = F.when(short, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi"))
    lower = F.when(short, F.least("lo", F.lit(0.0))).otherwise(F.col("lo"))
    spread = (upper - lower) * (F.col("n") if size_weighted else F.lit(1.0))
    return stats.join(sizes, "bi").select("bi", "bj", "n", "s", upper.alias("upper"), lower.alias("lower"), spread.alias("error"))


def split_blocks(blocks: DataFrame, degrees: DataFrame, witnesses: DataFrame) -> DataFrame:
    """(vid, gid, block, sig): for each vertex of a witness block one bit for each of the block's witnesses, whether its degree is
    over the block's mean (compared as d * n > s, exact for whole weights); an empty signature elsewhere."""
    tests = blocks.join(witnesses.select(F.col("bi").alias("block"), "bj", "n", "s"), "block").join(degrees, ["vid", "bj"], "left")
    bit = (F.coalesce("d", F.lit(0.0)) * F.col("n") > F.col("s")).cast("int")
    signs = tests.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("bj", bit.alias("bit")))).alias("sig"))
    return blocks.join(signs, "vid", "left").withColumn("sig", F.coalesce("sig", F.array().cast("array<struct<bj:bigint,bit:int>>")))


def renumber(split: DataFrame, m: int) -> DataFrame:
    """(vid, gid, block): of a block's groups the one with its first vertex keeps the number, others follow by (block, first vertex)."""
    groups = cut(split.groupBy("block", "sig").agg(F.min("vid").alias("first")))
    heads = groups.groupBy("block").agg(F.min("first").alias("head"))
    fresh = groups.join(heads, "block").where("first <> head").select("block", "sig", "first")
    count = fresh.count()
    numbered = ranked(fresh, ["block", "first"], "new", m, count)
    named = split.join(small(numbered.drop("first"), count), ["block", "sig"], "left")
    return named.select("vid", "gid", F.coalesce("new", "block").cast("long").alias("block"))


class QuasiStable:
    """Witness pairs of blocks are all pairs whose error reaches ``max * (1 - q_tolerance)``; all of a block's witnesses split it at once.

    ``refine`` stops at ``n_colors`` blocks or more, at ``max_steps``, or when the largest error is ``q`` or less. The error may
    rise between steps. ``size_weighted`` multiplies errors by the block's size. Blocks are numbered by their first vertex;
    ``going_on`` keeps the order of the last level's colours, as a run does that continues its own stored blocks.
    """

    def __init__(self, colored: ColoredGraph, q: float = 0.0, n_colors: float = math.inf, max_steps: float = math.inf, size_weighted: bool = False, q_tolerance: float = 0.0, going_on: bool = False):
        self.colored, self.q, self.n_colors, self.max_steps = colored, q, n_colors, max_steps
        self.size_weighted, self.q_tolerance = size_weighted, q_tolerance
        self.current_step = 0
        self.touched: list[int] = []  # edges that each step counted again
        level = colored.levels[-1]
        self.n_blocks = level.n_colors
        numbers = ranked(level.frame.groupBy("cls").agg(F.min("vid").alias("first")), ["cls" if going_on else "first"], "block", 0, self.n_blocks)
        self.blocks = cut(level.frame.join(small(numbers, self.n_blocks), "cls").select("vid", "gid", "block"))
        self._measure()

    def _measure(self) -> None:
        """Degrees and statistics of all blocks."""
        degrees = block_degrees(self.colored.graph, self.blocks)
        self._degrees = cut(degrees) if self.max_steps > 0 else None
        self.statistics = cut(block_statistics(degrees if self._degrees is None else self._degrees, self.blocks, self.size_weighted))
        self._sum_up()

    @property
    def degrees(self) -> DataFrame:
        """(vid, bj, d) of the present blocks. Only steps need them once statistics are there, so where no step is to follow they are stored when asked for."""
        if self._degrees is None:
            self._degrees = cut(block_degrees(self.colored.graph, self.blocks))
        return self._degrees

    def _sum_up(self) -> None:
        seen = self.statistics.agg(F.max("error").alias("top"), F.count("*").alias("pairs")).first()
        self.max_q_error, self._pairs = float(seen["top"] or 0.0), seen["pairs"]

    def _update(self, before: DataFrame) -> None:
        """Degrees and statistics after some vertices left their blocks: only degrees into a changed block (one that lost or won vertices) are
        counted again, from the edges that end there, and only pairs with a changed block on either side are summed up again."""
        moved = before.select("vid", F.col("block").alias("old")).join(self.blocks, "vid").where("old <> block")
        changed = cut(moved.select(F.explode(F.array("old", "block")).alias("c")).distinct())
        into = self.blocks.join(changed.withColumnRenamed("c", "block"), "block").select(F.col("vid").alias("dst"), F.col("block").alias("bj"))
        near = self.colored.graph.neighbours(into, "src", "weight")
        fresh = cut(near.groupBy(F.col("src").alias("vid"), "bj").agg(F.sum("weight").alias("d"), F.count("*").alias("edges")))
        self.touched.append(int(fresh.agg(F.sum("edges")).first()[0] or 0))
        fresh = fresh.drop("edges")
        kept = self.degrees.join(changed.withColumnRenamed("c", "bj"), "bj", "left_anti")
        inside = self.blocks.join(changed.withColumnRenamed("c", "block"), "block", "left_semi").select("vid")
        again = block_statistics(fresh.unionByName(kept.join(inside, "vid", "left_semi")), self.blocks, self.size_weighted)
        same = self.statistics.join(changed.withColumnRenamed("c", "bi"), "bi", "left_anti").join(changed.withColumnRenamed("c", "bj"), "bj", "left_anti")
        self.statistics = cut(same.unionByName(again))
        self._degrees = cut(kept.unionByName(fresh))
        self._sum_up()

    def witnesses(self) -> DataFrame:
        """(bi, bj, n, s, error) of the witness pairs with edges between them."""
        return self.statistics.where(F.col("error") >= self.max_q_error * (1 - self.q_tolerance)).select("bi", "bj", "n", "s", "error")

    def witness_count(self) -> int:
        """All witness pairs: at a threshold of zero also those without edges, which split nothing."""
        empty = self.n_blocks**2 - self._pairs if self.max_q_error * (1 - self.q_tolerance) <= 0 else 0
        return self.witnesses().count() + empty

    def refine_one_step(self) -> tuple[int, int, float, int]:
        """(blocks, step, largest error, witness pairs that were split on); at error 0 nothing changes."""
        if self.max_q_error == 0.0:
            return self.n_blocks, self.current_step, 0.0, 0
        witnesses = cut(self.witnesses())
        pairs = self.witness_count()
        before, degrees = self.blocks, self.degrees
        self.blocks = cut(renumber(split_blocks(before, degrees, witnesses), self.n_blocks))
        self.n_blocks = self.blocks.agg(F.max("block")).first()[0] + 1
        self.current_step += 1
        self.colored.push(self.blocks.withColumnRenamed("block", "cls"), self.n_blocks)
        self._update(before)
        return self.n_blocks, self.current_step, self.max_q_error, pairs

    def refine(self) -> tuple[int, int, float]:
        while self.n_blocks < self.n_colors and self.current_step < self.max_steps and self.max_q_error > self.q:
            self.refine_one_step()
        return self.n_blocks, self.current_step, self.max_q_error
