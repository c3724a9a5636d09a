"""Colour histograms of graphs, feature matrices and graph kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ColoredGraph
from ..runtime import cut, ship, stored


def features(colored: ColoredGraph) -> DataFrame:
    """(step, gid, color, cnt) of every level. Each level has colours of its own, so histograms over levels are unions of rows."""
    return colored.colors().groupBy("step", "gid", "color").agg(F.count("*").alias("cnt"))


def feature_vector(colored: ColoredGraph) -> DataFrame:
    """(color, cnt) over all levels and graphs."""
    return colored.colors().groupBy("color").agg(F.count("*").alias("cnt"))


def feature_maps(rows: DataFrame) -> DataFrame:
    """(gid, features map) from long features."""
    return rows.groupBy("gid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("color", "cnt")))).alias("features"))


def matrix_shape(rows: DataFrame) -> tuple[int, int]:
    """(largest gid + 1, largest colour + 1): the dense shape whose missing rows and columns are zero."""
    top = rows.agg(F.max("gid"), F.max("color")).first()
    return (top[0] + 1, top[1] + 1) if top[0] is not None else (0, 0)


def sparse_matrix(rows: DataFrame, columns: int) -> DataFrame:
    """(gid, size, indices, values): each graph's row of the feature matrix."""
    entries = F.array_sort(F.collect_list(F.struct("color", "cnt")))
    return rows.groupBy("gid").agg(entries.alias("e")).select(
        "gid", F.lit(columns).cast("long").alias("size"), F.transform("e", lambda x: x["color"]).alias("indices"), F.transform("e", lambda x: x["cnt"].cast("double")).alias("values"))


def stitch(rows: DataFrame, steps: list[int]) -> DataFrame:
    """The features of chosen steps side by side; with features partitioned by step only those files are read."""
    return rows.where(F.col("step").isin(*steps))


class SparseRows:
    """Rows of a feature matrix: row i's entries are ``indices[starts[i]:starts[i + 1]]`` and the same part of ``values``."""

    def __init__(self, starts: np.ndarray, indices: np.ndarray, values: np.ndarray, columns: int):
        self.starts, self.indices, self.values, self.shape = starts, indices, values.astype(float), (len(starts) - 1, columns)

    def take(self, places: np.ndarray) -> SparseRows:
        sizes = np.diff(self.starts)[places]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        at = np.arange(starts[-1]) + np.repeat(self.starts[places] - starts[:-1], sizes)
        return SparseRows(starts, self.indices[at], self.values[at], self.shape[1])

    def dense(self, first: int = 0, width: int | None = None) -> np.ndarray:
        """All columns, or ``width`` of them from ``first`` on."""
        width = self.shape[1] - first if width is None else width
        rows = np.repeat(np.arange(self.shape[0]), np.diff(self.starts))
        mine = (self.indices >= first) & (self.indices < first + width)
        out = np.zeros((self.shape[0], width))
        out[rows[mine], self.indices[mine] - first] = self.values[mine]
        return out

    def norms(self) -> np.ndarray:
        rows = np.repeat(np.arange(self.shape[0]), np.diff(self.starts))
        return np.sqrt(np.bincount(rows, self.values**2, self.shape[0]))


#: Columns that are multiplied at a time.
_WIDTH = 4096


def dot_matrix(x: SparseRows, y: SparseRows) -> np.ndarray:
    """All dot products of rows of ``x`` with rows of ``y``."""
    out = np.zeros((x.shape[0], y.shape[0]))
    for first in range(0, x.shape[1], _WIDTH):
        width = min(_WIDTH, x.shape[1] - first)
        out += x.dense(first, width) @ y.dense(first, width).T
    return out


def cosine_matrix(x: SparseRows, y: SparseRows) -> np.ndarray:
    """The dot products of rows of length one."""
    return dot_matrix(x, y) / (np.maximum(x.norms(), 1e-300)[:, None] * np.maximum(y.norms(), 1e-300)[None, :])


def intersection_matrix(x: SparseRows, y: SparseRows) -> np.ndarray:
    """What two histograms have in common: the sum of the smaller counts."""
    out = np.zeros((x.shape[0], y.shape[0]))
    for column in np.intersect1d(x.indices, y.indices).tolist():
        out += np.minimum(x.dense(column, 1), y.dense(column, 1).T)
    return out


MATRICES = {"linear_kernel": dot_matrix, "dot": dot_matrix, "cosine_similarity": cosine_matrix, "cosine": cosine_matrix}


def blocked_kernel(rows: DataFrame, function, block_graphs: int = 1024) -> DataFrame:
    """(g1, g2, k) of all pairs of graphs whose kernel is not 0, in both orders.

    Graphs are dealt into blocks of about ``block_graphs``, and each pair of blocks is one task that hands their rows to ``function(x, y)`` as two
    ``SparseRows`` over the same columns (those that the two blocks use, in order of colour) and takes a matrix. A colour that all graphs
    have costs as many entries as graphs, not as pairs of graphs. The function is symmetric.
    """
    spark = rows.sparkSession
    ship(spark)
    counts = rows.groupBy("gid", "color").agg(F.sum("cnt").alias("cnt"))
    blocks = max(1, -(-rows.select("gid").distinct().count() // block_graphs))
    own = F.pmod(F.xxhash64("gid"), F.lit(blocks)).cast("int")
    dealt = counts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "gid", "color", "cnt", "own", F.greatest("own", "other").alias("high"), F.least("own", "other").alias("low"))

    def multiply(table: pa.Table) -> pa.Table:
        gid, color, cnt, side = (table.column(c).to_numpy() for c in ("gid", "color", "cnt", "own"))
        high, low = table.column("high")[0].as_py(), table.column("low")[0].as_py()
        order = np.lexsort((color, gid))
        graphs, starts = np.unique(gid[order], return_index=True)
        colors, columns = np.unique(color, return_inverse=True)
        every = SparseRows(np.append(starts, len(gid)), columns[order], cnt[order], len(colors))
        of = side[order][starts]
        one, two = np.flatnonzero(of == high), np.flatnonzero(of == low)
        out = function(every.take(one), every.take(two))
        i, j = np.nonzero(out)
        g1, g2, k = graphs[one[i]], graphs[two[j]], np.asarray(out[i, j], dtype=float)
        if high != low:  # both orders
            g1, g2, k = np.concatenate((g1, g2)), np.concatenate((g2, g1)), np.concatenate((k, k))
        return pa.table({"g1": pa.array(g1), "g2": pa.array(g2), "k": pa.array(k)})

    return dealt.groupBy("high", "low").applyInArrow(multiply, "g1 bigint, g2 bigint, k double")


#: Up to so many different histograms a kernel is computed between them.
KERNEL_CLASSES = 16_384
#: So few go to every task; more of them must be shared by so many graphs each on average.
FEW_CLASSES, KERNEL_SHARED = 1024, 4
#: Up to so many graphs go to every task.
KERNEL_GRAPHS = 1_000_000
#: About so many graphs of a class are one piece; pairs of pieces are expanded one by one.
PIECE_GRAPHS = 256
#: Pieces of a band: a task's second graphs come from one or two bands, so that files name them by short codes.
BAND_PIECES = 128
#: About so many pairs of graphs are made by a task.
TASK_PAIRS = 1 << 24


def class_kernel(rows: DataFrame, function, block_graphs: int = 1024, digits: int | None = None) -> DataFrame:
    """``blocked_kernel`` for collections in which many graphs have the same histogram, its values rounded to ``digits``.

    Graphs with equal histograms are one class, and the kernel is computed between classes alone. What is shuffled are pairs of pieces of classes, without
    their graphs, and a task makes about ``TASK_PAIRS`` rows, one pair of pieces at a time: all graphs of a piece by each graph of another, so that written rows
    repeat and take little room. With more than ``KERNEL_CLASSES`` classes, or more than ``FEW_CLASSES`` of few graphs each, graphs meet in blocks.
    """
    value = F.col("k") if digits is None else F.round("k", digits)
    near = lambda own: blocked_kernel(own, function, block_graphs).withColumn("k", value)
    counts = rows.groupBy("gid", "color").agg(F.sum("cnt").alias("cnt"))
    graphs = cut(counts.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("color", "cnt"))).alias("hist")))
    classes = cut(graphs.groupBy("hist").agg(F.min("gid").alias("class"), F.count("*").alias("size")))
    n, size = classes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n > KERNEL_CLASSES or n > FEW_CLASSES and size < KERNEL_SHARED * n:
        return near(rows)
    values = stored(near(classes.select(F.col("class").alias("gid"), F.explode("hist").alias("e")).select("gid", "e.color", "e.cnt")))
    few = F.broadcast if n <= FEW_CLASSES else lambda df: df
    # A large class falls into pieces by a hash, so that none of its tasks sees all of it.
    dealt = graphs.join(few(classes), "hist").select("gid", "class", F.pmod(F.xxhash64("gid"), F.ceil(F.col("size") / PIECE_GRAPHS)).alias("part"))
    pieces = cut(dealt.groupBy("class", "part").agg(F.sort_array(F.collect_list("gid")).alias("own")).select(F.monotonically_increasing_id().alias("piece"), "class", "own"))
    bands = -(-(n + size // PIECE_GRAPHS) // BAND_PIECES)
    of = lambda i, *more: few(pieces.select(F.col("piece").alias(f"p{i}"), *more))
    few = F.broadcast if size <= KERNEL_GRAPHS else lambda df: df
    band = F.pmod(F.xxhash64("piece"), F.lit(max(1, bands))).alias("band")
    pairs = values.join(of(1, F.col("class").alias("g1")), "g1").join(of(2, F.col("class").alias("g2"), band), "g2").select("band", "p1", "p2", "k")
    pairs = pairs.repartitionByRange(max(1, -(-(size * size) // TASK_PAIRS)), "band", "p1", "p2")
    met = pairs.join(of(1, F.col("own").alias("one")), "p1").join(of(2, F.col("own").alias("two")), "p2")
    return met.select(F.explode("one").alias("g1"), "two", "k").select("g1", F.explode("two").alias("g2"), "k")


def dot_kernel(rows: DataFrame, block_graphs: int = 1024) -> DataFrame:
    """(g1, g2, k) for all pairs of graphs with a colour in common, in both orders; pairs without one have kernel 0."""
    return class_kernel(rows, dot_matrix, block_graphs)


def cosine_kernel(rows: DataFrame, block_graphs: int = 1024) -> DataFrame:
    """The dot kernel of rows of length one."""
    return class_kernel(rows, cosine_matrix, block_graphs)


def kernel(rows: DataFrame, kind, block_graphs: int = 1024, digits: int | None = None) -> DataFrame:
    """``kind``: a name of ``MATRICES`` or any symmetric function of two ``SparseRows`` to a matrix. ``digits``: places that values are rounded to."""
    return class_kernel(rows, MATRICES[kind] if isinstance(kind, str) else kind, block_graphs, digits)
