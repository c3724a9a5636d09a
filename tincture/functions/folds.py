"""Stratified folds: dealt by a formula that every engine can compute, or shuffled by a Mersenne Twister."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, ranked, ship

#: Shuffled folds come from one stream of random numbers, so from one place: a byte or two for each row.
MOST_SHUFFLED = 100_000_000


def stratified_folds(graphs: DataFrame, k: int, seed: int) -> DataFrame:
    """(gid, graph_label, fold): each label's graphs in a seeded order, dealt out in turn. Not the folds of any random generator."""
    order = Window.partitionBy("graph_label").orderBy((F.col("gid") * 7919 + seed) % 104729, "gid")
    return graphs.select("gid", "graph_label", ((F.row_number().over(order) - 1) % k).cast("int").alias("fold"))


def shuffled_allocation(sizes: list[int], k: int, seed: int) -> list[np.ndarray]:
    """For each class, in order of its first row, the fold of each of its rows.

    Were all rows sorted by class and dealt to the folds in turn, so many of a class would fall into each fold; which of its rows these are is
    shuffled, class after class, by a generator seeded once.
    """
    rng, out, start = np.random.RandomState(seed), [], 0
    for size in sizes:
        own = np.bincount(np.arange(start, start + size) % k, minlength=k)
        folds = np.arange(k, dtype=np.int16).repeat(own)
        rng.shuffle(folds)
        out.append(folds)
        start += size
    return out


def shuffled_folds(graphs: DataFrame, k: int, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., gid, graph_label, fold): shuffled stratified folds over the graphs in order of their ids; each value of ``by`` is split for itself
    with the same seed. Fewer graphs of a class than folds leave some folds without it; there may be ``MOST_SHUFFLED`` rows."""
    spark = graphs.sparkSession
    ship(spark)
    rows = graphs.select(*by, "gid", "graph_label")
    n = rows.count()
    if n > MOST_SHUFFLED:
        raise ValueError(f"shuffled folds take {MOST_SHUFFLED} rows at most; stratified_folds takes any number")
    placed = cut(ranked(rows, [*by, "graph_label", "gid"], "_at", 0, n))
    classes = placed.groupBy(*by, "graph_label").agg(F.count("*").alias("size"), F.min("gid").alias("first"), F.min("_at").alias("start")).collect()
    every = np.zeros(n, np.int16)
    for group in {tuple(r[c] for c in by) for r in classes}:
        own = sorted((r for r in classes if tuple(r[c] for c in by) == group), key=lambda r: r["first"])
        for r, folds in zip(own, shuffled_allocation([r["size"] for r in own], k, seed), strict=True):
            every[r["start"] : r["start"] + r["size"]] = folds
    shared = spark.sparkContext.broadcast(every)

    def look_up(batches):
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value[at].astype(np.int32))], names=[*batch.schema.names[:-1], "fold"])

    kept = placed.select(*by, "gid", "graph_label", "_at")
    return kept.mapInArrow(look_up, type(kept.schema)([*kept.schema.fields[:-1], *spark.createDataFrame([], "fold int").schema.fields]))
