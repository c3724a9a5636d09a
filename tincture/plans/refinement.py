"""Refinement runs that store every level, and go on where they stopped.

A run's folder holds ``colors/step=k``, ``features/step=k`` (each level's own colours only; earlier ones lie in earlier partitions)
and ``steps/step=k``, whose file is written last: a step without it did not happen and is made again.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions.formats import rounded
from ..model import ColoredGraph, GraphSet
from ..operators.coloring import WeisfeilerLeman, initial_coloring
from ..operators.gradual import GradualRefinement
from ..operators.quasi_stable import QuasiStable
from ..sources.tu import exists


@dataclass
class Store:
    spark: SparkSession
    root: str

    def steps(self) -> DataFrame | None:
        if not exists(self.spark, f"{self.root}/steps"):
            return None
        return self.spark.read.schema(model.STEPS).parquet(f"{self.root}/steps")

    def features(self) -> DataFrame:
        return self.spark.read.schema("gid long, color long, cnt long, step int").parquet(f"{self.root}/features")

    def level(self, step: int) -> DataFrame:
        return self.spark.read.schema("vid long, gid long, color long").parquet(f"{self.root}/colors/step={step}")

    def missing_steps(self, upto: int) -> list[int]:
        """Steps from 0 to ``upto`` that the log, the colours or the features lack."""
        have = self.steps()
        logged = have.select("step").distinct() if have is not None else self.spark.createDataFrame([], "step int")
        wanted = self.spark.range(upto + 1).select(F.col("id").cast("int").alias("step"))
        gone = {r["step"] for r in wanted.join(logged, "step", "left_anti").collect()}
        return sorted(gone | {k for k in range(upto + 1) if not all(exists(self.spark, f"{self.root}/{t}/step={k}/_SUCCESS") for t in ("colors", "features"))})

    def write(self, algo: str, step: int, level: DataFrame, n_colors: int, top_color: int, seconds: float, q_error: float | None = None, pairs: int | None = None) -> None:
        level.write.mode("overwrite").parquet(f"{self.root}/colors/step={step}")
        stored = self.level(step)
        stored.groupBy("gid", "color").agg(F.count("*").alias("cnt")).write.mode("overwrite").parquet(f"{self.root}/features/step={step}")
        # The reported dimension leaves out colour 0, whether or not it is in use; n_features counts what there is.
        n_features = self.features().where(F.col("step") <= step).select("color").distinct().count()
        row = [(algo, step, top_color, n_colors, n_features, q_error, pairs, rounded(seconds))]
        self.spark.createDataFrame(row, model.STEPS).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/steps/step={step}")

    def resume(self, graph: GraphSet) -> ColoredGraph | None:
        """The colouring as stored, after checking that no step is missing and each level has as many colours as its log says."""
        log = self.steps()
        if log is None:
            return None
        rows = {r["step"]: r for r in log.collect()}
        if not rows:
            return None
        if gone := self.missing_steps(max(rows)):
            raise ValueError(f"steps {gone} of {self.root} are missing")
        out = ColoredGraph(graph)
        for step in sorted(rows):
            level = self.level(step)
            seen = level.agg(F.count_distinct("color").alias("n"), F.min("color").alias("low")).first()
            if seen["n"] != rows[step]["n_colors"]:
                raise ValueError(f"step {step} has {seen['n']} colours, its log says {rows[step]['n_colors']}")
            out.push(level.withColumnRenamed("color", "cls"), seen["n"], seen["low"])
        return out


def _start(store: Store, graph: GraphSet) -> tuple[ColoredGraph, int]:
    colored = store.resume(graph)
    return (initial_coloring(graph), -1) if colored is None else (colored, colored.height - 1)


def _put(store: Store, algo: str, colored: ColoredGraph, step: int, seconds: float, **more) -> None:
    level = colored.levels[step]
    store.write(algo, step, level.colors(), level.n_colors, level.start + level.n_colors - 1, seconds, **more)


def run_wl(spark: SparkSession, graph: GraphSet, root: str, refinement_steps: int, signature: str = "exact") -> tuple[ColoredGraph, bool]:
    """Refine and store up to a step; returns the colouring and whether it is stable, which one more step that is not stored tells."""
    store = Store(spark, root)
    colored, done = _start(store, graph)
    if done < 0:
        _put(store, "WL", colored, 0, 0.0)
    runner = WeisfeilerLeman(colored, signature=signature)
    while colored.height - 1 < refinement_steps and not runner.is_stable:
        began, height = time.perf_counter(), colored.height
        runner.refine_one_step()
        if colored.height > height:
            _put(store, "WL", colored, colored.height - 1, time.perf_counter() - began)
    if not runner.is_stable:
        probe = WeisfeilerLeman(colored.copy(), signature=signature)
        probe.refine_one_step()
        return colored, probe.is_stable
    return colored, True


def run_gwl(spark: SparkSession, graph: GraphSet, root: str, refinement_steps: int, n_cluster: int, initialization: str = "forgy", **options) -> ColoredGraph:
    store = Store(spark, root)
    colored, done = _start(store, graph)
    if done < 0:
        _put(store, "GWL", colored, 0, 0.0)
    runner = GradualRefinement(colored, refinement_steps, n_cluster, initialization, **options)
    while colored.height - 1 < refinement_steps:
        began = time.perf_counter()
        runner.refine_one_step()
        _put(store, "GWL", colored, colored.height - 1, time.perf_counter() - began)
    return colored


def run_qsc(spark: SparkSession, graph: GraphSet, root: str, max_step: float = math.inf, q: float = 1.0, max_color_count: float = 4096, **options) -> ColoredGraph:
    """Refine while the step, the largest q-error and the number of blocks are within their bounds."""
    store = Store(spark, root)
    colored, done = _start(store, graph)
    runner = QuasiStable(colored, q=q, going_on=done >= 0, **options)
    if done < 0:
        _put(store, "QSC", colored, 0, 0.0, q_error=runner.max_q_error, pairs=0)
    while colored.height - 1 < max_step and runner.max_q_error > q and runner.n_blocks < max_color_count:
        began = time.perf_counter()
        _, _, error, pairs = runner.refine_one_step()
        _put(store, "QSC", colored, colored.height - 1, time.perf_counter() - began, q_error=error, pairs=pairs)
    return colored
