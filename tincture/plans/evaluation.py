"""Nested cross-validation of graph kernels, committed fold by fold, so that a run that stopped loses one fold at most.

A parameter gives each graph a feature vector; graphs with equal vectors are one class of the parameter (``members``), whose vector is kept
once (``vectors``). For a fold Spark counts graphs by (parameter, inner fold, class, label); each (fold, parameter, cost) is a task that
takes these counts and the parameter's vectors, makes their kernel and fits one classifier for each inner fold on weighted rows. So neither the
driver nor a broadcast holds a kernel, a vector or a label, and a fit is as large as there are different vectors, not graphs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions.folds import shuffled_folds, stratified_folds
from ..functions.report import best_parameters, inner_accuracy, report_lines, summary
from ..functions.svm import DENSE_ROWS, KernelRows, fit_predict_weighted
from ..operators.features import MATRICES, SparseRows
from ..runtime import cut, ship
from ..sources.logs import write_log
from ..sources.tu import exists

#: Grids of the evaluations.
COSTS = (1e-3, 1e-2, 1e-1, 1e0, 1e1, 1e2, 1e3)
#: The inner fold of graphs that the outer fold holds back.
_HELD = -1
TRAIN = "trial int, fold int, param int, C double, inner int, accuracy double"
TEST = "trial int, fold int, C double, param int, accuracy double"


def parameter_vectors(features: DataFrame, params: list[tuple[int, list[int]]]) -> tuple[DataFrame, DataFrame]:
    """(param, gid, cls) and (param, cls, colors, counts): graphs with the same features over a parameter's steps are one class, named by its smallest graph."""
    steps = features.sparkSession.createDataFrame([(p, s) for p, own in params for s in own], "param int, step int")
    entries = F.array_sort(F.collect_list(F.struct("color", "cnt")))
    # Few rows: as many as (parameter, step).
    own = features.join(F.broadcast(steps), "step").groupBy("param", "gid").agg(entries.alias("hist")).withColumn("digest", F.sha2(F.col("hist").cast("string"), 256))
    own = cut(own)
    classes = own.groupBy("param", "digest").agg(F.min("gid").alias("cls"))
    members = own.drop("hist").join(classes, ["param", "digest"]).select("param", "gid", "cls")
    vectors = own.drop("digest").join(classes.select("param", F.col("cls").alias("gid")), ["param", "gid"])
    return members, vectors.select("param", F.col("gid").alias("cls"), F.transform("hist", lambda x: x["color"]).alias("colors"), F.transform("hist", lambda x: x["cnt"]).alias("counts"))


def _kernel(rows: SparseRows, function):
    every = np.arange(rows.shape[0])
    if len(every) <= DENSE_ROWS:
        return function(rows, rows)
    diagonal = np.concatenate([np.diag(function(part := rows.take(every[i : i + 256]), part)) for i in range(0, len(every), 256)])
    return KernelRows(len(every), lambda places: function(rows.take(places), rows), diagonal)


def _fitter(kind, inner_folds: int):
    """A cogroup of counts and vectors of one (trial, fold, param, C) to accuracies: of each inner fold, or with ``inner_folds`` 0 of the held graphs."""
    function = MATRICES[kind] if isinstance(kind, str) else kind

    def fit(key, counted: pa.Table, vectors: pa.Table) -> pa.Table:
        trial, fold, param, cost = (k.as_py() for k in key)
        lists = vectors.column("colors").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        colors, columns = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        values = np.concatenate([c.flatten().to_numpy() for c in vectors.column("counts").chunks]) if vectors.num_rows else np.zeros(0)
        rows = SparseRows(np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))), columns, values, len(colors))
        kernel = _kernel(rows, function)
        names = vectors.column("cls").to_numpy()
        order = np.argsort(names)
        places = order[np.searchsorted(names, counted.column("cls").to_numpy(), sorter=order)]
        labels = np.array(counted.column("graph_label").to_pylist(), dtype=str)
        inner, weights = counted.column("inner").to_numpy(), counted.column("m").to_numpy()
        out = []
        for i in range(inner_folds) if inner_folds else [_HELD]:
            test, train = inner == i, (inner != i) & (inner != _HELD)
            if not test.any() or not train.any():
                continue
            keys, at = np.unique(np.stack([places[train], np.unique(labels, return_inverse=True)[1][train]]), axis=1, return_inverse=True)
            own = np.bincount(at.reshape(-1), weights[train], keys.shape[1])
            found = fit_predict_weighted(kernel, keys[0], np.unique(labels)[keys[1]], own, places[test], cost)
            out.append((i, 100.0 * weights[test][found == labels[test]].sum() / weights[test].sum()))
        n = len(out)
        columns = {"trial": [trial] * n, "fold": [fold] * n, "param": [param] * n, "C": [cost] * n, "inner": [i for i, _ in out], "accuracy": [a for _, a in out]}
        kinds = {"trial": pa.int32(), "fold": pa.int32(), "param": pa.int32(), "C": pa.float64(), "inner": pa.int32(), "accuracy": pa.float64()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in columns.items()})

    return fit


def _fitted(counted: DataFrame, vectors: DataFrame, jobs: DataFrame, kind, inner_folds: int) -> DataFrame:
    """Jobs are rows (trial, fold, param, C), as many as the grid has for the folds at hand."""
    keys = ["trial", "fold", "param", "C"]
    left = counted.join(F.broadcast(jobs), ["trial", "fold", "param"])
    right = vectors.join(F.broadcast(jobs), "param")
    right = right.toDF(*right.columns)  # columns of its own: both sides come from the same jobs
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_fitter(kind, inner_folds), TRAIN)


def _commit(rows: DataFrame, path: str) -> None:
    """Write the folds at hand; other folds' files stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trial", "fold").parquet(path)


def finished_folds(spark: SparkSession, root: str) -> set[tuple[int, int]]:
    if not exists(spark, f"{root}/test"):
        return set()
    return {(r["trial"], r["fold"]) for r in spark.read.schema(TEST).parquet(f"{root}/test").select("trial", "fold").distinct().collect()}


def cross_validate(
    spark: SparkSession, features: DataFrame, graphs: DataFrame, params: list[tuple[int, list[int]]], root: str, kind="dot", trials=range(10), folds: int = 10, inner_folds: int = 10, costs=COSTS,
    folds_at_once: int = 1, shuffled: bool = True, most_folds: int | None = None,
) -> tuple[float, float] | None:
    """Nested cross-validation: for each trial and outer fold the (parameter, cost) with the best mean inner accuracy, the first of
    equals, is fitted on all but the fold and tested on it. Returns mean and standard deviation of the trials' means, or
    None if the folder already has a report. Parameters whose steps are not stored are left out.

    ``root/train`` has the inner rows and ``root/test`` one row for each fold, both by (trial, fold), committed fold by fold (or ``folds_at_once``),
    inner rows first. What a run finds there stays; folds without a test row are made again. ``most_folds`` ends a run after so many folds, without a
    report (None). ``shuffled`` folds follow a Mersenne Twister seeded by the trial (0 inside); else a formula deals them. ``kind`` is a kernel's name or
    a function of two ``SparseRows``. With the report, ``train_results`` (means over inner folds) and ``test_results`` are written as CSV.
    """
    if exists(spark, f"{root}/report"):
        return None
    ship(spark)
    stored = {r["step"] for r in features.select("step").distinct().collect()}
    params = [(p, steps) for p, steps in params if set(steps) <= stored]
    if not params:
        raise ValueError("no parameter's steps are stored")
    split = shuffled_folds if shuffled else stratified_folds
    costs = [float(c) for c in costs]
    done = finished_folds(spark, root)
    todo = [(t, f) for t in trials for f in range(folds) if (t, f) not in done]
    stopped = most_folds is not None and most_folds < len(todo)
    todo = todo[:most_folds] if stopped else todo
    if todo:
        members, vectors = (cut(x) for x in parameter_vectors(features, params))
        live = cut(graphs.join(features.select("gid").distinct(), "gid", "left_semi").select("gid", F.col("graph_label").cast("string").alias("graph_label")))
        outer = {t: cut(split(live, folds, t)) for t in sorted({t for t, _ in todo})}
    for first in range(0, len(todo), folds_at_once):
        now = todo[first : first + folds_at_once]
        parts = None
        for t, f in now:
            placed = outer[t].withColumn("held", F.col("fold") == f).select(F.lit(t).alias("trial"), F.lit(f).alias("outer"), "gid", "graph_label", "held")
            parts = placed if parts is None else parts.unionByName(placed)
        parts = cut(parts)
        rest = parts.where("not held").drop("held")
        inner = shuffled_folds(rest, inner_folds, 0, ("trial", "outer")) if shuffled else _dealt_inside(rest, inner_folds)
        held = parts.where("held").select("trial", "outer", "gid", "graph_label", F.lit(_HELD).alias("fold"))
        every = inner.unionByName(held).withColumnsRenamed({"fold": "inner", "outer": "fold"})
        counted = cut(every.join(members, "gid").groupBy("trial", "fold", "param", "inner", "cls", "graph_label").agg(F.count("*").alias("m")))
        grid = spark.createDataFrame([(t, f, p, c) for t, f in now for p, _ in params for c in costs], "trial int, fold int, param int, C double")
        _commit(_fitted(counted, vectors, grid, kind, inner_folds), f"{root}/train")
        mine = spark.read.schema(TRAIN).parquet(f"{root}/train").join(F.broadcast(grid.select("trial", "fold").distinct()), ["trial", "fold"], "left_semi")
        best = cut(best_parameters(inner_accuracy(mine), [p for p, _ in params], costs).select("trial", "fold", "param", "C"))
        _commit(_fitted(counted, vectors, best, kind, 0).select("trial", "fold", "C", "param", "accuracy"), f"{root}/test")
    if stopped:
        return None
    results = spark.read.schema(TEST).parquet(f"{root}/test")
    write_log(inner_accuracy(spark.read.schema(TRAIN).parquet(f"{root}/train")).select("trial", "fold", "C", "param", "accuracy"), f"{root}/train_results", "overwrite")
    write_log(results.select("trial", "fold", "C", "param", "accuracy"), f"{root}/test_results", "overwrite")
    lines = report_lines(results)
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/report")
    total = summary(results).first()
    return total["mean"], total["std"]


def _dealt_inside(rest: DataFrame, inner_folds: int) -> DataFrame:
    """Inner folds by the formula, for each outer fold by itself."""
    named = rest.withColumn("own", F.concat_ws("/", "trial", "outer", "graph_label"))
    dealt = stratified_folds(named.select("gid", F.col("own").alias("graph_label")), inner_folds, 0).withColumnRenamed("graph_label", "own")
    return named.join(dealt, ["own", "gid"]).drop("own")


def evaluate_wl(spark, store, graphs, root, h_grid=range(11), **options):
    """Parameter h uses the levels 0 to h."""
    return cross_validate(spark, store.features(), graphs, [(h, list(range(h + 1))) for h in sorted(h_grid)], root, **options)


#: Gradual refinement is evaluated on the same grid of levels.
evaluate_gwl = evaluate_wl


def evaluate_qsc(spark, store, graphs, root, settings, kind="cosine", **options):
    """Parameters and their steps come from the log of q-errors; the kernel is cosine unless another is named."""
    return cross_validate(spark, store.features(), graphs, settings.steps(store.steps()), root, kind=kind, **options)
