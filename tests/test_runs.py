"""Stored runs, resuming them, and nested cross-validation."""

import shutil
from pathlib import Path

import pytest

from tincture.functions.steps import StepSettings
from tincture.functions.folds import shuffled_folds
from tincture.plans import evaluation, refinement
from tincture.sources.builders import conversation_paths, from_edges

from .conftest import SMALL
from .test_refinement import A


def rows(store):
    return [(r["algo"], r["step"], r["feature_dim"], r["n_colors"], r["n_features"]) for r in store.steps().orderBy("step").collect()]


def test_wl_run_stops_resumes_and_reports_stability(spark, tmp_path):
    graph = from_edges(spark, A)
    _, stable = refinement.run_wl(spark, graph, str(tmp_path / "a"), 2)
    assert not stable
    colored, stable = refinement.run_wl(spark, graph, str(tmp_path / "a"), 39)
    assert stable and colored.height == 5
    refinement.run_wl(spark, graph, str(tmp_path / "b"), 39)
    one, two = (refinement.Store(spark, str(tmp_path / x)) for x in "ab")
    assert rows(one) == rows(two) == [("WL", 0, 0, 1, 1), ("WL", 1, 3, 3, 4), ("WL", 2, 8, 5, 9), ("WL", 3, 16, 8, 17), ("WL", 4, 25, 9, 26)]
    assert sorted(map(tuple, one.features().collect())) == sorted(map(tuple, two.features().collect()))
    shutil.rmtree(Path(tmp_path / "b" / "colors" / "step=2"))
    assert two.missing_steps(4) == [2]
    with pytest.raises(ValueError):
        refinement.run_wl(spark, graph, str(tmp_path / "b"), 39)


def test_qsc_and_gwl_runs(spark, tmp_path):
    graph = from_edges(spark, A)
    refinement.run_qsc(spark, graph, str(tmp_path / "q"), max_step=1, q=0)
    refinement.run_qsc(spark, graph, str(tmp_path / "q"), q=0)
    log = refinement.Store(spark, str(tmp_path / "q")).steps().orderBy("step").collect()
    assert [(r["max_q_error"], r["witness_pair_count"], r["n_colors"]) for r in log] == [(2.0, 0, 1), (1.0, 1, 2), (1.0, 4, 5), (1.0, 6, 8), (0.0, 2, 9)]
    colored = refinement.run_gwl(spark, graph, str(tmp_path / "g"), 2, 2)
    assert colored.height == 3 and refinement.run_gwl(spark, graph, str(tmp_path / "g"), 3, 2).height == 4


def test_nested_cross_validation(spark, tmp_path):
    graph = conversation_paths(spark, SMALL)
    live = graph.graphs.join(graph.vertices.select("gid").distinct(), "gid", "left_semi")
    refinement.run_wl(spark, graph, str(tmp_path / "wl"), 1)
    store = refinement.Store(spark, str(tmp_path / "wl"))
    options = {"trials": range(2), "folds": 3, "inner_folds": 2, "costs": (1.0,)}
    mean, std = evaluation.evaluate_wl(spark, store, live, str(tmp_path / "cv"), h_grid=[0, 1, 7], **options)
    assert 0 <= mean <= 100 and std >= 0
    test = spark.read.parquet(str(tmp_path / "cv" / "test"))
    assert test.count() == 6 and test.where("param = 7").count() == 0  # level 7 is not stored
    assert evaluation.evaluate_wl(spark, store, live, str(tmp_path / "cv"), h_grid=[0], **options) is None
    report = (next((tmp_path / "cv" / "report").glob("part-*"))).read_text()
    assert report.startswith("# Parameter Frequency\nparam=")


def test_qsc_evaluation(spark, tmp_path):
    graph = conversation_paths(spark, SMALL)
    refinement.run_qsc(spark, graph, str(tmp_path / "q"), q=0, max_step=2)
    store = refinement.Store(spark, str(tmp_path / "q"))
    settings = StepSettings("h_grid", {"h_grid": [0, 1], "q_strictly_descending": False})
    live = graph.graphs.join(graph.vertices.select("gid").distinct(), "gid", "left_semi")
    mean, _ = evaluation.evaluate_qsc(spark, store, live, str(tmp_path / "cv"), settings, trials=range(1), folds=2, inner_folds=2, costs=(1.0,))
    assert 0 <= mean <= 100


def _rows(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("trial", "fold", "C", "param", "accuracy").collect()))


def test_a_stopped_evaluation_goes_on(spark, tmp_path):
    graph = conversation_paths(spark, SMALL)
    live = graph.graphs.join(graph.vertices.select("gid").distinct(), "gid", "left_semi")
    refinement.run_wl(spark, graph, str(tmp_path / "wl"), 1)
    store = refinement.Store(spark, str(tmp_path / "wl"))
    options = {"h_grid": [0, 1], "folds": 3, "inner_folds": 2, "costs": (0.1, 1.0)}
    run = lambda name, **more: evaluation.evaluate_wl(spark, store, live, str(tmp_path / name), **options, **more)
    whole = run("whole", trials=range(2), folds_at_once=6)
    # Stopped after a fold, then in the middle of another: its inner rows are there, its test row is not.
    assert run("parts", trials=range(2), most_folds=2) is None and not (tmp_path / "parts" / "report").exists()
    assert run("parts", trials=range(1), most_folds=1) is None or (tmp_path / "parts" / "report").exists()
    for left in ("report", "train_results", "test_results"):
        shutil.rmtree(tmp_path / "parts" / left, ignore_errors=True)
    done = _rows(spark, str(tmp_path / "parts" / "test"))
    shutil.rmtree(tmp_path / "parts" / "test" / "trial=0" / "fold=1")
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "parts" / "test" / "trial=0" / "fold=0").glob("part-*")}
    assert run("parts", trials=range(2)) == pytest.approx(whole)
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "parts" / "test" / "trial=0" / "fold=0").glob("part-*")} == before
    assert set(done) <= set(_rows(spark, str(tmp_path / "parts" / "test")))
    for table in ("train", "test"):
        assert _rows(spark, str(tmp_path / "parts" / table)) == _rows(spark, str(tmp_path / "whole" / table))
    log = next((tmp_path / "whole" / "test_results").glob("part-*")).read_text()
    assert log.startswith("trial,fold,C,param,accuracy\n")
    with pytest.raises(ValueError):
        evaluation.evaluate_wl(spark, store, live, str(tmp_path / "none"), h_grid=[7])


def test_evaluation_equals_a_plain_one(spark, tmp_path):
    """Weighted classes of equal graphs against one row for each graph, on the same folds, with a kernel given as a function."""
    import numpy as np

    from tincture.functions.svm import fit_predict
    from tincture.operators.features import intersection_matrix

    graph = conversation_paths(spark, SMALL)
    live = graph.graphs.join(graph.vertices.select("gid").distinct(), "gid", "left_semi")
    refinement.run_wl(spark, graph, str(tmp_path / "wl"), 2)
    store = refinement.Store(spark, str(tmp_path / "wl"))
    evaluation.evaluate_wl(spark, store, live, str(tmp_path / "cv"), h_grid=[2], trials=range(1), folds=3, inner_folds=2, costs=(1.0,), kind=intersection_matrix, folds_at_once=3)
    got = {r["fold"]: r["accuracy"] for r in spark.read.parquet(str(tmp_path / "cv" / "test")).collect()}
    labels = {r["gid"]: r["graph_label"] for r in live.collect()}
    gids = sorted(labels)
    y = np.array([labels[g] for g in gids])
    entries = store.features().where("step <= 2").toPandas()
    x = entries.pivot_table(index="gid", columns="color", values="cnt", fill_value=0).reindex(gids).to_numpy()
    kernel = np.minimum(x[:, None, :], x[None, :, :]).sum(axis=2).astype(float)
    fold = {r["gid"]: r["fold"] for r in shuffled_folds(live, 3, 0).collect()}
    own = np.array([fold[g] for g in gids])
    for f in range(3):
        train, test = np.flatnonzero(own != f), np.flatnonzero(own == f)
        expected = 100.0 * (fit_predict(kernel[np.ix_(train, train)], y[train], kernel[np.ix_(test, train)], 1.0) == y[test]).mean()
        assert got[f] == pytest.approx(expected)
