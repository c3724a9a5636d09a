"""Step selection, report, k-means and classifier on worked values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tincture.functions import folds, svm
from tincture.functions.formats import rounded, two_decimals
from tincture.functions.machine import log_level, logger, machine
from tincture.functions.report import report_lines
from tincture.functions.steps import StepSettings, anchors_by_halving, anchors_by_ratio, steps_by_position, strictly_descending
from tincture.functions.svm import fit_predict
from tincture.operators import kmeans
from tincture.operators.kmeans import cluster

TRACE = [(0, 16.0), (1, 18.0), (2, 12.0), (3, 12.0), (4, 7.0), (5, 3.0), (6, 1.0), (7, 0.0)]


def log(spark, rows=TRACE):
    return spark.createDataFrame(rows, "step int, max_q_error double")


def pairs(df):
    return [(r["param"], list(r["steps"])) for r in df.orderBy("param").collect()]


def test_descending(spark):
    assert [r["step"] for r in strictly_descending(log(spark)).orderBy("step").collect()] == [0, 2, 4, 5, 6, 7]


@pytest.mark.parametrize(("ratio", "anchors"), [(0.3, [0, 5, 6, 7]), (0.5, [0, 4, 5, 6, 7]), (0.7, [0, 4, 5, 6, 7])])
def test_ratio(spark, ratio, anchors):
    assert pairs(anchors_by_ratio(log(spark), ratio)) == [(i, anchors[: i + 1]) for i in range(len(anchors))]


def test_halving_with_rows_in_between(spark):
    assert pairs(anchors_by_halving(log(spark), True, True)) == [(0, [0]), (1, [0, 2]), (2, [0, 2, 4]), (3, [0, 2, 4, 5]), (4, [0, 2, 4, 5, 6])]


def test_grid(spark):
    assert pairs(steps_by_position(log(spark), [0, 1, 2, 16], True)) == [(0, [0]), (1, [0, 2]), (2, [0, 2, 4])]
    assert pairs(steps_by_position(log(spark), [0, 1, 2, 16])) == [(0, [0]), (1, [0, 1]), (2, [0, 1, 2])]


def test_single_row_and_duplicates(spark):
    one = log(spark, [(0, 0.0)])
    assert pairs(anchors_by_ratio(one, 0.5, True))[-1] == (1, [0, 0])
    assert pairs(anchors_by_ratio(one, 0.5, False)) == [(0, [0])]


def test_settings(spark):
    good = StepSettings("q_ratio", {"q_ratio": 0.5, "allow_duplicate_steps": False})
    assert good.to_dirname() == "q_ratio__0.5__no_duplicates" and good.steps(log(spark))[-1] == (4, [0, 4, 5, 6, 7])
    assert StepSettings("h_grid", {"h_grid": [0, 2], "q_strictly_descending": True}).to_dirname() == "h_grid__0-2__desc"
    for error, args in [(ValueError, ("other", {})), (ValueError, ("h_grid", {"h_grid": [1]})), (TypeError, ("h_grid", {"h_grid": ["1"], "q_strictly_descending": True})), (TypeError, ("q_ratio", {"q_ratio": 1, "allow_duplicate_steps": True}))]:
        with pytest.raises(error):
            StepSettings(*args)


def test_report_and_formats(spark):
    rows = spark.createDataFrame([("test", 0, 0, 1.0, 2, 50.0), ("test", 0, 1, 1.0, 2, 50.25), ("test", 1, 0, 1.0, 3, 75.0)], "phase string, trial int, fold int, C double, param int, accuracy double")
    lines = report_lines(rows)
    assert "param=2: 2 (66.67%)" in lines and "trial 0: 50.12" in lines and "Average of trial averages: 62.56" in lines and "Standard deviation of averages: 17.59" in lines
    assert rounded(2.675, 2) == 2.67
    assert spark.createDataFrame([(1234.5,)], "x double").select(two_decimals("x")).first()[0] == "1234.50"


def test_kmeans_limits():
    points = np.unique(np.array([[0, 0], [0, 1], [9, 9], [9, 8]]), axis=0)
    ones = np.ones(4)
    assert list(cluster(points, ones, 1)) == [0] * 4
    assert len(set(cluster(points, ones, 10))) == 4
    for method in ("forgy", "kmeans++"):
        got = cluster(points, ones, 2, method)
        assert got[0] == got[1] != got[2] == got[3]
    with pytest.raises(ValueError):
        cluster(points, ones, 2, "other")


def test_kmeans_weights_stand_for_repeats():
    rng = np.random.default_rng(0)
    for turn in range(20):
        data = rng.integers(0, 5, (200, 3))
        rows, inverse, counts = np.unique(data, axis=0, return_inverse=True, return_counts=True)
        starts = rows[rng.choice(len(rows), 4, replace=False)]
        for truncate in (True, False):
            weighted, one = kmeans._lloyd(rows, counts, starts.copy(), 100, truncate)
            repeated, two = kmeans._lloyd(data, np.ones(len(data)), starts.copy(), 100, truncate)
            assert (weighted[inverse.ravel()] == repeated).all() and np.allclose(one, two)
            assert kmeans._scatter(rows, counts, one, weighted) == pytest.approx(kmeans._scatter(data, np.ones(len(data)), two, repeated))
    assert list(cluster(rows, counts, 3, "first")) == list(kmeans._lloyd(rows, counts, rows[:3].copy(), 100, True)[0])


def test_classifier_warns_if_it_stops_early():
    x = np.random.default_rng(2).normal(size=(30, 2))
    y = np.where(np.arange(30) % 2, 1, -1)
    with pytest.warns(RuntimeWarning):
        svm.BinarySvm(1000.0, most=3).fit(x @ x.T, y)
    assert svm.BinarySvm(1.0).fit(x @ x.T, y).converged


def test_classifier_separates_and_votes():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (20, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    y = np.repeat(["a", "b", "c"], 20)
    k = x @ x.T
    test = np.arange(0, 60, 4)
    train = np.setdiff1d(np.arange(60), test)
    assert (fit_predict(k[np.ix_(train, train)] + 1, y[train], k[np.ix_(test, train)] + 1, 10.0) == y[test]).mean() == 1.0


def test_machine_and_logger(tmp_path):
    assert log_level("DEBUG") == 10 and log_level("nonsense") == 20
    path = tmp_path / "logs" / "run.log"
    for _ in range(2):
        out = logger("tincture-test", str(path))
    out.info("hello")
    assert len(out.handlers) == 2 and path.read_text().count("hello") == 1
    assert len(logger("tincture-test").handlers) == 1
    assert set(machine()) == {"cpu", "cores", "physical_cores", "frequency", "memory", "system", "python"}


def _plain_shuffled(labels, k, seed):
    """Labels in order of ids to folds, written down row by row."""
    rng = np.random.RandomState(seed)
    names = list(dict.fromkeys(labels))
    dealt = [i % k for i in range(len(labels))]
    by_class = sorted(range(len(labels)), key=lambda i: names.index(labels[i]))
    out = [None] * len(labels)
    for name in names:
        own = sorted(dealt[place] for place, i in enumerate(by_class) if labels[i] == name)
        rng.shuffle(own)
        for i, f in zip([i for i, x in enumerate(labels) if x == name], own, strict=True):
            out[i] = f
    return out


@pytest.mark.parametrize("seed", [0, 1, 9])
def test_shuffled_folds(spark, seed):
    for labels in (["b", "a", "b", "b", "a", "c", "a", "b", "b", "a", "a", "b", "c"], ["1"] * 17 + ["0"] * 9):
        rows = spark.createDataFrame([(10 * i + 3, x) for i, x in enumerate(labels)], "gid long, graph_label string").repartition(4)
        found = {r["gid"]: r["fold"] for r in folds.shuffled_folds(rows, 4, seed).collect()}
        assert [found[10 * i + 3] for i in range(len(labels))] == _plain_shuffled(labels, 4, seed)
    both = rows.withColumn("t", F.explode(F.array(F.lit(1), F.lit(2))))
    again = folds.shuffled_folds(both, 4, seed, ("t",)).collect()
    assert all(found[r["gid"]] == r["fold"] for r in again) and len(again) == 2 * len(labels)


#: The folds (of 3) of classes of these sizes, for three seeds.
_PUBLISHED = {
    ((5, 4), 0): [[1, 0, 0, 1, 2], [0, 2, 1, 2]],
    ((5, 4), 1): [[1, 0, 2, 0, 1], [0, 2, 2, 1]],
    ((5, 4), 9): [[1, 0, 0, 1, 2], [2, 1, 2, 0]],
    ((3, 7, 2), 0): [[2, 1, 0], [2, 0, 0, 1, 1, 0, 2], [1, 2]],
    ((3, 7, 2), 1): [[0, 2, 1], [2, 0, 2, 1, 0, 0, 1], [2, 1]],
    ((3, 7, 2), 9): [[1, 0, 2], [1, 0, 0, 1, 0, 2, 2], [1, 2]],
}


def test_shuffled_folds_have_stored_values():
    for (sizes, seed), expected in _PUBLISHED.items():
        assert [x.tolist() for x in folds.shuffled_allocation(list(sizes), 3, seed)] == expected


def test_weighted_classifier_equals_repeated_rows():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (60, 4)).astype(float)
    y = np.where(x[:, 0] + rng.normal(0, 0.8, 60) > 1, "p", np.where(x[:, 1] > 1, "q", "r"))
    grid, place = np.unique(x, axis=0, return_inverse=True)
    place = place.reshape(-1)
    kernel = grid @ grid.T
    test = np.arange(len(grid))
    for cost in (0.01, 1.0, 100.0):
        plain = fit_predict(x @ x.T, y, grid @ x.T, cost)
        keys, at = np.unique(np.stack([place, np.unique(y, return_inverse=True)[1]]), axis=1, return_inverse=True)
        weights = np.bincount(at.reshape(-1))
        labels = np.unique(y)[keys[1]]
        whole = svm.fit_predict_weighted(kernel, keys[0], labels, weights, test, cost)
        rows = svm.KernelRows(len(grid), lambda places: kernel[places], np.diag(kernel), most_bytes=8 * len(grid) * 5)
        assert (whole == plain).mean() > 0.97  # at the border a tolerance decides
        assert (svm.fit_predict_weighted(rows, keys[0], labels, weights, test, cost) == whole).all() and len(rows.kept) <= 5
    assert (svm.fit_predict_weighted(kernel, keys[0], np.repeat("p", len(keys[0])), weights, test, 1.0) == "p").all()


def test_many_rows_are_shuffled_into_the_same_folds(spark, monkeypatch):
    """Ranks by range partitions, whatever their column is called, give the folds that a window's ranks give."""
    from tincture import runtime
    from tincture.functions.folds import shuffled_folds

    graphs = spark.range(60).selectExpr("id % 2 as part", "id as gid", "cast(id % 3 as string) as graph_label")
    want = sorted(map(tuple, shuffled_folds(graphs, 4, 5, ("part",)).collect()))
    monkeypatch.setattr(runtime, "ONE_TASK_ROWS", 10)
    assert sorted(map(tuple, shuffled_folds(graphs, 4, 5, ("part",)).collect())) == want and len(want) == 60
