"""How often queries move rows: what they shuffle grows with that."""

import pytest

from tincture.plans import catalog

from .conftest import SMALL


@pytest.fixture
def moves(spark, monkeypatch):
    """Counts the exchanges in the plans of everything that a query writes to the shared folder."""
    kind, seen = type(spark.range(0)), []

    def checkpoint(self, eager=True, write=kind.checkpoint):
        seen.append(self._jdf.queryExecution().executedPlan().toString())
        return write(self, eager)

    monkeypatch.setattr(kind, "checkpoint", checkpoint)
    return lambda name: (catalog.queries()[name](spark, SMALL), sum(plan.count("Exchange ") - plan.count("BroadcastExchange ") for plan in seen))[1]


@pytest.mark.parametrize("name, most", [("edges_os", 4), ("edges_cs", 9), ("edges_ep", 1), ("wl2_edge_labels_os", 25)])
def test_rows_move_seldom(moves, name, most):
    assert moves(name) <= most


def test_kernel_between_classes(spark, monkeypatch):
    """Equal graphs meet once: blocks see one graph of each histogram."""
    from tincture.operators import features

    rows = spark.range(300).selectExpr("id as gid", "explode(array(id % 3, 7)) as color", "1L as cnt").cache()
    want, block, seen = {tuple(r) for r in features.blocked_kernel(rows, features.dot_matrix).collect()}, features.blocked_kernel, []
    monkeypatch.setattr(features, "blocked_kernel", lambda r, *more: (seen.append(r.select("gid").distinct().count()), block(r, *more))[1])
    got = [tuple(r) for r in features.kernel(rows, "dot").collect()]
    assert set(got) == want and len(got) == 300 * 300
    assert seen == [3]
    monkeypatch.setattr(features, "KERNEL_CLASSES", 2)
    assert {tuple(r) for r in features.kernel(rows, "dot").collect()} == want and seen == [3, 300]


def test_distinct_labels_number_nothing(spark, moves):
    """Whether labels differ is told without building the collections."""
    assert moves("has_distinct_labels") == 0
    from tincture.sources import builders

    for f, build in catalog._BUILD.items():
        graph = build(spark, SMALL)
        nodes, edges = builders.LABELS[f](spark, SMALL)
        assert [x.select("label").distinct().where("label is not null").count() > 1 for x in (nodes, edges)] == [graph.has_distinct_node_labels(), graph.has_distinct_edge_labels()]


@pytest.fixture
def all_moves(spark, monkeypatch):
    """Counts the exchanges in the plans of everything that a query checkpoints or writes as Parquet or text."""
    from pyspark.sql import DataFrameWriter

    kind, seen = type(spark.range(0)), []
    count = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString())
    checkpoint = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, eager=True: (count(self), checkpoint(self, eager))[1])
    for name in ("parquet", "text"):
        write = getattr(DataFrameWriter, name)
        monkeypatch.setattr(DataFrameWriter, name, lambda self, *a, write=write, **o: (count(self._df), write(self, *a, **o))[1])
    return lambda name: (catalog.queries()[name](spark, SMALL), sum(plan.count("Exchange ") - plan.count("BroadcastExchange ") for plan in seen))[1]


@pytest.mark.parametrize("name, most", [("text_edges_os", 30), ("text_without_labels_cs", 30)])
def test_text_moves_seldom(all_moves, name, most):
    assert all_moves(name) <= most


def test_centres_come_to_the_vectors(spark, monkeypatch):
    """Few centres are broadcast, so that clustering over tables moves no vector to them."""
    from tincture.operators import kmeans

    hist = "array(named_struct('key', named_struct('color', id % 7), 'n', id % 5 + 1))"
    kinds = spark.range(200).selectExpr("1L as color", "id as hid", "id % 3 + 1 as weight", f"{hist} as hist").checkpoint()
    kind, seen = type(kinds), []
    write = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, eager=True: (seen.append(self._jdf.queryExecution().executedPlan().toString()), write(self, eager))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as at size, where plans know no small table by themselves
    try:
        assert kmeans.cluster_tables(kinds, 3, "first").count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(plan.count("BroadcastHashJoin ") for plan in seen) >= 4


def test_neighbours_meet_in_bounded_tasks(spark, monkeypatch):
    """A task in which edges meet the colours of their ends gets no more of them as collections grow."""
    from tincture import runtime

    monkeypatch.setattr(runtime, "TASK_ROWS", 1000)
    for build in catalog._BUILD.values():
        graph = build(spark, SMALL)
        edges = graph.edges.count()
        assert edges <= graph.n_edges <= 2 * edges + 2
        assert graph.without_node_labels().n_edges == graph.n_edges
        near = graph.neighbours(graph.vertices.selectExpr("vid as dst", "label as end"), "src")
        parts = [sum(1 for _ in rows) for rows in near.rdd.glom().collect()]
        assert len(parts) >= edges // 1000 and sum(parts) == edges


@pytest.mark.parametrize("name", ["qsc0_errors_cs", "wl1_class_sizes_cs", "qsc_weighted_errors_os", "qsc1_blocks_cs"])
def test_dealt_neighbours_give_the_same(spark, duck, monkeypatch, name):
    from tincture import runtime

    from .test_catalog import values

    monkeypatch.setattr(runtime, "TASK_ROWS", 1000)
    assert values(catalog.queries()[name](spark, SMALL).toPandas()) == values(duck.execute(catalog.oracle_sql()[name]).df())


def test_statistics_alone_store_no_degrees(spark, monkeypatch):
    """Degrees, a row for each vertex and block near it, are stored for steps only; a step without them counts them."""
    from tincture.operators import coloring, quasi_stable

    kind, seen = type(spark.range(0)), []
    write = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, eager=True: (seen.append(self.columns), write(self, eager))[1])
    runner = catalog._qsc(spark, SMALL, "cs", 0)
    assert ["vid", "bj", "d"] not in seen
    other = quasi_stable.QuasiStable(coloring.initial_coloring(catalog._BUILD["cs"](spark, SMALL)))
    assert ["vid", "bj", "d"] in seen
    assert runner.refine_one_step() == other.refine_one_step() and sorted(runner.statistics.collect()) == sorted(other.statistics.collect())


def test_links_meet_in_bounded_tasks(spark, monkeypatch):
    """Customers' and suppliers' links are dealt into more tasks as lines become more, also where they are grouped by their ends."""
    from tincture import runtime
    from tincture.sources import builders

    monkeypatch.setattr(runtime, "TASK_ROWS", 500)
    parts, number = [], builders.numbered
    monkeypatch.setattr(builders, "numbered", lambda placed, name, start=0: (parts.append(placed.rdd.getNumPartitions()), number(placed, name, start))[1])
    builders.customer_suppliers(spark, SMALL)
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert len(parts) == 2 and min(parts) >= lines // 500


def test_many_neighbours_are_not_sorted(spark, monkeypatch):
    """Many edges meet the colours of their ends in tasks that hash the colours, which are fewer."""
    from tincture import runtime

    monkeypatch.setattr(runtime, "TASK_ROWS", 1000)
    graph = catalog._BUILD["cs"](spark, SMALL)
    plan = graph.neighbours(graph.vertices.selectExpr("vid as dst", "label as end"), "src")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_degrees_of_links_need_no_edges(spark, duck):
    """A vertex's degree is the length of its list of links, so that the edges are not made for a histogram of degrees."""
    from dataclasses import replace

    from tincture.operators import statistics

    graph = catalog._BUILD["cs"](spark, SMALL)
    want = sorted(duck.execute(catalog.oracle_sql()["degree_hist_cs"]).fetchall())
    assert sorted(tuple(r) for r in statistics.degree_histogram(replace(graph, edges=None)).collect()) == want
    assert sorted(tuple(r) for r in statistics.degree_histogram(replace(graph, degrees=None)).collect()) == want


@pytest.mark.parametrize("limit", [{}, {"FEW_CLASSES": 2}, {"KERNEL_GRAPHS": 10}])
def test_kernel_of_large_classes(spark, monkeypatch, limit):
    """Classes of several pieces, in many tasks, give the rows that blocks of all graphs give, in tasks of bounded size."""
    from tincture.operators import features

    rows = spark.range(230).selectExpr("id * 5 as gid", "explode(array(id % 3, 7, 10 + id % 2)) as color", "id % 2 + 1 as cnt").checkpoint()
    want = sorted(map(tuple, features.blocked_kernel(rows, features.intersection_matrix).collect()))
    for name, value in ({"PIECE_GRAPHS": 16, "BAND_PIECES": 4, "TASK_PAIRS": 2000} | limit).items():
        monkeypatch.setattr(features, name, value)
    made = features.kernel(rows, features.intersection_matrix)
    parts = [len(x) for x in made.rdd.glom().collect()]
    assert sorted(map(tuple, made.collect())) == want and max(parts) <= 230 * 230 // 4
    near = {(a, b): round(k, 3) for a, b, k in features.blocked_kernel(rows, features.cosine_matrix).collect()}
    assert {(a, b): k for a, b, k in features.kernel(rows, "cosine", digits=3).collect()} == near


def test_written_kernels_are_small(spark, tmp_path):
    """A kernel has a row for each pair of graphs; its rows lie so that files take much less than the number of a graph for each."""
    from tincture.operators import features

    rows = spark.range(4000).selectExpr("id * 77 as gid", "explode(array(id % 3, 7)) as color", "1L as cnt").checkpoint()
    features.kernel(rows, "dot").write.parquet(str(tmp_path / "k"))
    assert spark.read.parquet(str(tmp_path / "k")).count() == 4000 * 4000
    assert sum(f.stat().st_size for f in (tmp_path / "k").glob("*.parquet")) < 0.35 * 4000 * 4000
