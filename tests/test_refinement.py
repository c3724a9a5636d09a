"""The two worked example graphs, level by level, and properties that hold across algorithms."""

import random

import pytest
from pyspark.sql import functions as F

from tincture.operators.coloring import WeisfeilerLeman, initial_coloring
from tincture.operators.features import cosine_kernel, dot_kernel, features
from tincture.operators.gradual import GradualRefinement
from tincture.operators.quasi_stable import QuasiStable
from tincture.sources.builders import disjoint_union, from_edges

#: The edges of two worked examples.
A = [(0, 1), (0, 5), (0, 6), (1, 2), (1, 7), (2, 3), (3, 4), (3, 8), (4, 5)]
B = [(0, 1), (0, 3), (0, 5), (1, 2), (2, 3), (2, 6), (4, 5), (4, 6)]


def classes(colored, level=-1):
    """{colour: original ids} of a level."""
    names = {r["vid"]: int(r["orig_id"]) for r in colored.graph.vertices.collect()}
    out = {}
    for r in colored.level(level).colors().collect():
        out.setdefault(r["color"], set()).add(names[r["vid"]])
    return out


def blocks(runner):
    names = {r["vid"]: int(r["orig_id"]) for r in runner.colored.graph.vertices.collect()}
    out = {}
    for r in runner.blocks.collect():
        out.setdefault(r["block"], set()).add(names[r["vid"]])
    return [out[k] for k in sorted(out)]


@pytest.mark.parametrize("signature", ["exact", "concat"])
def test_wl_on_graph_a(spark, signature):
    colored = initial_coloring(from_edges(spark, A))
    runner = WeisfeilerLeman(colored, signature=signature)
    assert runner.refine_one_step() == (3, 1)
    assert classes(colored) == {1: {0, 1, 3}, 2: {5, 2, 4}, 3: {6, 7, 8}}
    assert runner.refine_one_step() == (5, 2)
    assert classes(colored) == {4: {0, 1}, 5: {5, 4}, 6: {6, 7, 8}, 7: {2}, 8: {3}}
    assert runner.refine_one_step() == (8, 3)
    assert classes(colored) == {9: {0}, 10: {1}, 11: {5}, 12: {6, 7}, 13: {2}, 14: {3}, 15: {4}, 16: {8}}
    assert runner.refine_one_step() == (9, 4) and colored.next_color_id == 26
    assert runner.refine_one_step() == (9, 4) and runner.is_stable and colored.next_color_id == 35 and colored.height == 5
    assert runner.refine_one_step() == (9, 4)
    colored.assert_consistent_height()


def test_wl_on_graph_b_until_stable(spark):
    colored = initial_coloring(from_edges(spark, B))
    WeisfeilerLeman(colored).refine_until_stable()
    assert classes(colored, 1) == {1: {0, 2}, 2: {1, 3, 5, 6, 4}}
    assert classes(colored, 2) == {3: {0, 2}, 4: {1, 3}, 5: {5, 6}, 6: {4}}
    assert colored.height == 3 and colored.next_color_id == 11
    with pytest.raises(ValueError):
        colored.num_colors(3)


def test_qsc_on_graph_a(spark):
    runner = QuasiStable(initial_coloring(from_edges(spark, A)))
    assert (runner.n_blocks, runner.max_q_error, runner.witness_count()) == (1, 2.0, 1)
    assert runner.refine_one_step() == (2, 1, 1.0, 1) and blocks(runner) == [{0, 1, 3}, {5, 6, 2, 7, 4, 8}]
    assert runner.witness_count() == 4
    assert runner.refine_one_step() == (5, 2, 1.0, 4) and blocks(runner) == [{0, 1}, {5, 4}, {3}, {6, 7, 8}, {2}]
    assert runner.refine_one_step() == (8, 3, 1.0, 6) and blocks(runner) == [{0}, {5}, {3}, {6, 7}, {2}, {1}, {4}, {8}]
    assert runner.refine_one_step() == (9, 4, 0.0, 2) and blocks(runner) == [{0}, {5}, {3}, {6}, {2}, {1}, {4}, {8}, {7}]
    assert runner.refine_one_step() == (9, 4, 0.0, 0)


def test_qsc_on_graph_b_may_rise(spark):
    runner = QuasiStable(initial_coloring(from_edges(spark, B)))
    errors = [runner.max_q_error]
    while runner.max_q_error > 0:
        errors.append(runner.refine_one_step()[2])
    assert errors == [1.0, 2.0, 1.0, 0.0]
    assert blocks(runner) == [{0, 2}, {1, 3}, {5, 6}, {4}]


def test_qsc_bounds_and_full_tolerance(spark):
    graph = from_edges(spark, A)
    assert QuasiStable(initial_coloring(graph), n_colors=2).refine()[0] == 2
    assert QuasiStable(initial_coloring(graph), max_steps=1).refine()[1] == 1
    assert QuasiStable(initial_coloring(graph), q=1.0).refine() == (2, 1, 1.0)
    runner = QuasiStable(initial_coloring(graph), q_tolerance=1.0)
    runner.refine_one_step()
    assert runner.witness_count() == runner.n_blocks**2
    assert QuasiStable(initial_coloring(graph), size_weighted=True).max_q_error == 18.0


def test_concatenated_signatures_can_collide(spark):
    """Own colour 1 with neighbours {2, 3} and own colour 12 with neighbour {3} both read 123."""
    edges = [("p", "q"), ("p", "r")] + [(f"x{i}", f"y{i}") for i in range(4, 12)] + [("m", "n")]
    labels = {"p": 1, "q": 2, "r": 3} | {f"x{i}": i for i in range(4, 12)} | {f"y{i}": i for i in range(4, 12)} | {"m": 12, "n": 3}
    graph = from_edges(spark, edges, labels)
    exact, concat = (initial_coloring(graph) for _ in range(2))
    n_exact = WeisfeilerLeman(exact).refine_one_step()[0]
    n_concat = WeisfeilerLeman(concat, signature="concat").refine_one_step()[0]
    assert n_exact == n_concat + 1


def test_partly_labelled_vertices_are_refused(spark):
    graph = from_edges(spark, [(0, 1), (1, 2)], {0: "a", 1: "b", 2: "c"})
    partly = type(graph)(graph.vertices.withColumn("label", F.when(F.col("vid") < 2, F.col("label"))), graph.edges, graph.graphs)
    with pytest.raises(ValueError):
        initial_coloring(partly)


def test_random_graphs_agree_across_algorithms(spark):
    rng = random.Random(5)
    parts = []
    for gid in range(3):
        n = rng.randint(5, 12)
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(2 * n)}
        parts.append(from_edges(spark, sorted(edges), gid=gid))
    graph = disjoint_union(*parts)
    assert graph.vertices.select("gid").distinct().count() == 3
    wl, qsc = initial_coloring(graph), initial_coloring(graph)
    WeisfeilerLeman(wl).refine_until_stable()
    runner = QuasiStable(qsc)
    runner.refine()
    one = {r["vid"]: r["color"] for r in wl.level().colors().collect()}
    two = {r["vid"]: r["block"] for r in runner.blocks.collect()}
    pair = lambda m: {frozenset(v for v in m if m[v] == c) for c in m.values()}
    assert pair(one) == pair(two)
    for a, b in zip(wl.levels, wl.levels[1:], strict=False):  # each level refines the one before
        joined = a.frame.select("vid", F.col("cls").alias("old")).join(b.frame.select("vid", "cls"), "vid")
        assert joined.groupBy("cls").agg(F.count_distinct("old").alias("n")).where("n > 1").count() == 0
    rows = features(wl)
    sums = {r["gid"]: r["s"] for r in rows.groupBy("gid").agg(F.sum("cnt").alias("s")).collect()}
    sizes = {r["gid"]: r["count"] for r in graph.vertices.groupBy("gid").count().collect()}
    assert sums == {g: n * wl.height for g, n in sizes.items()}
    k = {(r["g1"], r["g2"]): r["k"] for r in dot_kernel(rows).collect()}
    assert all(k[b, a] == v for (a, b), v in k.items())
    c = {(r["g1"], r["g2"]): r["k"] for r in cosine_kernel(rows).collect()}
    assert all(abs(c[g, g] - 1) < 1e-12 for g in sizes)


def test_gradual_refinement_with_many_clusters_is_one_exact_step(spark):
    graph = from_edges(spark, A)
    gwl, wl = initial_coloring(graph), initial_coloring(graph)
    gradual = GradualRefinement(gwl, 2, 100)
    gradual.refine()
    WeisfeilerLeman(wl, 2).refine()
    for level in (1, 2):
        assert set(map(frozenset, classes(gwl, level).values())) == set(map(frozenset, classes(wl, level).values()))
    assert min(classes(gwl, 1)) == 1


@pytest.mark.parametrize("method", ["forgy", "kmeans++"])
def test_gradual_refinement_splits_into_k(spark, method):
    colored = initial_coloring(from_edges(spark, A))
    GradualRefinement(colored, 3, 2, method).refine()
    assert colored.height == 4 and colored.num_colors(1) == 2
    again = initial_coloring(from_edges(spark, A))
    GradualRefinement(again, 3, 2, method).refine()
    assert [classes(colored, k) for k in range(4)] == [classes(again, k) for k in range(4)]
    with pytest.raises(ValueError):
        GradualRefinement(again, 1, 2, "other")


def test_edge_labels_count_where_they_differ(spark):
    star = [(0, 1, "x"), (0, 2, "y"), (0, 3, "x")]
    colored = initial_coloring(from_edges(spark, star))
    assert WeisfeilerLeman(colored).refine_one_step()[0] == 3
    plain = initial_coloring(from_edges(spark, [(a, b, "x") for a, b, _ in star]))
    assert WeisfeilerLeman(plain).refine_one_step()[0] == 2


def test_large_ranks_go_by_partitions(spark, monkeypatch):
    from tincture import runtime

    monkeypatch.setattr(runtime, "ONE_TASK_ROWS", 0)
    rows = runtime.ranked(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), ["k"], "n", 5, 1000)
    assert all(r["n"] == r["k"] + 5 for r in rows.collect())
    assert runtime.ranked(spark.range(0).toDF("k"), ["k"], "n").count() == 0


def test_quasi_stable_updates_equal_a_full_recount(spark):
    from tincture.operators.quasi_stable import block_degrees, block_statistics
    from tincture.sources.builders import customer_suppliers

    graph = customer_suppliers(spark, "/root/testdata/sf0.001")
    runner, edges = QuasiStable(initial_coloring(graph), size_weighted=True), graph.edges.count()
    for _ in range(4):
        runner.refine_one_step()
        degrees = block_degrees(graph, runner.blocks)
        assert sorted(map(tuple, runner.degrees.select("vid", "bj", "d").collect())) == sorted(map(tuple, degrees.select("vid", "bj", "d").collect()))
        full = block_statistics(degrees, runner.blocks, True)
        assert sorted(map(tuple, runner.statistics.select(full.columns).collect())) == sorted(map(tuple, full.collect()))
    assert len(runner.touched) == 4 and all(0 < n < edges for n in runner.touched)


@pytest.mark.parametrize("method", ["kmeans++", "forgy", "first"])
def test_one_large_colour_is_clustered_alike_in_one_task_and_in_many(spark, method):
    """Unlabelled vertices are one colour: its histograms by joins and aggregations, and in one task."""
    from tincture.sources.builders import order_stars

    graph = order_stars(spark, "/root/testdata/sf0.001").without_node_labels()
    options = {"cluster_initialization_method": method, "num_forgy_iterations": 3}
    one, many = (GradualRefinement(initial_coloring(graph), 2, 3, spread_over=n, **options).refine() for n in (20_000, 0))
    for level in (1, 2):
        assert sorted(map(tuple, one.level(level).colors().collect())) == sorted(map(tuple, many.level(level).colors().collect()))
    assert one.num_colors() > 3


def test_stacks_are_refined_without_levels(spark):
    from tincture.model import ColoredGraph
    from tincture.operators.gradual import StackRefinement
    from tincture.sources.builders import conversation_paths

    graph = conversation_paths(spark, "/root/testdata/sf0.001")
    start = initial_coloring(graph)
    stacks = start.stacks()
    made = StackRefinement(graph, stacks, 2, 2).refine()
    spread = StackRefinement(graph, stacks, 2, 2, spread_over=0).refine()
    assert sorted(map(str, made.collect())) == sorted(map(str, spread.collect()))
    colored, levels = ColoredGraph.from_stacks(graph, made), GradualRefinement(start, 2, 2).refine()
    assert colored.height == 3 and colored.next_color_id == sum(colored.num_colors(k) for k in range(3)) + 1
    for k in range(3):  # the same classes under other numbers
        assert set(map(frozenset, groups(colored, k))) == set(map(frozenset, groups(levels, k)))
    firsts = [min(own) for own in groups(colored, 1)]
    assert firsts != sorted(firsts) or len(firsts) == colored.num_colors(0)


def groups(colored, level):
    """Vertices of each colour, in the order of colours."""
    out = {}
    for r in colored.level(level).colors().collect():
        out.setdefault(r["color"], set()).add(r["vid"])
    return [out[c] for c in sorted(out)]


def test_stacks_that_are_missing_or_differ_are_refused(spark):
    from tincture.model import ColoredGraph
    from tincture.operators.gradual import StackRefinement

    graph = from_edges(spark, A)
    stacks = initial_coloring(graph).stacks()
    empty = F.when(F.col("vid") > 0, F.col("stack")).otherwise(F.array().cast("array<bigint>"))
    longer = F.when(F.col("vid") > 0, F.col("stack")).otherwise(F.array_append("stack", F.lit(9).cast("long")))
    null = F.when(F.col("vid") > 0, F.col("stack"))
    for wrong in (stacks.where("vid > 0"), stacks.limit(0), *(stacks.withColumn("stack", c) for c in (empty, null, longer))):
        with pytest.raises(ValueError):
            StackRefinement(graph, wrong, 1, 2)
    with pytest.raises(ValueError):
        ColoredGraph.from_stacks(graph, stacks.withColumn("stack", F.array((F.col("vid") * 2).cast("long"))))
    none = StackRefinement(from_edges(spark, A), stacks, 0, 2).refine()
    assert none.where("size(stack) = 1").count() == none.count() == graph.vertices.count()


def test_wide_levels_are_laid_out_by_partitions(spark, monkeypatch):
    from tincture import runtime
    from tincture.operators.hierarchy import layout, lines, printed
    from tincture.sources.builders import conversation_paths

    colored = initial_coloring(conversation_paths(spark, "/root/testdata/sf0.001"))
    WeisfeilerLeman(colored, 3).refine()
    at_once = sorted(map(tuple, layout(colored).collect()))
    monkeypatch.setattr(runtime, "ONE_TASK_ROWS", 10)
    assert sorted(map(tuple, layout(colored).collect())) == at_once
    assert list(printed(colored)) == [r["line"] for r in lines(colored).orderBy("path").collect()]
