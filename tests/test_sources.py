"""The text format: isolated vertices, edgeless graphs, missing label files, repeated and conflicting edges."""

import pytest
from pyspark.sql import functions as F

from tincture.model import GraphSet
from tincture.operators.statistics import analyze
from tincture.sources.logs import CV_LOG, read_log, write_log
from tincture.sources.builders import disjoint_union, from_edges
from tincture.sources import tu
from tincture.sources.tu import read_tu, write_tu

FILES = {
    "graph_indicator": "1\n1\n1\n2\n2\n2\n3\n3\n3\n4\n4\n",
    # triangle; path with (a,b) and (b,a) of different labels; an edge and an isolated vertex; graph 4 has no edge
    "A": "1, 2\n2, 3\n3, 1\n4, 5\n5, 4\n5, 6\n7, 8\n",
    "edge_labels": "0\n0\n0\n1\n2\n0\n1\n",
    "node_labels": "5\n6\n7\n5\n5\n6\n7\n7\n9\n9\n9\n",
    "graph_labels": "1\n-1\n1\n-1\n",
}


def write(root, names, **changed):
    (root / "DS").mkdir(parents=True)
    for n in names:
        (root / "DS" / f"DS_{n}.txt").write_text(changed.get(n, FILES[n]))
    return str(root)


def test_full_collection(spark, tmp_path):
    graph = read_tu(spark, write(tmp_path, FILES), "DS")
    vertices = {r["orig_id"]: r for r in graph.vertices.collect()}
    assert sorted(vertices, key=int) == ["1", "2", "3", "4", "5", "6", "7", "8"]
    assert [r["vid"] for r in sorted(vertices.values(), key=lambda r: int(r["orig_id"]))] == list(range(8))
    edges = {(r["src"], r["dst"]): r["label"] for r in graph.edges.collect()}
    assert len(edges) == 12 and edges[3, 4] == edges[4, 3] == "2"  # the last label given wins
    assert {r["gid"]: r["graph_label"] for r in graph.graphs.collect()} == {1: "1", 2: "-1", 3: "1"}
    row = analyze(graph).first()
    assert (row["graphs"], row["nodes"], row["edges"], row["graph_labels"], row["node_labels"], row["edge_labels"]) == (3, 8, 6, 2, 3, 3)
    assert row["mean_nodes"] == pytest.approx(8 / 3)


def test_optional_files_may_be_missing(spark, tmp_path):
    graph = read_tu(spark, write(tmp_path, ["graph_indicator", "A", "graph_labels"]), "DS")
    assert not graph.has_edge_labels() and not graph.has_distinct_node_labels()


def test_empty_lines(spark, tmp_path):
    assert read_tu(spark, write(tmp_path, FILES, node_labels=FILES["node_labels"] + "\n\n"), "DS").vertices.count() == 8
    (tmp_path / "b").mkdir()
    with pytest.raises(ValueError, match="empty line"):
        read_tu(spark, write(tmp_path / "b", FILES, node_labels="5\n\n7\n5\n5\n6\n7\n7\n9\n9\n9\n"), "DS")


def test_what_is_written_is_read_again(spark, tmp_path):
    graph = read_tu(spark, write(tmp_path, FILES), "DS")
    write_tu(graph, f"file://{tmp_path}/again", "X")
    again = read_tu(spark, f"file://{tmp_path}/again", "X")
    rows = lambda f, *c: sorted(map(tuple, f.select(*c).collect()), key=str)
    assert rows(again.edges, "src", "dst", "gid", "label") == rows(graph.edges, "src", "dst", "gid", "label")
    assert rows(again.vertices, "vid", "gid", "label") == rows(graph.vertices, "vid", "gid", "label")
    assert rows(again.graphs, "gid", "graph_label") == rows(graph.graphs, "gid", "graph_label")


def test_union_after_a_single_vertex(spark):
    loop = from_edges(spark, [("a", "a")])
    got = disjoint_union(loop, from_edges(spark, [("b", "c")]))
    assert sorted((r["vid"], r["gid"]) for r in got.vertices.collect()) == [(0, 0), (1, 1), (2, 1)]


def test_edges_between_graphs_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="links two graphs"):
        read_tu(spark, write(tmp_path, FILES, A="1, 4\n"), "DS")


def test_logs_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 0.1, 3, 87.5)], CV_LOG)
    write_log(rows, str(tmp_path / "log"))
    assert read_log(spark, str(tmp_path / "log"), CV_LOG).collect() == rows.collect()


def test_text_labels_that_would_not_be_read_back_are_refused(spark, tmp_path):
    from tincture.sources.builders import from_edges

    for label in ("a\nb", " a", "a ", "", "a\rb"):
        with pytest.raises(ValueError):
            tu.write_tu(from_edges(spark, [("x", "y")], {"x": label, "y": "d"}), str(tmp_path), "bad")
    graph = from_edges(spark, [("x", "y", "p"), ("y", "z")])
    with pytest.raises(ValueError):  # one edge has a label, the other has none
        tu.write_tu(graph, str(tmp_path), "bad")
    assert not (tmp_path / "bad").exists()


def test_text_files_of_many_parts_are_numbered_on(spark, tmp_path):
    n = 5000
    rows = spark.range(n).select(F.col("id"), (F.col("id") * 7).cast("string").alias("value"))
    rows.repartitionByRange(13, "id").sortWithinPartitions("id").select("value").write.text(str(tmp_path / "lines.txt"))
    assert len(list((tmp_path / "lines.txt").glob("part-*"))) == 13
    found = tu.numbered_lines(spark, str(tmp_path / "lines.txt"), 1).collect()
    assert sorted((r["n"], r["value"]) for r in found) == [(i + 1, str(7 * i)) for i in range(n)]


def test_ends_without_a_vertex(spark, tmp_path):
    for place, line in enumerate(("1, 99", "99, 1")):
        with pytest.raises(Exception, match="links two graphs"):
            read_tu(spark, write(tmp_path / str(place), FILES, A=FILES["A"] + line + "\n", edge_labels=FILES["edge_labels"] + "0\n"), "DS")


@pytest.mark.parametrize("lines", ["2, 1\n2, 3\n", "1, 2\n1, 3\n", "1, 3\n1, 2\n", "1, 2\n3, 2\n2, 3\n", "2, 3\n1, 2\n"])
def test_vertices_follow_their_first_appearance(spark, tmp_path, lines):
    graph = read_tu(spark, write(tmp_path, ["graph_indicator", "A", "graph_labels"], graph_indicator="1\n1\n1\n", A=lines, graph_labels="1\n"), "DS")
    ends = [int(x) for line in lines.split() for x in line.split(",") if x]
    number = {v: i for i, v in enumerate(dict.fromkeys(ends))}
    assert {int(r["orig_id"]): r["vid"] for r in graph.vertices.collect()} == number
    want = {(number[a], number[b]) for a, b in zip(ends[::2], ends[1::2])}
    assert {(r["src"], r["dst"]) for r in graph.edges.collect()} == want | {(b, a) for a, b in want}


def test_graphs_in_turns_and_in_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tu, "RUN", 2, raising=False)
    for place, gids in enumerate(([7, 5, 7, 5, 7], [7, 7, 7, 7, 7, 5, 5])):
        vertices = spark.createDataFrame([(i, g, str(i), None) for i, g in enumerate(gids)], "vid long, gid long, orig_id string, label string")
        edges = spark.createDataFrame([], "src long, dst long, gid long, label string, weight double")
        write_tu(GraphSet(vertices, edges), f"file://{tmp_path}/{place}", "X")
        found = tu.numbered_lines(spark, f"file://{tmp_path}/{place}/X/X_graph_indicator.txt", 0).orderBy("n").collect()
        assert [r["value"] for r in found] == [{5: "1", 7: "2"}[g] for g in gids]
