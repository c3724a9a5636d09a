"""Reader and writer of the multi-file text format of graph collections (``<dir>/<DS>/<DS>_*.txt``).

A line's number is its key, so every file is read as numbered lines. A file may also be a folder of parts, as Spark writes them: lines then
go on from part to part in the order of the parts' numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import GraphSet
from ..runtime import cut, ranked, stored
from .builders import symmetric


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, by Hadoop's file systems: label files are optional."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _placed_lines(spark: SparkSession, path: str, start: int) -> DataFrame:
    """(n, value, split) of ``numbered_lines``; ``split`` is the number of lines before the split of the file that a line lies in.

    The text is read twice and no line moves: first lines are counted by split, then a line's number is its split's offset and its place in the split.
    Both passes must cut the files alike; a line of a split that was not counted is an error.
    """
    part = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1), F.lit("")), F.lit("9999999999")).cast("long"), F.lit(0).cast("long"))
    own = {"file": F.col("_metadata.file_name"), "block": F.col("_metadata.file_block_start"), "length": F.col("_metadata.file_block_length")}
    lines = spark.read.text(path).select(F.trim("value").alias("value"), *(c.alias(k) for k, c in own.items()), part.alias("part"), F.monotonically_increasing_id().alias("_at"))
    task = F.shiftright("_at", 33).alias("task")
    counted = lines.groupBy("part", *own, task).agg(F.min("_at").alias("first"), F.count("*").alias("lines"), F.count_if(F.col("value") != "").alias("full"), F.max(F.expr("if(value <> '', _at, null)")).alias("last"))
    before = Window.orderBy("part", "file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    splits = cut(counted.withColumn("split", F.coalesce(F.sum("lines").over(before), F.lit(0)).cast("long")))
    seen = splits.agg(F.coalesce(F.max(F.col("split") + F.col("last") - F.col("first")) + 1, F.lit(0)).alias("n"), F.coalesce(F.sum("full"), F.lit(0)).alias("full")).first()
    if seen["full"] < seen["n"]:
        raise ValueError(f"{path} has an empty line before its end")
    known = lines.withColumn("task", task).join(F.broadcast(splits.select(*own, "task", "first", "split")), [*own, "task"], "left")
    place = F.when(F.col("split").isNull(), F.raise_error(F.lit("the files were cut in another way when they were read again")).cast("long")).otherwise(F.col("split") + F.col("_at") - F.col("first"))
    return known.select(place.alias("n"), "value", "split").where(F.col("n") < seen["n"]).withColumn("n", F.col("n") + start)


def numbered_lines(spark: SparkSession, path: str, start: int) -> DataFrame:
    """(n, value): lines without the trailing empty ones, numbered from ``start`` by part, place of the split in it, and line in the split. An empty
    line before the last full one would move all later numbers, so it is an error."""
    return _placed_lines(spark, path, start).select("n", "value")


def _labels(rows: DataFrame, name: str) -> DataFrame | None:
    """The rows if their last column can be written as lines; None if it is null throughout."""
    label = F.col(rows.columns[-1]).cast("string")
    unfit = F.coalesce(label.rlike(r"[\r\n]") | (F.trim(label) != label) | (label == ""), F.lit(True))
    seen = rows.agg(F.count(label).alias("labels"), F.count_if(unfit).alias("unfit")).first()
    if seen["labels"] and seen["unfit"]:
        raise ValueError(f"{seen['unfit']} of the {name} are null, empty, hold a line break or have a blank at an end: as lines they would not be read back")
    return rows if seen["labels"] else None


def write_tu(graph: GraphSet, directory: str, dataset: str) -> None:
    """Write a collection in the text format: graphs numbered from 1 in the order of their ids, vertices by ``vid``, each edge
    once. Files are folders of sorted parts, one for each range of lines. Label files are left out where there are no labels; labels that would not be
    read back as they are (nulls among others, empty ones, line breaks, blanks at an end) are an error, before anything is written."""
    spans = graph.vertices.groupBy("gid").agg(F.min("vid").alias("first"), F.max("vid").alias("last"), F.count("*").alias("size"))
    numbers = ranked(spans, ["gid"], "n", 1)
    put = lambda name, rows: rows.select(F.col(rows.columns[-1]).cast("string").alias("value")).write.mode("overwrite").text(f"{directory}/{dataset}/{dataset}_{name}.txt")
    edges = graph.edges.where("src <= dst").select("src", "dst", "label")
    files = {
        "edge_labels": _labels(edges, "edge labels"),
        "node_labels": _labels(graph.vertices.select("vid", "label"), "node labels"),
        "graph_labels": _labels(numbers.join(graph.graphs, "gid").orderBy("n").select("graph_label"), "graph labels") if graph.graphs is not None else None,
    }
    put("graph_indicator", _indicator(graph, numbers))
    edges = edges.orderBy("src", "dst")
    if files["edge_labels"] is not None:
        files["edge_labels"] = edges = cut(edges)  # sorted once for both files
    put("A", edges.select(F.concat((F.col("src") + 1).cast("string"), F.lit(", "), (F.col("dst") + 1).cast("string"))))
    if files["node_labels"] is not None:
        files["node_labels"] = files["node_labels"].orderBy("vid")
    for name, rows in files.items():
        if rows is not None:
            put(name, rows)


#: Lines of a graph that are made of one row at once.
RUN = 1 << 20


def _indicator(graph: GraphSet, numbers: DataFrame) -> DataFrame:
    """Each vertex's graph number by ``vid``, from ``numbers`` (gid, first, last, size, n). Where the vertices of every graph follow one another, vertices stay
    where they are: a graph's row becomes its lines."""
    if numbers.where("last - first + 1 <> size").limit(1).count():
        return graph.vertices.select("vid", "gid").join(numbers.select("gid", "n"), "gid").select("vid", "n").orderBy("vid")
    runs = numbers.orderBy("first").select("n", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(RUN).cast("long"))).alias("at"))
    return runs.select(F.explode(F.array_repeat("n", F.least(F.col("size") - F.col("at"), F.lit(RUN)).cast("int"))).alias("n"))


def _follow_edges(lines: DataFrame, vertices: int) -> bool:
    """Whether vertices 1, 2, ... up to ``vertices`` first appear in this order in ``lines`` (a, b, split), each split's lines being in order: no
    end is more than one above all ends before it."""
    tops = lines.groupBy("split").agg(F.max(F.greatest("a", "b")).alias("top"))
    above = F.max("top").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1))  # one row a split
    tops = cut(tops.withColumn("above", F.coalesce(above, F.lit(0)).cast("long")))
    if (tops.agg(F.max("top")).first()[0] or 0) != vertices:
        return False

    def leaps(frames):
        import numpy as np
        import pandas as pd

        tops = {}
        for f in frames:
            count = 0
            for split, own in f.groupby("split", sort=False):
                ends = own[["a", "b"]].to_numpy().ravel()
                highest = np.maximum.accumulate(np.concatenate([[tops.get(split, own["above"].iloc[0])], ends]))
                count += int((ends > highest[:-1] + 1).sum())
                tops[split] = highest[-1]
            yield pd.DataFrame({"leaps": [count]})

    found = lines.join(F.broadcast(tops.select("split", "above")), "split").select("split", "a", "b", "above").mapInPandas(leaps, "leaps long")
    return not found.agg(F.sum("leaps")).first()[0]


def read_tu(spark: SparkSession, directory: str, dataset: str) -> GraphSet:
    """The collection's tables. Labels of nodes, edges and graphs become strings.

    Vertices without an edge and graphs without one are dropped. Of repeated or reversed edges the last label wins. Vertices are
    numbered by their graph's first line in the edge file, then by their own first appearance there. An edge between two
    graphs raises an error when the tables are read.
    """
    part = lambda name: f"{directory}/{dataset}/{dataset}_{name}.txt"
    nodes = numbered_lines(spark, part("graph_indicator"), 1).select(F.col("n").alias("v"), F.col("value").cast("long").alias("gid"))
    ends = F.split("value", ",")
    lines = _placed_lines(spark, part("A"), 0).select(F.col("n").alias("eid"), F.trim(ends[0]).cast("long").alias("a"), F.trim(ends[1]).cast("long").alias("b"), "split")
    if _follow_edges(lines, nodes.agg(F.max("v")).first()[0] or 0):
        numbers, vid = nodes, lambda v, _: F.col(v) - 1  # a vertex's number need not move with it
    else:
        seen = lines.select(F.explode(F.array(F.struct(F.col("a").alias("v"), (2 * F.col("eid")).alias("at")), F.struct(F.col("b").alias("v"), (2 * F.col("eid") + 1).alias("at")))).alias("x"))
        seen = seen.groupBy(F.col("x.v").alias("v")).agg(F.min("x.at").alias("at")).join(nodes, "v")
        numbers = ranked(seen.join(seen.groupBy("gid").agg(F.min("at").alias("first")), "gid"), ["first", "at"], "vid").select("v", "gid", "vid")
        vid = lambda _, number: F.col(number)
    vertices = numbers
    if exists(spark, part("node_labels")):
        vertices = vertices.join(numbered_lines(spark, part("node_labels"), 1).select(F.col("n").alias("v"), F.col("value").alias("label")), "v", "left")
    else:
        vertices = vertices.withColumn("label", F.lit(None).cast("string"))
    lines = lines.select("eid", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    if exists(spark, part("edge_labels")):
        lines = lines.join(numbered_lines(spark, part("edge_labels"), 0).select(F.col("n").alias("eid"), F.col("value").alias("label")), "eid", "left")
    else:
        lines = lines.withColumn("label", F.lit(None).cast("string"))
    # Repeated edges meet where their lower end was looked up, so each line moves once by either end.
    of = lambda side: numbers.select(*(F.col(c).alias(side if c == "v" else f"{side}_{c}") for c in numbers.columns))
    links = lines.join(of("low"), "low", "left").groupBy("low", "high", *of("low").columns[1:]).agg(F.max_by("label", "eid").alias("label")).join(of("high"), "high", "left")
    check = F.assert_true(F.col("low_gid").eqNullSafe(F.col("high_gid")), F.lit("an edge links two graphs"))
    links = links.withColumn("_ok", check).where("_ok is null")
    low, high = vid("low", "low_vid"), vid("high", "high_vid")
    edges = stored(links.select(F.least(low, high).alias("src"), F.greatest(low, high).alias("dst"), F.col("low_gid").alias("gid"), "label")).where("gid is not null").withColumn("weight", F.lit(1.0))
    graphs = numbered_lines(spark, part("graph_labels"), 1).select(F.col("n").alias("gid"), F.col("value").alias("graph_label"))
    return GraphSet(vertices.select(vid("v", "vid").alias("vid"), "gid", F.col("v").cast("string").alias("orig_id"), "label"), symmetric(edges), graphs.join(numbers.select("gid").distinct(), "gid", "left_semi"))
