"""Merkle manifest of a table: a tree over each group's rows, a tree over the groups' roots, and every row's proof.

A digest is the lowercase hex SHA-256, and digests are put together as hex text. Rows of a group stand in order; every run of ``fanout``
nodes becomes one node (the last run may be shorter, down to a single node) until one is left. Trees are cut into aligned blocks of a
power of ``fanout`` nodes: a block is one matrix of 64 bytes a node, whose levels are reshaped runs, and siblings are found by index
arithmetic. The nodes over the blocks form a table of the same kind, a thousandth in size, so no task holds more than a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tune

#: Blocks hold the largest power of the fanout up to this, and one run at least.
BLOCK_NODES = 1024
_HEX = 64
_PATH = "array<struct<before:string,after:string>>"


def leaf_digest(*values: Column) -> Column:
    """SHA-256 over the values: ``-`` for null, else the value's length in UTF-8 bytes, a colon and the value as text."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(value.isNull(), F.lit(b"-")).otherwise(F.concat(F.octet_length(text).cast("string").cast("binary"), F.lit(b":"), text.cast("binary"))))
    return F.sha2(F.concat(*parts), 256)


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _matrix(digests: list[str] | str) -> np.ndarray:
    text = digests if isinstance(digests, str) else "".join(digests)
    return np.frombuffer(text.encode(), np.uint8).reshape(-1, _HEX)


def block_power(fanout: int) -> int:
    """How many levels a block has."""
    if fanout < 2:
        raise ValueError("a run holds two nodes at least")
    power = 1
    while fanout ** (power + 1) <= BLOCK_NODES:
        power += 1
    return power


def height(nodes: int, fanout: int) -> int:
    """Levels above ``nodes`` nodes, up to the one node that remains."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def tree_levels(nodes: np.ndarray, fanout: int, levels: int) -> list[np.ndarray]:
    """The nodes and the ``levels`` levels above them, each a matrix of one digest a row."""
    out, width = [nodes], fanout * _HEX
    for _ in range(levels):
        data = out[-1].tobytes()  # rows of a run lie side by side: the matrix reshaped by the fanout
        out.append(_matrix([_digest(data[at : at + width]) for at in range(0, len(data), width)]))
    return out


def siblings(count: int, fanout: int, level: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``count`` leaves, where the others of its run stand among a level's ``nodes`` nodes, and which of these places exist."""
    own = np.arange(count) // fanout**level
    others = np.arange(fanout - 1)
    places = (own // fanout * fanout)[:, None] + others + (others >= (own % fanout)[:, None])
    return places, places < nodes


def proofs(levels: list[np.ndarray], fanout: int) -> tuple[bytes, np.ndarray]:
    """Siblings of every leaf, level by level and left to right: all as one text, and where each leaf's begin (one more for the end)."""
    count = len(levels[0])
    if len(levels) == 1:
        return b"", np.zeros(count + 1, np.int64)
    found = [siblings(count, fanout, k, len(nodes)) for k, nodes in enumerate(levels[:-1])]
    there = np.concatenate([own for _, own in found], axis=1)
    text = np.concatenate([nodes[np.minimum(places, len(nodes) - 1)] for nodes, (places, _) in zip(levels, found, strict=False)], axis=1)[there]
    return text.tobytes(), np.concatenate(([0], np.cumsum(there.sum(axis=1)))) * _HEX


def fold(leaves: np.ndarray, levels: list[np.ndarray], fanout: int) -> np.ndarray:
    """The block's root as each leaf gives it by itself, together with its siblings."""
    now, own = leaves, np.arange(len(leaves))
    for nodes in levels[:-1]:
        runs, slot = own // fanout, own % fanout
        padded = np.concatenate((nodes, np.zeros((-len(nodes) % fanout, _HEX), np.uint8))).reshape(-1, fanout, _HEX)
        mine = padded[runs]
        mine[np.arange(len(now)), slot] = now
        width, data = fanout * _HEX, mine.tobytes()
        sizes = np.minimum(fanout, len(nodes) - runs * fanout) * _HEX
        now = _matrix([_digest(data[at * width : at * width + size]) for at, size in enumerate(sizes.tolist())])
        own = runs
    return now


def _placed(keep: Scratch, rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``pos`` (their place in their group ``k``) and ``n`` (the group's size): sorted into ranges, counted by range, and shifted by
    what the ranges before hold, so that a group that holds all rows is in as many tasks as there are ranges."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = keep.save(rows.repartitionByRange("k", *order).sortWithinPartitions("k", *order).withColumn("part", F.spark_partition_id()).withColumn("at", at))
    runs = ranged.groupBy("k", "part").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("k", "part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(Window.partitionBy("k")).alias("n"))
    return ranged.join(runs, ["k", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _blocks(keep: Scratch, nodes: DataFrame, fanout: int, carried: list[str]) -> DataFrame:
    """(k, n, block, carried columns as lists, leaf: digests put together, node: the block's root), one row a block."""
    power = block_power(fanout)
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}

    def reduce(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos").combine_chunks()
        n = rows.column("n")[0].as_py()
        leaves = "".join(rows.column("leaf").to_pylist())
        root = tree_levels(_matrix(leaves), fanout, min(power, height(n, fanout)))[-1].tobytes().decode()
        lists = {c: pa.array([rows.column(c).to_pylist()], pa.list_(rows.schema.field(c).type)) for c in carried}
        return pa.table({"k": rows.column("k").slice(0, 1), "n": pa.array([n], pa.int64()), "block": rows.column("block").slice(0, 1), **lists, "leaf": [leaves], "node": [root]})

    schema = "k string, n long, block long, " + "".join(f"`{c}` array<{kinds[c]}>, " for c in carried) + "leaf string, node string"
    dealt = nodes.select("k", "n", F.floor(F.col("pos") / fanout**power).cast("long").alias("block"), "pos", *carried, "leaf")
    return keep.save(dealt.groupBy("k", "block").applyInArrow(reduce, schema))


def _grow(keep: Scratch, nodes: DataFrame, fanout: int, carried: list[str]) -> list[DataFrame]:
    """Tables of blocks, from the leaves up to where every group has one block."""
    size, out = fanout ** block_power(fanout), []
    while True:
        out.append(_blocks(keep, nodes, fanout, carried))
        if (out[-1].agg(F.max("n")).first()[0] or 0) <= size:
            return out
        nodes, carried = out[-1].where(F.col("n") > size).select("k", F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("block").alias("pos"), F.col("node").alias("leaf")), []


def _paths(text: list[str], fanout: int, above: list[dict]) -> list[list[dict]]:
    """For each leaf of a block its siblings (before, after) level by level, then those above the block. ``text``: the levels as hex text."""
    out = []
    for own in range(len(text[0]) // _HEX):
        path = []
        for nodes in text[:-1]:
            first = own // fanout * fanout
            path.append({"before": nodes[first * _HEX : own * _HEX], "after": nodes[(own + 1) * _HEX : (first + fanout) * _HEX]})
            own //= fanout
        out.append(path + above)
    return out


def _opened(row: dict, fanout: int, power: int) -> list[str]:
    """The levels of a stored block as hex text."""
    return [m.tobytes().decode() for m in tree_levels(_matrix(row["leaf"]), fanout, min(power, height(row["n"], fanout)))]


def _descend(levels: list[DataFrame], tops: DataFrame | None, fanout: int) -> DataFrame:
    """(k, block, path: siblings above the block, extra columns of ``tops``) of the lowest blocks. ``tops`` gives (k, path, ...) from a group's root on."""
    power = block_power(fanout)
    size = fanout**power
    extra = [f for f in tops.schema.fields if f.name not in ("k", "path")]

    def opened(batches):
        for batch in batches:
            out = {name: [] for name in batch.schema.names if name not in ("n", "leaf")}
            for row in batch.to_pylist():
                paths = _paths(_opened(row, fanout, power), fanout, row["path"])
                for name in out:
                    out[name] += paths if name == "path" else range(row["block"] * size, row["block"] * size + len(paths)) if name == "block" else [row[name]] * len(paths)
            yield pa.RecordBatch.from_pydict({name: pa.array(values, batch.schema.field(name).type) for name, values in out.items()})

    paths = None
    for level, blocks in reversed(list(enumerate(levels))):
        finished = blocks.where(F.col("n") <= size).join(tops, "k")
        if paths is not None:
            finished = finished.select("k", "n", "block", "leaf", "path", *(f.name for f in extra)).unionByName(
                blocks.where(F.col("n") > size).join(paths, ["k", "block"]).select("k", "n", "block", "leaf", "path", *(f.name for f in extra)))
        rows = finished.select("k", "block", "n", "leaf", "path", *(f.name for f in extra))
        if level == 0:
            return rows.drop("n", "leaf")
        schema = f"k string, block long, path {_PATH}" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)
        paths = rows.select("k", "block", "n", "leaf", "path", *(f.name for f in extra)).mapInArrow(opened, schema)
    raise AssertionError("a tree has one table of blocks at least")


def manifest(df: DataFrame, columns: list[str], group_col: str = "lang", id_col: str = "doc_id", fanout: int = 2, claimed: Column | None = None) -> DataFrame:
    """One row for each row of ``df``: id, leaf, subroot (of its group), root, proof (its siblings up to the root, put together), folded_root
    and verified.

    A leaf is the digest of ``columns``. Leaves of a group ascend by id (nulls first; equal ids by leaf); groups ascend by their text's bytes, null first.
    ``claimed`` (default: the leaf) is the leaf digest that a holder shows: ``folded_root`` is the root that it gives with the original siblings, and
    ``verified`` whether that is the root. Nulls and empty texts have digests like any value; repeated rows are leaves of their own; an
    empty table gives no row (and so no root); other columns are left out.
    """
    spark = df.sparkSession
    tune(spark)
    keep, power = Scratch(spark, "merkle"), block_power(fanout)
    leaf = leaf_digest(*(F.col(c) for c in columns))
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("k"), F.col(id_col).alias("id"), leaf.alias("leaf"),
        (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"), F.monotonically_increasing_id().alias("tie"))
    # Texts are read once; a claim that equals the leaf need not be kept.
    read = keep.save(rows.withColumn("claimed", F.nullif("claimed", "leaf")))
    leaves = _placed(keep, read, ["id", "leaf", "tie"]).drop("tie")
    groups = _grow(keep, leaves, fanout, ["id", "claimed"])
    keep.drop(read)

    size = fanout**power
    subroots = None
    for blocks in groups:
        done = blocks.where(F.col("n") <= size).select("k", F.col("node").alias("leaf"))
        subroots = done if subroots is None else subroots.unionByName(done)
    top = _placed(keep, subroots.select(F.lit("").alias("k"), F.col("k").alias("group"), "leaf"), ["group"])
    whole = _grow(keep, top, fanout, ["group"])
    root = whole[-1].where(F.col("n") <= size).select("k", F.array().cast(_PATH).alias("path"), F.col("node").alias("root"))
    over = whole[0].drop("node").join(_descend(whole, root, fanout), ["k", "block"])
    plan = [("k", pa.string()), ("subroot", pa.string()), ("root", pa.string())]

    def named(batches):
        """Groups with the path from their subroot to the root."""
        for batch in batches:
            for row in batch.to_pylist():
                text = _opened(row, fanout, power)
                paths = _paths(text, fanout, row["path"])
                values = {"k": row["group"], "subroot": [text[0][i * _HEX : (i + 1) * _HEX] for i in range(len(paths))], "root": [row["root"]] * len(paths)}
                yield pa.RecordBatch.from_pydict({**{c: pa.array(values[c], kind) for c, kind in plan}, "path": pa.array(paths, batch.schema.field("path").type)})

    tops = keep.save(over.mapInArrow(named, f"k string, subroot string, root string, path {_PATH}"))
    lowest = groups[0].drop("node").join(_descend(groups, tops, fanout), ["k", "block"])

    def proven(batches):
        for batch in batches:
            ids = batch.schema.get_field_index("id")
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("n", "leaf", "claimed", "path", "subroot", "root")}
                levels = tree_levels(_matrix(row["leaf"]), fanout, min(power, height(row["n"], fanout)))
                own = [row["leaf"][i : i + _HEX] for i in range(0, len(row["leaf"]), _HEX)]
                text, starts = proofs(levels, fanout)
                above = "".join(p["before"] + p["after"] for p in row["path"])
                found = fold(_matrix([c or x for c, x in zip(row["claimed"], own, strict=True)]), levels, fanout).tobytes().decode()
                folded = []
                for at in range(0, len(found), _HEX):
                    now = found[at : at + _HEX]
                    for p in row["path"]:
                        now = _digest((p["before"] + now + p["after"]).encode())
                    folded.append(now)
                text = text.decode()
                yield pa.RecordBatch.from_arrays([
                    batch.column(ids)[r].values, pa.array(own, pa.string()), pa.array([row["subroot"]] * len(own), pa.string()), pa.array([row["root"]] * len(own), pa.string()),
                    pa.array([text[a:b] + above for a, b in zip(starts, starts[1:], strict=False)], pa.string()), pa.array(folded, pa.string()), pa.array([x == row["root"] for x in folded], pa.bool_()),
                ], names=[id_col, "leaf", "subroot", "root", "proof", "folded_root", "verified"])

    kind = df.schema[id_col].dataType.simpleString()
    return lowest.mapInArrow(proven, f"`{id_col}` {kind}, leaf string, subroot string, root string, proof string, folded_root string, verified boolean")


def tampered_leaf(columns: list[str], changed: str = "n_chars", id_col: str = "doc_id", every: int = 7) -> Column:
    """The leaf digest with 1 added to a column where ``every`` divides the unsigned CRC-32 of the id as text; nulls stay."""
    more = (F.col(changed).cast("decimal(38,0)") + 1).cast("string")
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    return F.when(hit & F.col(changed).isNotNull(), leaf_digest(*(more if c == changed else F.col(c) for c in columns)))
