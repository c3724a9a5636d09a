"""K-means over whole-number vectors with multiplicities, as gradual refinement uses it: in one task, or as Spark aggregations.

Draws come from a hash of (seed, restart, round, id of the vector), so both ways choose alike, and so does any engine with an MD5.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, ranked, small

METHODS = ("forgy", "kmeans++", "first")


def draws(seed: int, restart: int, turn: int, ids: np.ndarray) -> np.ndarray:
    """A number in (0, 1] for each id: 52 bits of an MD5."""
    return np.array([(int(hashlib.md5(f"{seed}:{restart}:{turn}:{i}".encode()).hexdigest()[:13], 16) + 1) / 4503599627370496.0 for i in ids.tolist()])


def drawn(seed: int, restart: Column, turn: int, ids: Column) -> Column:
    """The same as a column."""
    bits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), restart.cast("string"), F.lit(str(turn)), ids.cast("string")).cast("binary")), 1, 13)
    return (F.conv(bits, 16, 10).cast("long") + 1).cast("double") / F.lit(4503599627370496.0)


def _distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, points by centres."""
    return np.stack([np.square(points - c).sum(axis=1) for c in centers], axis=1)


def _lloyd(points: np.ndarray, weights: np.ndarray, centers: np.ndarray, most: int, truncate: bool) -> tuple[np.ndarray, np.ndarray]:
    """Assign to the nearest centre (ties: the first) and move centres to their members' mean, until memberships stay or ``most``
    passes and one more were made; the memberships returned are those of the pass before the last."""
    before = np.full(len(points), -1)
    centers = centers if truncate else centers.astype(float)
    for turn in range(1, most + 2):
        now = _distances(points, centers).argmin(axis=1)
        for c in np.unique(now):
            own = now == c
            centers[c] = (points[own] * weights[own, None]).sum(axis=0) / weights[own].sum()
        if turn > most or np.array_equal(before, now):
            break
        before = now
    return before, centers


def _scatter(points: np.ndarray, weights: np.ndarray, centers: np.ndarray, members: np.ndarray) -> float:
    """Sum of squared squared distances: the score that picks among restarts."""
    own = np.square(points - centers[members]).sum(axis=1)
    return float((np.square(own) * weights).sum())


def cluster(
    points: np.ndarray, weights: np.ndarray, k: int, method: str = "kmeans++", most: int = 100, restarts: int = 15, seed: int = 1234, truncate_centers: bool = True, ids: np.ndarray | None = None
) -> np.ndarray:
    """The cluster of each distinct row of ``points`` (sorted rows, each standing for ``weights`` vectors and known by its id, by default its place).

    At most as many clusters as rows. Centres are kept as whole numbers (means are cut off) unless ``truncate_centers`` is off.
    ``first``: the first rows are the starts, so nothing is drawn. ``forgy``: ``restarts`` random choices of rows, the one with the least scatter wins, the first of equals. ``kmeans++``: each
    next centre is drawn among the other rows in proportion to the squared distance to the nearest centre so far (the largest ``log(u) / weight`` wins).
    """
    if method not in METHODS:
        raise ValueError(f"unknown initialisation {method!r}")
    k = min(k, len(points))
    if k == 1:
        return np.zeros(len(points), dtype=np.int64)
    ids = np.arange(len(points)) if ids is None else ids
    if method == "first":
        return _lloyd(points, weights, points[:k].copy(), most, truncate_centers)[0]
    if method == "forgy":
        starts = [points[np.lexsort((ids, draws(seed, r, 0, ids)))[:k]].copy() for r in range(restarts)]
        runs = [_lloyd(points, weights, s, most, truncate_centers) for s in starts]
        return min(runs, key=lambda r: _scatter(points, weights, r[1], r[0]))[0]
    chosen = [int(np.lexsort((ids, draws(seed, 0, 0, ids)))[0])]
    near = np.square(points - points[chosen[0]]).sum(axis=1)
    while len(chosen) < k:
        left = np.flatnonzero(near > 0)
        keys = np.log(draws(seed, 0, len(chosen), ids[left])) / near[left]
        chosen.append(int(left[np.lexsort((ids[left], -keys))[0]]))
        near = np.minimum(near, np.square(points - points[chosen[-1]]).sum(axis=1))
    return _lloyd(points, weights, points[chosen].copy(), most, truncate_centers)[0]


def cluster_tables(kinds: DataFrame, k: int, method: str = "kmeans++", most: int = 100, restarts: int = 15, seed: int = 1234, truncate_centers: bool = True) -> DataFrame:
    """(color, hid, cluster) of (color, hid, weight, hist: sorted (key, n)): ``cluster`` for every colour at once, as joins and aggregations over sparse entries.

    A restart is a key next to the colour. No task holds a colour: vectors lie by (color, hid) and few centres go to all of them; distances are |x|^2 + |c|^2 - 2 x c, with the products summed over the keys
    that a vector and a centre share. Each turn sends one number to the driver.
    """
    own = ["color", "hid"]
    few = lambda rows: small(rows, rows.count())
    kinds = kinds.repartition(*own)
    x = cut(kinds.select(*own, "weight", F.explode("hist").alias("e")).select(*own, "weight", "e.key", "e.n"))
    norms = cut(kinds.select(*own, "weight", F.aggregate("hist", F.lit(0).cast("long"), lambda s, e: s + e["n"] * e["n"]).alias("sq")))

    def products(centers: DataFrame) -> DataFrame:
        return x.join(few(centers), ["color", "key"]).groupBy(*own, "r", "c").agg(F.sum(F.col("n") * F.col("v")).alias("dot"))

    def distances(centers: DataFrame, heads: DataFrame) -> DataFrame:
        """(color, hid, weight, r, c, d) of every vector and centre of its colour. ``heads``: (color, r, c), also centres without an entry."""
        lengths = centers.groupBy("color", "r", "c").agg(F.sum(F.col("v") * F.col("v")).alias("cc"))
        known = cut(heads.join(lengths, ["color", "r", "c"], "left"))
        met = norms.join(few(known), "color").join(products(centers), [*own, "r", "c"], "left")
        return met.select(*own, "weight", "r", "c", (F.col("sq") + F.coalesce("cc", F.lit(0)) - 2 * F.coalesce("dot", F.lit(0))).alias("d"))

    def entries(chosen: DataFrame) -> DataFrame:
        return cut(x.join(few(chosen), own).select("color", "r", "c", "key", F.col("n").alias("v")))

    zero = F.lit(0)
    if method == "kmeans++":
        first = norms.groupBy("color").agg(F.min_by("hid", F.struct(drawn(seed, zero, 0, F.col("hid")), "hid")).alias("hid"))
        newest = cut(first.select("color", "hid", zero.alias("r"), zero.alias("c")))
        starts, near = newest, None
        for turn in range(1, k):
            d = distances(entries(newest), newest.select("color", "r", "c")).select(*own, "weight", F.col("d").alias("near"))
            near = cut(d if near is None else near.join(d.withColumnRenamed("near", "new"), [*own, "weight"]).select(*own, "weight", F.least("near", "new").alias("near")))
            key = F.log(drawn(seed, zero, turn, F.col("hid"))) / F.col("near")
            newest = cut(near.where("near > 0").groupBy("color").agg(F.min_by("hid", F.struct(-key, "hid")).alias("hid")).select("color", "hid", zero.alias("r"), F.lit(turn).alias("c")))
            if not newest.limit(1).count():
                break
            starts = cut(starts.unionByName(newest))
    else:
        if method == "forgy":
            tried = norms.select(*own).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
            order = [drawn(seed, F.col("r"), 0, F.col("hid")), F.col("hid")]
        else:  # the first rows in the order of whole vectors: a smaller key in use, or more of it, comes later
            keys = x.select("key").distinct()
            numbers = ranked(keys, ["key"], "kid", 0)
            lists = x.join(numbers, "key").groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("kid", "n"))).alias("l"))
            lists = norms.select(*own).join(lists, own, "left")
            order = [F.coalesce(F.transform("l", lambda e: F.struct((-e["kid"]).alias("a"), e["n"].alias("n"))), F.array().cast("array<struct<a:bigint,n:bigint>>"))]
            tried = lists.withColumn("r", zero)
        place = F.row_number().over(Window.partitionBy("color", "r").orderBy(*order)) - 1  # a limit of k goes before the shuffle
        starts = cut(tried.withColumn("c", place).where(F.col("c") < k).select(*own, "r", "c"))
    heads = cut(starts.select("color", "r", "c"))
    centers, before = entries(starts), None
    for turn in range(1, most + 2):
        now = cut(distances(centers, heads).groupBy(*own, "weight", "r").agg(F.min(F.struct("d", "c")).alias("m")).select(*own, "weight", "r", F.col("m.c").alias("c")))
        sizes = now.groupBy("color", "r", "c").agg(F.sum("weight").alias("w"))
        sums = x.drop("weight").join(now, own).groupBy("color", "r", "c", "key").agg(F.sum(F.col("weight") * F.col("n")).alias("s")).join(sizes, ["color", "r", "c"])
        mean = F.floor(F.col("s") / F.col("w")).cast("long") if truncate_centers else F.col("s") / F.col("w")
        moved = sums.select("color", "r", "c", "key", mean.alias("v")).where("v <> 0")
        centers = cut(moved.unionByName(centers.join(sizes, ["color", "r", "c"], "left_anti")))
        if before is not None and not now.join(before.withColumnRenamed("c", "was"), [*own, "weight", "r"]).where("c <> was").limit(1).count():
            break
        if turn > most:
            break
        before = now
    if method != "forgy" or restarts == 1:
        return before.select(*own, F.col("c").cast("long").alias("cluster"))
    scored = distances(centers, heads).join(before, [*own, "weight", "r", "c"]).groupBy("color", "r").agg(F.sum(F.col("d").cast("double") * F.col("d") * F.col("weight")).alias("score"))
    best = scored.groupBy("color").agg(F.min(F.struct("score", "r")).alias("m")).select("color", F.col("m.r").alias("r"))
    return before.join(best, ["color", "r"]).select(*own, F.col("c").cast("long").alias("cluster"))
