"""SimHash near-deduplication: exact pairs within a Hamming radius by vantage-point partitioning.

Fingerprints are partitioned by their Hamming distances (rings) to a few vantage points. By the triangle inequality two
fingerprints within the radius lie in rings that differ by the radius at most; moreover distance and ring difference
have the same parity. So a fingerprint is a member of the shard of its own rings and is sent as a query to the
boundary-overlapping shards alone. Shards are counted before anything is sent; one with too many members is cut by the rings
of further vantage points in the same way. Inside a shard a vantage-point tree prunes on. A shard returns a spanning
forest of its links, never all pairs of a group.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, find_words, hash_bound, hash_words, raw, slices, splitmix, text_bytes, tune, window_hashes
from .components import Forest, components
from .decontaminate import shingles

_XXH64 = xxhash.xxh64_intdigest


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """A-Z lower-cased words in shingles of ``size`` (fewer words: all of them), each hashed by XXH64; a bit is 1 if set in
    over half of the hashes. No words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.fromiter((_XXH64(joined[a:b], seed) for a, b in spans), U64, len(words) - k + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the 64-bit fingerprint as a signed long."""
    tune(docs.sparkSession)

    def run(batches):
        for batch in slices(batches):
            prints = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], dtype=U64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return text_bytes(docs).mapInArrow(run, "doc_id bigint, fp bigint")


def choose_vantage_points(sample: np.ndarray, levels: int, candidates: int = 64) -> list[int]:
    """The sample's fingerprints whose rings together spread the sample most evenly (highest joint entropy)."""
    rng = np.random.default_rng(7)
    pool = rng.choice(sample, min(candidates, len(sample)), replace=False) if len(sample) else np.zeros(1, U64)
    chosen: list[int] = []
    keys = np.zeros(len(sample), np.int64)
    for _ in range(levels):
        best = None
        for v in pool:
            own = keys * 65 + np.bitwise_count(sample ^ v)
            _, n = np.unique(own, return_counts=True)
            entropy = -(n / n.sum() * np.log(n / n.sum())).sum() if len(n) else 0.0
            if best is None or entropy > best[0] + 1e-12:
                best = (entropy, int(v), own)
        chosen.append(best[1])
        keys = best[2]
    return chosen


def ring_steps(levels: int, radius: int) -> list[tuple[int, ...]]:
    """Ring differences that pairs within the radius can have, each pair in one direction: own rings first."""
    own = (0,) * levels
    return [own] + [s for s in product(range(-radius, radius + 1), repeat=levels) if s > own and len({x & 1 for x in s}) == 1]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one or more 64-bit words (last axis)."""
    bits = np.bitwise_count(a ^ b)
    return bits[..., 0] if bits.shape[-1] == 1 else bits.sum(axis=-1, dtype=np.int32)


class VantageTree:
    """Links between ``members`` and between members and ``queries`` (positions in ``prints``, fingerprints by words), into a forest."""

    def __init__(self, prints: np.ndarray, radius: int, leaf: int = 2048):
        self.prints, self.radius, self.leaf, self.forest = prints.reshape(len(prints), -1), radius, leaf, Forest(len(prints))

    def search(self, members: np.ndarray, queries: np.ndarray, depth: int = 0) -> None:
        """``queries`` holds positions to compare with ``members``; positions in both are members among themselves."""
        if not len(members) or not len(queries):
            return
        if len(members) <= self.leaf or depth >= 12:
            step = max(1, (1 << 20) // (len(members) * self.prints.shape[1]))
            for at in range(0, len(queries), step):
                own = queries[at : at + step]
                i, j = np.nonzero(distances(self.prints[own][:, None], self.prints[members][None, :]) <= self.radius)
                self.forest.link(own[i], members[j])
            return
        pivot = self.prints[members[len(members) // 2]]
        dm, dq = (distances(self.prints[x], pivot).astype(np.int64) for x in (members, queries))
        order = np.argsort(dm, kind="stable")
        members, dm = members[order], dm[order]
        rings, firsts = np.unique(dm, return_index=True)
        if dm[-1] - dm[0] <= self.radius:  # no ring would be pruned
            return self.search(members, queries, 12)
        for ring, first, last in zip(rings, firsts, np.append(firsts[1:], len(dm)), strict=True):
            self.search(members[first:last], queries[np.abs(dq - ring) <= self.radius], depth + 1)


def links(points: DataFrame, radius: int = 3, levels: int | None = None, largest_shard: int = 1000) -> DataFrame:
    """(a, b): a spanning forest, shard by shard, of the graph that links points whose fingerprints differ in ``radius``
    bits at most. ``points``: distinct ``fp`` with the node ``rep``. Every link is covered by a path of returned ones.
    Shards of over ``largest_shard`` members are cut by the rings of one more vantage point, those 64 times as large by two.
    """
    spark = points.sparkSession
    tune(spark)
    count = points.count()
    levels = levels or (2 if count < 1_000_000 else 3 if count < 30_000_000 else 4)
    share = min(1.0, 8192 / max(1, count))
    sample = points.where(F.xxhash64("fp") <= F.lit(hash_bound(share))).select("fp").limit(20_000).toArrow()
    vantage = choose_vantage_points(np.sort(sample.column("fp").to_numpy().view(U64)), levels + 2)
    rings = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(v - (1 << 64) if v >> 63 else v).cast("long"))) for v in vantage]
    keyed = points.select("fp", "rep", *[x.alias(f"r{i}") for i, x in enumerate(rings)])
    shard_of = lambda step: sum(((F.col(f"r{i}") + step[i]).cast("long") * 65**i for i in range(levels)), F.lit(0).cast("long"))
    inside = lambda step, first: _all((F.col(f"r{first + i}") + x).between(0, 64) for i, x in enumerate(step))
    # (shard, whether the point is a member of it, whether its distances to the shard's members are odd)
    sent = keyed.withColumn("to", F.explode(F.array_compact(F.array(*[
        F.when(inside(s, 0), F.struct(shard_of(s).alias("shard"), F.lit(not any(s)).alias("member"), F.lit(bool(s[0] & 1)).alias("odd"))) for s in ring_steps(levels, radius)])))).select("fp", "rep", f"r{levels}", f"r{levels + 1}", "to.*")
    large = keyed.groupBy(shard_of((0,) * levels).alias("shard")).agg(F.count("*").alias("n")).where(F.col("n") > largest_shard)
    large = large.select("shard", F.when(F.col("n") > 64 * largest_shard, 2).otherwise(1).alias("more")).collect()  # one row for each ``largest_shard`` points at most
    sub = F.lit(-1).cast("long")
    if large:
        sizes = spark.createDataFrame(large, "shard long, more int")
        sent = sent.join(F.broadcast(sizes) if len(large) <= 500_000 else sizes, "shard", "left")

        def cuts(more: int):
            """Where a row goes inside a shard that is cut by so many vantage points. A member meets the members of its own cut and, as a
            query, those of later ones; a query meets all cuts that the triangle bound leaves."""
            steps = [s for s in product(range(-radius, radius + 1), repeat=more) if len({x & 1 for x in s}) == 1]
            at = lambda s: sum(((F.col(f"r{levels + i}") + x).cast("long") * 65**i for i, x in enumerate(s)), F.lit(more << 40).cast("long"))
            right = lambda s: F.when(F.col("member"), F.lit(s >= (0,) * more and not s[0] & 1)).otherwise(F.col("odd") == F.lit(bool(s[0] & 1)))
            return F.array_compact(F.array(*[F.when(right(s) & inside(s, levels), F.struct(at(s).alias("sub"), (F.col("member") & F.lit(not any(s))).alias("member"))) for s in steps]))

        whole = F.array(F.struct(sub.alias("sub"), F.col("member").alias("member")))
        sent = sent.withColumn("cut", F.explode(F.when(F.col("more") == 2, cuts(2)).when(F.col("more") == 1, cuts(1)).otherwise(whole))).select("shard", "cut.sub", "cut.member", "fp", "rep")
    else:
        sent = sent.select("shard", sub.alias("sub"), "member", "fp", "rep")

    def solve(table: pa.Table) -> pa.Table:
        prints = table.column("fp").to_numpy().view(U64)
        member = table.column("member").to_numpy(zero_copy_only=False)
        reps = table.column("rep").to_numpy()
        tree = VantageTree(prints, radius)
        if member.any():
            tree.search(np.flatnonzero(member), np.arange(len(prints)))
        return _edges(tree.forest, reps)

    return sent.groupBy("shard", "sub").applyInArrow(solve, "a bigint, b bigint")


def _all(tests):
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: 16 lowercase hex digits and the smallest doc_id reachable by links of
    ``radius`` differing bits at most.

    Null and empty texts have the fingerprint zero and link like any other. Equal fingerprints are one node, so copies cost
    nothing. Rows with a null doc_id get a fingerprint and, if their fingerprint is shared or linked, its component.
    Repeated rows stay; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, size))
    points = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(points.where("rep is not null"), radius), scratch)
    labelled = points.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(labelled, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """The documents whose id is their component's smallest; of repeated rows of that id one stays. Rows with a null id stay."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash-keep")
    groups = scratch.save(near_duplicates(docs, radius, size).where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct())
    return semi(docs, groups, "left_anti").select(*docs.columns)


SKETCH_WORDS, BANDS, BAND_ROWS = 4, 10, 3
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def similarity_radius(similarity: float, bits: int = 64 * SKETCH_WORDS) -> int:
    """Differing bits that two texts of a Jaccard similarity have on average: equally large sets have the cosine 2s / (1 + s)."""
    return int(bits * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of ``size`` lower-cased words of each text."""
    buf, offsets = raw(texts)
    buf = _LOWER[buf]
    starts, ends, first = find_words(buf, offsets)
    words = hash_words(buf, starts, ends)
    return [np.unique(shingles(words[a:b], size)) for a, b in zip(first, first[1:], strict=False)]


def sketches(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, s0, s1, n, p0, ..., p3, bands), all of the set of shingles of ``size`` lower-cased words: a 128-bit hash that names the
    set, its size, a 256-bit SimHash, and ten keys, each of three minimum hashes, which texts of similarity 0.8 share at least one of
    in 99.9 of 100 cases."""
    tune(docs.sparkSession)
    salts = splitmix(np.arange(BANDS * BAND_ROWS, dtype=U64) + U64(0x5A17))

    def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        total = np.zeros(64 * SKETCH_WORDS, np.int64)
        least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, U64)
        name = np.zeros(2, U64)
        for at in range(0, len(hashes), 1 << 14):
            own = hashes[at : at + (1 << 14)]
            words = np.stack([splitmix(own + U64(k)) for k in range(SKETCH_WORDS)], axis=1)
            total += np.unpackbits(words.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint32)
            with np.errstate(over="ignore"):
                for k, salt in enumerate(salts):
                    least[k] = min(least[k], ((own ^ salt) * U64(0x9E3779B97F4A7C15)).min())
                name += np.array([splitmix(own ^ salt).sum(dtype=U64) for salt in salts[:2]])
        keys = window_hashes(least, BAND_ROWS)[::BAND_ROWS]
        return name, np.packbits(2 * total > len(hashes)).view(U64), splitmix(keys + np.arange(BANDS, dtype=U64))

    def run(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), size)
            found = [sketch(s) for s in sets]
            names, prints = (np.array([f[k] for f in found]).view(np.int64) for k in (0, 1))
            bands = pa.array([f[2].view(np.int64) for f in found], pa.list_(pa.int64()))
            columns = [pa.array(x[:, k]) for x in (names, prints) for k in range(x.shape[1])]
            columns.insert(2, pa.array([len(s) for s in sets], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, bands], names=["doc_id", *_SET, "n", *_PRINT, "bands"])

    return text_bytes(docs).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{p} bigint" for p in [*_SET, "n", *_PRINT]) + ", bands array<bigint>")


_SET = ["s0", "s1"]
_PRINT = [f"p{k}" for k in range(SKETCH_WORDS)]


def in_parts(rows: DataFrame, key: str, node: str, largest: int, scratch: Scratch) -> DataFrame:
    """Add ``part``: groups by ``key`` of over ``largest`` rows are cut by ``node`` into parts, and a row goes to every pair of parts that
    holds its own, so that any two rows of a group still meet, in groups of twice ``largest`` at most on average."""
    large = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > largest)
    large = scratch.save(large.select(key, F.ceil(F.col("n") / largest).cast("int").alias("parts")))
    if not large.limit(1).count():
        return rows.withColumn("part", F.lit(0))
    held = rows.join(large, key, "left").withColumn("own", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(node), "parts").cast("int")))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
    return held.withColumn("part", F.greatest("own", "other") * 100_003 + F.least("own", "other")).drop("parts", "own", "other")


def semi(docs: DataFrame, ids: DataFrame, how: str, most: int = 500_000) -> DataFrame:
    """Join by doc_id to a table of distinct ids: broadcast if it has at most ``most`` rows, by shuffle beyond."""
    return docs.join(F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids, "doc_id", how)


def slot_counts(docs: DataFrame, size: int, slots: int) -> np.ndarray:
    """How many texts' shingles fall into each of ``slots`` slots (a hash modulo ``slots``), 65,535 at most."""
    step = min(slots, 1 << 14)

    def count(batches):
        total = np.zeros(slots, np.int64)
        for batch in slices(batches):
            for s in shingle_sets(batch.column("text"), size):
                np.add.at(total, (s % U64(slots)).astype(np.int64), 1)
        own = np.minimum(total, 65_535).astype(np.uint16)
        at = [k for k in range(0, slots, step) if own[k : k + step].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([own[k : k + step].tobytes() for k in at], pa.binary())], names=["at", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(step, np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, np.uint16)
        return pa.table({"at": table.column("at").slice(0, 1), "counts": pa.array([np.minimum(total, 65_535).astype(np.uint16).tobytes()], pa.binary())})

    schema = "at int, counts binary"
    out = np.zeros(slots, np.uint16)
    for row in text_bytes(docs).mapInArrow(count, schema).groupBy("at").applyInArrow(add, schema).toArrow().to_pylist():  # two bytes a slot
        out[row["at"] : row["at"] + step] = np.frombuffer(row["counts"], np.uint16)
    return out


def prefix_length(n: int, similarity: float) -> int:
    """Of two sets with the similarity, these many first shingles each, in any one order of all shingles, have one in common."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def missed_pairs(docs: DataFrame, labels: DataFrame, similarity: float, size: int, shingle_count: int, largest_part: int, scratch: Scratch) -> DataFrame:
    """(a, b): all pairs of the documents of ``labels`` (doc_id, label) of different labels whose shingle sets have the similarity.

    Prefix filtering, exact: shingles are ordered by how common their slot is, and the rarest ``prefix_length`` ones of each text are
    its prefix. Texts that share a prefix shingle, at places and with sizes that allow the similarity, are compared. How good
    the counts are changes the work only, never the result. Shingles of over ``largest_part`` texts are cut into parts.
    """
    spark = docs.sparkSession
    slots = 1 << min(20, max(12, (shingle_count // 32).bit_length()))
    shared = spark.sparkContext.broadcast(slot_counts(docs, size, slots))

    def prefixes(batches):
        counts = shared.value
        for batch in slices(batches):
            rows = []
            for s in shingle_sets(batch.column("text"), size):
                common = counts[(s % U64(slots)).astype(np.int64)]
                order = np.lexsort((s, common))[: prefix_length(len(s), similarity)]
                profile = np.bincount((s >> U64(58)).astype(np.int64), minlength=64).astype(np.int32).tobytes()
                rows.append((len(s), int(np.count_nonzero(common[order] <= largest_part)), s[order].view(np.int64), profile))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n", "cold", "prefix", "profile"])

    def bound(n, m):
        """The least overlap of sets of these sizes with the similarity."""
        return similarity / (1 + similarity) * (n + m) - 1e-6

    def meet(table: pa.Table) -> pa.Table:
        key, doc, label, sizes = (table.column(c).to_numpy() for c in ("key", "doc_id", "label", "sizes"))
        order = np.argsort(key, kind="stable")
        key, doc, label, n, place = (x[order] for x in (key, doc, label, sizes >> 32, sizes & 0xFFFFFFFF))
        live, step, found = np.arange(len(order)), 0, np.zeros((0, 2), np.int64)
        waiting: list[np.ndarray] = []
        while len(live):
            step += 1
            live = live[live + step < len(order)]
            live = live[key[live] == key[live + step]]
            other = live + step
            fit = (label[live] != label[other]) & (np.minimum(n[live] - place[live], n[other] - place[other]) >= bound(n[live], n[other]))
            pairs = np.stack((np.minimum(doc[live[fit]], doc[other[fit]]), np.maximum(doc[live[fit]], doc[other[fit]])), axis=1)
            waiting.append(pairs)
            if sum(map(len, waiting)) > 1 << 20:
                found, waiting = np.unique(np.concatenate([found, *waiting]), axis=0), []
        found = np.unique(np.concatenate([found, *waiting]), axis=0)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    def possible(batches):
        """Pairs whose numbers of shingles in 64 classes allow the similarity."""
        for batch in batches:
            own = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32).reshape(-1, 64) for c in ("pa", "pb")]
            fit = np.minimum(*own).sum(axis=1) >= bound(own[0].sum(axis=1), own[1].sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(fit))

    def sets(batches):
        for batch in slices(batches):
            own = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), size)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), own], names=["doc_id", "shingles"])

    def similar(batches):
        for batch in batches:
            own = zip(*(batch.column(c).to_pylist() for c in ("sa", "sb")), strict=True)
            fit = [_jaccard(np.frombuffer(x, U64), np.frombuffer(y, U64)) >= similarity for x, y in own]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(fit, pa.bool_()))

    # Labels join once, before anything is read twice; what meets carries one key and one word of size and place.
    held = text_bytes(docs).mapInArrow(prefixes, "doc_id bigint, n int, cold int, prefix array<bigint>, profile binary")
    held = scratch.save(semi(held, labels, "inner"))
    rows = held.select("doc_id", "label", "cold", "n", F.posexplode("prefix").alias("place", "shingle"))
    rows = rows.select("doc_id", "label", "cold", "place", "shingle", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("place")).alias("sizes"))
    hot = scratch.save(rows.where("place >= cold").select("doc_id", "label", "shingle", "sizes"))
    parted = in_parts(hot, "shingle", "doc_id", largest_part, scratch)
    # Keys that fall together by chance add pairs to compare, never links.
    rows = rows.where("place < cold").select("doc_id", "label", "sizes", F.col("shingle").alias("key")).unionByName(
        parted.select("doc_id", "label", "sizes", F.xxhash64("shingle", "part").alias("key")))
    shards = max(8, min(1_000_000, int(shingle_count * (1 - similarity)) // 200_000))
    met = rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")).applyInArrow(meet, "a bigint, b bigint").distinct()
    profiles = held.select("doc_id", "profile")
    met = scratch.save(met.where("a <> b"))
    for side in "ab":
        met = met.join(profiles.select(F.col("doc_id").alias(side), F.col("profile").alias(f"p{side}")), side)
    chosen = scratch.save(met.select("a", "b", "pa", "pb").mapInArrow(possible, "a bigint, b bigint").distinct())
    ids = chosen.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    own = scratch.save(text_bytes(semi(docs, scratch.save(ids), "inner")).mapInArrow(sets, "doc_id bigint, shingles binary"))
    for side in "ab":
        chosen = chosen.join(own.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"s{side}")), side)
    return chosen.select("a", "b", "sa", "sb").mapInArrow(similar, "a bigint, b bigint")


def similar_groups(docs: DataFrame, similarity: float = 0.8, size: int = 5, largest_part: int = 20_000) -> DataFrame:
    """(doc_id, component_id): documents linked by a Jaccard similarity of their ``size``-word shingle sets of ``similarity`` or more,
    and what such links connect. No link is lost and none is made without the exact check (up to collisions of 64-bit hashes).

    Texts with the same set of shingles are one node. 256-bit SimHashes of the sets within a radius that pairs at the threshold
    stay inside in 99 of 100 cases propose groups, and the exact similarity decides inside those. At this radius the
    distances to any vantage point say next to nothing (unrelated fingerprints lie 128 bits apart, give or take 8, and a pair
    may differ by 52), so vantage-point trees alone would compare all pairs: fingerprints are dealt into shards by band keys
    first, and trees search inside them. ``missed_pairs`` then finds every link between groups that SimHash did not propose.
    Groups of over ``largest_part`` members are cut into parts, and each pair of parts is a task. Null and empty texts are
    copies of each other; rows with a null id get no group.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    found = scratch.save(sketches(docs, size))
    points = scratch.save(found.groupBy(*_SET).agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n", *_PRINT, "bands"), "doc_id").alias("own")).select(*_SET, "rep", "own.*"))
    radius = similarity_radius(similarity) + 13  # 2.3 standard deviations of a pair at the threshold

    def propose(table: pa.Table) -> pa.Table:
        keys = table.column("band").to_numpy().view(U64) ^ splitmix(table.column("part").to_numpy().astype(U64))
        tree = VantageTree(np.stack([table.column(p).to_numpy().view(U64) for p in _PRINT], axis=1), radius)
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1], [True])))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                tree.search(order[a:b], order[a:b])
        return _edges(tree.forest, table.column("rep").to_numpy())

    dealt = in_parts(points.select("rep", *_PRINT, F.explode("bands").alias("band")), "band", "rep", largest_part, scratch)
    count, shingle_count = points.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(8, min(1_000_000, count * BANDS // 20_000))
    shard = F.pmod(F.xxhash64("band", "part"), F.lit(shards))
    proposed = scratch.save(components(dealt.withColumn("shard", shard).groupBy("shard").applyInArrow(propose, "a bigint, b bigint"), scratch))

    def sets(batches):
        for batch in slices(batches):
            own = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), size)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("component"), own], names=["doc_id", "component", "shingles"])

    def decide(table: pa.Table) -> pa.Table:
        group = table.column("component").to_numpy().astype(U64) ^ splitmix(table.column("part").to_numpy().astype(U64))
        own = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
        counts, forest = np.array([len(x) for x in own]), Forest(len(own))
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1], [True])))
        for a, b in zip(cuts, cuts[1:], strict=False):
            rows = order[a:b]
            for k, i in enumerate(rows[:-1]):
                rest = rows[k + 1 :]
                rest = rest[forest.roots(rest) != forest.roots(np.array([i]))[0]]
                rest = rest[np.minimum(counts[rest], counts[i]) >= similarity * np.maximum(counts[rest], counts[i])]
                linked = [j for j in rest if _jaccard(own[i], own[j]) >= similarity]
                if linked:
                    forest.link(np.full(len(linked), i), np.array(linked))
        return _edges(forest, table.column("doc_id").to_numpy())

    members = proposed.withColumnRenamed("node", "doc_id")
    texts = text_bytes(semi(docs, members, "inner"), "text", "doc_id", "component")
    held = scratch.save(texts.mapInArrow(sets, "doc_id bigint, component bigint, shingles binary"))
    exact = in_parts(held, "component", "doc_id", largest_part // 10, scratch)
    shards = max(8, min(1_000_000, proposed.count() // 1000))
    shard = F.pmod(F.xxhash64("component", "part"), F.lit(shards))
    groups = scratch.save(components(exact.withColumn("shard", shard).groupBy("shard").applyInArrow(decide, "a bigint, b bigint"), scratch))
    nodes = points.select(F.col("rep").alias("node")).distinct().join(groups, "node", "left")
    labels = scratch.save(nodes.select(F.col("node").alias("doc_id"), F.coalesce("component", "node").alias("label")))
    missed = missed_pairs(docs, labels, similarity, size, shingle_count, largest_part, scratch)
    links = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(missed)
    groups = components(links, scratch)
    labelled = points.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(*_SET, F.coalesce("component", "rep").alias("component_id"))
    return found.select("doc_id", *_SET).join(labelled, _SET).select("doc_id", "component_id")


def _edges(forest: Forest, nodes: np.ndarray) -> pa.Table:
    a, b = forest.edges()
    return pa.table({"a": pa.array(nodes[a], pa.int64()), "b": pa.array(nodes[b], pa.int64())})


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted distinct values."""
    merged = np.sort(np.concatenate((a, b)))
    both = np.count_nonzero(merged[1:] == merged[:-1])
    return both / max(1, len(a) + len(b) - both) if len(a) or len(b) else 1.0


def keep_one_of_similar(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """The documents whose id is the smallest of their group of similar ones. Rows of that id, and rows with a null id, all stay."""
    scratch = Scratch(docs.sparkSession, "similar-keep")
    gone = scratch.save(similar_groups(docs, similarity, size).where("doc_id <> component_id").select("doc_id").distinct())
    return semi(docs, gone, "left_anti").select(*docs.columns)
