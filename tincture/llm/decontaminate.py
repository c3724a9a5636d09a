"""Benchmark decontamination by SimHash over item-sized windows.

A window of a document has as many words as the benchmark item it is held against. Of repeated five-word shingles the first, second, ... of the
window are different elements, so that weighted similarity is that of two sets, and no repeat outweighs the rest of a fingerprint. The
256-bit SimHash over these elements is looked up in a multi-index of the fingerprints of all items of that size: the bits are cut into blocks of
16, and by the pigeonhole principle every fingerprint within the radius agrees with the query in one block up to ``radius // 16`` bits. What the
index returns are candidates, which exact weighted-shingle similarity then verifies.

No radius holds every similar pair of two texts, so what may lie beyond it is found exactly: two windows with m and n shingles and
similarity s share s * (m + n) / (1 + s) of them, so a window has one of all but so many (less one) of the item's shingles, and windows that
hold enough of that item's shingles are verified too. Windows that cannot hold enough shingles of any item are not looked at.
Items are handled in blocks of bounded size, each of which is broadcast.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, find_words, hash_words, raw, slices, splitmix, text_bytes, tune, window_hashes

SHINGLE = 5


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words; fewer words give one shingle of all of them, none gives none."""
    if 0 < len(words) < size:
        return window_hashes(words, len(words), 0xA11 + len(words))
    return window_hashes(words, size)


#: Bits of a fingerprint, in words of 64.
WORDS = 4


def _bits(elements: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.stack([splitmix(elements + U64(k)) for k in range(WORDS)], axis=1).view(np.uint8), axis=1)


def numbered(hashes: np.ndarray) -> np.ndarray:
    """The shingles as elements of a set: the first of equal ones is itself, the second, third, ... differ from it and from each other."""
    order = np.argsort(hashes, kind="stable")
    heads = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))
    at = np.arange(len(hashes))
    number = np.empty(len(hashes), U64)
    number[order] = (at - np.maximum.accumulate(np.where(heads, at, 0))).astype(U64)
    return np.where(number > 0, splitmix(hashes ^ splitmix(number)), hashes)


def _repeats(own: np.ndarray, here: np.ndarray, size: int, totals: np.ndarray, most: int = 30_000) -> None:
    """Correct the windows' sums of bits, which take every shingle as the first of its kind, for those that are not the first in their window."""
    n, order = len(own), np.argsort(own, kind="stable")
    heads = np.concatenate(([True], own[order][1:] != own[order][:-1]))
    kind, number, before = np.empty(n, np.int64), np.empty(n, np.int64), np.full(n, -1, np.int64)
    kind[order] = np.cumsum(heads) - 1
    starts = np.flatnonzero(heads)
    number[order] = np.arange(n) - starts[kind[order]]
    before[order[1:]] = np.where(heads[1:], -1, order[:-1])
    places = kind[order] * (n + 1) + order  # ascending: by kind, then place
    again = np.flatnonzero(before >= 0)
    low, high = np.searchsorted(again, here), np.searchsorted(again, here + size)
    ends = np.cumsum(high - low)
    first = 0
    while first < len(here):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
        counts = (high - low)[first:last]
        window = np.repeat(np.arange(first, last), counts)
        p = again[np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[first:last], counts)]
        inside = before[p] >= here[window]
        window, p = window[inside], p[inside]
        if len(p):
            nth = number[p] - (np.searchsorted(places, kind[p] * (n + 1) + here[window]) - starts[kind[p]])
            _, one, which = np.unique(kind[p] * (n + 1) + nth, return_index=True, return_inverse=True)
            change = _bits(splitmix(own[p[one]] ^ splitmix(nth[one].astype(U64)))).astype(np.int16) - _bits(own[p[one]])
            of, cuts = np.unique(window, return_index=True)
            totals[of] += np.add.reduceat(change[which], cuts, axis=0, dtype=np.int32)
        first = last


def window_prints(hashes: np.ndarray, starts: np.ndarray, size: int, most: int = 1 << 13) -> np.ndarray:
    """The SimHash of the ``size`` shingles from each start (ascending): a bit is 1 if set in over half of the window's elements."""
    out = np.zeros((len(starts), WORDS), U64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        end = max(at + 1, int(np.searchsorted(starts, low + most)))
        own, here = hashes[low : int(starts[end - 1]) + size], starts[at:end] - low
        sums = np.zeros((len(own) + 1, 64 * WORDS), np.int32)
        np.cumsum(_bits(own), axis=0, out=sums[1:])
        totals = sums[here + size] - sums[here]
        _repeats(own, here, size, totals)
        out[at:end] = np.packbits(2 * totals > size, axis=1).view(U64)
        at = end
    return out


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: sum of smaller over sum of larger counts."""
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / max(1, a.total() + b.total() - both)


class HammingIndex:
    """All stored fingerprints within ``radius`` bits of a query. Every block of 16 bits has its values in order; a query looks up all values that
    differ from its own in ``radius // blocks`` bits at most."""

    def __init__(self, prints: np.ndarray, radius: int = 62):
        self.prints, self.radius = prints.reshape(-1, WORDS), radius
        blocks = 4 * WORDS
        values = np.arange(1 << 16, dtype=np.uint16)
        self.flips = values[np.bitwise_count(values) <= radius // blocks]
        own = self.prints.view(np.uint16)
        self.tables = [(order := np.argsort(own[:, t], kind="stable"), own[order, t]) for t in range(blocks)]

    def search(self, queries: np.ndarray, most: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(query, stored fingerprint) pairs within the radius, in order."""
        queries = queries.reshape(-1, WORDS)
        pairs = [np.zeros(0, np.int64)]
        for first in range(0, len(queries), most):
            part = queries[first : first + most]
            if len(self.prints) <= len(self.flips):  # fewer to look at than values to look up
                query, stored = np.nonzero(np.bitwise_count(part[:, None, :] ^ self.prints[None]).sum(axis=2, dtype=np.int64) <= self.radius)
                pairs.append((query + first) * len(self.prints) + stored)
                continue
            values, found = part.view(np.uint16), []
            for t, (order, listed) in enumerate(self.tables):
                wanted = (values[:, t, None] ^ self.flips).ravel()
                a = np.searchsorted(listed, wanted)
                n = np.searchsorted(listed, wanted, side="right") - a
                hit = np.flatnonzero(n)
                a, n = a[hit], n[hit]
                query = np.repeat(hit // len(self.flips), n)
                found.append(query * len(self.prints) + order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)])
            met = np.unique(np.concatenate(found))
            query, stored = met // max(1, len(self.prints)), met % max(1, len(self.prints))
            close = np.bitwise_count(part[query] ^ self.prints[stored]).sum(axis=1, dtype=np.int64) <= self.radius
            pairs.append(met[close] + first * len(self.prints))
        every = np.concatenate(pairs)
        return every // max(1, len(self.prints)), every % max(1, len(self.prints))


_SLOTS = U64((1 << 22) - 1)


class Items:
    """One broadcast block of benchmark items: an index of fingerprints for each number of words, and a bitmap of shingle hashes."""

    def __init__(self, ids: list[int], hashes: list[np.ndarray], words: list[int], threshold: float):
        self.ids, self.threshold = ids, threshold
        self.counts = [Counter(h.tolist()) for h in hashes]
        self.bitmap = np.zeros(1 << 22, dtype=bool)
        by_size: dict[int, list[int]] = {}
        for i, (h, n) in enumerate(zip(hashes, words, strict=True)):
            self.bitmap[h & _SLOTS] = True
            by_size.setdefault(n, []).append(i)
        self.indexes = {n: (HammingIndex(np.concatenate([window_prints(hashes[i], np.zeros(1, np.int64), len(hashes[i])) for i in own])), own) for n, own in sorted(by_size.items())}
        self.shingles = [np.unique(h) for h in hashes]
        rarity = Counter(x for h in self.shingles for x in h.tolist())
        #: Each item's shingles with the rarest first.
        self.rarest = [sorted(h.tolist(), key=lambda x: (rarity[x], x)) for h in self.shingles]
        self._prefixes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _need(self, windows: int, items: int) -> int:
        return int(np.ceil(self.threshold * (windows + items) / (1 + self.threshold) - 1e-9))

    def _prefix(self, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingles, in order, of which a window of ``m`` that is similar to an item of ``n`` words has at least one; and the places in ``indexes[n]`` of their items."""
        if (n, m) not in self._prefixes:
            pairs = []
            for place, i in enumerate(self.indexes[n][1]):
                # With repeats counted the item has more elements than shingles; leaving out the commonest is safe while fewer than ``need`` elements are left out.
                left = self._need(m, self.counts[i].total()) - 1
                for x in reversed(self.rarest[i]):
                    left -= self.counts[i][x]
                    if left < 0:
                        pairs.append((x, place))
            pairs.sort()
            self._prefixes[n, m] = np.array([x for x, _ in pairs], U64), np.array([p for _, p in pairs], np.int64)
        return self._prefixes[n, m]

    def _beyond(self, n: int, m: int, need: int, shingles: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
        """(place in ``starts``, place in ``indexes[n]``) of windows that have ``need`` shingles of an item, by the item's rarest shingles."""
        listed, places = self._prefix(n, m)
        inside = np.zeros(len(shingles) + 1, np.int64)
        np.add.at(inside, starts, 1)
        np.add.at(inside, np.minimum(starts + m, len(shingles)), -1)
        seen = np.unique(shingles[np.cumsum(inside)[:-1] > 0])
        low, high = np.searchsorted(listed, seen), np.searchsorted(listed, seen, side="right")
        out = []
        for k in np.unique(np.concatenate([places[a:b] for a, b in zip(low, high, strict=True) if b > a] or [np.zeros(0, np.int64)])).tolist():
            has = np.concatenate(([0], np.cumsum(np.isin(shingles, self.shingles[self.indexes[n][1][k]]))))
            out += [(q, k) for q in np.flatnonzero(has[starts + m] - has[starts] >= need).tolist()]
        return out

    def find(self, hashes: dict[int, np.ndarray], count: int) -> list[tuple[int, int, int, float, int]]:
        """(item, start word, words, similarity, fingerprint distance) of the first best window for each item that passes.
        ``hashes``: a document's shingles of five words (0), and of fewer where items are as short; ``count``: its words."""
        best: dict[int, tuple] = {}
        hits = {k: np.concatenate(([0], np.cumsum(self.bitmap[h & _SLOTS]))) for k, h in hashes.items()}
        for n, (index, own) in self.indexes.items():
            short = n if n < SHINGLE else 0
            m, items = max(1, min(n, count) - SHINGLE + 1), max(1, n - SHINGLE + 1)
            need = self._need(m, items)
            if short not in hits or len(hashes[short]) < m or m < need or hits[short][-1] < need:
                continue
            near = hits[short]
            starts = np.flatnonzero(near[m:] - near[:-m] >= need)
            if not len(starts):
                continue
            prints = window_prints(hashes[short], starts, m)
            met = set(zip(*(x.tolist() for x in index.search(prints)), strict=True)) | set(self._beyond(n, m, need, hashes[short], starts))
            window, last = Counter(), -1
            for q, k in sorted(met):
                i, start = own[k], int(starts[q])
                if q != last:
                    window, last = Counter(hashes[short][start : start + m].tolist()), q
                sim = similarity(window, self.counts[i])
                if sim >= self.threshold and (i not in best or sim > best[i][3] + 1e-12):
                    apart = int(np.bitwise_count(prints[q] ^ index.prints[k]).sum())
                    best[i] = (self.ids[i], start, min(n, count), sim, apart)
        return [best[i] for i in sorted(best)]


def _items(rows, threshold: float) -> Items:
    ids, hashes, sizes = [], [], []
    for item_id, text in rows:
        buf = np.frombuffer((text or "").encode(), dtype=np.uint8)
        starts, ends, _ = find_words(buf, np.array([0, len(buf)]))
        if item_id is not None and len(starts):
            ids.append(item_id)
            hashes.append(shingles(hash_words(buf, starts, ends)))
            sizes.append(len(starts))
    return Items(ids, hashes, sizes, threshold)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity, distance): for each document and item the first best window with
    weighted five-word-shingle similarity of ``threshold`` or more.

    A document shorter than the item is held against it whole. An item of under five words is one shingle of all of them, which a
    window of as many words must equal; a document of fewer words than the item and fewer than five matches nothing. Null and
    empty texts, items and ids match nothing. Repeated rows give repeated matches; of equally good windows the first counts.
    Benchmark tables over ``block_bytes`` are split by item into blocks; the documents are read once for each block, whose matches are
    written before the next block is broadcast.
    """
    spark = docs.sparkSession
    tune(spark)
    items = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // block_bytes))
    schema = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, similarity double, distance int"
    out, keep = None, Scratch(spark, "matches")
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast(_items(sorted(map(tuple, own.distinct().collect())), threshold))

        def run(batches, shared=shared):
            for batch in slices(batches):
                buf, offsets = raw(batch.column("text"))
                starts, ends, first = find_words(buf, offsets)
                words = hash_words(buf, starts, ends)
                ids, rows, items = batch.column("doc_id").to_pylist(), [], shared.value
                # Shingles of all texts at once; those that cross texts are left out below.
                lengths = {0: SHINGLE} | {n: n for n in items.indexes if n < SHINGLE}
                all_shingles = {k: window_hashes(words, n, 0xA11 + k) for k, n in lengths.items()}
                near = {k: np.concatenate(([0], np.cumsum(items.bitmap[h & _SLOTS]))) for k, h in all_shingles.items()}
                for i, doc_id in enumerate(ids):
                    a, b = int(first[i]), int(first[i + 1])
                    held = {k: (a, b - n + 1) for k, n in lengths.items() if b - a >= n}
                    if doc_id is not None and any(near[k][y] > near[k][x] for k, (x, y) in held.items()):
                        rows += [(doc_id, *m) for m in items.find({k: all_shingles[k][x:y] for k, (x, y) in held.items()}, b - a)]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

        names = ["doc_id", "item_id", "start_word", "n_words", "similarity", "distance"]
        arrow = pa.schema(list(zip(names, [pa.int64()] * 4 + [pa.float64(), pa.int32()], strict=True)))
        found = text_bytes(docs).mapInArrow(run, schema)
        if parts > 1:
            found = keep.save(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Documents in which no item was found; rows with a null doc_id stay. Columns and repeated rows are kept."""
    hit = Scratch(docs.sparkSession, "decontaminate").save(matches(docs, benchmark, threshold).select("doc_id").distinct())
    few = hit.limit(500_001).count() <= 500_000
    return docs.join(F.broadcast(hit) if few else hit, "doc_id", "left_anti").select(*docs.columns)
