"""Exact byte-string deduplication by difference-cover blockwise suffix sorting.

Every string of ``length`` bytes has an anchor, the smallest hash of the shorter strings in it, so that equal strings have equal
anchors. A first question to hash buckets leaves only strings whose anchor another document has too, and counts what blocks would
send for it. Strings of hot anchors (a popular phrase within different texts) are asked for one by one, and those that another document
has too go to the shard of a hash of the whole string, so that no phrase fills a shard. All other runs of such strings with one
anchor (stretches of text) meet those of the whole corpus in the anchor's shard, where their suffixes are sorted to the depth
of ``length`` bytes: cover-sample ranks first, then one suffix bucket at a time, long ties by the ranks
(``suffix_order``). A run of equal strings in that order has one smallest document, and all others lose theirs. Hashes only say
where strings meet; what is equal is decided on bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Block, BlockTable, answer_repeats, copies_of, group_sorted, pack_repeats, runs, sliding
from .common import U64, Scratch, place_keys, splitmix, text_bytes
from .suffix_order import suffix_buckets

_BYTES = splitmix(np.arange(256, dtype=U64) + U64(0xC0FE))


def string_hashes(data: np.ndarray, size: int, segment: int = 1 << 16) -> np.ndarray:
    """Hashes of the strings of ``size`` bytes at all places, by doubling, in cache-sized segments."""
    n = max(0, len(data) - size + 1)
    out = np.empty(n, U64)
    keys = place_keys(2, 0xD0B1)
    parts = [1 << k for k in range(size.bit_length()) if size >> k & 1][::-1]
    with np.errstate(over="ignore"):
        for low in range(0, n, segment):
            level, doubled = _BYTES[data[low : low + segment + size - 1]], {}
            for k in range(size.bit_length()):
                doubled[1 << k] = level
                if 2 << k > size:
                    break
                half = 1 << k
                level = level[:-half] * keys[0] + level[half:]
                level ^= level >> U64(31)
                level *= keys[1]
            total, done = doubled[parts[0]], parts[0]
            for p in parts[1:]:
                right = doubled[p][done:]
                m = min(len(total), len(right))
                total = total[:m] * keys[0] + right[:m]
                total ^= total >> U64(31)
                total *= keys[1]
                done += p
            out[low : low + segment] = total[: min(segment, n - low)]
    return splitmix(out)


class _Strings:
    """What a block works out again at every stage, from its texts and the bits it was sent."""

    def __init__(self, length: int, buckets: int, shards: int, hot: int):
        self.length, self.buckets, self.shards, self.hot = length, buckets, shards, hot
        self.part = max(1, 2 * length // 5)

    def anchored(self, block: Block, copies: np.ndarray):
        """Runs of places whose strings have one anchor: (first place, end, document row, anchor). Copies have none. Then the hashes of
        all shorter strings."""
        count = max(0, len(block.data) - self.length + 1)
        if not count:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
        parts = string_hashes(block.data, self.part)
        least = sliding(parts, self.length - self.part + 1, np.minimum)[:count]
        fits = np.arange(count) + self.length <= np.repeat(np.where(copies, 0, block.offsets[1:]), block.lengths)[:count]
        change = np.flatnonzero((least[1:] != least[:-1]) | (fits[1:] != fits[:-1])) + 1
        begin, end = np.concatenate(([0], change)), np.append(change, count)
        live = fits[begin]  # a text's last places hold no whole string, so no run crosses texts
        begin, end = begin[live], end[live]
        return begin, end, np.searchsorted(block.offsets, begin, side="right") - 1, splitmix(least[begin]), parts

    def ask(self, block: Block, row: np.ndarray, key: np.ndarray, counts: np.ndarray | None = None):
        """Which keys has another document too? ``counts`` are of the distinct keys, in order."""
        order, starts, _ = group_sorted(key)
        owners = block.ids[row[order]]
        several = np.minimum.reduceat(owners, starts) != np.maximum.reduceat(owners, starts) if len(starts) else np.zeros(0, bool)
        yield from pack_repeats(key[order][starts], several, self.buckets, counts)

    def ask_anchors(self, block: Block, bits):
        begin, end, row, anchor, parts = self.anchored(block, copies_of(block, bits[0]))
        # Equal stretches of a block are sent once; their ends tell well enough how many there are of an anchor.
        with np.errstate(over="ignore"):
            stretch = splitmix(splitmix(parts[begin]) + parts[end - 1 + self.length - self.part]) + (end - begin).astype(U64)
        order = np.lexsort((stretch, anchor))
        fresh = np.ones(len(order), np.int64)
        head = np.ones(len(order), bool)
        head[1:] = anchor[order][1:] != anchor[order][:-1]
        fresh[1:] = head[1:] | (stretch[order][1:] != stretch[order][:-1])
        yield from self.ask(block, row, anchor, np.add.reduceat(fresh, np.flatnonzero(head)) if len(order) else fresh)

    def answer_anchors(self, payloads: list[bytes]) -> list[np.ndarray]:
        return answer_repeats(payloads, self.hot)

    def shared(self, block: Block, copies: np.ndarray, bits: np.ndarray):
        """Runs whose anchor another document has too and that is not hot, then the single strings of hot anchors (a run of one place
        each, with a hash of the whole string in place of the anchor): two tuples (first place, end, document row, key)."""
        begin, end, row, anchor, parts = self.anchored(block, copies)
        _, _, inverse = group_sorted(anchor)
        repeated, hot = bits.reshape(-1, 2)[inverse].T if len(inverse) else np.zeros((2, 0), bool)
        cool = repeated & ~hot
        hot = np.flatnonzero(repeated & hot)
        sizes = end[hot] - begin[hot]
        places = np.arange(int(sizes.sum())) + np.repeat(begin[hot] - np.cumsum(sizes) + sizes, sizes)
        key = np.zeros(len(places), U64)
        with np.errstate(over="ignore"):
            for at in [*range(0, self.length - self.part, self.part), self.length - self.part]:
                key = splitmix(key + parts[places + at])
        return (begin[cool], end[cool], row[cool], anchor[cool]), (places, places + 1, np.repeat(row[hot], sizes), key)

    def ask_hot(self, block: Block, bits):
        _, (_, _, row, key) = self.shared(block, copies_of(block, bits[0]), bits[1])
        yield from self.ask(block, row, key)

    def stretches(self, block: Block, bits):
        """Runs whose anchor another document has too (of hot anchors the strings that another document has too), as (first place, strings,
        document row); the run that stands for each (of equal ones in the block that of the smallest document), and the texts of
        those that stand for any, in the order sent, with their keys."""
        cool, single = self.shared(block, copies_of(block, bits[0]), bits[1])
        _, _, inverse = group_sorted(single[3])
        live = bits[2][inverse] if len(inverse) else np.zeros(0, bool)
        begin, end, row, anchor = (np.concatenate((x, y[live])) for x, y in zip(cool, single, strict=True))
        data, more, seen, sent = block.data.tobytes(), self.length - 1, {}, []
        stands, firsts, lasts = [0] * len(begin), begin.tolist(), (end + more).tolist()
        for i in np.argsort(block.ids[row], kind="stable").tolist():
            text = data[firsts[i] : lasts[i]]
            own = stands[i] = seen.setdefault(text, i)
            if own == i:
                sent.append((i, text))
        texts = [t for _, t in sent]
        sent = np.array([i for i, _ in sent], np.int64)
        order = np.argsort(anchor[sent], kind="stable")
        return begin, end - begin, row, np.array(stands, np.int64), sent[order], [texts[k] for k in order.tolist()], anchor[sent[order]]

    def ask_shards(self, block: Block, bits):
        _, _, row, _, sent, texts, anchor = self.stretches(block, bits)
        ids, sizes = block.ids[row[sent]], np.fromiter(map(len, texts), np.int32, len(texts))
        for shard, a, b in runs(anchor, self.shards):
            yield shard, np.int64(b - a).tobytes() + ids[a:b].tobytes() + sizes[a:b].tobytes() + b"".join(texts[a:b])

    def answer_shards(self, payloads: list[bytes]) -> list[np.ndarray]:
        """For each string of each stretch sent, whether a smaller document holds it."""
        least: dict[bytes, list[int]] = {}  # text: its number and its smallest document
        told = []
        for p in payloads:
            n = int(np.frombuffer(p, np.int64, 1)[0])
            ids, sizes = np.frombuffer(p, np.int64, n, 8), np.frombuffer(p, np.int32, n, 8 + 8 * n)
            at = (np.concatenate(([0], np.cumsum(sizes))) + 8 + 12 * n).tolist()
            numbers = []
            for doc, a, b in zip(ids.tolist(), at, at[1:], strict=False):
                own = least.setdefault(p[a:b], [len(least), doc])
                own[1] = min(own[1], doc)
                numbers.append(own[0])
            told.append((ids, sizes.astype(np.int64) - self.length + 1, np.array(numbers, np.int64)))
        text = np.frombuffer(b"".join(least), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, least), np.int64, len(least)))
        starts = np.concatenate(([0], ends[:-1]))
        holder = np.array([doc for _, doc in least.values()], np.int64)
        counts = ends - starts - self.length + 1
        firsts = np.concatenate(([0], np.cumsum(counts)[:-1]))  # of each distinct stretch's strings among all
        within = np.arange(int(counts.sum())) - np.repeat(firsts, counts)
        places = within + np.repeat(starts, counts)
        number = np.full(len(text), -1, np.int64)
        number[places] = np.arange(len(places))
        owner = np.repeat(holder, counts)
        smallest = np.empty(len(places), np.int64)
        for own, heads in suffix_buckets(text, places, self.length):
            own = number[own]
            smallest[own] = np.repeat(np.minimum.reduceat(owner[own], heads), np.diff(np.append(heads, len(own))))
        out = []
        for ids, sizes, numbers in told:
            at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(firsts[numbers], sizes)
            out.append(smallest[at] < np.repeat(ids, sizes))
        return out

    def removed(self, block: Block, bits) -> np.ndarray:
        """The bytes that a string covers which also starts in a smaller document."""
        copies = copies_of(block, bits[0])
        begin, sizes, row, stands, sent, _, _ = self.stretches(block, bits)
        first = np.zeros(len(begin), np.int64)
        first[sent] = np.cumsum(sizes[sent]) - sizes[sent]
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        later = block.ids[row] > block.ids[row[stands]]
        told = bits[3][np.repeat(first[stands], sizes) + within] | np.repeat(later, sizes) if len(begin) else np.zeros(0, bool)
        repeats = (np.repeat(begin, sizes) + within)[told]
        edges = np.zeros(len(block.data) + 1, np.int32)
        edges[repeats] += 1
        edges[repeats + self.length] -= 1
        return (np.cumsum(edges[:-1]) > 0) | np.repeat(copies & (block.lengths >= self.length), block.lengths)


def deduplicate(docs: DataFrame, length: int = 50, text: bool = False, block_bytes: int = 2 << 20, hot: int = 500) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``text`` the bytes
    that are left (column ``kept``).

    Every byte goes that is covered by a string of ``length`` bytes which also starts in a document with a smaller id; all
    strings are judged on the input. Null and shorter texts lose nothing. Rows of one id count as one document and do not
    take from each other; null ids count as one document after all others (one with the largest bigint). An empty table gives
    an empty one. Strings are compared by bytes; whole copies of a text are told by 128 bits of its hash. An anchor for which blocks
    would send over ``hot`` stretches is split by whole strings, which changes no result.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    blocks = BlockTable(text_bytes(docs), scratch, block_bytes)
    try:
        strings = _Strings(length, blocks.buckets(blocks.bytes / 16), blocks.buckets(blocks.bytes, 4 << 20), hot)
        copies = blocks.copies()
        asked = blocks.ask(strings.ask_anchors, strings.answer_anchors, copies)
        anchors = blocks.gather(asked)
        # Without a hot anchor nobody asks for single strings, so that question is left out.
        singles = blocks.gather(blocks.ask(strings.ask_hot, answer_repeats, copies, anchors) if asked.where("marked").limit(1).count() else asked.limit(0))
        shards = blocks.gather(blocks.ask(strings.ask_shards, strings.answer_shards, copies, anchors, singles))

        def finish(block: Block, bits):
            gone = strings.removed(block, bits)
            total = np.concatenate(([0], np.cumsum(gone)))
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            borders = block.offsets[:-1][block.offsets[:-1] < len(gone)]
            opens[borders] = gone[borders]
            spans = np.concatenate(([0], np.cumsum(opens)))
            left = block.data[~gone]
            at = block.offsets - total[block.offsets]
            kept = [left[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
            columns = [block.id_column, pa.array(block.lengths), pa.array(np.diff(total[block.offsets])), pa.array(np.diff(spans[block.offsets])), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * text, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * text)

        schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * text
        return scratch.save(blocks.run(finish, schema, copies, anchors, singles, shards))
    finally:
        blocks.drop()
