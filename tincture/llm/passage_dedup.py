"""Word-passage deduplication by suffix automata of reference shards.

The reference of every passage is its first occurrence in the corpus, and the corpus is cut into shards by the passage's
anchor (its smallest hash of eight consecutive words, so equal passages meet in one shard). In a shard the repeated stretches
are streamed in document order through a suffix automaton of those before them: its matching statistic at a word is the
longest run of words ending there that occurred before, and a window of 20 words is a repeat where that is 20 or more.

Two questions to hash buckets come first, so that only text which is repeated reaches a shard: which anchors, then which
windows occur more than once. Automata stay small, and a passage that many documents share reaches a shard once
for each block of documents.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Block, BlockTable, answer_repeats, copies_of, group_sorted, pack_repeats, runs, sliding
from .common import U64, Scratch, find_words, hash_words, text_bytes, window_hashes


class SuffixAutomaton:
    """An automaton of all substrings of the word sequences added so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words) -> list[int]:
        """Add a sequence; returns its matching statistics: for each word, how many words up to it occurred as a run before,
        in earlier sequences or earlier in this one."""
        follow, link, length, last, out = self.next, self.link, self.length, 0, []
        for w in words:
            to = follow[last].get(w)
            if to is not None:
                last = to if length[to] == length[last] + 1 else self._split(last, w, to)
                out.append(length[last])
                continue
            new, p = len(follow), last
            follow.append({})
            link.append(0)
            length.append(length[last] + 1)
            while p >= 0 and w not in follow[p]:
                follow[p][w] = new
                p = link[p]
            if p >= 0:
                to = follow[p][w]
                link[new] = to if length[to] == length[p] + 1 else self._split(p, w, to)
            out.append(length[link[new]])
            last = new
        return out

    def _split(self, p: int, w, to: int) -> int:
        """A state for the shorter strings of ``to``, those that also end another way."""
        copy = len(self.next)
        self.next.append(dict(self.next[to]))
        self.link.append(self.link[to])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.next[p].get(w) == to:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[to] = copy
        return copy


class _Passages:
    """What a block works out again at every stage."""

    def __init__(self, size: int, buckets: int, shards: int):
        self.size, self.buckets, self.shards = size, buckets, shards
        self.anchor = max(1, 2 * size // 5)

    def words(self, block: Block, copies: np.ndarray):
        """Starts and ends of words, each document's first word, each word's hash; then for each window its anchor (0: no window, or
        one of a copy)."""
        starts, ends, first = find_words(block.data, block.offsets)
        hashes = hash_words(block.data, starts, ends)
        count = max(0, len(hashes) - self.size + 1)
        fits = np.arange(count) + self.size <= np.repeat(np.where(copies, 0, first[1:]), np.diff(first))[:count]
        parts = window_hashes(hashes, self.anchor) | U64(1)
        anchors = np.where(fits, sliding(parts, self.size - self.anchor + 1, np.minimum)[:count], U64(0)) if count else np.zeros(0, U64)
        return starts, ends, first, hashes, parts, anchors

    def anchor_places(self, parts: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        width = self.size - self.anchor
        around = np.concatenate((np.zeros(width, U64), anchors, np.zeros(width, U64)))
        best = sliding(around, width + 1, np.maximum)[: len(parts)] if len(anchors) else np.zeros(len(parts), U64)
        return np.flatnonzero((best == parts[: len(best)]) & (best > 0))

    def ask_anchors(self, block: Block, bits):
        *_, parts, anchors = self.words(block, copies_of(block, bits[0]))
        values = parts[self.anchor_places(parts, anchors)]
        order, starts, _ = group_sorted(values)
        yield from pack_repeats(values[order][starts], np.diff(np.append(starts, len(values))) > 1, self.buckets)

    def windows(self, block: Block, bits: np.ndarray, words):
        """Places of windows with a repeated anchor, grouped by their hash."""
        *_, hashes, parts, anchors = words
        distinct = np.unique(parts[self.anchor_places(parts, anchors)])
        live = np.flatnonzero(anchors)
        places = live[bits[np.searchsorted(distinct, anchors[live])]] if len(live) else live
        values = window_hashes(hashes, self.size)[places] if len(places) else np.zeros(0, U64)
        order, starts, inverse = group_sorted(values)
        return places, values, order, starts, inverse

    def ask_windows(self, block: Block, bits):
        _, values, order, starts, _ = self.windows(block, bits[1], self.words(block, copies_of(block, bits[0])))
        yield from pack_repeats(values[order][starts], np.diff(np.append(starts, len(values))) > 1, self.buckets)

    def stretches(self, block: Block, bits, words):
        """Runs of repeated windows with one anchor: (first window, windows, document row, anchor), and for each the number of the
        stretch that stands for it: the first, by document id and place, of equal ones in the block."""
        starts, ends, first, hashes, parts, anchors = words
        places, values, _, _, inverse = self.windows(block, bits[1], words)
        chosen = bits[2][inverse] if len(places) else np.zeros(0, bool)
        at, hashed = places[chosen], values[chosen]
        row = np.searchsorted(first, at, side="right") - 1
        # rows without words share a border with the next row; the last of them owns the word
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (anchors[at[1:]] != anchors[at[:-1]])
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(at)))
        begin, owner, own_anchor = at[heads], row[heads], anchors[at[heads]]
        tail = hashed[heads + sizes - 1] if len(heads) else hashed
        # Two windows at most ``size`` words apart cover all words between them, so their hashes tell a stretch.
        alone = np.where(sizes > self.size, np.arange(len(heads)) + 1, 0)
        order = np.lexsort((begin - first[owner], block.ids[owner], alone, sizes, tail, hashed[heads], own_anchor)) if len(heads) else np.zeros(0, np.int64)
        key = np.stack([x[order].astype(U64) for x in (own_anchor, hashed[heads], tail, sizes, alone)]) if len(heads) else np.zeros((5, 0), U64)
        new = np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))) if len(heads) else np.zeros(0, bool)
        stands = np.empty(len(heads), np.int64)
        stands[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(heads) else 0
        return begin, sizes, owner, own_anchor, stands, order[new]

    def ask_shards(self, block: Block, bits):
        words = self.words(block, copies_of(block, bits[0]))
        starts, ends, first, _, parts, _ = words
        begin, sizes, owner, anchor, _, sent = self.stretches(block, bits, words)
        data = block.data
        for bucket, a, b in runs(anchor[sent], self.shards):
            texts, inner = [], []
            for i in sent[a:b].tolist():
                s, e = int(begin[i]), int(begin[i] + sizes[i]) + self.size - 1
                texts.append(b" ".join(data[x:y].tobytes() for x, y in zip(starts[s:e].tolist(), ends[s:e].tolist(), strict=True)))
                inner.append(np.count_nonzero(parts[s : e - self.anchor + 1] == anchor[i]) > 1)
            own = sent[a:b]
            head = np.empty(b - a, _HEAD)
            head["anchor"], head["doc"], head["start"], head["windows"] = anchor[own], block.ids[owner[own]], begin[own] - first[owner[own]], sizes[own]
            head["bytes"], head["inner"] = list(map(len, texts)), inner
            yield bucket, np.int64(b - a).tobytes() + head.tobytes() + b"".join(texts)

    def answer_shards(self, payloads: list[bytes]) -> list[np.ndarray]:
        heads, texts = [], []
        for p in payloads:
            n = int(np.frombuffer(p, np.int64, 1)[0])
            head = np.frombuffer(p, _HEAD, n, 8)
            heads.append(head)
            at = np.concatenate(([0], np.cumsum(head["bytes"]))) + 8 + n * _HEAD.itemsize
            texts += [p[x:y] for x, y in zip(at.tolist(), at[1:].tolist(), strict=False)]
        head = np.concatenate(heads)
        order = np.lexsort((head["start"], head["doc"], head["anchor"])).tolist()
        anchor, doc, start, windows, inner = (head[c].tolist() for c in ("anchor", "doc", "start", "windows", "inner"))
        found: list = [None] * len(order)
        shard = None
        for i in order:
            if shard != anchor[i]:
                shard, automaton, waiting, seen = anchor[i], None, None, {}
            before = seen.get(texts[i])
            if before is not None:  # a copy: every window is repeated, unless it is the very same place
                same = doc[i] == doc[before] and start[i] == start[before]
                found[i] = found[before] if same else np.ones(windows[i], bool)
                continue
            seen[texts[i]] = i
            if automaton is None and waiting is None and not inner[i]:
                waiting, found[i] = texts[i], np.zeros(windows[i], bool)
                continue
            if automaton is None:
                automaton = SuffixAutomaton()
                if waiting is not None:
                    automaton.add(waiting.split(b" "))
            found[i] = np.array(automaton.add(texts[i].split(b" "))[self.size - 1 :]) >= self.size
        out, at = [], 0
        for h in heads:
            out.append(np.concatenate([np.zeros(0, bool), *found[at : at + len(h)]]))
            at += len(h)
        return out

    def removed(self, block: Block, bits, words, copies: np.ndarray) -> np.ndarray:
        """The words that a window covers which starts earlier in the corpus too."""
        _, _, first, hashes, _, _ = words
        begin, sizes, owner, anchor, stands, sent = self.stretches(block, bits, words)
        place = np.empty(len(begin), np.int64)
        place[sent] = np.concatenate(([0], np.cumsum(sizes[sent])[:-1])) if len(sent) else 0
        edges = np.zeros(len(hashes) + 1, np.int32)
        if len(begin):
            leader = stands
            start = begin - first[owner]
            same = (block.ids[owner] == block.ids[owner[leader]]) & (start == start[leader])
            within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            told = bits[3][np.repeat(place[leader], sizes) + within]
            gone = (np.repeat(begin, sizes) + within)[told | ~np.repeat(same, sizes)]
            edges[gone] += 1
            np.subtract.at(edges, gone + self.size, 1)
        counts = np.diff(first)
        return (np.cumsum(edges[:-1]) > 0) | np.repeat(copies & (counts >= self.size), counts)


_HEAD = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("windows", "<i4"), ("bytes", "<i4"), ("inner", "?")])


def deduplicate(docs: DataFrame, size: int = 20, text: bool = False, block_bytes: int = 2 << 20) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, and with ``text`` the words left, joined by
    one space (column ``kept``, UTF-8 bytes).

    Every word goes that is covered by a window of ``size`` words whose sequence also starts earlier: in a document with a
    smaller id, or earlier in the same one; windows are judged on the input. Null, empty and shorter texts lose nothing.
    Rows of one id are taken as copies of one document and do not take from each other; null ids come after all others. An empty table
    gives an empty one. Where stretches are told apart inside a block, and which windows are looked at, rests on 64-bit hashes;
    what is removed across blocks is decided on the words themselves.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    blocks = BlockTable(text_bytes(docs), scratch, block_bytes)
    try:
        passages = _Passages(size, blocks.buckets(blocks.bytes / 30, 500_000), blocks.buckets(blocks.bytes, 6 << 20))
        copies = blocks.copies()
        anchors = blocks.gather(blocks.ask(passages.ask_anchors, answer_repeats, copies))
        windows = blocks.gather(blocks.ask(passages.ask_windows, answer_repeats, copies, anchors))
        shards = blocks.gather(blocks.ask(passages.ask_shards, passages.answer_shards, copies, anchors, windows))

        def finish(block: Block, bits):
            copies = copies_of(block, bits[0])
            words = passages.words(block, copies)
            first, kept = words[2], []
            keep = (~passages.removed(block, bits, words, copies)).tolist()
            for i, (a, b) in enumerate(zip(block.offsets, block.offsets[1:], strict=False)):
                own = block.data[a:b].tobytes().split()
                kept.append(b" ".join(compress(own, keep[first[i] : first[i + 1]])))
            left = np.concatenate(([0], np.cumsum(keep)))
            counts = np.diff(first)
            columns = [block.id_column, pa.array(counts), pa.array(counts - np.diff(left[first]).astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * text)

        schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept binary" * text
        return scratch.save(blocks.run(finish, schema, copies, anchors, windows, shards))
    finally:
        blocks.drop()
