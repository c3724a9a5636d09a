"""Suffix order by a difference cover, one suffix bucket at a time.

A difference cover modulo ``period`` samples places so that any two places of a text reach a sampled place of both after the
same number of steps, fewer than ``period``. The sampled suffixes are ranked first. All suffixes are then dealt into buckets by
ranges of their first bytes, and one bucket at a time is sorted: by its first bytes, and where those tie over the period's
length by the ranks at the sampled places that both reach, so that no comparison, however long the tie, reads further. Memory
is the text, the ranks and one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Difference covers (every difference modulo the period occurs), by period.
COVERS = {31: (1, 5, 11, 24, 25, 27), 13: (0, 1, 3, 9), 7: (1, 2, 4), 3: (0, 1), 1: (0,)}


def cover_for(depth: int) -> int:
    """The largest period whose directly compared part does not reach over ``depth`` bytes by more than one word."""
    return max(p for p in COVERS if p == 1 or -(-(p - 1) // 8) * 8 <= depth)


def reach_table(period: int) -> np.ndarray:
    """For places by their remainders, the steps to the next place that is sampled seen from both."""
    inside = np.isin(np.arange(2 * period) % period, COVERS[period])
    steps = np.zeros((period, period), np.int64)
    for a in range(period):
        for b in range(period):
            steps[a, b] = np.flatnonzero(inside[a : a + period] & inside[b : b + period])[0]
    return steps


def words_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number that orders as they do."""
    return np.lib.stride_tricks.sliding_window_view(text, 8)[at].view(">u8").ravel().astype(np.uint64)


def _by_words(text: np.ndarray, places: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their next ``words`` times eight bytes, and whether each differs from the one before."""
    first = words_at(text, places)
    order = np.argsort(first)
    places, first = places[order], first[order]
    new = np.ones(len(places), bool)
    new[1:] = first[1:] != first[:-1]
    for k in range(1, words):
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        group, own = np.cumsum(new)[tied], places[tied]
        word = words_at(text, own + 8 * k)
        order = np.lexsort((word, group))
        word = word[order]
        places[tied] = own[order]
        new[tied[1:]] |= word[1:] != word[:-1]
    return places, new


class CoverRanks:
    """Ranks of the sampled suffixes of a text to a depth of at least ``depth`` bytes; ``text`` is followed by zeros."""

    def __init__(self, text: np.ndarray, depth: int):
        self.period, n = cover_for(depth), len(text)
        self.words = max(1, -(-(self.period - 1) // 8))
        self.text = np.concatenate((text, np.zeros(2 * depth + 2 * self.period + 8 * self.words + 8, np.uint8)))
        sampled = np.flatnonzero(np.isin(np.arange(self.period), COVERS[self.period]))
        at = (np.arange(-(-n // self.period))[:, None] * self.period + sampled).ravel()
        at, new = _by_words(self.text, at[at < n], self.words)
        self.rank = np.zeros(len(self.text), np.int64)
        self.rank[at] = np.cumsum(new)
        reach = max(self.period, 8 * self.words // self.period * self.period)
        while reach < depth:  # places a multiple of the period further on are sampled too
            pair = self.rank[at] << 32 | self.rank[at + reach]
            self.rank[at] = np.unique(pair, return_inverse=True)[1] + 1
            reach *= 2
        self.steps = reach_table(self.period)

    def settle(self, places: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order places inside groups (numbers that do not fall) whose strings are alike over the period's length.

        All groups are cut at once into what comes before, with and after a pivot of each, until nothing is left to cut.
        """
        out, slots, period = places.copy(), np.arange(len(places)), self.period
        while len(places):
            heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            sizes = np.diff(np.append(heads, len(places)))
            pivot = np.repeat(places[heads + sizes // 2], sizes)
            step = self.steps[places % period, pivot % period]
            side = np.sign(self.rank[places + step] - self.rank[pivot + step]) + 1
            key = np.repeat(np.arange(len(heads)) * 3, sizes) + side
            order = np.argsort(key, kind="stable")
            places, key = places[order], key[order]
            out[slots] = places
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(heads, len(places)))
            still = (key % 3 != 1) & (np.repeat(sizes, sizes) > 1)
            places, group, slots = places[still], key[still], slots[still]
        return out


def suffix_buckets(text: np.ndarray, places: np.ndarray, depth: int, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For one suffix bucket after another: its places in the order of their strings of ``depth`` bytes, and the start of each run of
    equal strings. Every place must have ``depth`` bytes of text before it. A bucket holds about ``most`` places; only
    strings with the same first eight bytes are never parted."""
    if not len(places):
        return
    ranks = CoverRanks(text, depth)
    first = words_at(ranks.text, places) >> np.uint64(8 * max(0, 8 - depth))
    count = -(-len(places) // most)
    sample = np.sort(first[:: max(1, len(first) // (256 * count))])
    splitters = np.unique(sample[[len(sample) * k // count for k in range(1, count)]])
    bucket = np.searchsorted(splitters, first, side="right")
    for b in range(len(splitters) + 1):
        own = places[bucket == b] if count > 1 else places
        if not len(own):
            continue
        own, new = _by_words(ranks.text, own, ranks.words)
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if len(tied):
            own[tied] = ranks.settle(own[tied], np.cumsum(new)[tied])
        # Neighbours that the first words do not tell apart, or tell apart only beyond the depth, are compared to the depth.
        pairs = np.flatnonzero(~new) if 8 * ranks.words <= depth else np.arange(1, len(own))
        one, two = own[pairs - 1], own[pairs]
        differ = np.zeros(len(pairs), bool)
        for at in [*range(0, depth - 7, 8), depth - 8] if depth >= 8 else []:
            differ |= words_at(ranks.text, one + at) != words_at(ranks.text, two + at)
        for at in range(depth if depth < 8 else 0):
            differ |= ranks.text[one + at] != ranks.text[two + at]
        new[pairs] = differ
        yield own, np.flatnonzero(new)
