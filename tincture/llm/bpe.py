"""Byte-level BPE encoding by depth-first traversal of a trie of distinct words.

The encoding of a prefix is the encoding of some shorter prefix plus one last token, so a trie node needs to keep only
its last token. Distinct words are visited in sorted order, which is the depth-first order of their trie; the stack of
last tokens along the current path is kept, so that a prefix shared by many words is worked out once. A token is a
prefix's last token exactly if it is a suffix of it and BPE would never merge across the border to the token before.
"""

from __future__ import annotations

import hashlib
import json
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, tune

#: Fixed value: the word pattern of byte-level vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable bytes stand for themselves, others follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieTokenizer:
    """Encoder and decoder for a vocabulary file of byte-level BPE (a JSON text)."""

    def __init__(self, definition: str, cache_words: int = 150_000):
        data = json.loads(definition)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = data["model"]["vocab"]
        self.ids = {as_bytes(s): i for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.pieces = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for piece, i in self.ids.items():
            self.pieces[i] = piece
        for content, i in self.special.items():
            self.pieces[i] = content.encode()
        self.ranks: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            a, b = (self.ids[as_bytes(x)] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = self.ids[self.pieces[a] + self.pieces[b]]
            self.ranks[a, b] = rank
            self.halves.setdefault(whole, (a, b, rank))
        self.alone = [self.ids.get(bytes([b])) for b in range(256)]
        self.pattern = regex.compile(WORD_PATTERN)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._fits: dict[int, bool] = {}
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _edge(self, token: int, right: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of a token while it is put together: (token, rank of the merge that ends it)."""
        known = self._edges.get((token, right))
        if known is None:
            known, now, end = [], token, _NEVER
            while True:
                known.append((now, end))
                if now not in self.halves:
                    break
                end = self.halves[now][2]
                now = self.halves[now][right]
            known.reverse()
            self._edges[token, right] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between two tokens alone: no pair across it is merged before either side moves on."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            a, b, i, j, known = self._edge(left, 1), self._edge(right, 0), 0, 0, True
            while True:
                rank = self.ranks.get((a[i][0], b[j][0]), _NEVER)
                if rank < a[i][1] and rank <= b[j][1]:  # of equal ranks the leftmost goes first
                    known = False
                    break
                if a[i][1] == b[j][1] == _NEVER:
                    break
                if a[i][1] <= b[j][1]:
                    i += 1
                else:
                    j += 1
            if len(self._fits) > 500_000:
                self._fits.clear()
            self._fits[key] = known
        return known

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Encodings of distinct words as little-endian unsigned 32-bit ids, by one walk over their trie.

        Exactly one token can be a prefix's last one, so candidates may be tried in any order: first the last token grown by a
        byte, then the new byte alone, then longer ones.
        """
        get, known, fits, alone, out = self.ids.get, self._fits.get, self.fits, self.alone, {}
        last: list[int] = [-1]  # last token of each prefix on the current path
        back: list[int] = [0]  # where that token starts
        before = b""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start = back[end - 1]
                token = get(word[start:end])
                if token is None or start and not (f if (f := known(last[start] << 32 | token)) is not None else fits(last[start], token)):
                    start, token = end - 1, alone[word[end - 1]]
                    if start and not (f if (f := known(last[start] << 32 | token)) is not None else fits(last[start], token)):
                        for start in range(end - 2, -1, -1):
                            token = get(word[start:end])
                            if token is not None and (start == 0 or (f if (f := known(last[start] << 32 | token)) is not None else fits(last[start], token))):
                                break
                last.append(token)
                back.append(start)
            tokens, at = [], len(word)
            while at:
                tokens.append(last[at])
                at = back[at]
            tokens.reverse()
            out[word] = pack(f"<{len(tokens)}I", *tokens)
            before = word
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each whole text. Strings of special tokens in a text become those tokens, as the tokenizers library does."""
        cut: list[list[list[str] | int]] = []  # for each text, lists of words and special tokens in turn
        find, cache = self.pattern.findall, self.cache
        for text in texts:
            if self.splitter and any(s in text for s in self.special):
                cut.append([self.special[x] if x in self.special else find(x) for x in self.splitter.split(text) if x])
            else:
                cut.append([find(text)])
        words = set()
        for parts in cut:
            words.update(*(x for x in parts if not isinstance(x, int)))
        new = words.difference(cache)
        if len(cache) + len(new) > self.cache_words:
            # Most words are rare: those that this batch uses again are the ones worth keeping.
            kept = {w: cache[w] for w in words if w in cache}
            cache.clear()
            cache.update(kept)
        done = self.encode_words([w.encode() for w in new])
        cache.update({w: done[w.encode()] for w in new})
        lookup, out = cache.__getitem__, []
        for parts in cut:
            out.append(b"".join([pack("<I", x) if isinstance(x, int) else b"".join(map(lookup, x)) for x in parts]))
        return out

    def decode_batch(self, ids: list[bytes]) -> list[str]:
        """Texts of packed ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        get = self.pieces.__getitem__
        return [b"".join(map(get, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace") for x in ids]


def _lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))


_loaded: dict[int, TrieTokenizer] = {}


def _tokenizer(shared) -> TrieTokenizer:
    """One tokenizer for each worker process and vocabulary."""
    if shared.id not in _loaded:
        _loaded[shared.id] = TrieTokenizer(shared.value)
    return _loaded[shared.id]


class _Definition:
    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if len(text) > 64 << 20:
            raise ValueError("a vocabulary file of over 64 MB is not broadcast")
        self.broadcast, self.id = spark.sparkContext.broadcast(text), f"{path}:{hashlib.sha256(text.encode()).hexdigest()}"

    @property
    def value(self) -> str:
        return self.broadcast.value


def encode(df: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """Add ``ids`` (array of int): the byte-level BPE ids of the whole text, null and empty texts as an empty array.

    ``vocabulary`` is the path of a tokenizers JSON file, read on the driver and broadcast (bounded by its size). Every
    row and column stays; a column ``ids`` is replaced.
    """
    return _run(df.drop("ids"), vocabulary, text_col, "ids array<int>", lambda t, texts, ids: [_lists(ids)])


def encode_checked(df: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """Add ``ids`` as ``encode`` does, and ``round_trip``: whether they decode to the text again. One pass, so that a worker holds one
    tokenizer."""

    def columns(t, texts, ids):
        return [_lists(ids), pa.array([a == b for a, b in zip(texts, t.decode_batch(ids), strict=True)], pa.bool_())]

    return _run(df.drop("ids", "round_trip"), vocabulary, text_col, "ids array<int>, round_trip boolean", columns)


def encode_digests(df: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers) and ``decoded_sha256`` (the text
    decoded from the ids, as UTF-8)."""

    def columns(t, texts, ids):
        decoded = t.decode_batch(ids)
        return [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
        ]

    return _run(df.drop("n_tokens", "ids_sha256", "decoded_sha256"), vocabulary, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", columns)


def _run(df: DataFrame, vocabulary: str, text_col: str, added: str, columns) -> DataFrame:
    tune(df.sparkSession)
    shared = _Definition(df.sparkSession, vocabulary)
    keep, text = df.columns, free_name(df, "_text")
    fields = df.sparkSession.createDataFrame([], added).schema.fields
    schema = type(df.schema)([*df.schema.fields, *fields])

    def run(batches):
        tokenizer = _tokenizer(shared)
        for batch in slices(batches, text, 1 << 20):
            texts = batch.column(text).to_pylist()
            ids = tokenizer.encode_batch(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns(tokenizer, texts, ids)], names=[*keep, *(f.name for f in fields)])

    return df.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``: the text of an array of ids (null: empty), special tokens included."""
    df = df.drop("decoded")
    keep = df.columns
    tune(df.sparkSession)
    shared = _Definition(df.sparkSession, vocabulary)

    def run(batches):
        tokenizer = _tokenizer(shared)
        for batch in batches:
            ids = batch.column(ids_col)  # one row's numbers at a time: a batch may hold many long texts
            texts = tokenizer.decode_batch([x.values.to_numpy().astype("<u4").tobytes() if x.is_valid else b"" for x in ids])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*keep, "decoded"])

    schema = type(df.schema)([*df.schema.fields, *df.sparkSession.createDataFrame([], "decoded string").schema.fields])
    return df.mapInArrow(run, schema)
