"""Cross-tokenizer alignment: which tokens of two vocabularies end at the same byte, and how often each pair does so in the corpus.

Texts are cut where no token of either side can cross: before a space that follows a visible character. Each distinct piece is tokenized and
aligned once for a worker; a document is the sum of its pieces. What leaves a document is its pairs with their multiplicities (postings),
dealt by (bucket of the second id, group of documents) and cogrouped with the pairs' corpus-wide counts, so that a pair that all documents
have is spread over all groups. Groups add up the contributions of their documents, which are then summed by document.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WORD_PATTERN, byte_letters
from .common import Scratch, free_name, slices, tune

#: A pair is (second id, first id), and a posting is a pair with its multiplicity, in one long. Larger multiplicities are split over several postings.
_ID_BITS, _TIMES_BITS = 21, 21
_IDS, _TIMES = (1 << _ID_BITS) - 1, (1 << _TIMES_BITS) - 1
#: Buckets of second ids, and about how many postings all buckets of a group of documents hold.
BUCKETS, GROUP_POSTINGS = 16, 4_000_000
#: Characters of a text that are worked on at once, and distinct pieces that a worker keeps.
PART, CACHED = 1 << 20, 250_000
#: A piece begins with a space or line break after a character that is white space under no version of Unicode.
_SHOWN = r"[^\s\u180e\u200b\ufeff]"
_BORDER, _CLOSED = re.compile(rf"(?<={_SHOWN})(?=[ \n])"), re.compile(rf"{_SHOWN}\Z")
#: What stands before pieces that are tokenized together, so that the space that the second side puts first is none of theirs.
_LEAD = " a"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def _ranked(definition: str, vocab: dict[str, int]):
    """A faster encoder with the same results, where the definition allows it: merges whose results are numbered in order, over the usual words
    without prefixes, continuations or normalization."""
    import tiktoken

    data, letters = json.loads(definition), byte_letters()
    kind, before = data["model"], data.get("pre_tokenizer") or {}
    results = ["".join(m.split(" ") if isinstance(m, str) else m) for m in kind["merges"]]
    ids = [vocab[r] for r in results]
    plain = data.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    bare = not any(kind.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    own = {bytes(letters[c] for c in t): i for t, i in kind["vocab"].items() if all(c in letters for c in t)}
    whole = {bytes([b]) for b in range(256)} | {bytes(letters[c] for c in r) for r in results}
    if plain and bare and ids == sorted(set(ids)) and whole <= set(own) and max(own[bytes([b])] for b in range(256)) < ids[0]:
        return tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks={t: own[t] for t in whole}, special_tokens={})
    return None


class Aligner:
    """Tokenizes and aligns pieces of text. ``first``: a JSON definition of byte-level BPE; ``second``: a serialized model of pieces, which
    puts a space before a text by itself."""

    def __init__(self, first: str, second: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(first)
        self.first.encode_special_tokens = True
        self.first.no_truncation()
        self.first.no_padding()
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        letters = byte_letters()
        vocab = self.first.get_vocab(with_added_tokens=True)
        sizes = max(vocab.values()) + 1, self.second.get_piece_size()
        if max(sizes) > _IDS:
            raise ValueError("vocabularies of over two million ids are not aligned")
        self.first_bytes = [b""] * sizes[0]
        for token, i in vocab.items():
            self.first_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.second.id_to_piece(i) for i in range(sizes[1])]
        self.second_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.lengths = [np.array([len(x) for x in side], np.int64) for side in (self.first_bytes, self.second_bytes)]
        names = [str(i) for i in range(max(sizes))]
        self.inner, self.middle, self.last = (np.array([n + mark for n in names], dtype=object) for mark in ",|;")
        self.space = self.second.piece_to_id("▁")
        self.fast = _ranked(first, vocab)
        #: Whether pieces of the second side never cross a border; else texts are one piece each.
        self.separable = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.forget()

    def _first(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(text) if self.fast else self.first.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []  # each group's ids, with a semicolon after every group
        self.sizes = np.zeros((1024, 5), np.int64)  # first tokens, second tokens, groups, whether the bytes agree, first pair
        self.pairs, self.n_pairs = np.zeros(1024, np.int64), 0

    def learn(self, pieces: list[str]) -> None:
        """Pieces that stand between borders on both sides are tokenized in one go, as if they were one text; the others (a text's last one
        may end in white space) and those of a run whose bytes are not kept, one by one."""
        whole = [p for p in pieces if self.separable and p[0] in " \n" and _CLOSED.search(p)]
        if whole:
            text = _LEAD + "".join(whole)
            if not self._learn(whole, self._first(text), self.second.encode(text[1:], num_threads=1), text):
                whole = []
        for piece in pieces:
            if piece not in self.place:
                two = [self.space] if piece == " " else self.second.encode(piece[1:] if piece[0] == " " else piece, num_threads=1)
                if piece[0] == "\n":  # the space that the model puts before a text is none of the piece's
                    two = two[1:]
                if not self._learn([piece], self._first(piece), two, piece):
                    self._keep([piece], [""], np.zeros((1, 4), np.int64), np.zeros(0, np.int64))

    def _keep(self, pieces: list[str], groups: list[str], sizes: np.ndarray, pairs: np.ndarray) -> None:
        start, end, low, high = len(self.groups), len(self.groups) + len(pieces), self.n_pairs, self.n_pairs + len(pairs)
        self.place.update(zip(pieces, range(start, end), strict=True))
        self.groups += groups
        if end > len(self.sizes):
            self.sizes = np.concatenate((self.sizes, np.zeros((end, 5), np.int64)))
        if high > len(self.pairs):
            self.pairs = np.concatenate((self.pairs, np.zeros(high, np.int64)))
        self.sizes[start:end, :4] = sizes
        self.sizes[start:end, 4] = low + np.concatenate(([0], np.cumsum(sizes[:, 2])[:-1]))
        self.pairs[low:high], self.n_pairs = pairs, high

    def _learn(self, pieces: list[str], one: list[int], two: list[int], text: str) -> bool:
        raw = text.encode()
        if b"".join(map(self.first_bytes.__getitem__, one)) != raw or b"".join(map(self.second_bytes.__getitem__, two)) != raw:
            return False
        a, b = np.array(one, np.int64), np.array(two, np.int64)
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        at_a, at_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        # A group's tokens of the first side, then those of the second, in one list of texts.
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        before_b, upto_a = np.concatenate(([0], at_b + 1)), np.append(at_a + 1, 0)
        marked_a, marked_b = self.inner[a], self.inner[b]
        marked_a[at_a], marked_b[at_b] = self.middle[a[at_a]], self.last[b[at_b]]
        words = np.empty(len(a) + len(b), dtype=object)
        words[np.arange(len(a)) + before_b[group_a]] = marked_a
        words[np.arange(len(b)) + upto_a[group_b]] = marked_b
        words = words.tolist()
        lengths = np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces))
        lead = len(raw) - int(lengths.sum())
        borders = lead + np.cumsum(lengths)
        last = np.searchsorted(common, borders)  # each piece's last group
        if not np.array_equal(common[np.minimum(last, len(common) - 1)], borders):
            return False
        first = np.concatenate(([np.searchsorted(common, lead, side="right")], last[:-1] + 1))
        before = lambda side: np.where(first > 0, side[first - 1] + 1, 0)
        from_a, to_a, from_b, to_b = before(at_a), at_a[last] + 1, before(at_b), at_b[last] + 1
        groups = ["".join(words[start:end]) for start, end in zip((from_a + from_b).tolist(), (to_a + to_b).tolist(), strict=True)]
        sizes = np.stack((to_a - from_a, to_b - from_b, last + 1 - first, np.ones(len(pieces), np.int64)), axis=1)
        self._keep(pieces, groups, sizes, (b[at_b] << _ID_BITS | a[at_a])[first[0] : last[-1] + 1])
        return True

    def parts(self, text: str) -> Iterator[list[str]]:
        """The pieces of a space and the text, about ``PART`` characters at a time."""
        text, start = " " + text, 0
        if not self.separable:
            yield [text]
            return
        while start < len(text):
            border = _BORDER.search(text, start + PART) if len(text) - start > PART else None
            end = border.start() if border else len(text)
            yield _BORDER.split(text[start:end])
            start = end

    def prepare(self, texts: list[list[str]]) -> None:
        """Learn the pieces of several texts at once."""
        words = dict.fromkeys(w for own in texts for w in own)
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > CACHED:
            self.forget()
            new = list(words)
        if new:
            self.learn(new)

    def align_all(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """(first tokens, second tokens, groups, SHA-256 of the groups, postings) of each text; nothing if it is empty or its bytes are not kept."""
        out: list = [_NOTHING] * len(texts)
        short = [i for i, t in enumerate(texts) if 0 < len(t) < PART]
        cut = [[*self.parts(texts[i])][0] for i in short]
        self.prepare(cut)
        digests = [hashlib.sha256() for _ in short]
        for i, (totals, keys, times), digest in zip(short, self._tally(cut, digests), digests, strict=True):
            if totals is not None:
                out[i] = (*totals, digest.hexdigest(), _packed(keys, times))
        for i in (i for i, t in enumerate(texts) if len(t) >= PART):
            out[i] = self._long(texts[i])
        return out

    def _long(self, text: str) -> tuple[int, int, int, str, np.ndarray]:
        digest, sums, keys, times = hashlib.sha256(), np.zeros(3, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for number, words in enumerate(self.parts(text)):
            self.prepare([words])
            if number:
                digest.update(b";")
            [(totals, own, counts)] = self._tally([words], [digest])
            if totals is None:
                return _NOTHING
            sums += totals
            keys, times = _summed(np.concatenate((keys, own)), np.concatenate((times, counts)))
        return (*sums.tolist(), digest.hexdigest(), _packed(keys, times))

    def _tally(self, texts: list[list[str]], digests: list) -> Iterator[tuple]:
        """(sizes or None, pairs, multiplicities) of each text; its groups go to its digest."""
        places = [np.fromiter(map(self.place.__getitem__, words), np.int64, len(words)) for words in texts]
        for own, digest in zip(places, digests, strict=True):
            digest.update("".join(map(self.groups.__getitem__, own.tolist()))[:-1].encode())
        if not texts:
            return
        width = len(self.groups) + 1
        of = np.repeat(np.arange(len(texts)), [len(p) for p in places])
        found, counts = np.unique(of * width + np.concatenate(places), return_counts=True)
        of, at = found // width, found % width
        sizes = self.sizes[at]
        sums = [np.bincount(of, sizes[:, k] * counts, len(texts)).astype(np.int64) for k in range(3)]
        bad = np.bincount(of, sizes[:, 3] == 0, len(texts)) > 0
        n, starts = sizes[:, 2], np.concatenate(([0], np.cumsum(sizes[:, 2])[:-1]))
        entries = np.arange(n.sum()) + np.repeat(sizes[:, 4] - starts, n)
        keys, times = _summed(np.repeat(of, n) << 2 * _ID_BITS | self.pairs[entries], np.repeat(counts, n))
        cuts = np.searchsorted(keys, np.arange(len(texts) + 1) << 2 * _ID_BITS)
        keys &= (1 << 2 * _ID_BITS) - 1
        for k, (low, high) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
            yield None if bad[k] else tuple(int(x[k]) for x in sums), keys[low:high], times[low:high]


_NOTHING = (0, 0, 0, "", np.zeros(0, np.int64))


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where, times, len(found)).astype(np.int64)


def _packed(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    pieces = -(-counts // _TIMES)
    if (pieces > 1).any():
        pairs, last = np.repeat(pairs, pieces), np.cumsum(pieces) - 1
        rest = counts - (pieces - 1) * _TIMES
        counts = np.full(len(pairs), _TIMES, np.int64)
        counts[last] = rest
    return pairs << _TIMES_BITS | counts


_loaded: dict[str, Aligner] = {}


class _Vocabularies:
    """The two files, read on the driver and broadcast; their size is checked."""

    def __init__(self, spark, first: str, second: str):
        with open(first, encoding="utf-8") as f, open(second, "rb") as g:
            files = f.read(), g.read()
        if sum(map(len, files)) > 64 << 20:
            raise ValueError("vocabulary files of over 64 MB are not broadcast")
        self.shared, self.id = spark.sparkContext.broadcast(files), hashlib.sha256(files[0].encode() + files[1]).hexdigest()

    def aligner(self) -> Aligner:
        if self.id not in _loaded:
            _loaded[self.id] = Aligner(*self.shared.value)
        return _loaded[self.id]


def postings(df: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, n_postings, postings): one row for each row of ``df``. ``postings`` has one list for each bucket of second ids."""
    tune(df.sparkSession)
    files = _Vocabularies(df.sparkSession, first, second)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        aligner = files.aligner()
        for batch in slices(batches):
            found = aligner.align_all(batch.column("text").to_pylist())
            sizes, values = [], []
            for *_, own in found:
                bucket = (own >> (_ID_BITS + _TIMES_BITS)) % buckets
                order = np.argsort(bucket, kind="stable")
                values.append(own[order])
                sizes.append(np.bincount(bucket, minlength=buckets))
            ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ends), buckets, dtype=np.int32)), lists)
            numbers = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *numbers, pa.array([f[3] for f in found], pa.string()), pa.array([len(v) for v in values], pa.int64()), rows],
                names=["id", "n_a", "n_b", "n_groups", "groups_sha256", "n_postings", "postings"])

    return rows.mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, n_postings long, postings array<array<bigint>>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count): how often each pair of ids ends together in the corpus.

    There are at most as many rows as pairs of ids, and as many for one second id as the first vocabulary has ids.
    """
    each = rows.select(F.explode(F.flatten("postings")).alias("p"))
    return each.groupBy(F.shiftright("p", _TIMES_BITS).alias("pair")).agg(F.sum(F.col("p").bitwiseAND(F.lit(_TIMES))).alias("count"))


def align(df: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, group_postings: int = GROUP_POSTINGS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row for each row of ``df``.

    ``first`` is the path of a byte-level BPE definition (its side reads a space and the text), ``second`` of a model of pieces (which puts the space itself).
    Groups end where tokens of both sides end, and each such place links the two tokens that end there. ``n_best`` counts the links whose pair is
    the second id's most frequent one in the corpus (ties included), ``count_sum`` adds the pairs' corpus-wide counts over the links. Texts that are null, empty or whose
    tokens' bytes are not the space and the text have zeros and an empty digest. Repeated rows count as often as they stand; an empty table gives no row; other columns play no part.
    """
    spark = df.sparkSession
    keep = Scratch(spark, "alignment")
    row = free_name(df, "row")
    encoded = keep.save(postings(df, first, second, id_col, text_col, buckets).withColumn(row, F.monotonically_increasing_id()))
    second_id = F.shiftright("pair", _ID_BITS)
    counts = keep.save(pair_counts(encoded))
    most = counts.groupBy(second_id.alias("second")).agg(F.max("count").alias("most"))
    ranked = counts.withColumn("second", second_id).join(most, "second").select("pair", "count", (F.col("count") == F.col("most")).alias("best"), (F.col("second") % buckets).alias("bucket"))

    groups = max(1, -(-int(encoded.agg(F.sum("n_postings")).first()[0] or 0) // group_postings))
    group = F.pmod(F.xxhash64(row), F.lit(groups))
    mine = encoded.where("n_postings > 0").select(row, group.alias("grp"), F.posexplode("postings").alias("bucket", "own")).where(F.size("own") > 0)
    mine = mine.select((F.col("grp") * buckets + F.col("bucket")).alias("dealt"), F.col(row).alias("row"), "own")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    theirs = ranked.withColumn("grp", every).select((F.col("grp") * buckets + F.col("bucket")).alias("dealt"), "pair", "count", "best")

    def meet(own: pa.Table, known: pa.Table) -> pa.Table:
        """Contributions of a group's documents: their links' counts, and how many links are best."""
        if not own.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "n_best": pa.array([], pa.int64()), "count_sum": pa.array([], pa.int64())})
        lists = own.column("own").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        packed, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        pair = known.column("pair").to_numpy()
        order = np.argsort(pair, kind="stable")
        at = order[np.searchsorted(pair, packed >> _TIMES_BITS, sorter=order)]
        times, starts = packed & _TIMES, np.concatenate(([0], np.cumsum(sizes)[:-1]))
        count, best = known.column("count").to_numpy()[at], known.column("best").to_numpy()[at]
        return pa.table({"row": own.column("row"), "n_best": np.add.reduceat(times * best, starts), "count_sum": np.add.reduceat(times * count, starts)})

    met = mine.groupBy("dealt").cogroup(theirs.groupBy("dealt")).applyInArrow(meet, "row long, n_best long, count_sum long")
    sums = met.groupBy(F.col("row").alias(row)).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = encoded.drop("postings").join(sums, row, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
