"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has one row of bits for each slot and one column (bit slice) for each language: an n-gram's
slots are read as language masks and ANDed, which returns every language that holds the n-gram at once. A text's
popcount in each slice, corrected for the slice's false-positive rate, decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, free_name, hash_bound, held_out, raw, slices, splitmix, tune

#: ASCII letters lower-cased, other ASCII as a space; bytes of longer characters stay.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def grams(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte n-grams of each folded text between two spaces, runs of spaces as one; with each row's first gram."""
    lengths = np.diff(offsets)
    n = len(lengths)
    padded = np.full(len(buf) + 2 * n, 32, dtype=np.uint8)
    padded[np.arange(len(buf)) + np.repeat(2 * np.arange(n) + 1, lengths)] = _FOLD[buf]
    heads = offsets[:-1] + 2 * np.arange(n)
    keep = padded != 32
    keep[1:] |= padded[:-1] != 32
    keep[heads] = True
    kept = padded[keep]
    starts = np.concatenate(([0], np.cumsum(keep)))[np.append(heads, len(padded))]
    count = max(0, len(kept) - size + 1)
    packed = np.zeros(count, dtype=U64)
    for k in range(size):
        packed |= kept[k : k + count].astype(U64) << U64(8 * k)
    inside = np.ones(count, dtype=bool)
    for border in range(1, size):  # grams that run over a row's end
        at = starts[1:-1] - border
        inside[at[(at >= 0) & (at < count)]] = False
    first = np.concatenate(([0], np.cumsum(inside)))[np.minimum(starts, count)]
    return packed[inside], first


@dataclass
class LanguageFilters:
    """``table``: for each slot a mask with a bit for each of ``languages``."""

    languages: list[str]
    table: np.ndarray
    gram_size: int
    probes: int
    fallback: int = 0

    @property
    def false_positive_rates(self) -> np.ndarray:
        fill = [np.count_nonzero(self.table >> U64(i) & U64(1)) / len(self.table) for i in range(len(self.languages))]
        return np.array(fill) ** self.probes

    def masks(self, packed: np.ndarray) -> np.ndarray:
        slots = U64(len(self.table))
        mask = self.table[splitmix(packed) % slots]
        for j in range(1, self.probes):
            mask &= self.table[splitmix(packed + U64(j * 0x9E3779B97F4A7C15 % 2**64)) % slots]
        return mask

    def decide(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language index, score) of each row; no gram known: the language with most training texts, score 0."""
        packed, first = grams(buf, offsets, self.gram_size)
        total = np.diff(first).astype(float)
        votes = np.zeros((len(total), len(self.languages)))
        if len(packed):
            masks = self.masks(packed)
            for i, rate in enumerate(self.false_positive_rates):
                hits = np.concatenate(([0], np.cumsum((masks >> U64(i) & U64(1)).astype(np.int64))))
                votes[:, i] = np.maximum(0.0, (hits[first[1:]] - hits[first[:-1]] - total * rate) / max(1e-9, 1 - rate))
        best = votes.argmax(axis=1)
        none = votes.sum(axis=1) == 0
        best[none] = self.fallback
        shares = np.divide(votes[np.arange(len(best)), best], votes.sum(axis=1), out=np.zeros(len(best)), where=~none)
        return best, shares


def has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True for rows with a letter of any script."""
    ascii_letter = np.concatenate(([0], np.cumsum(((buf | 32) >= 97) & ((buf | 32) <= 122))))
    high = np.concatenate(([0], np.cumsum(buf >= 128)))
    found = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~found & (high[offsets[1:]] > high[offsets[:-1]])):
        found[i] = any(c.isalpha() for c in buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    gram_size: int = 4,
    slots: int = 1 << 21,
    probes: int = 3,
    texts_per_language: int = 2000,
    share: float = 0.15,
) -> LanguageFilters:
    """Fit filters on up to ``texts_per_language`` whole texts of each language (a documented bound; the texts with the
    smallest hashes are taken). An n-gram enters a language's slice if it was seen twice there and its frequency is at
    least ``share`` of the highest frequency it has in any language, which keeps passages quoted in other languages
    out. At most 64 languages; null languages and null texts are left out. What the driver gathers is one
    row for each filter slot at most.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("draw"))
    counts = dict(rows.groupBy("lang").count().collect())
    languages = sorted(counts)
    if not languages:
        return LanguageFilters(["und"], np.zeros(slots, U64), gram_size, probes)
    if len(languages) > 64:
        raise ValueError("a mask holds 64 languages")
    # A threshold on the hash takes about the bound's number of texts without sorting a language in one task.
    bounds = {k: hash_bound(texts_per_language / counts[k]) for k in languages}
    limit = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(bounds[k]))])
    sample = rows.where(F.col("draw") <= limit[F.col("lang")]).drop("draw")

    def count(batches):
        for batch in slices(batches):
            buf, offsets = raw(batch.column("text"))
            packed, first = grams(buf, offsets, gram_size)
            names = batch.column("lang").to_pylist()
            for lang in set(names):
                rows_of = np.array([x == lang for x in names])
                own = packed[np.repeat(rows_of, np.diff(first))]
                gram, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    tune(spark)
    seen = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = dict(seen.groupBy("lang").agg(F.sum("n")).collect())
    scale = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(1.0 / max(1, totals.get(k, 1))))])
    bit = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))])
    per_gram = seen.select("gram", F.struct(F.col("n"), (F.col("n") * scale[F.col("lang")]).alias("f"), bit[F.col("lang")].alias("b")).alias("e")).groupBy("gram").agg(
        F.collect_list("e").alias("es"))  # one entry for each language: at most 64
    top = per_gram.select("gram", "es", F.array_max(F.transform("es", lambda e: e["f"])).alias("top"))
    kept = top.select("gram", F.explode("es").alias("e"), "top").where((F.col("e.n") >= 2) & (F.col("e.f") >= share * F.col("top")))
    member = kept.groupBy("gram").agg(F.collect_list("e.b").alias("bits"))

    def to_slots(batches):
        for batch in batches:
            packed = batch.column("gram").to_numpy(zero_copy_only=False).view(U64)
            mask = np.array([sum(1 << b for b in bits) for bits in batch.column("bits").to_pylist()], dtype=U64)
            for j in range(probes):
                slot = splitmix(packed + U64(j * 0x9E3779B97F4A7C15 % 2**64)) % U64(slots)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(mask.view(np.int64))], names=["slot", "mask"])

    table = np.zeros(slots, U64)
    for part in member.mapInArrow(to_slots, "slot bigint, mask bigint").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow().to_batches():
        table[part.column("slot").to_numpy()] = part.column("mask").to_numpy().view(U64)
    fallback = max(range(len(languages)), key=lambda i: (counts[languages[i]], -i))
    return LanguageFilters(languages, table, gram_size, probes, fallback)


def predict(df: DataFrame, filters: LanguageFilters, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1: the decided language's share of all corrected popcounts).

    ``und`` with score 0 where the text is null or has no letter. Ties go to the language first in alphabetical order.
    Existing columns of those two names are replaced; all other columns and all repeated rows stay.
    """
    spark = df.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(filters)  # 8 bytes a slot, whatever the corpus
    df = df.drop("lang_pred", "score")
    keep, text = df.columns, free_name(df, "_bytes")
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    flagged = df.withColumn(text, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))

    def run(batches):
        model = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in slices(batches, text):
            buf, offsets = raw(batch.column(text))
            best, score = model.decide(buf, offsets)
            letters = has_letter(buf, offsets)
            best[~letters] = len(model.languages)
            score[~letters] = 0.0
            columns = batch.columns[: len(keep)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names[best], pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return flagged.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out("doc_id", 4, 2))
