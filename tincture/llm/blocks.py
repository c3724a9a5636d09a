"""Blocks of documents, and questions from blocks to hash buckets.

A repeated-text operator must learn, for places of a text, whether the same string occurs elsewhere in the corpus. Texts do
not move for that: documents are written once as blocks of a few MB, in a table bucketed by block. For each question a
block sends every hash bucket one packed, sorted list of distinct hashes; a bucket sorts what it gets and returns one bit for each
entry, in the sender's order. Answers meet the blocks again through the table's bucketing, so only the answers are shuffled.
A block sends a bucket nothing if it has no hash for it, so there are never more rows than hashes, however large both grow.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, slices, tune

_LAST = np.iinfo(np.int64).max
#: Bytes sent for a hash where a chance match only costs time.
SHORT = 5


@dataclass
class Block:
    """Documents with ids, the end of each one's text, all bytes, and which ids are null; those count as the largest number."""

    number: int
    ids: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    nulls: np.ndarray

    @property
    def id_column(self) -> pa.Array:
        return pa.array(self.ids, mask=self.nulls)

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def document_of(self, at: np.ndarray) -> np.ndarray:
        """The id of the document that holds each byte position."""
        return self.ids[np.searchsorted(self.offsets, at, side="right") - 1]


class BlockTable:
    """The blocks of a document table (columns doc_id, text) in the shared folder, and what they ask."""

    def __init__(self, docs: DataFrame, scratch: Scratch, block_bytes: int = 2 << 20):
        spark = self.spark = docs.sparkSession
        tune(spark)
        self.scratch = scratch
        # Counted, not taken from the plan, which knows no size for a table that is not read from files.
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.parts = max(8, min(100_000, -(-size // (12 << 20))))
        self.name = f"blocks_{uuid.uuid4().hex}"

        def pack(batches):
            from pyspark import TaskContext

            number, held, total = TaskContext.get().partitionId() << 32, [], 0

            def row():
                ids = np.concatenate([x.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False) for x in held])
                texts = [t for x in held for t in x.column("text").to_pylist()]
                nulls = np.concatenate([x.column("doc_id").is_null().to_numpy(zero_copy_only=False) for x in held])
                ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
                return pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([int(ends[-1])], pa.int64())] + [pa.array([x], pa.binary()) for x in (ids.tobytes(), ends.tobytes(), b"".join(texts), nulls.tobytes())],
                    names=["block", "size", "ids", "offsets", "data", "nulls"])

            for batch in slices(batches, most=block_bytes):
                bytes_in = sum(len(t) for t in batch.column("text").to_pylist())
                if held and (total + bytes_in > block_bytes or sum(x.num_rows for x in held) > 50_000):
                    yield row()
                    number, held, total = number + 1, [], 0
                held.append(batch)
                total += bytes_in
            if held:
                yield row()

        packed = docs.mapInArrow(pack, "block bigint, size bigint, ids binary, offsets binary, data binary, nulls binary")
        writer = packed.write.format("parquet").option("compression", "zstd").option("path", f"{scratch.root}/{self.name}")
        writer.bucketBy(self.parts, "block").saveAsTable(self.name)
        self.table = spark.table(self.name)
        self.bytes = self.table.agg(F.sum("size")).first()[0] or 0

    def drop(self) -> None:
        """Forget the table; its files lie in the shared folder and are deleted with it."""
        self.spark.sql(f"drop table if exists {self.name}")
        self.scratch._delete(f"{self.scratch.root}/{self.name}")

    def buckets(self, entries: float, each: int = 1_500_000) -> int:
        return max(8, int(-(-entries // each)))

    def run(self, function: Callable, schema: str, *answers: DataFrame) -> DataFrame:
        """Map blocks with the bits of earlier questions: ``function(block, [bits, ...])`` yields record batches."""
        table = self.table
        for i, a in enumerate(answers):
            table = table.join(a.select("block", F.col("bits").alias(f"bits{i}")), "block", "left")
        count = len(answers)

        def each(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    one = {n: batch.column(n)[i] for n in batch.schema.names}
                    block = Block(one["block"].as_py(), *(np.frombuffer(one[n].as_buffer(), t) for n, t in (("ids", np.int64), ("offsets", np.int64), ("data", np.uint8), ("nulls", bool))))
                    yield from function(block, [join_bits(one[f"bits{k}"].as_py()) for k in range(count)])

        return table.mapInArrow(each, schema)

    def ask(self, question: Callable, answer: Callable, *answers: DataFrame) -> DataFrame:
        """(block, bucket, n, bits, marked). ``question(block, bits)`` yields (bucket, payload); ``answer(payloads)`` returns
        an array of booleans for each payload of a bucket, or one of two columns; ``marked`` tells whether the second has a true one."""

        def send(block, bits):
            rows = list(question(block, bits))
            for at in range(0, len(rows), 64):
                part = rows[at : at + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in part], pa.int32()), pa.array([block.number] * len(part), pa.int64()), pa.array([p for _, p in part], pa.binary())], names=["bucket", "block", "payload"])

        def reply(table: pa.Table) -> pa.Table:
            found = answer(table.column("payload").to_pylist())
            return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n": pa.array([x.size for x in found], pa.int32()),
                             "bits": pa.array([np.packbits(x.ravel()).tobytes() for x in found], pa.binary()),
                             "marked": pa.array([x.ndim == 2 and bool(x[:, 1].any()) for x in found], pa.bool_())})

        schema = "block bigint, bucket int, n int, bits binary, marked boolean"
        replies = self.run(send, "bucket int, block bigint, payload binary", *answers).groupBy("bucket").applyInArrow(reply, schema)
        return self.scratch.save(replies)

    def copies(self) -> DataFrame:
        """Bits for ``copies_of``: does a smaller document hold the very same text? Such copies need no further question, and as
        the smaller one holds all their strings, nobody needs their answers either."""
        buckets = self.buckets(self.table.count() * 1e3)

        def question(block, _bits):
            texts, owners, _ = _whole_texts(block)
            for bucket, a, b in runs(texts[:, 0], buckets):
                yield bucket, texts[a:b].tobytes() + owners[a:b].tobytes()

        def answer(payloads):
            counts = [len(p) // 24 for p in payloads]
            texts = np.concatenate([np.frombuffer(p, U64, 2 * n).reshape(n, 2) for p, n in zip(payloads, counts, strict=True)])
            owners = np.concatenate([np.frombuffer(p, np.int64, n, 16 * n) for p, n in zip(payloads, counts, strict=True)])
            order, starts, inverse = group_pairs(texts)
            least = np.minimum.reduceat(owners[order], starts)
            return np.split(least[inverse] < owners, np.cumsum(counts)[:-1])

        return self.gather(self.ask(question, answer))

    def gather(self, *replies: DataFrame) -> DataFrame:
        """The answers of each block together: as many entries as there are buckets."""
        every = replies[0]
        for r in replies[1:]:
            every = every.unionByName(r)
        return every.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("bits"))


def join_bits(parts: list[dict] | bytes | None) -> np.ndarray:
    """A block's answers in bucket order, which is the order of the sorted hashes that it sent; or bits that it kept itself."""
    if isinstance(parts, bytes):
        return np.unpackbits(np.frombuffer(parts, np.uint8)).astype(bool)
    parts = sorted(parts or [], key=lambda x: x["bucket"])
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]).astype(bool) for x in parts)])


def _whole_texts(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(128-bit hash of each distinct text, its smallest holder in the block, each document's place among them)."""
    ends = block.offsets.tolist()
    hashes = np.frombuffer(b"".join(hashlib.blake2b(block.data[a:b], digest_size=16).digest() for a, b in zip(ends, ends[1:], strict=False)), U64).reshape(-1, 2)
    order, starts, inverse = group_pairs(hashes)
    owners = np.minimum.reduceat(block.ids[order], starts) if len(starts) else np.zeros(0, np.int64)
    return hashes[order][starts], owners, inverse


def copies_of(block: Block, bits: np.ndarray) -> np.ndarray:
    """For each document, whether a smaller one has the same text."""
    _, owners, inverse = _whole_texts(block)
    return bits[inverse] | (block.ids > owners[inverse]) if len(inverse) else np.zeros(0, bool)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket grows with the hash, so sorted hashes are cut into runs."""
    return ((hashes >> U64(32)) * U64(buckets)) >> U64(32)


def runs(hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, last) of the buckets that sorted hashes fall into."""
    own = bucket_of(hashes, buckets)
    if not len(own):
        return []
    cuts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return [(int(own[a]), int(a), int(b)) for a, b in zip(cuts, np.append(cuts[1:], len(own)), strict=True)]


def group_sorted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts of equal runs in that order, run number of each input entry)."""
    order = np.argsort(hashes)
    s = hashes[order]
    first = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    inverse = np.empty(len(s), np.int64)
    inverse[order] = np.cumsum(first) - 1
    return order, np.flatnonzero(first), inverse


def group_pairs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``group_sorted`` of hashes of two numbers each."""
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    s = hashes[order]
    first = np.concatenate(([True], (s[1:] != s[:-1]).any(axis=1))) if len(s) else np.zeros(0, bool)
    inverse = np.empty(len(s), np.int64)
    inverse[order] = np.cumsum(first) - 1
    return order, np.flatnonzero(first), inverse


def sliding(values: np.ndarray, width: int, better) -> np.ndarray:
    """Best of each run of ``width`` values, by doubling."""
    best, have = values, 1
    while 2 * have <= width:
        best, have = better(best[:-have], best[have:]), 2 * have
    rest = width - have
    return better(best[: len(best) - rest], best[rest:]) if rest else best


def pack_repeats(distinct: np.ndarray, several: np.ndarray, buckets: int, counts: np.ndarray | None = None):
    """Question "does this hash occur anywhere else?": a few bytes of each hash, and a bit for those that the block has twice itself. With
    ``counts``, also how much the block would send for each (told where it is more than once)."""
    short = distinct.view(np.uint8).reshape(-1, 8)[:, :SHORT]
    for bucket, a, b in runs(distinct, buckets):
        more = b""
        if counts is not None:
            often = np.flatnonzero(counts[a:b] > 1)
            more = np.stack((often, counts[a:b][often])).astype(np.int32).tobytes()
        yield bucket, np.int64(b - a).tobytes() + short[a:b].tobytes() + np.packbits(several[a:b]).tobytes() + more


def answer_repeats(payloads: list[bytes], hot: int | None = None) -> list[np.ndarray]:
    """For each hash, whether it occurs elsewhere; with ``hot`` in a second column whether more than that would be sent for it."""
    counts = [int(np.frombuffer(p, np.int64, 1)[0]) for p in payloads]
    keys = np.zeros((sum(counts), 8), np.uint8)
    several, often, at = np.zeros(len(keys), bool), np.ones(len(keys), np.int64), 0
    for p, n in zip(payloads, counts, strict=True):
        keys[at : at + n, :SHORT] = np.frombuffer(p, np.uint8, n * SHORT, 8).reshape(n, SHORT)
        several[at : at + n] = np.unpackbits(np.frombuffer(p, np.uint8, -1, 8 + n * SHORT), count=n)
        if hot is not None:
            places, told = np.frombuffer(p[8 + n * SHORT + -(-n // 8) :], np.int32).reshape(2, -1)
            often[at + places] = told
        at += n
    order, starts, inverse = group_sorted(keys.view(U64).ravel())
    sizes = np.diff(np.append(starts, len(order)))
    repeated = (sizes > 1) | (np.logical_or.reduceat(several[order], starts) if len(starts) else sizes > 1)
    if hot is not None:
        repeated = np.stack((repeated, np.add.reduceat(often[order], starts) > hot if len(starts) else repeated), axis=1)
    return np.split(repeated[inverse], np.cumsum(counts)[:-1])
