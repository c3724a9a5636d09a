"""Mixing sources to target weights: each source's words are repeated or thinned so that its share comes near a target.

Words are counted once and summed by source; a source's rate is its target over its size. Every document is taken ``floor(rate)`` times,
and once more if a draw that a hash of its id decides falls below the fraction. A source turns its draws by the one of ``TURNS`` equal steps
that brings its sum nearest to the target; for a single document every turn is as likely to take it as the fraction says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ranked
from .common import Scratch, free_name, shared_dir

#: The most a source may be repeated.
MOST_REPEATS = 3
#: Sources are broadcast up to so many (about 100 bytes each); beyond, they are joined by shuffle with each source dealt over ``_SALTS`` tasks.
_BROADCAST_SOURCES, _SALTS = 50_000, 64
#: In how many steps a source's draws are turned around the unit circle.
TURNS = 32
_WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    """Number of runs of bytes other than space and the controls from tab to carriage return; 0 for null. Every word becomes one mark, so that no list of words is made."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), _WORD, "x")
    return (F.length(marks) - F.length(F.translate(marks, "x", ""))).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A draw in [0, 1) that depends on the key and the seed alone: 52 bits of an MD5, exact as a double. Null keys draw as the empty text."""
    bits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return F.conv(bits, 16, 10).cast("long").cast("double") / float(1 << 52)


def _key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int = MOST_REPEATS) -> DataFrame:
    """(key, source_size, weight, target) from (key, source_size).

    Sources in order of their text's bytes, null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops at ``most`` times the source's
    size; what is over is shared among the others by weight until none is above. Only sums come to the driver.
    """
    rows = sizes.count()
    order = sizes.withColumn("_last", (F.col("key") == "").cast("int"))
    placed = ranked(order, ["_last", "key"], "_place", 0, rows).drop("_last")
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    weighed = placed.select("key", "source_size", weight.alias("weight"))
    wide = F.col("source_size").cast("decimal(38,0)")
    total = int(weighed.agg(F.sum(wide)).first()[0] or 0)
    left, share = total, int(weighed.agg(F.sum("weight")).first()[0] or 0)
    capped = F.lit(False)
    while share:
        # A source is above its stop if left * weight / share > most * size; all are whole numbers, so nothing is rounded.
        over = F.col("weight").cast("decimal(10,0)") * F.lit(left).cast("decimal(28,0)") > F.lit(most * share).cast("decimal(18,0)") * F.col("source_size").cast("decimal(20,0)")
        seen = weighed.agg(F.sum(F.when(over, wide)).alias("size"), F.sum(F.when(over, F.col("weight"))).alias("weight")).first()
        now, rest = total - most * int(seen["size"] or 0), int(weighed.agg(F.sum("weight")).first()[0]) - int(seen["weight"] or 0)
        capped = over
        if (now, rest) == (left, share):
            break
        left, share = now, rest
    open_ = F.lit(float(left)) * F.col("weight").cast("double") / F.lit(float(share or 1))
    return weighed.withColumn("target", F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(open_))


def _turned(u: Column, turn: Column) -> Column:
    """The draw a number of steps further on, exact as a double."""
    further = u + turn / F.lit(float(TURNS))
    return F.when(further >= 1, further - 1).otherwise(further)


def source_rates(docs: DataFrame, weights: tuple[int, ...], most: int, keep: Scratch) -> DataFrame:
    """(key, source_size, target, rate, turn) from (key, size, u), written once. The rate of an empty source is 0. ``turn``: the first whose extra copies come nearest to
    what the fraction of the rate asks for."""
    sizes = keep.save(docs.groupBy("key").agg(F.sum("size").alias("source_size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = keep.save(targets(sizes, weights, most).select("key", "source_size", "target", rate.alias("rate")))
    part = F.col("rate") - F.floor("rate")
    sums = [F.sum(F.when(_turned(F.col("u"), F.lit(float(j))) < part, F.col("size")).otherwise(0)) for j in range(TURNS)]
    extra = _joined(docs, rates, "key", "u").groupBy("key").agg(F.array(*sums).alias("sums"))
    off = F.transform("sums", lambda s: F.abs(s.cast("double") - part * F.col("source_size")))
    return keep.save(rates.join(extra, "key").withColumn("off", off).select(*rates.columns, (F.array_position("off", F.array_min("off")) - 1).cast("double").alias("turn")))


def _joined(df: DataFrame, rates: DataFrame, key: str, id_col: str) -> DataFrame:
    if rates.count() <= _BROADCAST_SOURCES:
        return df.join(F.broadcast(rates), key)
    salt = free_name(df, "_salt")  # a source may hold a third of all rows: its rows are dealt by id
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long")))
    return df.withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(_SALTS))).join(rates.withColumn(salt, every), [key, salt]).drop(salt)


def _copies(rate: str, turn: str, u: Column, most: int) -> Column:
    whole = F.floor(rate)
    return F.least(F.lit(most).cast("long"), whole + (_turned(u, F.col(turn)) < F.col(rate) - whole).cast("int")).cast("int")


def plan(df: DataFrame, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most: int = MOST_REPEATS, seed: str = "mix") -> DataFrame:
    """(id, size, source_size, target, rate, copies, taken): how often each document is taken, one row for each row of ``df``.

    ``size`` counts the text's words (null: 0), ``taken`` is ``size`` times ``copies``. Empty sources have target and rate 0. Rows with the same id draw
    alike, so reruns agree whatever the partitions; an empty table gives no row; other columns play no part.
    """
    shared_dir(df.sparkSession)
    keep = Scratch(df.sparkSession, "mixing")
    docs = keep.save(df.select(F.col(id_col).alias("id"), _key(F.col(source_col)).alias("key"), count_words(F.col(text_col)).alias("size"), uniform(F.col(id_col), seed).alias("u")))
    rated = _joined(docs, source_rates(docs, weights, most, keep), "key", "id").withColumn("copies", _copies("rate", "turn", F.col("u"), most))
    return rated.select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(df: DataFrame, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most: int = MOST_REPEATS, seed: str = "mix") -> DataFrame:
    """The documents of the mix with all their columns, each as often as ``plan`` takes it, and ``copy`` (from 0; a column of that name is replaced)."""
    shared_dir(df.sparkSession)
    key, rate, turn = (free_name(df, name) for name in ("_key", "_rate", "_turn"))
    keep = Scratch(df.sparkSession, "mixing")
    sized = keep.save(df.select(_key(F.col(source_col)).alias("key"), count_words(F.col(text_col)).alias("size"), uniform(F.col(id_col), seed).alias("u")))
    rates = source_rates(sized, weights, most, keep).select(F.col("key").alias(key), F.col("rate").alias(rate), F.col("turn").alias(turn))
    rated = _joined(df.drop("copy").withColumn(key, _key(F.col(source_col))), rates, key, id_col)
    copies = _copies(rate, turn, uniform(F.col(id_col), seed), most)
    every = F.when(copies > 0, F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return rated.withColumn("copy", F.explode(every)).drop(key, rate, turn)
