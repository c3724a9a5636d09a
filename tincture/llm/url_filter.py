"""URL filter: allow and block rules held in Bloom filter cascades, tested without joins and without false answers.

A cascade's level 0 is a Bloom filter of the listed keys; level 1 one of the keys of the corpus that level 0 lets
through by mistake; level 2 one of the listed keys that level 1 holds by mistake, and so on until no mistake is
left. Over the key universe it was built for, its answer is exact. The universe here is complete: every (host suffix,
path prefix) that any row of the corpus could be judged by; it is written to the shared folder once. Everything runs as JVM expressions; only the false
positives of level 0 (about as many as there are rules, by the filter's size) come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str  # "allow" or "block"

    @property
    def key(self) -> str:
        return self.host + self.path


#: The rules of the production query.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All keys a rule for this host and path could have, longest first (of equal length, the longer host first).

    A rule fits its host and all subdomains, so each suffix of the host at a label border counts, together with each
    prefix of the path whose length some rule has.
    """
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(path_lengths)]), lambda p: p.isNotNull()
    )
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(
        (-F.length(h) - F.length(p)).alias("size"), (-F.length(h)).alias("host"), F.concat(h, p).alias("key")))))
    return F.transform(F.array_sort(pairs), lambda x: x["key"])


@dataclass
class BloomFilter:
    """``words`` of 64 bits, ``probes`` bits to a key; ``contains`` is a JVM expression over Spark's own XXH64."""

    bits: int
    probes: int
    salt: int
    words: list[int] = field(default_factory=list)

    def slots(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.salt * 64 + j), key), F.lit(self.bits)) for j in range(self.probes)]

    def load(self, keys: DataFrame) -> BloomFilter:
        """Set the bits of a single-column table of keys; its row count is bounded by the caller."""
        words = [0] * (-(-self.bits // 64))
        found = keys.select(F.explode(F.array(*self.slots(F.col(keys.columns[0])))).alias("slot")).distinct()
        for (slot,) in found.collect():
            words[slot >> 6] |= 1 << (slot & 63)
        self.words = [w - (1 << 64) if w >> 63 else w for w in words]
        return self

    def contains(self, key: Column) -> Column:
        table = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # one literal after constant folding
        test = F.lit(True)
        for slot in self.slots(key):
            word = F.get(table, F.shiftright(slot, 6).cast("int"))
            test = test & (F.expr("1L").bitwiseAND(F.call_function("shiftrightunsigned", word, F.pmod(slot, F.lit(64)).cast("int"))) == 1)
        return test


class FilterCascade:
    """Exact membership of ``listed`` keys over ``universe`` (a table with the column ``key``, distinct).

    ``largest_list`` bounds what the driver holds; a longer list must be split by key hash by the caller.
    """

    def __init__(self, listed: list[str], universe: DataFrame, universe_size: int, largest_list: int = 1_000_000):
        if len(listed) > largest_list:
            raise ValueError(f"{len(listed)} listed keys; split lists over {largest_list} by key hash")
        self.levels: list[BloomFilter] = []
        spark, members, wrong = universe.sparkSession, sorted(set(listed)), None
        table = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
        while members:
            others = universe_size if wrong is None else len(wrong)
            self._add(table(members), len(members), others)
            passed = (universe if wrong is None else table(wrong)).where(self.levels[-1].contains(F.col("key")))
            # Level 0 is sized to let about as many wrong keys through as there are listed ones.
            rows = passed.limit(20 * len(members) + 10_001).collect() if wrong is None else passed.collect()
            if len(rows) > 20 * len(members) + 10_000:
                raise ValueError("level 0 lets through more keys than its size allows")
            wrong = sorted({r.key for r in rows} - set(listed))
            if not wrong:
                break
            self._add(table(wrong), len(wrong), len(members))
            members = [r.key for r in table(members).where(self.levels[-1].contains(F.col("key"))).collect()]

    def _add(self, keys: DataFrame, count: int, others: int) -> None:
        rate = min(0.5, max(1e-9, count / max(others, 1)))
        probes = max(1, round(-math.log2(rate)))
        bits = max(64, math.ceil(count * probes / math.log(2)))
        self.levels.append(BloomFilter(bits, probes, len(self.levels)).load(keys))

    def contains(self, key: Column) -> Column:
        """Leaving at an even level means not listed, at an odd one listed; a key that stays belongs to the last level's side."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(~self.levels[i].contains(key), F.lit(i % 2 == 1)).otherwise(answer)
        return answer


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge each row's url: adds ``host``, ``path``, ``rule`` (the longest fitting rule as host + path, else null) and
    ``verdict`` (that rule's action, else ``default``: a url that no list names is not blocked).

    Null urls and urls without ``://`` have an empty host and path and no rule. Repeated rows are judged alike; an empty
    table gives an empty one. Input columns of the four names are replaced.
    """
    lengths = sorted({len(r.path) for r in rules})
    parsed = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    # Written once: every step of both cascades reads it.
    universe = Scratch(pages.sparkSession, "urls").save(parsed.select(F.explode(keys).alias("key")).distinct())
    size = universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    cascades = {a: FilterCascade([r.key for r in rules if r.action == a], universe, size) for a in ("allow", "block")}
    verdict = lambda k: F.when(cascades["block"].contains(k), F.lit("block")).when(cascades["allow"].contains(k), F.lit("allow"))
    hit = F.get(F.filter(F.transform(keys, lambda k: F.struct(k.alias("key"), verdict(k).alias("verdict"))), lambda x: x["verdict"].isNotNull()), F.lit(0))
    found = free_name(parsed, "_hit")
    judged = parsed.withColumn(found, hit)
    return judged.withColumns({"rule": judged[found]["key"], "verdict": F.coalesce(judged[found]["verdict"], F.lit(default))}).drop(found)
