"""PII: keyed, type-consistent surrogates for detected entities.

Each distinct entity of the corpus gets one surrogate, a keyed function of its type and normal form: digits become digits,
letters letters of the same script and case, names names of the same gender and script, card numbers keep their checksum. Numbers
that no card can have, dates, and bare runs of digits without a word like "phone" before them stay as they are. The
distinct entities and their surrogates are a table of the corpus; a collision check over it draws again where two entities
would share a surrogate or a surrogate is somebody's real entity, so distinct entities stay distinct and all mentions of one
stay equal. Texts are never shuffled: a surrogate is recomputed where it is needed, and only the entities that were drawn
again (few) are looked up.
"""

from __future__ import annotations

import hashlib
import ipaddress
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_name, slices, tune

#: Given names by script and gender, and surnames by script.
GIVEN = {
    ("LATIN", "f"): "Anna Maria Laura Julia Sofia Emma Clara Elena Marie Sarah Alice Lucia Carmen Ingrid Helga Claire Camille Isabel Emily Olivia Greta Hannah Nora Paula".split(),
    ("LATIN", "m"): "John Peter Thomas Martin David Daniel Carlos Miguel Jean Pierre Hans Klaus James Robert William Michael Paul Lucas Pablo Diego Henri Louis Stefan Jonas".split(),
    ("CYRILLIC", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("CYRILLIC", "m"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил".split(),
    ("GREEK", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Ιωάννα".split(),
    ("GREEK", "m"): "Γιώργος Δημήτρης Νίκος Γιάννης Κώστας Παύλος".split(),
}
SURNAMES = {
    "LATIN": "Smith Miller Weber Fischer Garcia Martinez Lopez Dubois Moreau Laurent Keller Brandt Walker Turner Hughes Navarro Romero Fontaine Girard Vogel Hartmann Sommer Parker Bennett".split(),
    "CYRILLIC": "Иванов Петров Смирнов Кузнецов Попов Соколов Лебедев Козлов Новиков Морозов".split(),
    "GREEK": "Παπαδόπουλος Γεωργίου Δημητρίου Νικολάου Ιωάννου Βασιλείου".split(),
}
#: Titles before a surname, with the gender they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Monsieur": "m", "Madame": "f", "Prof": "", "Sr": "m", "Sra": "f", "Mme": "f", "Mlle": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
_GIVEN = {name.lower(): (script, gender) for (script, gender), names in GIVEN.items() for name in names}
_TITLES = {t.lower() for t in TITLES}
#: What an entity of each type looks like. Earlier types win where two overlap.
PATTERNS = (
    ("email", r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+"),
    ("secret", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("secret", r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?\K[^\s\"',;]{6,}"),
    ("ipv6", r"(?<![\w:.])(?:[23][\da-fA-F]{3}|[fF][cCdD][\da-fA-F]{2}|[fF][eE][89abAB][\da-fA-F]):(?:[\da-fA-F]{0,4}:){1,6}(?:[\da-fA-F]{1,4}|(?<=::))(?!\w|:\w)"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d+])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?!\d)"),
    ("phone", r"(?<![\w.])(?:\+|00)?\(?\d{1,4}\)?(?:[ ./-]?\(?\d{2,5}\)?){1,5}(?!\w)"),
)
_COMPILED = [(kind, regex.compile(p)) for kind, p in PATTERNS]
_DATE = regex.compile(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{4}")
_DIGIT = regex.compile(r"\d")
_DIGITS = regex.compile(r"\d+")
_NAME = regex.compile(r"\b(\p{Lu}\p{L}*)(\.? +)(\p{Lu}\p{L}+)(?: +(\p{Lu}\p{L}+))?")
#: A bare run of digits is a phone number only behind a word that says so; a name that no list has is one behind words that announce it.
_BARE = regex.compile(r"(?<![\w.+,/-])\d{8,15}(?![\w/-]|[.,]\d)")
_PHONE_CUE = regex.compile(r"(?i)\b(?:phone|tel|telephone|telefon|mobile|cell|fax|whatsapp|call|dial)(?: (?:number|no|me|us))?\.?(?: (?:at|on|is))?[ :=#]{1,3}$")
_NAME_CUE = regex.compile(
    r"\b(?i:my name is|full name:|signed by|sincerely,)\s+(?:(?:" + "|".join(TITLES) + r")\.? +)?(\p{Lu}[\p{L}'’-]*\p{L})(?: (\p{Lu}[\p{L}'’-]*\p{L}))(?: (\p{Lu}[\p{L}'’-]*\p{L}))?")
_SECRET_HINT = regex.compile(r"(?i)password|passwd|pwd|secret|token|api[_-]?key|AKIA")

#: The attempt from which surrogates get longer.
WIDER = 24


def script_of(word: str) -> str:
    for c in word:
        if c.isalpha():
            return unicodedata.name(c, "LATIN").split(" ")[0]
    return "LATIN"


def normal_form(kind: str, found: str) -> str:
    """What mentions of one entity have in common: numbers without punctuation, everything else without case."""
    if kind in ("phone", "card", "ssn"):
        digits = "".join(c for c in found if c.isdigit())
        return "+" + digits if kind == "phone" and found.startswith("+") else digits
    if kind == "iban":
        return found.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(found).exploded
    return found if kind in ("secret", "ip") else found.lower()


def _phones(pattern: regex.Pattern, text: str, taken: bytearray, rejected: bytearray) -> Iterator[regex.Match]:
    """Matches with 8 to 15 digits that are no dates, are no bare numbers, touch nothing taken and do not begin inside a rejected card;
    after any other match the search goes on behind its first date or group of digits."""
    m = pattern.search(text)
    while m:
        a, b = m.span()
        date = _DATE.match(m[0])
        bare = m[0].isdigit() and not m[0].startswith("00")
        if not bare and not (date and date.end() == b - a) and 8 <= sum(c.isdigit() for c in m[0]) <= 15 and not rejected[a] and not any(taken[a:b]):
            yield m
            at = b
        else:
            at = a + (date or _DIGITS.search(m[0])).end()
        m = pattern.search(text, at)


def is_card(number: str) -> bool:
    """13 to 19 digits that an issuer may give out (they begin with 3 to 6, or 22 to 27) and whose checksum is right."""
    return 13 <= len(number) <= 19 and (number[0] in "3456" or "22" <= number[:2] <= "27") and _luhn(number) == 0


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of each entity, in order, without overlaps. The time is linear in the text."""
    spans: list[tuple[int, int, str, str]] = []
    has_digit, has_at, has_secret = _DIGIT.search(text) is not None, "@" in text, _SECRET_HINT.search(text) is not None
    taken = bytearray(len(text)) if has_digit or has_at or has_secret else bytearray()
    rejected = bytearray(len(taken))  # all of a rejected card but its first place
    for kind, pattern in _COMPILED:
        if not (has_at if kind == "email" else has_secret if kind == "secret" else has_digit):
            continue
        for m in _phones(pattern, text, taken, rejected) if kind == "phone" else pattern.finditer(text):
            a, b = m.span()
            if any(taken[a:b]) or kind == "secret" and not any(map(str.isalnum, m[0])):  # masked: no entity
                continue
            try:
                value = normal_form(kind, m[0])
            except ValueError:  # groups and colons that are no address
                continue
            if kind == "card" and not is_card(value):
                rejected[a + 1 : b] = b"\1" * (b - a - 1)
                continue
            taken[a:b] = b"\1" * (b - a)
            spans.append((a, b, kind, value))
    for m in _BARE.finditer(text) if has_digit else ():
        a, b = m.span()
        if not any(taken[a:b]) and _PHONE_CUE.search(text[max(0, a - 32) : a]):
            spans.append((a, b, "phone", m[0]))
    for m in _NAME_CUE.finditer(text) if any(x in text for x in ("ame", "igned", "incerely", "AME", "IGNED", "INCERELY")) else ():
        first = m[1].lower()
        spans.append((*m.span(1), "given:" + _GIVEN.get(first, ("", ""))[1], first))
        spans += [(*m.span(i), "surname", m[i].lower()) for i in (2, 3) if m[i]]
    at, m = 0, _NAME.search(text)
    while m:
        first, second, third = m[1].lower(), m[3].lower(), m[4]
        last = 0
        if first in _TITLES and second not in _TITLES:
            last = 4 if second in _GIVEN and third is not None else 3
            if last == 4:
                spans.append((m.start(3), m.end(3), "given:" + _GIVEN[second][1], second))
        elif first in _GIVEN and second not in _TITLES and "." not in m[2]:
            last = 3
            spans.append((m.start(1), m.end(1), "given:" + _GIVEN[first][1], first))
        if last:
            spans.append((m.start(last), m.end(last), "surname", m[last].lower()))
        # The next name may begin with the word after a rejected one, or with a surname that is a given name too.
        at = m.end(1) if not last else m.start(last) if m[last].lower() in _GIVEN else m.end(last)
        m = _NAME.search(text, at)
    spans.sort()
    out: list[tuple[int, int, str, str]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def _stream(key: bytes, kind: str, value: str, attempt: int) -> Iterator[int]:
    n = 0
    while True:
        yield from hashlib.blake2b(f"{kind}\0{value}\0{attempt}\0{n}".encode(), key=key).digest()
        n += 1


def _draw(stream: Iterator[int], choices: int) -> int:
    return int.from_bytes(bytes(next(stream) for _ in range(4)), "big") % choices


def _luhn(digits: str) -> int:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def _like(c: str, stream: Iterator[int], hexadecimal: bool = False) -> str:
    """A character of the same class: digit, upper or lower case letter of the same alphabet; others stay."""
    if hexadecimal and c in "0123456789abcdef":
        return "0123456789abcdef"[_draw(stream, 16)]
    if c.isdigit():
        return str(_draw(stream, 10))
    if c.isascii() and c.isalpha():
        return chr((65 if c.isupper() else 97) + _draw(stream, 26))
    if c.isalpha():
        alphabet = {"CYRILLIC": "абвгдежзиклмнопрстуфхцчшэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}.get(script_of(c), "áéíóúàèìòùäöüñç")
        new = alphabet[_draw(stream, len(alphabet))]
        return new.upper() if c.isupper() else new
    return c


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The replacement of a normal form, itself in normal form. From attempt ``WIDER`` on it gets longer with each, so that no set of
    entities can hold all that is drawn."""
    s = _stream(key, kind, value, attempt)
    more = attempt - WIDER + 4 if attempt >= WIDER else 0
    letters = "".join(chr(97 + _draw(s, 26)) for _ in range(more))
    if kind.startswith("given:"):
        pool = [n for n in GIVEN.get((script_of(value), kind[6:])) or GIVEN[("LATIN", kind[6:] or "f")] if n.lower() != value]
        name = pool[_draw(s, len(pool))].lower()
        return name if attempt < 8 else name + "-" + pool[_draw(s, len(pool))].lower() if attempt < 24 else "".join(_like(c, s) for c in value) + letters
    if kind == "surname":
        pool = [n for n in SURNAMES.get(script_of(value), SURNAMES["LATIN"]) if n.lower() != value]
        name = pool[_draw(s, len(pool))].lower()
        return name if attempt < 4 else name + "-" + pool[_draw(s, len(pool))].lower() if attempt < 16 else "".join(_like(c, s) for c in value) + letters
    if kind == "ip":
        low = {1: (1, 9), 2: (10, 99), 3: (100, 254)}
        return ".".join(str(a + _draw(s, b - a + 1)) for a, b in ((1, 254) if more else low[len(o)] for o in value.split(".")))
    if kind == "ipv6":  # the first group tells the kind of address and stays, and so do groups of zeros
        groups = [int(g, 16) for g in value.split(":")]
        low = [16 ** (len(f"{g:x}") - 1) for g in groups]
        drawn = [1 + _draw(s, 0xFFFF) if more else g and n + _draw(s, 15 * n) for g, n in zip(groups[1:], low[1:], strict=True)]
        return ":".join(f"{g:04x}" for g in [groups[0], *drawn])
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        if labels[-2:-1] != ["example"] and len(labels) > 1:
            d = _stream(key, "domain", domain, 0)
            labels = ["".join(_like(c, d) for c in x) for x in labels[:-1]] + labels[-1:]
        return "".join(_like(c, s) for c in local) + letters + "@" + ".".join(labels)
    if kind == "card":
        body = value[0] + "".join(str(_draw(s, 10)) for _ in range(len(value) - 2 + more))
        if _luhn(value) == 0:
            return next(body + str(c) for c in range(10) if _luhn(body + str(c)) == 0)
        return body + str(_draw(s, 10))
    if kind == "phone":
        kept = 2 if value.startswith("+") else 0
        rest = [str(_draw(s, 10)) for _ in range(len(value) - kept + more)]
        if kept == 0 and value[0] != "0":
            rest[0] = str(1 + _draw(s, 9))
        return value[:kept] + "".join(rest)
    if kind == "iban":
        return value[:2] + "".join(_like(c, s) for c in value[2:] + "0" * more)
    start = 4 if kind == "secret" and value.startswith("AKIA") else 0
    hexadecimal = kind == "secret" and not value.isdigit() and all(c in "0123456789abcdef" for c in value[start:])
    tail = "0" * more if kind == "ssn" else "a" * more
    return value[:start] + "".join(_like(c, s, hexadecimal) for c in value[start:] + tail)


def render(found: str, kind: str, new: str) -> str:
    """A surrogate in the mention's own format: its punctuation for numbers, its case for names and addresses."""
    if kind in ("phone", "card", "ssn", "iban"):
        signs = iter(new.lstrip("+"))
        return "".join(next(signs) if c.isalnum() else c for c in found) + "".join(signs)
    if kind == "ipv6":
        groups = new.split(":")
        if "::" in found:
            head, _, tail = found.partition("::")
            left, right = (x.split(":") if x else [] for x in (head, tail))
            hidden = groups[len(left) : 8 - len(right)]
            shown = [(left, groups[: len(left)]), (right, groups[8 - len(right) :])] if not any(int(g, 16) for g in hidden) else []
        else:
            shown = [(found.split(":"), groups)]
        spelled = "::".join(":".join(f"{int(g, 16):0{len(f)}x}" for f, g in zip(*x, strict=True)) for x in shown) or ipaddress.IPv6Address(new).compressed
        return spelled.upper() if found.isupper() else spelled
    if kind == "email" and len(found) == len(new):
        return "".join(b.upper() if a.isupper() else b for a, b in zip(found, new, strict=True))
    if kind == "surname" or kind.startswith("given:"):
        return new.upper() if found.isupper() and len(found) > 1 else "-".join(x.capitalize() for x in new.split("-"))
    return new


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct (kind, value) of the whole table."""

    def run(batches):
        for batch in slices(batches, "_text"):
            found = sorted({(k, v) for t in batch.column("_text").to_pylist() for _, _, k, v in detect(t)})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["kind", "value"])

    return docs.select(F.col(text_col).alias("_text")).where("_text is not null").mapInArrow(run, "kind string, value string").distinct()


def assign(found: DataFrame, key: bytes, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(kind, value, attempt, new): one surrogate for each entity, no two alike within a kind, none a real entity of it.

    A name of either gender must not come out as another's, so kinds of given names are checked together.
    """

    def draw(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "attempt")), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(key, *r) for r in rows], pa.string())], names=["kind", "value", "attempt", "new"])

    schema = "kind string, value string, attempt int, new string"
    group = F.split("kind", ":")[0]
    current = scratch.save(found.withColumn("attempt", F.lit(0)).mapInArrow(draw, schema))
    real = found.select(group.alias("g"), F.col("value").alias("new"), F.lit(True).alias("taken")).distinct()
    for _ in range(most_rounds):
        first = current.groupBy(group.alias("g"), "new").agg(F.min_by("value", F.struct("attempt", "value", "kind")).alias("owner"), F.min_by("kind", F.struct("attempt", "value", "kind")).alias("owner_kind"), F.count("*").alias("n"))
        wrong = first.join(real, ["g", "new"], "left").where("n > 1 or taken")
        clash = current.join(wrong.withColumnRenamed("g", "_g").withColumnRenamed("new", "_new"), (group == F.col("_g")) & (F.col("new") == F.col("_new"))).where(
            "taken or not (value = owner and kind = owner_kind)").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        again = scratch.save(clash)
        if again.limit(1).count() == 0:
            return current
        following = scratch.save(current.join(again.select("kind", "value"), ["kind", "value"], "left_anti").unionByName(again.mapInArrow(draw, schema)))
        scratch.drop(current, again)
        current = following
    raise RuntimeError("surrogates still collide; the pools are too small for these entities")


def replace(df: DataFrame, key: bytes, text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """Texts with every detected entity replaced, and ``n_entities`` (mentions replaced).

    Null texts stay null with 0 entities, an empty table stays empty. All other columns and repeated rows stay; ``n_entities`` is replaced. Entities that
    were drawn again are broadcast if they are at most ``broadcast_rows``; beyond that they are joined by the hash of the
    text that mentions them.
    """
    spark = df.sparkSession
    tune(spark)
    scratch = Scratch(spark, "pii")
    assigned = assign(scratch.save(entities(df, text_col)), key, scratch)
    redrawn = assigned.where("attempt > 0").select("kind", "value", "attempt")
    df = df.drop("n_entities")
    keep, redrawn_here, text_hash = df.columns, free_name(df, "_attempts"), free_name(df, "_h")
    schema = T.StructType([*df.schema.fields, T.StructField("n_entities", T.LongType(), False)])

    def rewrite(text: str | None, attempts: dict) -> tuple[str | None, int]:
        if text is None:
            return None, 0
        parts, at, spans = [], 0, detect(text)
        for a, b, kind, value in spans:
            parts += [text[at:a], render(text[a:b], kind, surrogate(key, kind, value, attempts.get((kind, value), 0)))]
            at = b
        return "".join([*parts, text[at:]]), len(spans)

    few = redrawn.limit(broadcast_rows + 1).collect()
    shared = spark.sparkContext.broadcast({(r.kind, r.value): r.attempt for r in few} if len(few) <= broadcast_rows else None)

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            own = batch.column(len(keep)).to_pylist() if batch.num_columns > len(keep) else None
            out = [rewrite(t, shared.value if own is None else {(x["kind"], x["value"]): x["attempt"] for x in own[i] or ()}) for i, t in enumerate(texts)]
            columns = [pa.array([t for t, _ in out], pa.string()) if f == text_col else batch.column(f) for f in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array([n for _, n in out], np.int64))], names=[*keep, "n_entities"])

    if len(few) <= broadcast_rows:
        return df.mapInArrow(run, schema)

    def mentions(batches):
        for batch in slices(batches, "_text"):
            rows = sorted({(h, k, v) for h, t in zip(batch.column("_h").to_pylist(), batch.column("_text").to_pylist(), strict=True) for _, _, k, v in detect(t)})
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["_h", "kind", "value"])

    hashed = df.withColumn(text_hash, F.xxhash64(text_col))
    per_text = hashed.select(F.col(text_hash).alias("_h"), F.col(text_col).alias("_text")).where("_text is not null").mapInArrow(mentions, "_h bigint, kind string, value string").distinct().join(redrawn, ["kind", "value"]).groupBy("_h").agg(
        F.collect_list(F.struct("kind", "value", "attempt")).alias(redrawn_here)).withColumnRenamed("_h", text_hash)
    return hashed.join(per_text, text_hash, "left").select(*keep, redrawn_here).mapInArrow(run, schema)
