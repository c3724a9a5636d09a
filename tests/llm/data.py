"""Small hostile tables and brute-force versions shared by the tests."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def prose(rng, n):
    return " ".join("".join(rng.choice(["ta", "ko", "mi", "re", "su", "ne", "lo"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def hostile(seed=0):
    """(doc_id, text): nulls, empties, very long texts, exact and near copies, shared passages, repetition, odd bytes."""
    rng = random.Random(seed)
    shared = prose(rng, 60)
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(20, 60)]
    rows += [(3, prose(rng, 40) + " " + shared + " " + prose(rng, 9)), (7, shared), (1, "x " + shared + "\n" + shared), (90, shared[:-3] + "é€😀")]
    rows += [(100 + i, rows[5][1]) for i in range(6)]  # copies
    rows += [(120, None), (121, ""), (122, "   \n\t"), (123, None), (124, "a"), (125, "a b"), (126, "ñ" * 80), (127, "ñ" * 80 + "x")]
    rows += [(130, "the " * 200), (131, "the " * 100), (132, "ab" * 400), (133, "a" * 49), (134, "a" * 50), (135, "a" * 51), (136, "B" + "a" * 50)]
    rows += [(140, prose(rng, 9000)), (141, rows[0][1].upper()), (142, rows[0][1] + " <|endoftext|> it's  42!\u00a0\u3000end")]
    rng.shuffle(rows)
    return rows


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_bytes(docs, length=50):
    first = {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def brute_words(docs, size=20):
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = words(t)
        gone = [0] * len(w)
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            if key in seen:
                gone[p : p + size] = [1] * size
            seen.add(key)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()))
    return out


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def table(spark, rows):
    """Documents with the usual columns and some whose names clash with what operators add."""
    full = [(i, t, "en", "s", None if t is None else len(t), "keep", 5.0, i) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, component long").repartition(3)
