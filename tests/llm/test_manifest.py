"""Merkle manifest, mixing and token alignment."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tincture.llm import alignment, merkle, mixing, queries

from .data import hostile, table, words

SMALL = "/root/testdata/sf0.001"
COLUMNS = queries.LEAF


def _compare(spark, duck, name):
    mine = queries.queries()[name](spark, SMALL)
    theirs = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    assert sorted(map(tuple, mine.select(*names).collect())) == sorted(theirs.fetchall())


def test_manifest_and_mix_equal_sql(spark, duck):
    _compare(spark, duck, "op13_merkle")
    _compare(spark, duck, "op12_mixing")


# Merkle manifest.
def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _climb(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def _brute_manifest(rows, fanout):
    """rows: (id, group, leaf, shown) -> sorted (id, leaf, subroot, root, proof, folded, verified)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = _climb([r[2] for r in groups[g]], fanout)
    top = _climb([trees[g][-1][0] for g in names], fanout)
    out = []
    for place, g in enumerate(names):
        for i, (own, _, leaf, shown) in enumerate(groups[g]):
            proof, now = [], shown
            for levels, at in ((trees[g], i), (top, place)):
                for nodes in levels[:-1]:
                    first = at // fanout * fanout
                    before, after = nodes[first:at], nodes[at + 1 : first + fanout]
                    proof += before + after
                    now = _h(*before, now, *after)
                    at //= fanout
            out.append((own, leaf, trees[g][-1][0], top[-1][0], "".join(proof), now, now == top[-1][0]))
    return sorted(out, key=str)


def _leaf(row, extra=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = None if n_chars is None else n_chars + extra
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _manifest_table(spark, n, groups, copies=3):
    """Documents with nulls in every column, repeated ids, repeated rows, and a column whose name clashes."""
    rows = [(i, f"text {i} ñ" * (i % 5), groups[0] if i % 3 else groups[i % len(groups)], f"s{i % 4}", i) for i in range(n)]
    rows += [(None, "no id", groups[0], None, None), (4, "same id", groups[0], "s", 9), (5, None, None, "", 0)] + [(7, "copy", groups[0], "s", 1)] * copies
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf string").repartition(5)
    return rows, frame


@pytest.mark.parametrize(("fanout", "block"), [(2, 4), (2, 1024), (3, 9), (5, 5)])
def test_manifest_against_brute_force(spark, monkeypatch, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK_NODES", block)  # small blocks: trees of several tables
    groups = ["en", None, "", "é", "z"] + [f"g{i}" for i in range(7)]
    rows, frame = _manifest_table(spark, 150, groups)
    hit = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
    expected = _brute_manifest([(r[0], r[2], _leaf(r), _leaf(r, 1) if hit(r) else _leaf(r)) for r in rows], fanout)
    found = merkle.manifest(frame, COLUMNS, fanout=fanout, claimed=merkle.tampered_leaf(COLUMNS)).collect()
    assert sorted(map(tuple, found), key=str) == expected
    assert 0 < sum(not r["verified"] for r in found) < len(found) / 2


def test_manifest_of_few_rows(spark):
    rows, frame = _manifest_table(spark, 1, ["en"], 0)
    one = frame.where("n_chars = 0 and doc_id = 0")
    r = merkle.manifest(one, COLUMNS).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] == _leaf(rows[0]) and r["proof"] == "" and r["verified"]
    assert merkle.manifest(frame.where("false"), COLUMNS).collect() == []
    long = spark.createDataFrame([(1, "ab " * 700_000, "en", None, 2**63 - 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.manifest(long, COLUMNS, claimed=merkle.tampered_leaf(COLUMNS, every=1)).first()["verified"] is False


# Mixing.
def _brute_targets(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, share = total - most * sum(sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and left * weight[s] > most * sizes[s] * share}
        if not more:
            return {s: float(most * sizes[s]) if s in capped else left * weight[s] / share for s in order}
        capped |= more


def _mixed_table(spark):
    rows = [(i, t, s) for i, (k, t) in enumerate(hostile(3)) for s in [["a", "B", None, "", "é", "tiny", "zz"][min(6, k % 11)]]]
    rows += [(5000 + i, "one two", "tiny") for i in range(2)] + [(6000 + i, None if i % 2 else " \t\n", "empty") for i in range(4)] + [(None, "no id here", "a"), (1, "same id again", "a")]
    rows += [(10_000 + i, "w " * (i % 50 + 1), "hot") for i in range(4000)]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, copy string, key int").repartition(4)


def test_mix_against_brute_force(spark):
    rows, frame = _mixed_table(spark)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    goal = _brute_targets(sizes)
    found = mixing.plan(frame).collect()
    assert len(found) == len(rows)
    assert sorted((r["doc_id"] or 0, r["size"], r["source_size"], r["target"]) for r in found) == sorted((i or 0, len(words(t)), sizes[s], goal[s]) for i, t, s in rows)
    assert all(r["taken"] == r["size"] * r["copies"] and r["copies"] in (int(r["rate"]), min(3, int(r["rate"]) + 1)) for r in found)
    hot = [r for r in found if r["source_size"] == sizes["hot"]]
    assert abs(sum(r["taken"] for r in hot) / goal["hot"] - 1) < 0.05
    assert any(goal[s] == 3 * sizes[s] > 0 for s in sizes)  # the stop was reached
    again = mixing.plan(frame.repartition(9)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mix_emits_the_copies_that_the_plan_counts(spark, monkeypatch):
    rows, frame = _mixed_table(spark)
    mixed = mixing.mix(frame)
    assert set(mixed.columns) == set(frame.columns)
    taken = sum(r["taken"] for r in mixing.plan(frame).collect())
    assert mixed.agg(F.sum(mixing.count_words(F.col("text")))).first()[0] == taken
    assert {r["copy"] for r in mixed.select("copy").distinct().collect()} <= {0, 1, 2}
    monkeypatch.setattr(mixing, "_BROADCAST_SOURCES", 0)  # many sources: dealt by id
    assert sorted(map(str, mixing.plan(frame).collect())) == sorted(map(str, mixing.plan(frame).collect()))
    assert mixing.mix(frame).count() == mixed.count()


def test_mix_of_nothing(spark):
    _, frame = _mixed_table(spark)
    assert mixing.plan(frame.where("false")).collect() == [] and mixing.mix(frame.where("false")).count() == 0
    empty = mixing.plan(frame.where("source = 'empty'")).collect()
    assert [(r["target"], r["taken"]) for r in empty] == [(0.0, 0)] * 4


# Alignment.
def _brute_alignment(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(queries.vocabulary_path())
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary_path(queries.PIECE_BPE))
    from tincture.llm.bpe import byte_letters

    letters = byte_letters()
    out, links, counts = [], [], {}
    for doc_id, text in docs:
        groups, own, a, b = [], [], [], []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            left = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
            right = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
                a, b = [], []
            i = j = from_a = from_b = 0
            end_a, end_b = (len(left[0]), len(right[0])) if a else (0, 0)
            while i < len(a) and j < len(b):
                if end_a == end_b:
                    groups.append(",".join(map(str, a[from_a : i + 1])) + "|" + ",".join(map(str, b[from_b : j + 1])))
                    own.append((a[i], b[j]))
                    from_a, from_b = i + 1, j + 1
                if end_a <= end_b:
                    i += 1
                    end_a += len(left[i]) if i < len(a) else 1
                    if end_a - (len(left[i]) if i < len(a) else 1) == end_b:
                        j += 1
                        end_b += len(right[j]) if j < len(b) else 1
                else:
                    j += 1
                    end_b += len(right[j]) if j < len(b) else 1
        for pair in own:
            counts[pair] = counts.get(pair, 0) + 1
        links.append(own)
        out.append((doc_id, len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return sorted((*o[:5], sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), o[5]) for o, own in zip(out, links, strict=True))


def _odd_texts():
    return [
        (900, "a  b   c \n\n  d\t e  "), (901, " lead and trail "), (902, "x ▁y z"), (903, "don't  <|endoftext|> <s> </s> <0x41> it's"), (904, "日本語 テキスト　全角 空白"), (905, "a b c ᠎ d ​ e﻿ f"),
        (906, "\x00 \x01 \x1c a \x85 b"), (907, " "), (908, "   "), (909, "é é ﬁ Å  👩‍👩‍👧 ok"), (910, "word" * 3000), (911, "1234567 89  - -- --- ?!"), (912, "the the the the"), (913, "\n \n"), (915, "a\nb\n\nc \n d\n"), (916, "x\r\ny ▁"), (917, "one\ntwo the.\nThe"), (914, "tab\there  and　there"),
    ]


def test_alignment_against_brute_force(spark, monkeypatch):
    docs = hostile(5) + _odd_texts() + [(912, "the the the the")]
    expected = _brute_alignment(docs)
    frame = table(spark, docs).withColumn("row", F.lit("x"))
    paths = queries.vocabulary_path(), queries.vocabulary_path(queries.PIECE_BPE)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = alignment.align(frame, *paths, group_postings=300)
    assert found.columns == columns and sorted(map(tuple, found.collect())) == expected
    assert [r for r in expected if r[0] == 902][0][1:] == (0, 0, 0, 0, 0, 0, "")
    assert alignment.align(frame.where("false"), *paths).collect() == []


def test_alignment_in_parts_and_with_a_small_cache(monkeypatch):
    paths = queries.vocabulary_path(), queries.vocabulary_path(queries.PIECE_BPE)
    definition, model = open(paths[0], encoding="utf-8").read(), open(paths[1], "rb").read()
    texts = [t for _, t in hostile(6) + _odd_texts() if t]
    whole = alignment.Aligner(definition, model)
    assert whole.separable
    expected = whole.align_all(texts)
    monkeypatch.setattr(alignment, "PART", 40)
    monkeypatch.setattr(alignment, "CACHED", 30)
    monkeypatch.setattr(alignment, "_TIMES", 3)
    parts = alignment.Aligner(definition, model)
    for text, (*numbers, own) in zip(texts, expected, strict=True):
        [(*other, packed)] = parts.align_all([text])
        assert other == numbers
        totals = {}
        for p in packed.tolist():
            totals[p >> 21] = totals.get(p >> 21, 0) + (p & ((1 << 21) - 1))
        assert totals == {p >> 21: p & ((1 << 21) - 1) for p in own.tolist()} and all(1 <= p & ((1 << 21) - 1) <= 3 for p in packed.tolist())
    parts.separable = False
    assert [e[:3] for e in parts.align_all(texts)] == [e[:3] for e in expected]
    assert whole.fast is not None
    whole.forget()
    whole.fast = None
    assert [e[:4] for e in whole.align_all(texts)] == [e[:4] for e in expected]
