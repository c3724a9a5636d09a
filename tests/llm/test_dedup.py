"""Byte strings, word passages, SimHash and embeddings against brute force."""

import math
import random

import numpy as np
import pytest
import xxhash

from tincture.llm import embedding_dedup, passage_dedup, simhash, substring_dedup, suffix_order
from tincture.llm.blocks import Block, answer_repeats, join_bits
from tincture.llm.common import Scratch
from tincture.llm.components import components
from tincture.llm.passage_dedup import SuffixAutomaton

from .data import brute_bytes, brute_words, hostile, prose, table, union_find, words


def small(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return docs, [tuple(r) for r in docs.collect()]


@pytest.mark.parametrize(("block_bytes", "hot"), [(2 << 20, 2000), (3000, 2000), (3000, 1), (2 << 20, 0)])
def test_byte_strings(spark, block_bytes, hot):
    rows = hostile()
    got = substring_dedup.deduplicate(table(spark, rows), text=True, block_bytes=block_bytes, hot=hot).collect()
    want = brute_bytes(rows)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)


def test_byte_strings_whole_table(spark):
    docs, rows = small(spark)
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.deduplicate(docs).collect()}
    assert got == brute_bytes(rows)


def popular(n):
    """Documents of one phrase each in words of their own; every third also has a passage of over 50 bytes around the phrase."""
    rng = random.Random(8)
    phrase = "all rights reserved by us "
    around = ("this notice must stay in place, " + phrase, "and nobody may leave it out of any copy ")
    return [(i, f"{rng.getrandbits(400):x} " + (phrase if i % 3 else phrase.join(around)) + f"{rng.getrandbits(400):x}") for i in range(n)]


def test_a_popular_phrase_is_split_and_changes_nothing(spark):
    rows = popular(300)
    for hot in (2000, 20):
        got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.deduplicate(table(spark, rows), block_bytes=4000, hot=hot).collect()}
        assert got == brute_bytes(rows)


def test_the_largest_group_of_a_popular_phrase():
    """What one key is sent: a stretch of each document without splitting, one string of each block with it."""
    rows = popular(240)
    held = []
    for number in range(8):
        texts = [t.encode() for _, t in rows[number * 30 : number * 30 + 30]]
        ends = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        held.append(Block(number, np.arange(number * 30, number * 30 + 30), ends, np.frombuffer(b"".join(texts), np.uint8), np.zeros(30, bool)))

    def exchange(question, answer, bits):
        sent = [(bucket, i, p) for i, block in enumerate(held) for bucket, p in question(block, bits[i])]
        parts = [[] for _ in held]
        for bucket in {b for b, _, _ in sent}:
            own = [(i, p) for b, i, p in sent if b == bucket]
            for (i, _), x in zip(own, answer([p for _, p in own]), strict=True):
                parts[i].append({"bucket": bucket, "n": x.size, "bits": np.packbits(x.ravel()).tobytes()})
        return [[*b, join_bits(p)] for b, p in zip(bits, parts, strict=True)]

    def largest(hot):
        strings = substring_dedup._Strings(50, 4, 4, hot)
        bits = [[np.zeros(30, bool)] for _ in held]
        bits = exchange(strings.ask_anchors, strings.answer_anchors, bits)
        bits = exchange(strings.ask_hot, answer_repeats, bits)
        keys = np.concatenate([strings.stretches(block, b)[-1] for block, b in zip(held, bits, strict=True)])
        return np.unique(keys, return_counts=True)[1].max()

    assert largest(10**9) >= 80 and largest(20) <= 20  # 80 documents hold the passage


def test_byte_strings_with_null_ids_and_repeated_rows(spark):
    long = prose(random.Random(3), 40)
    docs = spark.createDataFrame([(None, long), (None, long), (5, long), (5, long)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in substring_dedup.deduplicate(docs).collect()), key=str)
    n = len(long)
    assert got == [(5, 0), (5, 0), (None, n), (None, n)]


def test_the_largest_id_is_not_a_null_one(spark):
    long = prose(random.Random(4), 40)
    docs = spark.createDataFrame([(2**63 - 1, long), (None, "short"), (7, long)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.deduplicate(docs).collect()}
    assert got == {2**63 - 1: len(long), None: 0, 7: 0}
    assert {r["doc_id"] for r in passage_dedup.deduplicate(docs).collect()} == set(got)


def test_every_cover_reaches_every_difference():
    for period, cover in suffix_order.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert suffix_order.cover_for(50) == 31


@pytest.mark.parametrize("depth", [1, 3, 8, 9, 20, 31, 50, 70, 200])
def test_suffix_order_with_long_ties(depth):
    rng = random.Random(depth)
    for letters in (b"a", b"ab", b"abcdefgh \x00\xff"):
        t = bytes(rng.choices(letters, k=900))
        t += t[100:350] * 2 + b"a" * 300 + t[:200]
        places = np.array([p for p in range(len(t) - depth + 1) if rng.random() < 0.8])
        want = sorted(t[p : p + depth] for p in places)
        for most in (1 << 19, 64):
            strings, runs = [], 0
            for own, heads in suffix_order.suffix_buckets(np.frombuffer(t, np.uint8), places, depth, most):
                for group in np.split(own, heads[1:]):
                    assert len({t[p : p + depth] for p in group}) == 1
                runs += len(heads)
                strings += [t[p : p + depth] for p in own]
            assert strings == want and runs == len(set(want))


def test_string_hashes_tell_strings_apart():
    data = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=3000)), np.uint8)
    for size in (1, 2, 7, 20, 50):
        hashes = substring_dedup.string_hashes(data, size, segment=64)
        strings = [data[i : i + size].tobytes() for i in range(len(data) - size + 1)]
        assert len(set(hashes.tolist())) == len(set(strings)) == len(set(zip(hashes.tolist(), strings, strict=True)))


@pytest.mark.parametrize("block_bytes", [2 << 20, 3000])
def test_passages(spark, block_bytes):
    rows = hostile()
    got = passage_dedup.deduplicate(table(spark, rows), text=True, block_bytes=block_bytes).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_words(rows)
    assert all(len(words(r["kept"].decode())) == r["n_words"] - r["n_removed"] for r in got)


def test_passages_whole_table_and_other_sizes(spark):
    docs, rows = small(spark)
    for size in (20, 3, 1):
        got = {r["doc_id"]: tuple(r)[1:] for r in passage_dedup.deduplicate(docs, size).collect()}
        assert got == brute_words(rows, size)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for f in (substring_dedup.deduplicate, passage_dedup.deduplicate, simhash.near_duplicates, simhash.similar_groups):
        assert f(none).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_matching_statistics():
    rng = random.Random(2)
    automaton, past = SuffixAutomaton(), []
    for _ in range(40):
        seq = [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        got = automaton.add(seq)
        for t in range(len(seq)):
            best = 0
            for n in range(1, t + 2):
                run = seq[t + 1 - n : t + 1]
                earlier = any(p[i : i + n] == run for p in past for i in range(len(p))) or any(seq[i : i + n] == run for i in range(t + 1 - n))
                best = n if earlier else best
            assert got[t] == best
        past.append(seq)


def brute_fingerprint(text, size=3):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    k = min(size, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark):
    rows = hostile()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table(spark, rows)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    groups = union_find(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in ids}


@pytest.mark.parametrize(("levels", "largest"), [(1, 1000), (1, 20), (1, 0), (2, 2), (2, 0), (3, 1000)])
def test_vantage_partitions_lose_no_link(spark, levels, largest):
    rng = random.Random(levels)
    codes = [rng.getrandbits(64) for _ in range(300)]
    codes += [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in codes for _ in range(2)]
    codes = list(dict.fromkeys(codes))
    rows = [(c - (1 << 64) if c >> 63 else c, i) for i, c in enumerate(codes)]
    scratch = Scratch(spark, "test")
    found = components(simhash.links(spark.createDataFrame(rows, "fp long, rep long"), 3, levels, largest), scratch)
    got = dict(map(tuple, found.collect()))
    want = union_find(range(len(codes)), [(i, j) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 3])
    assert {i: got.get(i, i) for i in want} == want


def test_vantage_tree_prunes_right(spark):
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 2**63, 600, dtype=np.uint64)
    prints[300:] = prints[:300] ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64))
    tree = simhash.VantageTree(prints, 3, leaf=8)
    tree.search(np.arange(600), np.arange(600))
    want = union_find(range(600), [(i, j) for i in range(600) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 3])
    assert tree.forest.roots(np.arange(600)).tolist() == [want[i] for i in range(600)]


def test_shingle_similarity_groups(spark):
    docs, rows = small(spark)
    rng = random.Random(9)
    extra = []
    for i, t in rows[:60]:
        w = words(t)
        for k in range(3):
            v = list(w)
            for _ in range(max(1, len(v) * (k + 1) // 100)):
                v[rng.randrange(len(v))] = "changed"
            extra.append((1000 + 10 * i + k, " ".join(v)))
    rows = rows + extra + [(9001, None), (9002, ""), (9003, "one two")]

    def sets(t):
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}

    own = {i: sets(t) for i, t in rows}
    ids = sorted(own)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])]
    want = union_find(ids, near)
    for part in (20_000, 30):
        got = dict(map(tuple, simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), largest_part=part).collect()))
        assert got == want


def shingle_groups(rows):
    """Components of exact set similarity 0.8 of five-word shingles, by brute force."""

    def sets(t):
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}

    own = {i: sets(t) for i, t in rows}
    ids = sorted(own)
    return union_find(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])])


def test_similar_groups_miss_nothing_in_short_and_repetitive_texts(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    line = " ".join(word() for _ in range(40))
    rows = []
    for i in range(0, 600, 2):
        w = [word() for _ in range(rng.randint(6, 40))]
        v = [*w, *(word() for _ in range(len(w) // 5))] if i % 4 else w[: len(w) - rng.randint(0, len(w) // 5)]
        rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
    for i in range(1000, 1060, 2):
        w = [word() for _ in range(204)]
        rows += [(i, " ".join(w)), (i + 1, " ".join(w[:100] + w[88:100] * rng.choice([5, 10, 20]) + w[100:]))]
    rows += [(2000 + i, f"{line} {' '.join(word() for _ in range(rng.randint(1, 60)))}") for i in range(60)]
    want = shingle_groups(rows)
    for part in (20_000, 20):
        got = dict(map(tuple, simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), largest_part=part).collect()))
        assert got == want


def test_texts_of_one_word_in_the_main_stay_apart(spark):
    rng = random.Random(12)
    other = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(40))
    filler = "na " * 60
    rows = [(i, filler + other()) for i in range(6)]
    near = rows[3][1].rsplit(" ", 3)[0]
    rows += [(10, near), (11, near + " x y")]
    got = dict(map(tuple, simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == shingle_groups(rows) and got[0] == 0 and got[1] == 1 and got[10] == 3


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()))
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(301)} == {1000} and len(got) == 502


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 16))
    rows = [(i, (centres[i % 60] + 0.15 * rng.standard_normal(16)).tolist()) for i in range(900)]
    rows += [(2000 + i, rows[3][1]) for i in range(40)]  # copies
    odd = [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [math.nan] * 16), (3004, [math.inf] + [1.0] * 15), (3005, [None] + [1.0] * 15), (3006, [1.0] * 4), (3007, [-1.0] * 4), (None, rows[3][1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, kept string")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(frame, leaf=64, trees=12).collect()}
    ids = np.array([i for i, _ in rows] + [-1])
    unit = np.array([v for _, v in rows] + [rows[3][1]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    found = np.array([got[None if i < 0 else int(i)]["n_links"] for i in ids])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.9 * near.sum()
    groups = union_find(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in np.argwhere(near)])
    agree = np.mean([got[int(i)]["component_id"] == min(x for x in groups if x >= 0 and groups[x] == groups[int(i)]) for i in ids if i >= 0])
    assert agree >= 0.9
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(3000, 3008))
    assert not got[None]["kept"] and got[None]["component_id"] == got[3]["component_id"]


def recall(got, ids, vectors):
    """Found links over all links, by brute force; none may be found beyond those."""
    unit = np.array(vectors, dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = np.concatenate([(unit[i : i + 2000] @ unit.T >= 0.9).sum(axis=1) - 1 for i in range(0, len(unit), 2000)])
    found = np.array([got[i] for i in ids])
    assert (found <= want).all() and want.sum() > 0
    return found.sum() / want.sum()


def test_embeddings_recall_on_the_whole_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toPandas()
    rng = np.random.default_rng(5)
    base = np.array(frame["embedding"].tolist(), dtype=float)
    ids, vectors = frame["vec_id"].tolist(), base.tolist()
    for k in range(2):  # the table itself holds no two vectors this close
        noise = rng.standard_normal(base.shape) / np.sqrt(base.shape[1])
        near = base + np.linalg.norm(base, axis=1, keepdims=True) * rng.uniform(0.05, 0.47, (len(base), 1)) * noise
        ids += [10_000_000 * (k + 1) + i for i in frame["vec_id"].tolist()]
        vectors += near.tolist()
    rows = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<double>").repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(rows, leaf=400).collect()}
    assert recall(got, ids, vectors) >= 0.9


def test_embeddings_of_other_lengths_and_dense_clusters(spark):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(8)
    rows = [(i, (centre + 0.02 * rng.standard_normal(8)).tolist()) for i in range(700)]
    rows += [(1000 + i, rng.standard_normal(8).tolist()) for i in range(300)]
    rows += [(2000 + i, [1.0, 2.0, 3.0 + i, 4.0]) for i in range(2)] + [(3000, [5.0]), (3001, [7.0]), (3002, [-7.0]), (3003, [1.0] * 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for part in (8000, 100):
        got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(frame, leaf=200, largest_part=part).collect()}
        eights = [(i, v) for i, v in rows if len(v) == 8]
        assert recall({i: r["n_links"] for i, r in got.items()}, [i for i, _ in eights], [v for _, v in eights]) >= 0.99
        assert all(got[i]["component_id"] == 0 for i in range(700))
        assert [got[i]["component_id"] for i in (2000, 2001, 3000, 3001, 3002, 3003)] == [2000, 2000, 3000, 3000, 3002, 3003]
