"""The pipeline, stage by stage on its own input, and what the entry module registers."""

import re
import shutil
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

from tokenizers import Tokenizer

import corpus_pipeline
from tincture.llm import decontaminate, pii, queries, simhash
from tincture.llm.common import crc_of

from .data import words
from .test_dedup import shingle_groups

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
        ids = {r["doc_id"] for r in docs.collect()}
        assert ids <= before
        before = ids
    assert decontaminate.matches(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0
    groups = simhash.similar_groups(docs).where("doc_id <> component_id").count()
    assert groups <= 1  # surrogates may bring two texts together
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len(last) == len(before) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in last)
    assert sum(1 for r in docs.collect() for _ in pii.detect(r["text"] or "")) > 0
    assert corpus_pipeline.run(spark, SMALL).count() == len(last)


def plain_pipeline(docs, items, key, library):
    """The five stages over lists of rows, without Spark and without any index."""

    def grams(text):
        folded = re.sub(b" +", b" ", b" " + bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()) + b" ")
        return [folded[i : i + 4] for i in range(len(folded) - 3)]

    seen = defaultdict(Counter)
    for r in docs:
        if r["doc_id"] is not None and crc_of(r["doc_id"]) % 4 != 2 and r["lang"] is not None and r["text"] is not None:
            seen[r["lang"]].update(grams(r["text"]))
    share = lambda lang, g: seen[lang][g] / max(1, seen[lang].total())
    known = {g for lang in seen for g, n in seen[lang].items() if n >= 2 and share(lang, g) >= 0.15 * max(share(x, g) for x in seen)}
    docs = [r for r in docs if any(c.isalpha() for c in r["text"] or "") and any(g in known for g in grams(r["text"]))]
    kept = [len(docs)]

    component = shingle_groups([(r["doc_id"], r["text"]) for r in docs if r["doc_id"] is not None])
    docs = [r for r in docs if r["doc_id"] is None or component[r["doc_id"]] == r["doc_id"]]
    kept.append(len(docs))

    def cut(w):
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]

    def holds(text, item):
        w, t = words(text), words(item)
        n, own = min(len(w), len(t)), Counter(cut(t))
        if not n or not any(s in own for s in cut(w)):
            return False
        for windows in (Counter(cut(w[s : s + n])) for s in range(len(w) - n + 1)):
            both = (windows & own).total()
            if both >= 0.8 * (windows.total() + own.total() - both) - 1e-9:
                return True
        return False

    docs = [r for r in docs if r["doc_id"] is None or not any(holds(r["text"], t) for t in items)]
    kept.append(len(docs))

    found = {(k, v) for r in docs for _, _, k, v in pii.detect(r["text"])}
    attempts, group = dict.fromkeys(found, 0), lambda kind: kind.split(":")[0]
    real = {(group(k), v) for k, v in found}
    while True:
        drawn = defaultdict(list)
        for (k, v), n in attempts.items():
            drawn[group(k), pii.surrogate(key, k, v, n)].append((n, v, k))
        again = [(k, v) for new, own in drawn.items() for n, v, k in sorted(own)[0 if new in real else 1 :]]
        if not again:
            break
        for e in again:
            attempts[e] += 1
    out = []
    for r in docs:
        text, at, parts = r["text"], 0, []
        for a, b, k, v in pii.detect(text):
            parts += [text[at:a], pii.render(text[a:b], k, pii.surrogate(key, k, v, attempts[k, v]))]
            at = b
        text = "".join([*parts, text[at:]])
        ids = library.encode(text, add_special_tokens=False).ids
        out.append((r["doc_id"], r["lang"], r["source"], len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False) == text))
    return out, kept


def test_run_equals_the_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows, items = [r.asDict() for r in docs.collect()], [r["text"] for r in benchmark.collect()]
    base = next(r for r in rows if len(words(r["text"])) > 100)
    w = words(base["text"])
    near, far = " ".join([*w[:-4], "x", *w[-3:]]), " ".join(w[: len(w) // 2] + w[: len(w) // 2 : -1])
    known = [v for v in w if len(v) > 4][:3]
    extra = [None, "", " 12 345 !", "Щ", "zqxj", base["text"], near, near.upper(), far, f"{' '.join(w[3:20])} {items[0]} {known[0]}", " ".join(words(items[1])[:-1]),
             " ".join(words(items[2])[: len(words(items[2])) // 2]), f"{known[0]} Mr Smith wrote to ann.lee@example.com, {known[1]} Anna Miller and Mr Smith {known[2]}",
             f"{known[1]} <|endoftext|> {known[2]} ü 😀", " ".join(w * 30)]
    rows += [{"doc_id": 10_000 + i, "text": t, "lang": None, "source": "added", "n_chars": None} for i, t in enumerate(extra)]
    rows += [{"doc_id": None, "text": base["text"], "lang": "en", "source": None, "n_chars": 1}]
    spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    want, kept = plain_pipeline(rows, items, queries.surrogate_key(spark), Tokenizer.from_file(queries.vocabulary_path()))
    assert len(rows) > kept[0] > kept[1] > kept[2] > 0  # each filtering stage has something to remove
    got = [(r["doc_id"], r["lang"], r["source"], r["n_tokens"], tuple(r["ids"]), r["round_trip"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_take_nulls_and_empty_tables(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "Is and retitioning ouen the of, nterti thorreou", "en", "s", 47), (None, "the and of with", "en", None, 15)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            docs.count()


def test_entry_works_without_this_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy), "HOME": "/tmp", "JAVA_HOME": __import__("os").environ.get("JAVA_HOME", "")})


def test_registered_queries_match_their_sql(spark, duck):
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SMALL).toPandas()
        want = duck.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        plain = lambda f: sorted(tuple(None if x != x else x for x in r) for r in f[columns].itertuples(index=False))
        assert list(map(str, plain(got))) == list(map(str, plain(want))), name
