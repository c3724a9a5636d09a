"""Queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, embedding_dedup, language_id, merkle, mixing, passage_dedup, pii, simhash, substring_dedup, toxicity, url_filter
from .common import documents, held_out

#: The session setting that holds the key of surrogates. A deployment sets its own; the default makes the registered query repeatable.
SURROGATE_KEY = "spark.tincture.surrogateKey"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
#: What a leaf of the manifest is made of, in order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def vocabulary_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def surrogate_key(spark: SparkSession) -> bytes:
    return spark.conf.get(SURROGATE_KEY, "registered query").encode()


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(documents(spark, sf_dir, "doc_id", "text"))


def op2_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.deduplicate(documents(spark, sf_dir, "doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    filters = language_id.fit(language_id.training_rows(docs))
    found = language_id.predict(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(documents(spark, sf_dir, "doc_id", "text"), surrogate_key(spark))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir, "doc_id", "text"), vocabulary_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir, "doc_id", "text"), vocabulary_path(), vocabulary_path(PIECE_BPE))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir, "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    proven = merkle.manifest(documents(spark, sf_dir, *LEAF), LEAF, claimed=merkle.tampered_leaf(LEAF))
    return proven.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring_dedup, op2_passage_dedup, op3_toxicity, op4_language_id, op5_benchmark_decontamination, op6_pii, op7_simhash, op8_url_filter, op9_bpe, op10_embedding_dedup, op11_alignment, op12_mixing, op13_merkle)}


_OP8_SQL = """
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rule_host, rule_path, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path,
       (SELECT max_by(rule_host || rule_path, length(rule_host || rule_path)) FROM rules
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
       coalesce((SELECT max_by(action, length(rule_host || rule_path)) FROM rules
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)), 'allow') AS verdict
FROM parsed
"""


_OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
r AS (SELECT w.doc_id, w.p FROM w JOIN f USING (s) WHERE least < w.doc_id),
g AS (SELECT DISTINCT doc_id, p + unnest(range(50)) AS b FROM r),
c AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < b - 1) AS n_spans
      FROM (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id ORDER BY b) AS before FROM g) GROUP BY doc_id),
k AS (SELECT x.doc_id, string_agg(substr(h, 2 * x.b + 1, 2), '' ORDER BY x.b) AS kept
      FROM (SELECT doc_id, h, unnest(range(n)) AS b FROM d) x ANTI JOIN g ON g.doc_id = x.doc_id AND g.b = x.b GROUP BY x.doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
_OP2_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 19), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS i FROM x) WHERE i > 1),
g AS (SELECT DISTINCT doc_id, p + unnest(range(20)) AS b FROM r),
k AS (SELECT y.doc_id, string_agg(y.word, ' ' ORDER BY y.b) AS kept, count(*) AS n
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS b FROM d) y ANTI JOIN g ON g.doc_id = y.doc_id AND g.b = y.b GROUP BY y.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
#: All pairs: the forest's answer equals it where it misses none, as on tables of up to a leaf's size.
_OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
t(a, b) AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
m AS (SELECT a, min(b) AS least FROM t GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id, vec_id <= coalesce(m.least, vec_id) AS kept
FROM u LEFT JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
_OP12_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
c AS (SELECT *, row_number() OVER o AS i, (SELECT sum(source_size) FROM p) - 3 * coalesce(sum(source_size) OVER b, 0) AS open_size, (SELECT sum(w) FROM p) - coalesce(sum(w) OVER b, 0) AS open_w
      FROM p WINDOW o AS (ORDER BY source_size::DOUBLE / w, source), b AS (ORDER BY source_size::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT i, open_size, open_w FROM c WHERE open_size * w <= 3 * source_size * open_w ORDER BY i LIMIT 1),
t AS (SELECT c.source, source_size, CASE WHEN c.i < f.i THEN (3 * source_size)::DOUBLE ELSE f.open_size::DOUBLE * w::DOUBLE / f.open_w::DOUBLE END AS target FROM c, f),
r AS (SELECT doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
             ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
z AS (SELECT r.*, j, CASE WHEN u + j / 32.0::DOUBLE >= 1 THEN u + j / 32.0::DOUBLE - 1 ELSE u + j / 32.0::DOUBLE END AS v FROM r, range(32) x(j)),
y AS (SELECT source, j, abs(sum(CASE WHEN v < rate - floor(rate) THEN size ELSE 0 END)::DOUBLE - any_value((rate - floor(rate)) * source_size)) AS off FROM z GROUP BY source, j),
b AS (SELECT source, j FROM y QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, j) = 1)
SELECT doc_id, size, source_size, target, (size * least(3, floor(rate)::BIGINT + (v < rate - floor(rate))::BIGINT))::BIGINT AS taken
FROM z JOIN b ON b.source IS NOT DISTINCT FROM z.source AND b.j = z.j
"""
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
_OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, sha256({" || ".join(_FIELD.format(c) for c in LEAF)}) AS leaf,
         sha256({" || ".join(_FIELD.format("(n_chars + 1)" if c == "n_chars" else c) for c in LEAF)}) AS changed, {_CRC} % 7 = 0 AS hit FROM documents),
l AS (SELECT doc_id, lang, leaf, CASE WHEN hit AND n_chars IS NOT NULL THEN changed ELSE leaf END AS shown, row_number() OVER () AS r,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t(lang, lvl, pos, h, n) AS (
  SELECT lang, 0, pos, leaf, n FROM l
  UNION ALL SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
g AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, pos, h, n) AS (
  SELECT 0, pos, h, n FROM g UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n),
a AS (
  SELECT l.r, t.lvl AS ord, t.pos % 2 = 0 AS first, s.h AS sib
  FROM l JOIN t ON t.lang IS NOT DISTINCT FROM l.lang AND t.pos = l.pos >> t.lvl AND t.n > 1 LEFT JOIN t s ON s.lang IS NOT DISTINCT FROM t.lang AND s.lvl = t.lvl AND s.pos = xor(t.pos, 1)
  UNION ALL SELECT l.r, 100 + u.lvl, u.pos % 2 = 0, s.h
  FROM l JOIN g ON g.lang IS NOT DISTINCT FROM l.lang JOIN u ON u.pos = g.pos >> u.lvl AND u.n > 1 LEFT JOIN u s ON s.lvl = u.lvl AND s.pos = xor(u.pos, 1)),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY ord) AS i FROM a),
f(r, i, h) AS (SELECT r, 0, shown FROM l UNION ALL SELECT k.r, k.i, sha256(CASE WHEN sib IS NULL THEN h WHEN first THEN h || sib ELSE sib || h END) FROM f JOIN k ON k.r = f.r AND k.i = f.i + 1),
e AS (SELECT r, max_by(h, i) AS folded FROM f GROUP BY r), p AS (SELECT r, sha256(string_agg(coalesce(sib, ''), '' ORDER BY i)) AS proof FROM k GROUP BY r)
SELECT doc_id, leaf, g.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM u WHERE n = 1) AS verified
FROM l JOIN g ON g.lang IS NOT DISTINCT FROM l.lang JOIN e USING (r) LEFT JOIN p USING (r)
"""


def oracle_sql() -> dict:
    return {"op1_substring_dedup": _OP1_SQL, "op2_passage_dedup": _OP2_SQL, "op8_url_filter": _OP8_SQL, "op10_embedding_dedup": _OP10_SQL, "op12_mixing": _OP12_SQL, "op13_merkle": _OP13_SQL}
