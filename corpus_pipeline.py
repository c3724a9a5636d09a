"""The corpus pipeline: five of the training-data operators over ``documents``, each on all that the one before kept.

``run(spark, sf_dir)`` writes what each stage hands on to the shared folder as Parquet and reads it as the next one's input, so that
no stage is computed twice and a lost executor costs tasks of one stage. Each stage takes and (but for the last)
returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tincture.llm import bpe, decontaminate, language_id, pii, queries, simhash
from tincture.llm.common import Scratch


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the language filters find a language; those without letters or without any known n-gram go."""
    filters = language_id.fit(language_id.training_rows(docs))
    judged = language_id.predict(docs, filters)
    return judged.where("lang_pred <> 'und' and score > 0").select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: SimHash over five-word shingles, similarity 0.8."""
    return simhash.keep_one_of_similar(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets; n_chars follows the new text."""
    replaced = pii.replace(docs, queries.surrogate_key(spark))
    n_chars = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    return replaced.withColumn("n_chars", n_chars).select(*docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and whether they decode to its text."""
    coded = bpe.encode_checked(docs.select("doc_id", "lang", "source", "text"), queries.vocabulary_path())
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_near_copies),
    ("benchmark_decontamination", without_benchmarks),
    ("pii_surrogates", with_surrogates),
    ("bpe", tokenized),
]

#: SimHash components and surrogates are not expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = kept.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
