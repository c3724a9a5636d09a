"""Toxicity: a counterfactual-regularised logistic classifier over a text's distinct words.

Besides the loss on labelled texts, training holds down how much a text's score changes when its identity terms are
swapped for others of the same kind: a word that only names a group then gets no weight of its own, which lowers false
positives on neutral mentions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, crc_of, free_name, hash_bound, slices, tune

_WORDS = regex.compile(r"\p{L}+")
#: Kinds of identity terms whose members are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "refugee", "foreigner", "native", "migrant"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer", "juden", "muslime", "christen", "ausländer"),
    ("femmes", "hommes", "juifs", "musulmans", "chrétiens", "immigrés"),
    ("mujeres", "hombres", "judíos", "musulmanes", "cristianos", "inmigrantes"),
)


_IDENTITY = frozenset(w for kind in IDENTITY_TERMS for w in kind)


def words_of(text: str, whole: frozenset[str] = _IDENTITY) -> set[str]:
    """Distinct letter runs, lower-cased, and the first four and five letters of longer ones (as ``abcd*``), so that unseen forms
    of a known stem count; digits, marks and punctuation do not. The terms in ``whole`` give no stems: a swap of identity terms
    then changes no feature but the terms themselves, whose weights training penalises."""
    words = set(_WORDS.findall(text.lower()))
    stems = words - whole
    return words | {w[:4] + "*" for w in stems if len(w) > 4} | {w[:5] + "*" for w in stems if len(w) > 5}


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    whole: frozenset[str] = _IDENTITY

    def score(self, text: str | None) -> float:
        known = self.weights.keys() & words_of(text or "", self.whole)
        return float(1.0 / (1.0 + np.exp(-np.clip(self.bias + sum(self.weights[w] for w in sorted(known)), -50, 50))))


def train(
    texts: list[set[str]],
    labels: list[int],
    identity_terms=IDENTITY_TERMS,
    counterfactual: float = 4.0,
    ridge: float = 1e-4,
    lasso: float = 5e-4,
    least_texts: int = 5,
    largest_vocabulary: int = 50_000,
    steps: int = 500,
) -> ToxicityModel:
    """Fit by accelerated proximal gradient steps: log loss + ``ridge`` + ``lasso`` + ``counterfactual`` times the squared change of the logit
    under each swap of an identity term. Words in fewer than ``least_texts`` texts carry no weight, except identity terms."""
    order = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    codes = np.fromiter((order[w] for t in texts for w in sorted(t)), np.int64, len(row))
    return _train(row, codes, list(order), np.asarray(labels, dtype=float), identity_terms, counterfactual, ridge, lasso, least_texts, largest_vocabulary, steps)


def _train(row, codes, terms, y, identity_terms=IDENTITY_TERMS, counterfactual=4.0, ridge=1e-4, lasso=5e-4, least_texts=5, largest_vocabulary=50_000, steps=500) -> ToxicityModel:
    """``train`` over pairs of a text's number and a word's, with ``terms`` giving a word by its number."""
    n = len(y)
    whole = frozenset(w for kind in identity_terms for w in kind)
    if not n or len(set(y)) < 2:
        rate = (float(np.sum(y)) + 0.5) / (n + 1.0)
        return ToxicityModel(float(np.log(rate / (1 - rate))), whole=whole)
    kinds = {w: kind for kind in identity_terms for w in kind}
    counts = np.bincount(codes, minlength=len(terms))
    chosen = np.flatnonzero(counts >= least_texts)
    chosen = chosen[np.argsort(-counts[chosen], kind="stable")][:largest_vocabulary].tolist()
    vocabulary = [str(terms[i]) for i in chosen]
    have = set(vocabulary)
    for i, w in ((i, w) for i, w in enumerate(terms) if w in kinds and w not in have):
        chosen.append(i)
        vocabulary.append(w)
    to = np.full(len(terms), -1, np.int64)
    to[chosen] = np.arange(len(chosen))
    live = to[codes] >= 0
    row, col = row[live], to[codes[live]]
    place = {w: i for i, w in enumerate(vocabulary)}
    # Each swap of term a for b in a labelled text changes the logit by w[b] - w[a]; a pair's weight counts its texts.
    within = {w: set(row[col == place[w]].tolist()) for w in kinds if w in place}
    pairs = {(place[x], place.get(z, -1)): len(own - within.get(z, set())) / n for x, own in within.items() for z in kinds[x] if z != x}
    a, b = (np.array([p[i] for p in pairs], dtype=np.int64) for i in (0, 1))
    strength = counterfactual * np.array(list(pairs.values()))
    # The last weight is the bias: a word of every text, without penalties.
    size, per_text = len(vocabulary) + 1, np.bincount(row, minlength=n) + 1
    row, col = np.concatenate((row, np.arange(n))), np.concatenate((col, np.full(n, size - 1)))
    tied = b >= 0
    decay, least = np.full(size, ridge), np.full(size, lasso)
    decay[-1] = least[-1] = 0.0
    curve = 0.25 * np.bincount(col, per_text[row], size) / n + decay + 1e-9
    if len(a):
        curve += 4 * (np.bincount(a, strength, size) + np.bincount(b[tied], strength[tied], size))
    w = np.zeros(size)
    v, before, momentum = w.copy(), w.copy(), 1.0
    for _ in range(steps):
        error = 1.0 / (1.0 + np.exp(-np.clip(np.bincount(row, v[col], n), -50, 50))) - y
        grad = np.bincount(col, error[row], size) / n + decay * v
        if len(a):
            change = 2 * strength * (np.where(tied, v[np.maximum(b, 0)], 0.0) - v[a])
            grad += np.bincount(b[tied], change[tied], size) - np.bincount(a, change, size)
        moved = v - grad / curve
        w = np.sign(moved) * np.maximum(0.0, np.abs(moved) - least / curve)
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        v, before, momentum = w + (momentum - 1) / after * (w - before), w, after
    return ToxicityModel(float(w[-1]), {word: float(x) for word, x in zip(vocabulary, w[:-1], strict=True) if abs(x) > 1e-6}, whole)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", texts_per_class: int = 4000, characters: int = 20_000, **options) -> ToxicityModel:
    """Train on labelled texts whose crc32(doc_id as text) mod 3 is not 1.

    At most about ``texts_per_class`` texts of each class are taken, those with the smallest id hashes (a documented
    bound); of those the words that can carry weight, and the texts as numbers of such words, go to the driver. Texts over ``characters`` are left out of the sample, so that
    the driver's share is bounded too (scoring reads every text whole). Labels other than 0 and 1 and null texts are
    left out; of repeated ids one row is enough, all count.
    """
    tune(docs.sparkSession)
    whole = frozenset(w for kind in options.get("identity_terms", IDENTITY_TERMS) for w in kind)
    known = labels.where(F.col(label_col).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)).select(
        "doc_id", F.col(label_col).cast("int").alias("_y"), F.xxhash64("doc_id").alias("_draw"))
    counts = dict(known.groupBy("_y").count().collect())
    bound = F.create_map(*[x for k in (0, 1) for x in (F.lit(k), F.lit(hash_bound(texts_per_class / max(1, counts.get(k, 1)))))])
    sample = known.where(F.col("_draw") <= bound[F.col("_y")]).drop("_draw").limit(3 * texts_per_class)
    texts = docs.select("doc_id", F.col("text").alias("_t")).where(F.col("_t").isNotNull() & (F.length("_t") <= characters))
    joined = texts.join(F.broadcast(sample), "doc_id").select("_y", "_t", "doc_id")  # ids of a sample of stated size

    def distinct_words(batches):
        for batch in batches:
            found = [sorted(words_of(t, whole)) for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_y"), batch.column("doc_id"), pa.array(found, pa.list_(pa.string()))], names=["y", "doc_id", "words"])

    # Which words carry weight is counted by executors; the driver gets those words and the texts as their numbers.
    held = Scratch(docs.sparkSession, "toxicity").save(joined.mapInArrow(distinct_words, "y int, doc_id bigint, words array<string>"))
    least, largest = options.get("least_texts", 5), options.get("largest_vocabulary", 50_000)
    word = F.col("word")
    counted = held.select(F.explode("words").alias("word")).groupBy("word").count().where((F.col("count") >= least) | word.isin(sorted(whole)))
    terms = [r["word"] for r in counted.orderBy(word.isin(sorted(whole)).desc(), F.desc("count"), "word").limit(largest + len(whole)).select("word").collect()]
    numbers = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(terms)})

    def encode(batches):
        for batch in batches:
            own = [[k for k in map(numbers.value.get, x) if k is not None] for x in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("doc_id"), pa.array(own, pa.list_(pa.int32()))], names=["y", "doc_id", "codes"])

    rows = held.mapInArrow(encode, "y int, doc_id bigint, codes array<int>").toArrow().sort_by("doc_id")
    y, codes = rows.column("y").to_numpy().astype(float), rows.column("codes").to_pylist()
    row = np.repeat(np.arange(len(y)), [len(c) for c in codes])
    model = _train(row, np.fromiter((k for c in codes for k in c), np.int64, len(row)), terms, y, **options)
    if min(counts.get(0, 0), counts.get(1, 0), y.sum(), len(y) - y.sum()) > 0:  # from the sample's share of label 1 to the table's
        model.bias += float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def score(df: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``threshold`` on) for every whole text.

    Null and empty texts get the score of a text without words. Other columns and repeated rows stay; columns of the two
    names are replaced.
    """
    tune(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary
    df = df.drop("score", "predicted")
    keep, text = df.columns, free_name(df, "_text")
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        model = shared.value
        for batch in slices(batches, text):
            values = np.array([model.score(t) for t in batch.column(text).to_pylist()])
            own = batch.columns[: len(keep)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(values), pa.array((values >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return df.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, schema)


def is_held_out(doc_id: int) -> bool:
    return crc_of(doc_id) % 3 == 1
