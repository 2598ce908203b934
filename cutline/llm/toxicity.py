"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

The lexicon is learned: words and word beginnings whose document counts differ between toxic and other labelled documents (a
log-likelihood ratio of at least `evidence`), with their log-odds as weights. Features are densities of lexicon hits, their
closeness to second-person words, capitals, punctuation, digits, lengthened words and obfuscation (letters mixed with digits
or symbols, spelled-out words, and hits that appear only once such disguise is undone). The labelled sample is cut in three by
a hash of the id: one part for the lexicon, one for the trees, one for the calibration, so that none is fitted on what
another has seen.

Null and empty texts have no hits and are scored like any other text. Without labels of both kinds the score is the rate of
toxic labels, or 0 without labels. Repeated rows are scored one by one."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cutline.llm.frames import per_batch
from cutline.llm.learning import SAMPLE_ROWS, base_rate, both_classes, sample
from cutline.llm.words import utf8, words_of

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(w.encode() for w in (
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestro").split())
FEATURES = ("log_words", "hits_per_word", "weight_per_word", "top_weight", "log_hits", "log_kinds", "near_second_person", "second_person_per_word",
            "capitals", "exclaims_per_word", "punctuation", "digits", "mixed_per_word", "disguised_per_word", "lengthened_per_word")
NEAR = 6  # words between a hit and a second-person word
_LEET = bytes.maketrans(b"0134578", b"oieastb")
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_MIXED = re.compile(rb"[A-Za-z\x80-\xff][0-9@$*#!|]+[A-Za-z\x80-\xff]")
_LONG = re.compile(rb"([a-z])\1\1")


def terms(word: bytes) -> list[bytes]:
    """The word, and its beginnings of four and five bytes, marked."""
    return [word, *(word[:n] + b"*" for n in (4, 5) if len(word) > n)]


def lexicon(rows: DataFrame, evidence: float, size: int) -> dict[bytes, float]:
    """At most `size` terms with their log-odds, from a bounded sample."""
    schema = T.StructType([T.StructField("term", T.BinaryType()), T.StructField("toxic", T.LongType()), T.StructField("other", T.LongType())])

    def run(batch: pa.RecordBatch) -> dict:
        counts = (Counter(), Counter())
        for text, label in zip(utf8(batch.column("text")), batch.column("label").to_pylist(), strict=True):
            counts[label].update({t for w in set(words_of(text)) for t in terms(w)})
        names = list({*counts[0], *counts[1]})
        return {"term": names, "toxic": [counts[1][t] for t in names], "other": [counts[0][t] for t in names]}

    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    a, b = F.col("toxic"), F.col("other")

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    share = (a + b) / float(max(1, n0 + n1))
    ratio = 2 * (part(a, share * n1) + part(b, share * n0) + part(n1 - a, (1 - share) * n1) + part(n0 - b, (1 - share) * n0))
    odds = F.log(((a + 0.5) / (n1 + 1.0)) / ((b + 0.5) / (n0 + 1.0)))
    found = (per_batch(rows.select("text", "label"), run, schema, rows=4000).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
             .where(a > 2).withColumn("ratio", ratio).withColumn("odds", odds).where((F.col("ratio") >= evidence) & (F.col("odds") > 1.0)))
    return {bytes(r["term"]): r["odds"] for r in found.orderBy(F.desc("ratio"), "term").limit(size).collect()}


class Weights(dict):
    """The weight of each word: the greatest of its terms'. Words seen are kept, up to a bound."""

    def __init__(self, known: dict[bytes, float]):
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> float:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = max((self.known.get(t, 0.0) for t in terms(word)), default=0.0)
        return value


def features(text: bytes | None, weights: Weights) -> list[float]:
    """The FEATURES of one text."""
    data = text or b""
    words = words_of(data)
    n, size = max(1, len(words)), max(1, len(data))
    values = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
    hits = np.flatnonzero(values)
    second = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON], np.int64)
    near = 0
    if len(hits) and len(second):
        after = np.searchsorted(second, hits)
        left, right = second[np.maximum(after - 1, 0)], second[np.minimum(after, len(second) - 1)]
        near = int((np.minimum(np.abs(hits - left), np.abs(hits - right)) <= NEAR).sum())
    disguised = sum(1 for i, w in enumerate(words) if not w.isalpha() and not values[i] and (p := w.translate(_LEET)) != w and weights[p])
    disguised += sum(1 for run in spelled(words) if weights[run])
    lower = len(data) - len(data.translate(None, _PUNCTUATION))
    return [math.log1p(len(words)), len(hits) / n, float(values.sum()) / n, float(values.max(initial=0.0)), math.log1p(len(hits)),
            math.log1p(len({words[i] for i in hits})), near / max(1, len(hits)), len(second) / n, _share(data, _UPPER, size),
            (data.count(b"!") + data.count(b"?")) / n, lower / size, _share(data, _DIGITS, size), len(_MIXED.findall(data)) / n, disguised / n,
            len(_LONG.findall(data.lower())) / n]


def _share(data: bytes, characters: bytes, size: int) -> float:
    return (len(data) - len(data.translate(None, characters))) / size


def spelled(words: list[bytes]) -> list[bytes]:
    """Runs of four or more one-letter words, joined."""
    out, run = [], []
    for word in [*words, b"  "]:
        if len(word) == 1:
            run.append(word)
        elif run:
            if len(run) > 3:
                out.append(b"".join(run))
            run = []
    return out


def featured(docs: DataFrame, known: dict[bytes, float]) -> DataFrame:
    """The rows' other columns with the FEATURES of their `text`."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batch: pa.RecordBatch) -> dict:
        weights = Weights(shared.value)
        return {f.name: batch.column(f.name) for f in kept} | {"features": [features(t, weights) for t in utf8(batch.column("text"))]}

    return per_batch(docs, run, schema)


def scored(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS,
           evidence: float = 16.0, lexicon_size: int = 5000, trees: int = 20, depth: int = 3, seed: int = 7) -> DataFrame:
    """id and score (0 to 1) of every document. `learn`, a condition on `id`, says which labels may be used; `rows` bounds the
    sample that is fitted."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    known = sample(docs, labels, label, learn, rows)
    words, fit, hold = known.where("part < 0.45"), known.where("part >= 0.45 and part < 0.8"), known.where("part >= 0.8")
    if not (both_classes(words) and both_classes(fit)):
        return docs.select("id", F.lit(base_rate(known)).alias("score"))
    terms_ = lexicon(words, evidence, lexicon_size)
    vector = array_to_vector(F.col("features")).alias("vector")
    train = featured(fit.select("text", "label"), terms_).select("label", vector).repartition(4)
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed).fit(train)
    chance = vector_to_array(F.col("probability"))[1].alias("chance")
    found = model.transform(featured(docs, terms_).select("id", vector)).select("id", chance)
    held = model.transform(featured(hold.select("text", "label"), terms_).select("label", vector)).select("label", chance)
    if not both_classes(hold):
        return found.select("id", F.col("chance").alias("score"))
    curve = IsotonicRegression(featuresCol="chance", labelCol="label").fit(held.withColumn("label", F.col("label").cast("double")).repartition(1))
    # The calibrated curve has steps; a hundredth of the trees' own score keeps the order inside a step.
    return curve.transform(found).select("id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("prediction") + 0.01 * F.col("chance"))).alias("score"))
