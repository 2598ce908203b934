"""A quality classifier of sparse rules: paths of shallow trees as conjunctions, weighted by a lasso logistic regression, and
compiled into one column expression.

Every text gives STATISTICS. A forest of shallow trees on a bounded labelled sample gives candidate rules: each path from a
root to a node below is a conjunction of bounds on statistics, in its simplest form, and equal ones are one. The lasso keeps a
few; the score is the logistic function of their weights, as a Spark expression over the statistics, without trees or Python.

Null and empty texts have statistics of zero. Without labels of both kinds the score is the rate of good labels, or 0.5
without labels. Repeated rows are scored one by one."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cutline.llm.frames import per_batch, stored
from cutline.llm.learning import SAMPLE_ROWS, base_rate, both_classes, sample
from cutline.llm.quality_rules import measure
from cutline.llm.words import utf8

STATISTICS = ("n_words", "word_length", "symbols", "punctuation", "capitals", "digits", "duplicate_lines", "repeated_words", "distinct_words",
              "doubled_words", "short_words", "open_ends", "exclaims", "bars", "words_per_line", "beyond_ascii", "sentences")
_DIGITS, _HIGH = bytes(range(48, 58)), bytes(range(0xC0, 0x100))
_CONDITION = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def statistics(data: bytes | None) -> list[float]:
    """The STATISTICS of one text."""
    if not data:
        return [0.0] * len(STATISTICS)
    n_words, chars, symbols, dup_lines, repeats, lines, upper, punctuation = measure(data)
    words = data.split()
    n, c, size = max(1, n_words), max(1, chars), len(data)
    doubled = sum(map(operator.eq, words, words[1:]))
    ends = sum(1 for w in words if w[-1] in b"*#$%&|<>!_=~^")
    return [float(n_words), chars / n, symbols / c, punctuation / c, upper / c, (size - len(data.translate(None, _DIGITS))) / c, dup_lines / max(1, lines),
            repeats / n, len(set(words)) / n, doubled / n, sum(1 for w in words if len(w) < 3) / n, ends / n, data.count(b"!") / n, data.count(b"|") / n,
            n / max(1, lines), (size - len(data.translate(None, _HIGH))) / c, sum(1 for w in words if w[-1] in b".?!") / n]


def measured(docs: DataFrame) -> DataFrame:
    """The rows' other columns with the STATISTICS of their `text`."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, *[T.StructField(s, T.DoubleType()) for s in STATISTICS]])

    def run(batch: pa.RecordBatch) -> dict:
        found = np.array([statistics(t) for t in utf8(batch.column("text"))], np.float64).reshape(batch.num_rows, len(STATISTICS))
        return {f.name: batch.column(f.name) for f in kept} | {s: found[:, i] for i, s in enumerate(STATISTICS)}

    return per_batch(docs, run, schema)


@dataclass(frozen=True)
class Rule:
    """For each statistic used, an open lower and a closed upper bound."""

    bounds: tuple[tuple[int, float, float], ...]

    def column(self) -> Column:
        parts = []
        for i, low, high in self.bounds:
            value = F.col(STATISTICS[i])
            parts += [value > low] * (low > -np.inf) + [value <= high] * (high < np.inf)
        return functools.reduce(operator.and_, parts)

    def holds(self, values) -> bool:
        return all(low < values[i] <= high for i, low, high in self.bounds)


def rules_of(description: str) -> list[Rule]:
    """The paths of a tree, from its printed form."""
    path: list[tuple[int, int, str, float]] = []
    out = []
    for line in description.splitlines():
        if found := _CONDITION.match(line):
            depth = len(found[1])
            path = [p for p in path if p[0] < depth] + [(depth, int(found[2]), found[3], float(found[4]))]
            bounds: dict[int, tuple[float, float]] = {}
            for _, i, side, at in path:
                low, high = bounds.get(i, (-np.inf, np.inf))
                bounds[i] = (low, min(high, at)) if side == "<=" else (max(low, at), high)
            out.append(Rule(tuple((i, *bounds[i]) for i in sorted(bounds))))
    return out


@dataclass(frozen=True)
class Ensemble:
    """Rules with their weights, and the weight of none."""

    bias: float
    weighted: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.weighted:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(train: DataFrame, trees: int, depth: int, penalty: float, seed: int) -> Ensemble:
    """Fit on rows with `label` and the STATISTICS: a bounded sample."""
    vector = array_to_vector(F.array(*STATISTICS)).alias("vector")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7).fit(train.select("label", vector))
    rules = list(dict.fromkeys(r for tree in forest.trees for r in rules_of(tree.toDebugString)))
    if not rules:
        rate = min(max(base_rate(train), 1e-6), 1 - 1e-6)
        return Ensemble(float(np.log(rate / (1 - rate))), ())
    held = array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("rules")
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60)
    model = lasso.fit(stored(train.select("label", held), "rule-values"))
    return Ensemble(float(model.intercept), tuple((r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if abs(w) > 1e-9))


def scored(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS,
           trees: int = 20, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> DataFrame:
    """id and score (0 to 1) of every document. `learn`, a condition on `id`, says which labels may be used; `rows` bounds the
    sample that is fitted."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    known = sample(docs, labels, label, learn, rows)
    if not both_classes(known):
        return docs.select("id", F.lit(0.5 if known.isEmpty() else base_rate(known)).alias("score"))
    ensemble = fit(stored(measured(known.select("text", "label")).repartition(4), "rule-statistics"), trees, depth, penalty, seed)
    return measured(docs).select("id", ensemble.column().alias("score"))
