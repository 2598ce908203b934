"""Quality rules whose cutoffs are certified on labelled documents.

Every text is measured once. For each rule and stratum, cutoffs run from loose to strict. A cutoff is certified while an
exact binomial test rejects "this rule rejects more than `risk / rules` of the good documents of the stratum"; the chain
stops at the first that fails, so the level is split over rules and strata only (fixed-sequence testing with a Bonferroni
correction). Of the certified cutoffs the one that gains most is taken. All rules of a stratum together then reject more
than `risk` of its good documents with a probability of at most `delta`. Where labels are too few to certify anything, no
rule applies.

Null and empty texts have no words and fail the base rules. A null stratum is a stratum of its own. Repeated rows are
measured one by one. With no labels nothing but the base rules rejects."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cutline.llm.frames import one_label, per_batch, stored
from cutline.llm.words import utf8

_SPACE = bytes([32, *range(9, 14)])
_NOT_COUNTED = bytes([*_SPACE, *range(0x80, 0xC0)])  # spaces, and bytes that continue a character
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punctuation")
STEPS = 200


def _within(data: bytes, characters: bytes) -> int:
    return len(data) - len(data.translate(None, characters))


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the list holds twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    size = len(number)
    if size < 1 << 20:
        keys = (ids[:n] * size + ids[1:n + 1]) * size + ids[2:]
    else:  # three ids no longer fit into one number: name the pairs first
        pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1].astype(np.int64)
        keys = pairs[:n] * size + ids[2:]
    _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[which] > 1)
    hit = np.zeros(len(words), bool)
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def measure(data: bytes | None) -> tuple[int, ...]:
    """The MEASURES of one text."""
    if not data:
        return (0,) * len(MEASURES)
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (len(words), len(data.translate(None, _NOT_COUNTED)), _within(data, _SYMBOLS), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), _within(data, _UPPER), _within(data, _PUNCTUATION))


def measures(docs: DataFrame, id_column: str, text: str, stratum: str) -> DataFrame:
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("stratum", T.StringType()),
                           *[T.StructField(m, T.LongType()) for m in MEASURES]])

    def run(batch: pa.RecordBatch) -> dict:
        found = np.array([measure(t) for t in utf8(batch.column("text"))], np.int64).reshape(batch.num_rows, len(MEASURES))
        return {"id": batch.column("id"), "stratum": batch.column("stratum")} | {m: found[:, i] for i, m in enumerate(MEASURES)}

    return per_batch(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"), F.col(stratum).cast("string").alias("stratum")), run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Each rule's value, from 0 to 1, higher being worse."""
    def share(part, whole):
        return F.least(F.lit(1.0), F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0))

    length = F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(0.0)
    return {"symbols": share("n_symbols", "word_chars"), "punctuation": share("n_punctuation", "word_chars"),
            "capitals": share("n_upper", "word_chars"), "repeats": share("n_repeat_words", "n_words"),
            "lines": share("n_dup_lines", "n_lines"), "length": F.least(F.lit(1.0), length / 40)}


def binomial_below(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exactly summed."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose(good: np.ndarray, bad: np.ndarray, risk: float, level: float, price: float) -> dict | None:
    """The cutoff, as a number of steps, from counts by step: documents with a step above the cutoff are rejected. None
    where nothing certified gains."""
    n, best = int(good.sum()), None
    for cut in range(len(good) - 2, -1, -1):
        lost, caught = int(good[cut + 1:].sum()), int(bad[cut + 1:].sum())
        if n == 0 or lost > risk * n or binomial_below(lost, n, risk) > level:
            break
        gain = caught - price * lost
        if gain > 0 and (best is None or gain > best["gain"]):
            best = {"cut": cut, "gain": gain, "n_good": n, "n_lost": lost, "n_caught": caught}
    return best


def cutoffs(measured: DataFrame, labels: DataFrame, label: str, risk: float, delta: float, price: float) -> DataFrame:
    """stratum, rule, cutoff and the counts behind it. The counts by step are at most strata x rules x steps rows."""
    named = rules()
    known = (measured.where(~base_failed()).join(one_label(labels, label).withColumnRenamed("doc_id", "id"), "id")
             .select("stratum", label, F.explode(F.create_map(*[x for name, value in named.items() for x in (F.lit(name), F.ceil(value * STEPS))])).alias("rule", "step")))
    counted = stored(known.groupBy("stratum", "rule", "step").agg(
        F.sum(F.col(label)).alias("good"), F.sum(1 - F.col(label)).alias("bad")), "quality-steps")
    strata = max(1, counted.select("stratum").distinct().count())
    level, each = delta / (strata * len(named)), risk / len(named)
    schema = "stratum string, rule string, cutoff double, n_good long, n_lost long, n_caught long"

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(STEPS + 1, np.int64), np.zeros(STEPS + 1, np.int64)
        np.add.at(good, group["step"].to_numpy(np.int64), group["good"].to_numpy(np.int64))
        np.add.at(bad, group["step"].to_numpy(np.int64), group["bad"].to_numpy(np.int64))
        best = choose(good, bad, each, level, price)
        rows = [] if best is None else [(group["stratum"].iloc[0], group["rule"].iloc[0], best["cut"] / STEPS, best["n_good"], best["n_lost"], best["n_caught"])]
        return pd.DataFrame(rows, columns=["stratum", "rule", "cutoff", "n_good", "n_lost", "n_caught"])

    return counted.groupBy("stratum", "rule").applyInPandas(pick, schema)


def judged(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", stratum: str = "lang",
           label: str = "quality", risk: float = 0.05, delta: float = 0.05, price: float = 20.0) -> DataFrame:
    """One row per document: id, stratum, the MEASURES, base_failed, the names of the rules it breaks, kept.

    `risk`: the share of good documents that the rules of a stratum may reject; `delta`: the chance that they reject more;
    `price`: how many bad documents one good document is worth."""
    measured = stored(measures(docs, id_column, text, stratum), "quality-measures")
    chosen = cutoffs(measured, labels, label, risk, delta, price)
    wide = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in rules()])
    wide = wide.withColumnRenamed("stratum", "of_stratum")
    broken = F.filter(F.array(*[F.when(F.ceil(value * STEPS) > F.round(F.col(f"cut_{r}") * STEPS), F.lit(r)) for r, value in rules().items()]), lambda x: x.isNotNull())
    return (measured.join(wide, F.col("stratum").eqNullSafe(F.col("of_stratum")), "left")
            .withColumn("base_failed", base_failed()).withColumn("broken", broken)
            .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
            .select("id", "stratum", *MEASURES, "base_failed", "broken", "kept"))
