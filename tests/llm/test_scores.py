"""Classifiers by held-out accuracy and by their parts; quality rules against brute force."""

import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cutline.llm import quality_rules, rule_ensemble, toxicity
from cutline.llm.frames import remainder

SF = "/root/testdata/sf0.01"


def labelled(column):
    return dict(duckdb.execute(f"SELECT doc_id, {column} FROM '{SF}/labels.parquet'").fetchall())


def auc(scores, labels):
    good, bad = [s for s, y in zip(scores, labels, strict=True) if y], [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize(("name", "label", "modulus", "rest", "least"), [("op4_toxicity", "toxic", 5, 0, 0.85), ("op10_quality_rules_ensemble", "quality", 3, 1, 0.95)])
def test_held_out_documents_are_told_apart(spark, name, label, modulus, rest, least):
    rows = entry.queries()[name](spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in rows)
    known = labelled(label)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert auc([r["score"] for r in held], [known[r["doc_id"]] for r in held]) >= least


@pytest.mark.parametrize("module", [toxicity, rule_ensemble])
def test_odd_rows_and_missing_labels(spark, module):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "!!!", "x"), (3, "!!!", "x"), (None, "a b", "x"), (4, "w " * 50_000, "x")], "doc_id long, text string, label string")
    labels = "doc_id long, quality int, toxic int"
    for rows in ([], [(1, None, None), (None, 1, 1)], [(2, 1, 1), (2, 0, 0), (3, 1, 1)]):
        got = module.scored(docs, spark.createDataFrame(rows, labels), F.lit(True)).collect()
        assert len(got) == 6 and len({r["score"] for r in got}) == 1 and 0 <= got[0]["score"] <= 1
    assert module.scored(docs.limit(0), spark.createDataFrame([(1, 1, 1)], labels), F.lit(True)).count() == 0


def test_remainder_is_that_of_the_text_of_the_id(spark):
    rows = spark.range(50).select("id", remainder("id", 5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_toxic_features():
    weights = toxicity.Weights({b"fool": 2.0, b"grum*": 1.5})
    names = dict(zip(toxicity.FEATURES, toxicity.features("You FOOL, a grumble! f00l f o o l sooo".encode(), weights), strict=True))
    assert names["log_hits"] == pytest.approx(math.log1p(2)) and names["near_second_person"] == 1.0 and names["top_weight"] == 2.0
    assert names["disguised_per_word"] == pytest.approx(2 / 10) and names["lengthened_per_word"] == pytest.approx(1 / 10)
    assert toxicity.features(None, weights) == toxicity.features(b"", weights) == [0.0] * len(toxicity.FEATURES)


def test_rules_of_a_printed_tree_hold_where_their_columns_do(spark):
    text = "\n".join(["  If (feature 0 <= 0.5)", "   If (feature 1 <= -2.0)", "    Predict: 0.0", "   Else (feature 1 > -2.0)", "    If (feature 0 <= 0.25)", "     Predict: 1.0",
                      "    Else (feature 0 > 0.25)", "     Predict: 0.0", "  Else (feature 0 > 0.5)", "   Predict: 1.0"])
    rules = rule_ensemble.rules_of(text)
    inf = float("inf")
    assert rules[3] == rule_ensemble.Rule(((0, -inf, 0.25), (1, -2.0, inf))) and rules[4].bounds == ((0, 0.25, 0.5), (1, -2.0, inf)) and len(rules) == 6
    rng = random.Random(4)
    values = [[rng.choice([-3.0, -2.0, 0.0, 0.25, 0.3, 0.5, 0.6]) for _ in rule_ensemble.STATISTICS] for _ in range(60)]
    df = spark.createDataFrame([tuple(v) for v in values], list(rule_ensemble.STATISTICS))
    for row, v in zip(df.select(*rule_ensemble.STATISTICS, *[r.column().alias(f"r{i}") for i, r in enumerate(rules)]).collect(), values, strict=True):
        assert [row[f"r{i}"] for i in range(len(rules))] == [r.holds(row) for r in rules] == [r.holds(v) for r in rules]
    ensemble = rule_ensemble.Ensemble(0.5, ((rules[0], -1.0), (rules[3], 2.0)))
    for row, v in zip(df.select(ensemble.column().alias("s")).collect(), values, strict=True):
        assert row["s"] == pytest.approx(1 / (1 + math.exp(-(0.5 - rules[0].holds(v) + 2.0 * rules[3].holds(v)))))


def brute_measure(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@given(st.lists(st.sampled_from(["a", "b", "é🙂", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "#", "|x", "\r", "\x0b"]), max_size=60).map("".join))
def test_measures_equal_brute_force(text):
    assert quality_rules.measure(text.encode())[:5] == brute_measure(text)


def test_measures_of_whole_texts(spark, texts):
    for text in texts.values():
        if len(text) < 4000:
            assert quality_rules.measure(text.encode())[:5] == brute_measure(text)


def test_binomial_sums():
    for n, p in ((10, 0.3), (200, 0.01), (7, 0.5)):
        for k in range(n + 1):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert quality_rules.binomial_below(k, n, p) == pytest.approx(want, rel=1e-9)


def test_chosen_cutoffs_keep_their_promise():
    """With cutoffs certified at 5 %, rejecting more than the risk of good documents happens in about that share of trials."""
    rng = np.random.default_rng(2)
    broken = 0
    true = np.linspace(0.2, 0.0, quality_rules.STEPS + 1)
    for _ in range(200):
        good = np.histogram(rng.random(1500) * 150, np.arange(quality_rules.STEPS + 2))[0]
        bad = np.histogram(rng.random(300) * 200, np.arange(quality_rules.STEPS + 2))[0]
        best = quality_rules.choose(good, bad, 0.02, 0.05, 1e-9)
        broken += best is not None and max(0.0, 1 - (best["cut"] + 1) / 150) > 0.02
    assert broken / 200 <= 0.1 and len(true) == quality_rules.STEPS + 1
    assert quality_rules.choose(np.array([10, 0]), np.array([0, 9]), 0.02, 0.05, 1) is None


def test_verdicts(spark):
    rng = random.Random(6)
    prose = lambda mark: " ".join(f"w{rng.randrange(10**6)}{mark if rng.random() < 0.9 else ''}" for _ in range(60))
    rows = [(i, prose("") if i % 4 else prose("***"), "x" if i % 2 else None) for i in range(4000)]
    odd = [(9000, None, "x"), (9001, "", "x"), (9002, "few words", None), (9003, "same words here " * 40, "x"), (9004, prose("***"), "unseen"), (None, prose(""), "x"), (9005, prose(""), "x"), (9005, prose(""), "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id long, text string, lang string, kept int").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(4000)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judged(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        if r["id"] is not None and r["id"] < 4000:
            assert r["kept"] == (r["id"] % 4 != 0) and r["base_failed"] is False
    kept = {r["id"]: r["kept"] for r in got}
    assert [kept[i] for i in (9000, 9001, 9002, 9003, 9004, None, 9005)] == [False, False, False, False, True, True, True]
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.judged(docs, labels.limit(0)).collect())
