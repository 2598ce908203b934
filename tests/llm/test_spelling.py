"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from cutline.llm import spelling as s

SMALL = "/root/testdata/sf0.001"
COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def brute_counts(rows, modulus=None, least=6):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if modulus and h % modulus == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            out[word] += len(word) >= least
    return out


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(rows, modulus=None, least=6, seen=5, ratio=5):
    n = {w: c for w, c in brute_counts(rows, modulus, least).items() if c >= seen}
    holes = defaultdict(set)  # a word with one character out meets every near word there
    for w in n:
        for k in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            holes[k].add(w)
    near = {w: {v for k in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))} for v in holes[k] if one_apart(w, v)} for w in n}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-n[v], v))
            if n[best] >= ratio * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "?", 1) for r in rows], "doc_id long, text string, word string, n long")
    return sorted((tuple(r[c] for c in COLUMNS) for r in s.variants(docs, **options).collect()), key=repr)


def random_rows(seed, words=120, letters="abcé", docs=100):
    draw = random.Random(seed)
    stock = ["".join(draw.choice(letters) for _ in range(draw.randrange(5, 10))) for _ in range(words)]
    for w in stock[:words // 2]:  # variants
        at = draw.randrange(len(w))
        stock.append(draw.choice([w[:at] + w[at + 1:], w[:at] + draw.choice(letters) + w[at:], w[:at] + draw.choice(letters) + w[at + 1:]]))
    weights = [draw.choice([1, 1, 5, 30]) for _ in stock]
    return [(i, " ".join(draw.choices(stock, weights, k=draw.randrange(120)))) for i in range(docs)]


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"frequent": 1}), (3, {"frequent": 3, "votes": 2}), (4, {"inner": 2}), (5, {"shortest": 3}), (6, {"votes": 5, "frequent": 8})])
def test_equals_brute_force(spark, seed, options):
    rows = random_rows(seed)
    want = brute(rows, 13)
    assert sum(r[4] > 0 for r in want) > 20
    assert run(spark, rows, slip=s.one_in(13), **options) == want


def test_nulls_odd_characters_ties_and_chains(spark):
    rows = [(1, None), (2, ""), (None, "summer " * 9), (3, "SUMMER sümmer×÷ " * 200), (3, "SUMMER sümmer×÷ " * 200), (4, "summerš日ummers ÀÉÈÀÉÈ àéèàéè " * 30),
            (5, "abcdef " * 5 + "abcdeg " * 25 + "abcdeh " * 25 + "abcdgh " * 125 + "xabcdgh " * 625), (6, "x" * 5000 + " " + "short " * 90), (7, "abcdef1abcdef_abcdef " * 3)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, slip=s.one_in(2)) == brute(rows, 2)


def test_no_words(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "a b c")]) == []


def test_an_edit_changes_no_more_grams_than_the_bound():
    draw = random.Random(7)
    for _ in range(1500):
        letters = draw.choice(["ab", "abcd"])
        inner = {"".join(draw.choice(letters + "^") for _ in range(draw.choice([2, 3]))) for _ in range(draw.randrange(12))}
        word = "".join(draw.choice(letters) for _ in range(draw.randrange(6, 12)))
        at = draw.randrange(len(word) + 1)
        other = draw.choice([word[:at] + draw.choice(letters) + word[at:], word[:at] + word[at + 1:], word[:at] + "z" + word[at + 1:]])
        grams = s.decomposed(f"^{word}$", inner, 2, 4)
        own = [(p, g) for p, g, kept in grams if kept]
        there = {(p, g) for p, g, _ in s.decomposed(f"^{other}$", inner, 2, 4)}
        shift = len(other) - len(word)
        same = sum((p, g) in there or (p + shift, g) in there for p, g in own)
        assert s.affected(grams) < len(own)
        if len(other) >= 6 and other != word:
            assert same >= len(own) - s.affected(grams)


def test_too_short_words_are_refused(spark):
    with pytest.raises(ValueError):
        s.near_pairs(spark.createDataFrame([("ab",)], "word string"), least=1)


def test_query_equals_brute_force(spark, texts):
    got = entry.queries()["op13_spelling_variants"](spark, SMALL).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(list(texts.items()), 199)
