"""DartMinHash, classes and components against brute force."""

import random

import numpy as np
import pytest

from cutline.llm import near_duplicates
from cutline.llm.components import components
from cutline.llm.words import blocks, words_of


def similarity(a, b):
    return sum(min(a.get(x, 0), b.get(x, 0)) for x in {*a, *b}) / sum(max(a.get(x, 0), b.get(x, 0)) for x in {*a, *b})


@pytest.mark.parametrize("scale", [0.3, 1.0, 7.5])
def test_signatures_agree_as_often_as_weighted_sets_are_similar(scale):
    rng = np.random.default_rng(1)
    for size in (3, 40, 900):
        a = {int(x): float(w) for x, w in zip(rng.integers(1, 2**62, size), rng.random(size) * scale + 0.01, strict=True)}
        b = {x: (w if rng.random() < 0.8 else w * 2.5) for x, w in a.items() if rng.random() < 0.9} | {5: scale}
        k = 4000
        flat = [(x, w, n) for n, s in enumerate((a, b)) for x, w in s.items()]
        got = near_duplicates.signatures(np.array([f[0] for f in flat], np.uint64), np.array([f[1] for f in flat]), np.array([f[2] for f in flat]), 3, k)
        assert abs((got[0] == got[1]).mean() - similarity(a, b)) < 0.04
        assert (got[:2] != 0).all() and (got[2] == 0).all()
        again = near_duplicates.signatures(np.array(list(b), np.uint64), np.array(list(b.values())), np.zeros(len(b), np.int64), 1, k)
        assert (again[0] == got[1]).all()


def shingle_set(text):
    w = words_of(text.encode())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def expected(rows):
    """Classes by comparing all pairs of texts."""
    parent = {i: i for i, t in rows if i is not None and t is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, t, shingle_set(t)) for i, t in rows if i is not None and t is not None]
    for n, (i, t, a) in enumerate(known):
        for j, u, b in known[:n]:
            if t == u or (a and b and len(a & b) >= 0.8 * len(a | b)):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return sorted(((i, top(i) if i is not None and t is not None else None) for i, t in rows), key=repr)


def planted():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    rows, passage = [], prose(60)
    for group in range(25):
        base = prose(rng.choice([12, 60, 200]))
        for copy in range(rng.choice([1, 2, 5, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((group * 100 + copy, " ".join(words) if copy % 3 else " ".join(words).upper() + "!"))
    rows += [(5000 + i, " ".join(prose(40) + passage + prose(40))) for i in range(30)]
    rows += [(6000, ""), (6001, ""), (6002, "!!"), (6003, "??"), (6004, "!!"), (6005, None), (6006, None), (None, "some words"), (None, "some words"), (6007, "some words"),
             (6008, "Some, words"), (6009, "some"), (6010, "a " * 4000), (6011, "a " * 3000), (6012, "é " * 10), (6012, "é " * 10), (6013, "only here")]
    rows += [(7000, " ".join(prose(80))), (7000, " ".join(prose(80)))]
    return rows


def test_classes_equal_brute_force(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bucket string, n int").repartition(6)
    got = near_duplicates.classes(docs).collect()
    want = expected([r for r in rows if r[0] != 7000])
    assert sorted([tuple(r) for r in got if r[0] != 7000], key=repr) == want
    assert [r[1] for r in got if r[0] == 7000] == [7000, 7000]


def test_classes_of_small_tables_equal_brute_force(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates.classes(docs).collect()), key=repr) == expected(list(texts.items()))


def test_classes_of_no_rows(spark):
    assert near_duplicates.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(7000, 7000), (None, 3), (5, 4)]
    got = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}


def test_long_texts_are_hashed_in_pieces():
    words = [f"word{i % 977}" for i in range(400_000)]
    (whole,) = list(blocks([" ".join(words).encode()]))
    (short,) = list(blocks([" ".join(words[:977]).encode()]))
    assert len(whole.hashes) == len(words)
    assert (whole.hashes[:977] == short.hashes).all() and (whole.hashes[977 * 300:977 * 301] == short.hashes).all()


def test_a_large_group_of_near_copies_equals_brute_force(spark, monkeypatch):
    """Copies with few and with many changes, copies of copies, shortened and lengthened ones, around one text."""
    rng = random.Random(9)
    base = [f"b{rng.randrange(900)}" for _ in range(120)]
    texts = [base]
    for _ in range(45):
        words = list(rng.choice([base, base, texts[-1], rng.choice(texts)]))
        for _ in range(rng.choice([0, 1, 2, 4, 6])):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        kind = rng.random()
        if kind < 0.15:
            words = words[:rng.randrange(70, len(words) + 1)]
        elif kind < 0.3:
            words = words + [f"t{i}" for i in range(rng.randrange(40))]
        texts.append(words)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = expected(rows)
    assert 1 < len({c for _, c in want}) < 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(near_duplicates, "_FEW", 12)  # larger buckets go through smaller ones
    # Enough bands that every pair similar enough meets.
    got = sorted((tuple(r) for r in near_duplicates.classes(docs, bands=40, rows=3).collect()), key=repr)
    assert got == want


def test_buckets_are_compared_whole_within_a_budget_of_pairs(spark):
    members = spark.createDataFrame([(b, m) for b, m in [(1, 80)] * 80 + [(2, 100)] * 100 + [(3, 100)] * 100 + [(4, 500)] * 500], "bucket bigint, members bigint")
    pairs = {80: 80 * 79 // 2, 100: 2 * 100 * 99 // 2}
    assert near_duplicates._most_compared(members, 0) == 64
    assert near_duplicates._most_compared(members, pairs[80]) == 80
    assert near_duplicates._most_compared(members, pairs[80] + pairs[100] - 1) == 80
    assert near_duplicates._most_compared(members, pairs[80] + pairs[100]) == 100


def test_links_that_change_no_class_cost_no_round(spark, monkeypatch):
    from cutline.llm import components as graph

    written = []
    real = near_duplicates.stored
    for module in (near_duplicates, graph):
        monkeypatch.setattr(module, "stored", lambda df, name, **k: written.append(name) or real(df, name, **k))
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)], "vertex bigint, root bigint")
    same = near_duplicates._joined(roots, spark.createDataFrame([(2, 3), (8, 7)], "a bigint, b bigint"))
    assert same is roots and written == ["class-links"]
    got = near_duplicates._joined(roots, spark.createDataFrame([(8, 3)], "a bigint, b bigint"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (7, 1), (8, 1)]
    assert written.count("large-star") == 1  # two classes joined: the first round changes nothing


def test_members_meet_again_only_by_the_shingles_that_fewest_of_them_have(spark):
    """Three members lack the same shingle of the leader and each has seven that nobody else has: two of its own would have to be
    in a similar text, so the one that they share can't make them similar. Two that share two of theirs do meet."""
    leader = list(range(1000, 1022))
    own = {i: [-9, *range(10_000 * i, 10_000 * i + 7)] for i in (1, 2, 3)}
    own[4] = own[5] = [-8, -7, *range(90_000, 90_006)]
    sets = spark.createDataFrame([(0, leader), *[(i, leader + some) for i, some in own.items()]], "id bigint, elements array<bigint>")
    rest = spark.createDataFrame([(i, 0, 30, 1, i) for i in own], "id bigint, leader bigint, n bigint, centre bigint, root bigint")
    met = {}
    for r in near_duplicates._still_possible(rest, sets, 0.8).collect():
        met.setdefault(r["bucket"], set()).add(r["id"])
    assert {frozenset(some) for some in met.values()} == {frozenset((4, 5))}
