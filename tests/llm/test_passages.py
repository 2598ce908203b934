"""Repeated passages against brute force: every equal run is covered, and nothing but repeated words is."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cutline.llm import passages
from cutline.llm.words import words_of


def prose(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def planted():
    rng = random.Random(5)
    rows, clean = [], []
    shared = [prose(rng, 70) for _ in range(6)]
    for n in range(40):
        words = prose(rng, rng.choice([60, 200, 900]))
        if n % 2:
            passage = list(shared[n % 6])
            if n % 3 == 0:  # a changed, a missing and an added word, 20 words or more apart
                passage[25], passage[48:49] = "changed", ["two", "words"]
            at = rng.randrange(len(words))
            words[at:at] = passage
        else:
            clean.append(n)
        rows.append((n, " ".join(words)))
    rows.append((100, rows[7][1].upper()))
    rows.append((101, " ".join(prose(rng, 30) + words_of(rows[9][1].encode())[5:5 + 0].copy())))
    long = prose(rng, 6000)
    edited = list(long)
    for at in range(100, 6000, 150):
        edited[at] = "edit"
    rows += [(200, " ".join(long)), (201, " ".join(edited[:3000] + ["x", "y"] + edited[3000:]))]
    rows += [(300, "same " * 500), (301, "same " * 400), (302, None), (303, ""), (None, rows[0][1]), (304, " ".join(prose(rng, 49))), (305, "a b")]
    return rows, clean


def test_planted_passages_are_found_and_clean_documents_are_not(spark):
    rows, clean = planted()
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, start int, sources string").repartition(6)
    found = passages.passages(docs).collect()
    texts = {i: words_of((t or "").encode()) for i, t in rows if i is not None}
    got = {}
    for r in found:
        assert r["end"] - r["start"] >= 50 and r["similarity"] >= 0.8 and max(r["sources"]) < r["id"]
        got.setdefault(r["id"], set()).update(range(r["start"], r["end"]))
    assert not set(clean) & set(got)
    earlier = []
    for i in sorted(texts):
        for j in earlier:
            if len(texts[i]) < 2000:
                for block in SequenceMatcher(None, texts[j], texts[i], autojunk=False).get_matching_blocks():
                    if block.size >= 50:
                        # The anchor is an earlier document, which may differ from j in a word next to the passage.
                        assert set(range(block.b + 1, block.b + block.size - 1)) <= got.get(i, set()), (i, j, block)
        earlier.append(i)
    assert len(got[201]) > 5900 and got[100] == set(range(len(texts[100])))
    fuzzy = [n for n in range(40) if n % 2 and n % 3 == 0]
    assert sum(len(got.get(n, ())) >= 60 for n in fuzzy) >= len(fuzzy) - 2  # the first of each passage has no earlier one

    spans = spark.createDataFrame([(r["id"], r["start"], r["end"]) for r in found], "id long, start long, end long")
    rest = {r["doc_id"]: r["text"] for r in passages.without(docs, spans).collect()}
    assert len(rest) == len({i for i, _ in rows})
    for i, words in texts.items():
        want = [w for n, w in enumerate(words) if n not in got.get(i, ())]
        assert words_of((rest[i] or "").encode()) == want
    for i, t in rows:
        if i is not None and i not in got:
            assert rest[i] == t


def covered(spark, texts):
    """The words of each document that lie in a passage, from lists of words by id."""
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(4)
    got = {i: set() for i in texts}
    for r in passages.passages(docs).collect():
        got[r["id"]].update(range(r["start"], r["end"]))
    return got


def test_equal_runs_are_kept_whatever_stands_between_them(spark):
    rng = random.Random(8)
    texts, want = {}, {}
    for n, (first, gap, second, there) in enumerate([*((60, g, 60, g) for g in range(1, 65)), (60, 25, 20, 25), (60, 40, 60, 33), (60, 12, 60, 40), (50, 30, 9, 30)]):
        one, two = prose(rng, first), prose(rng, second)
        texts[2 * n] = prose(rng, 40) + one + prose(rng, there) + two + prose(rng, 40)
        texts[2 * n + 1] = prose(rng, 30) + one + prose(rng, gap) + two + prose(rng, 30)
        want[2 * n + 1] = {*range(30, 30 + first), *(range(30 + first + gap, 30 + first + gap + second) if second >= 50 else ())}
    got = covered(spark, texts)
    assert {i for i, w in want.items() if not w <= got[i]} == set()


def test_passages_with_changed_words_are_found(spark):
    rng = random.Random(9)
    texts, cases = {}, []
    for size, changes in [(60, [15, 45]), (60, [15, 30, 45]), (70, range(15, 70, 15)), *((100, range(s, 100, s)) for s in range(5, 13))] * 6:
        n, passage = 2 * len(cases), prose(rng, size)
        edited = [f"changed{n}" if i in set(changes) else w for i, w in enumerate(passage)]
        texts[n] = prose(rng, 50) + passage + prose(rng, 50)
        texts[n + 1] = prose(rng, 40) + edited + prose(rng, 40)
        cases.append((n + 1, size))
    got = covered(spark, texts)
    assert [c for c in cases if len(got[c[0]] & set(range(40, 40 + c[1]))) < c[1] - 4] == []
    assert all(min(w) >= 30 and max(w) < 50 + s for (i, s) in cases if (w := got[i]))


def test_long_copies_are_found_whole(spark):
    rng = random.Random(13)
    long = prose(rng, 2500)
    got = covered(spark, {0: long[:1068], 1: long[:1068], 2: long, 3: prose(rng, 30) + long[100:2500], 4: long[:1025], 5: long[1000:2100]})
    assert [len(got[i]) for i in range(6)] == [0, 1068, 1068, 2400, 1025, 1100]


def test_changed_passages_whose_runs_all_stand_in_earlier_documents(spark):
    rng = random.Random(12)
    texts, cases = {}, []
    for step in (5, 8, 10):
        for _ in range(10):
            passage = prose(rng, 60)
            edited = [f"new{rng.randrange(3000)}" if i % step == step - 1 else w for i, w in enumerate(passage)]
            for i in range(0, 60, step):  # each equal run also in an unrelated document before both
                texts[len(texts)] = prose(rng, 40) + passage[i:i + step - 1] + prose(rng, 40)
            cases.append((passage, edited))
    for passage, _ in cases:
        texts[len(texts)] = prose(rng, 50) + passage + prose(rng, 50)
    first = len(texts)
    for _, edited in cases:
        texts[len(texts)] = prose(rng, 40) + edited + prose(rng, 40)
    got = covered(spark, texts)
    found = [len(got[first + n] & set(range(40, 100))) >= 50 for n in range(30)]
    assert sum(found) >= 28, found
    assert not any(got[i] for i in range(first))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.integers(0, 6), st.integers(0, 2)), max_size=40, unique_by=lambda r: r[1:3]), st.integers(0, 40))
def test_seeds_meet_the_earliest_documents_in_one_go_or_in_pieces(rows, cut):
    def want(keys):
        out = set()
        for s, i, at, c in rows:
            i0, at0 = min((r[1], r[2]) for r in rows if all(r[x] == (s, i, at, c)[x] for x in keys))
            if i > i0:
                out.add((i, i0, at - at0, at))
        return out

    given_rows = np.array(rows, np.int64).reshape(-1, 4)
    got, _ = passages.meet(given_rows)
    assert {tuple(r) for r in got.tolist()} == want((0,)) | want((0, 3))
    _, firsts = passages.meet(given_rows[:cut])
    _, both = passages.meet(np.concatenate([firsts, given_rows[cut:]]))
    assert np.unique(both, axis=0).tolist() == np.unique(passages.meet(given_rows)[1], axis=0).tolist()


def test_stretches_inside_a_solid_run_of_another_document_go():
    match = [(7, 1, 3, at) for at in range(10, 40)] + [(7, 2, 0, 20), (7, 2, 0, 30), (7, 3, 0, 38), (7, 3, 0, 45), (7, 4, 0, 60), (7, 5, 3, 9), (9, 2, 0, 20), (9, 2, 0, 30)]
    rows = np.array(sorted(match), np.int64)
    runs = passages.solid(rows, 4)
    assert runs.tolist() == [[7, 1, 10, 43]]
    found = np.array([(7, 1, 10, 43, 7, 40), (7, 2, 20, 34, 20, 34), (7, 3, 38, 49, 38, 49), (7, 4, 60, 64, 60, 64), (9, 2, 20, 34, 20, 34)], np.int64)
    assert passages.outer(found, runs)[:, :3].tolist() == [[7, 1, 10], [7, 3, 38], [7, 4, 60], [9, 2, 20]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1 << 50), st.integers(-(1 << 62), 1 << 62), st.integers(-5, 5)), max_size=30))
def test_packed_columns_come_back(rows):
    columns = np.array(sorted(rows), np.int64).reshape(-1, 3)
    assert passages.unpack(passages.pack(*columns.T), 3).tolist() == columns.tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), max_size=40))
def test_dense_matches(places):
    rows = np.array([(i, 0, 0, at) for i, at in sorted(places)], np.int64).reshape(-1, 4)
    want = []
    for i, _, _, at in rows.tolist():
        starts = sorted({a for j, a in places if j == i})
        # A window begins at a run and holds whole runs.
        want.append(any(low <= at <= low + 16 and len({w for a in starts if low <= a <= low + 16 for w in range(a, a + 4)}) >= 0.3 * 20 for low in starts))
    assert passages.dense(rows, 4, 20, 0.3).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
def test_parts_of_an_alignment(a, b):
    a, b = np.array(a, np.int32), np.array(b, np.int32)
    x, y = passages.common_places(a, b)
    assert len(x) == passages.common_words(a, b) and (a[x] == b[y]).all() and (np.diff(x) > 0).all() and (np.diff(y) > 0).all()
    parts = passages.segments(x, y, 0.8)
    assert all(same >= 0.8 * max(x1 - x0, y1 - y0) for x0, x1, y0, y1, same in parts)
    assert all(any(x0 <= i < x1 for x0, x1, *_ in parts) for i in x.tolist())


def test_no_rows_and_no_repeats(spark):
    schema = "doc_id long, text string"
    assert passages.passages(spark.createDataFrame([], schema)).count() == 0
    assert passages.passages(spark.createDataFrame([(1, "a few words")], schema)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40))
def test_common_words(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    assert passages.common_words(np.array(a, np.uint64), np.array(b, np.uint64)) == table[-1, -1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(1, 9)), min_size=1, max_size=9))
def test_chains_begin_with_the_best(parts):
    f = np.array([(x, x + n, y, y + n, n + 8) for x, y, n in parts])
    best = 0.0

    def extend(score, last, rest):
        nonlocal best
        best = max(best, score)
        for i in rest:
            if last is None or (f[i, 0] > f[last, 1] and f[i, 2] > f[last, 3]):
                skipped = 0 if last is None else f[i, 0] - f[last, 1] + f[i, 2] - f[last, 3]
                extend(score + f[i, 4] - 0.25 * skipped, i, rest - {i})

    extend(0.0, None, frozenset(range(len(f))))
    found = passages.chains(*f.T, 0.25)
    assert sorted(i for c in found for i in c) == list(range(len(f)))
    top = found[0]
    score = sum(f[i, 4] for i in top) - 0.25 * sum(f[j, 0] - f[i, 1] + f[j, 2] - f[i, 3] for i, j in zip(top, top[1:], strict=False))
    assert score == pytest.approx(best)


def test_removing_words_keeps_the_rest_as_it_is():
    assert passages.remove("One, two THREE!  four\nfive.", [1, 3], [2, 4]) == "One, THREE!  five."
    assert passages.remove("One two", [0], [2]) == ""
    assert passages.remove(None, [0], [1]) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 60), st.integers(1, 20)), max_size=30))
def test_pieces_cover_what_their_ranges_cover(ranges):
    group, low, size = (np.array([r[i] for r in ranges], np.int64) for i in range(3))
    found = list(zip(*(c.tolist() for c in passages.pieces(group, low, low + size)), strict=True))
    assert {(g, w) for g, a, b in found for w in range(a, b)} == {(g, w) for g, a, n in ranges for w in range(a, a + n)}
    assert sum(b - a for _, a, b in found) == len({(g, w) for g, a, n in ranges for w in range(a, a + n)})
    assert found == sorted(found)


def test_copies_of_an_anchor_in_many_pairs_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(planted()[0], "doc_id long, text string")
    whole = sorted(map(tuple, passages.passages(docs).collect()))
    monkeypatch.setattr(passages, "_OFTEN", 1)
    assert sorted(map(tuple, passages.passages(docs).collect())) == whole and whole
