"""Hard negatives against brute force, and the filter's intervals against true scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<double>, label int, score long, ids string, rank int"


def brute(rows, step=3, positives=5, negatives=5, share=(4, 5)):
    """The contract in plain Python; rows are (id, vector, label)."""
    one = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        x = [math.floor(256 * v) for v in x]
        if sum(v * v for v in x) < 1 << 62:
            one[i] = max(one.get(i, (label, x)), (label, x), key=lambda r: (r[0], np.array(r[1], np.int32).tobytes()))
    out = []
    for a, (label, x) in one.items():
        if a % step:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), i, other) for i, (other, y) in one.items() if i != a)
        for minus, p, _ in [s for s in scores if s[2] == label][:positives]:
            near = [s for s in scores if s[2] != label and share[0] * -minus <= share[1] * -s[0] and s[0] >= minus]
            out += [(a, p, k, n, -minus, -t) for k, (t, n, _) in enumerate(near[:negatives], 1)]
    return sorted(out)


def run(spark, rows, step=3, **options):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    return sorted(map(tuple, h.mined(docs, F.col("id") % step == 0, F.col("label"), **options).collect()))


def vectors(n, d, seed, spread=0.15, centres=4):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, d))
    x = middle[np.arange(n) % centres] + spread * draw.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True), draw


@pytest.mark.parametrize("n, d, seed", [(300, 64, 1), (200, 7, 2), (150, 100, 3)])
def test_equals_brute_force(spark, n, d, seed, monkeypatch):
    monkeypatch.setattr(h, "_BLOCK", 32)
    x, draw = vectors(n, d, seed)
    rows = [(i, x[i].tolist(), int(draw.integers(3))) for i in range(n)]
    rows += [(1000 + i, rows[0][1], i % 4) for i in range(12)]  # ties
    want = brute(rows)
    assert len(want) > 50 and run(spark, rows) == want


def test_nulls_repeats_and_odd_vectors(spark):
    x, _ = vectors(40, 5, 4)
    rows = [(i, x[i].tolist(), i % 2) for i in range(40)]
    rows += [(None, [1.0] * 5, 0), (41, None, 0), (42, [1.0] * 5, None), (45, [1.0, None, 0.0, 0.0, 0.0], 1), (48, [float("nan")] * 5, 0), (51, [float("inf")] * 5, 1),
             (54, [1e300] * 5, 1), (57, [2.0**23] * 5, 0), (60, [2.0**22 - 1] * 5, 1), (63, [], 0), (66, [0.0] * 5, 1), (69, [0.5], 0), (72, [0.5] * 9, 1), (75, [-0.5] * 5, 0)]
    rows += [rows[3], rows[3], (6, [0.25] * 5, 1), (6, [0.25] * 5, 0)]
    assert run(spark, rows) == brute(rows)


def test_other_numbers_of_rows(spark):
    x, _ = vectors(60, 16, 5, 0.3)
    rows = [(i, x[i].tolist(), i % 3) for i in range(60)]
    assert run(spark, rows, positives=2, negatives=3, share=(1, 2)) == brute(rows, positives=2, negatives=3, share=(1, 2))


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 0)]) == []
    assert run(spark, [(3, [1.0], 0)]) == []


@pytest.mark.parametrize("planes", [1, 4, 8])
def test_scores_lie_inside_their_intervals(planes):
    draw = np.random.default_rng(6)
    numbers = draw.integers(-300, 300, (500, 70)) * draw.integers(0, 2, (500, 1))
    codes, shape = h.coded(numbers)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    turned = h.rotated(numbers)
    assert np.allclose(turned @ turned.T, numbers @ numbers.T)
    for i in range(40):
        low, high = h.Query(turned[i], planes).bounds(codes, ones, shape)
        true = numbers @ numbers[i]
        assert (low <= true).all() and (true <= high).all()


def test_the_filter_leaves_out_most_rows_of_clustered_vectors():
    x, _ = vectors(2000, 64, 7, 0.02, 20)
    numbers = np.floor(256 * x).astype(np.int64)
    codes, shape = h.coded(numbers)
    low, high = h.Query(h.rotated(numbers)[0], 6).bounds(codes, np.bitwise_count(codes).sum(axis=1, dtype=np.int64), shape)
    best = np.sort(numbers @ numbers[0])[::-1][5]
    assert (high >= 0.8 * best).mean() < 0.2


def test_band_is_exact():
    for positive in range(-30, 31):
        least, most = h.band(positive, (4, 5))
        assert [s for s in range(-40, 41) if least <= s <= most] == [s for s in range(-40, 41) if 80 * positive <= 100 * s <= 100 * positive]
