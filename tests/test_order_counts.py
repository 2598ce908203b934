"""Simulated orders against exact chances."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.plans import order_counts, simulate

DRAWS = 20_000


def exact(strength, out=None):
    """Chance of each (entry, place), and of each (entry, place) as a finisher, by summing over everything that can happen."""
    n = len(strength)
    every, ended = np.zeros((n, n)), np.zeros((n, n))
    for gone in itertools.product([False, True], repeat=n):
        chance = 1.0
        for i, g in enumerate(gone):
            q = 0.0 if out is None else out[i]
            chance *= q if g else 1 - q
        if chance == 0:
            continue
        running = [i for i in range(n) if not gone[i]]
        for order in itertools.permutations(running):
            c, rest = chance, sum(strength[i] for i in running)
            for i in order:
                c *= strength[i] / rest
                rest -= strength[i]
            for place, i in enumerate([*order, *[i for i in range(n) if gone[i]]]):
                every[i, place] += c
                ended[i, place] += c if not gone[i] else 0.0
    return every, ended


def close(counts, chance, draws=DRAWS):
    """Within five standard deviations, and nothing where nothing can be."""
    error = 5 * np.sqrt(draws * chance * (1 - chance)) + 1e-9
    return (np.abs(counts - draws * chance) <= error).all()


@pytest.mark.parametrize("strength, out", [([1.0], None), ([0.7, 0.3], None), ([5.0, 1.0, 1.0], [0.1, 0.4, 0.0]), ([0.1, 0.2, 0.3, 0.4], [0.5, 0.0, 1.0, 0.2]), ([3.0, 1.0, 2.0, 0.5, 0.5], None)])
def test_both_ways_of_drawing_have_the_exact_chances(strength, out):
    every, ended = exact(strength, out)
    one = order_counts.by_sets(1, np.array([9]), np.array([strength]), None if out is None else np.array([out]), DRAWS)
    other = order_counts.drawn(1, 9, 0, np.array(strength), None if out is None else np.array(out), DRAWS)
    for found in ((one[0][0], one[1][0]), other):
        assert close(found[0], every) and close(found[1], ended)
        assert (found[0].sum(axis=0) == DRAWS).all() and (found[0].sum(axis=1) == DRAWS).all()


def test_counts_vary_as_draws_do():
    """Means and variances over many events are those of 1,000 independent draws."""
    strength = np.tile([[0.6, 0.3, 0.1]], (4000, 1))
    every, _ = order_counts.by_sets(3, np.arange(4000), strength, None, 1000)
    chance, _ = exact([0.6, 0.3, 0.1])
    assert np.allclose(every.mean(axis=0), 1000 * chance, atol=1.2)
    assert np.allclose(every.var(axis=0), 1000 * chance * (1 - chance), rtol=0.12)


def test_sets_of_a_field():
    for n in range(1, 7):
        found = order_counts.sets(n)
        assert sorted(x for some, _, _ in found for x in some.tolist()) == list(range(1, 1 << n))
        for some, members, rest in found:
            assert (rest | 1 << members == some[:, None]).all() and len(some) == math.comb(n, members.shape[1])


def test_missing_and_extreme_values():
    every, _ = order_counts.by_sets(1, np.array([1]), np.array([[np.nan, 1.0, 0.0]]), np.array([[np.nan, 2.0, -1.0]]), 100)
    assert every[0, 1, 2] == 100  # certain to retire
    every, _ = order_counts.by_sets(1, np.array([1]), np.array([[np.inf, 1.0]]), None, 100)
    assert every[0].tolist() == [[100, 0], [0, 100]]


@pytest.fixture(scope="module")
def fields(spark):
    draw = np.random.default_rng(2)
    rows = [(event, 100 + k, float(draw.random()), float(draw.random() / 2)) for event, n in enumerate([1, 2, 3, 5, 8, 14]) for k in range(n)]
    return spark.createDataFrame(rows, "event long, entity long, p double, q double").cache()


def counts_of(df, plan, **options):
    return {(r.event, r.entity): (r.field, r.every, r.ended) for r in simulate.order_counts_of(df, "p", DRAWS, plan, **options).collect()}


def test_frames_have_every_entry_and_do_not_depend_on_partitions(fields, plan):
    got = counts_of(fields, plan, p_out="q")
    assert got == counts_of(fields.repartition(7, "entity"), plan, p_out="q")
    assert len(got) == fields.count()
    for (_, _), (field, every, ended) in got.items():
        assert len(every) == field and sum(every) == DRAWS and all(e <= c for c, e in zip(every, ended, strict=True))
    for event, n in enumerate([1, 2, 3, 5]):
        held = fields.where(F.col("event") == event).orderBy("entity").toPandas()
        every, ended = exact(held.p.tolist(), held.q.tolist())
        assert close(np.array([got[event, 100 + k][1] for k in range(n)]), every)
        assert close(np.array([got[event, 100 + k][2] for k in range(n)]), ended)


def test_blocks_of_draws_and_row_by_row_draws_have_the_same_chances(fields, plan, monkeypatch):
    whole = counts_of(fields, plan, p_out="q")
    monkeypatch.setattr(simulate, "_BLOCK_CELLS", 30_000)
    blocks = counts_of(fields, plan, p_out="q")
    monkeypatch.setattr(simulate, "_LARGEST_FIELD", 6)
    rows = counts_of(fields, plan, p_out="q")
    assert whole.keys() == blocks.keys() == rows.keys()
    for key, (field, every, ended) in whole.items():
        for other in (blocks, rows):
            assert other[key][0] == field and sum(other[key][1]) == DRAWS
            for a, b in ((every, other[key][1]), (ended, other[key][2])):
                chance = (np.array(a) + b) / (2 * DRAWS)
                assert (np.abs(np.array(a) - b) <= 5 * np.sqrt(2 * DRAWS * chance * (1 - chance)) + 3).all()


def test_repeated_rows_are_one_entry_and_no_rows_give_none(fields, plan, spark):
    assert counts_of(fields.unionByName(fields), plan) == counts_of(fields, plan)
    assert counts_of(fields.where("event < 0"), plan) == {}


def test_top_places_of_finishers(fields, plan):
    held = fields.where("event = 3").orderBy("entity").toPandas()
    _, ended = exact(held.p.tolist(), held.q.tolist())
    got = {r.entity: r.t for r in simulate.top_k_with_retirements(fields.where("event = 3"), "p", "q", 2, DRAWS, plan, name="t").collect()}
    assert all(abs(got[100 + k] - ended[k, :2].sum()) < 0.02 for k in range(5))
