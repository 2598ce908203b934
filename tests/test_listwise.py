"""The listwise ranker against a plain optimum, and against the pointwise one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.operators.spans import Spans
from cutline.plans import listwise, models

COLUMNS = ("a", "b", "c")


def plan(df, keys, order):
    return Spans(tuple(keys), order)


@pytest.fixture(scope="module")
def frame(spark):
    """Winners are drawn by a softmax; c is the same for a whole event, so it says nothing."""
    rng, rows = np.random.default_rng(11), []
    for event in range(400):
        n = int(rng.integers(2, 9))
        a, b, c = rng.normal(size=n), rng.normal(size=n), rng.normal()
        s = 4.0 * a - 2.0 * b
        winner = rng.choice(n, p=np.exp(s) / np.exp(s).sum())
        rows += [(event, k, event // 100, event * 10, float(a[k]), None if rng.random() < 0.05 else float(b[k]), float(c), int(k == winner), int(k == winner)) for k in range(n)]
    rows += [(1000, k, 3, 3995, 0.0, 0.0, 0.0, 0, 0) for k in range(3)]  # nobody wins
    return spark.createDataFrame(rows, "event int, entity int, season int, ord long, a double, b double, c double, win int, podium int").cache()


def plain(pdf, cut, C=0.5):
    """Newton on the whole loss."""
    old = pdf[pdf.ord < cut]
    x = old[list(COLUMNS)].to_numpy(float)
    medians = np.nanmedian(x, axis=0)
    x = np.where(np.isnan(x), medians, x)
    z = (x - x.mean(0)) / x.std(0)
    groups = [np.flatnonzero(old.event.to_numpy() == e) for e in old.event.unique()]
    groups = [g for g in groups if old.win.to_numpy()[g].sum() == 1]
    beta = np.zeros(len(COLUMNS))
    for _ in range(80):
        gradient, curvature = beta.copy(), np.eye(len(COLUMNS))
        for g in groups:
            p = np.exp(z[g] @ beta)
            p /= p.sum()
            mean = p @ z[g]
            gradient += C * (mean - old.win.to_numpy()[g] @ z[g])
            curvature += C * ((z[g] * p[:, None]).T @ z[g] - np.outer(mean, mean))
        beta = beta - np.linalg.solve(curvature, gradient)
    return beta


@pytest.mark.parametrize("part", [1024, 3])
def test_every_fold_is_the_plain_optimum(frame, monkeypatch, part):
    monkeypatch.setattr(listwise, "_PART", part)  # with 3, most events lie in several rows
    cuts = [1000, 2000, 3995]
    ranker = listwise.fit(frame, COLUMNS, cuts, plan, calibration_events=10)
    borders = listwise.calibration_borders(frame, cuts, 10)
    assert borders == [900, 1900, 3900]
    for f, border in enumerate(borders):
        assert np.allclose(ranker.beta[f], plain(frame.toPandas(), border), atol=1e-6)
    assert abs(ranker.beta[2, 2]) < 0.2 and all(t in listwise.GRID for t in ranker.temperature)


def test_chances_fill_events_and_beat_the_pointwise_ranker(frame):
    cuts = [1000, 2000, 3000]
    ranker = listwise.fit(frame, COLUMNS, cuts, plan, calibration_events=25)
    got = listwise.chances(frame, ranker, plan).toPandas()
    assert np.allclose(got.groupby("event").p.sum(), 1) and set(got.season) == {1, 2, 3}
    log_loss = -np.log(got[got.win == 1].p).mean()
    other = [models.ranker(frame.where(F.col("ord") < cut + 1000), COLUMNS, cut, plan).toPandas() for cut in cuts]
    pointwise = np.mean(np.concatenate([-np.log(o[o.win == 1].p) for o in other]))
    assert log_loss < pointwise


def test_temperature_is_the_best_of_the_grid(frame):
    ranker = listwise.fit(frame, COLUMNS, [3000], plan, calibration_events=40)
    late = listwise.scored(frame.withColumn("ord", F.col("ord") + 100_000), ranker).toPandas()
    late = late[(late.ord >= 100_000 + 2600) & (late.ord < 100_000 + 3000)]

    def loss(t):
        return np.mean([-np.log(np.exp(g.score / t)[g.win == 1].sum() / np.exp(g.score / t).sum()) for _, g in late.groupby("event")])

    assert ranker.temperature[0] == min(listwise.GRID, key=loss)


def test_too_few_events_and_no_rows(frame):
    few = frame.where("ord < 200")
    assert listwise.calibration_borders(few, [100, 200], 25) == [100, 200]
    ranker = listwise.fit(few, COLUMNS, [0, 50], plan)
    assert (ranker.beta[0] == 0).all() and listwise.chances(few, ranker, plan, min_events=6).count() == 0
    assert (listwise.fit(frame.where("event < 0"), COLUMNS, [5], plan).beta == 0).all()


def test_events_that_lie_whole_make_no_products_by_entry(frame, monkeypatch):
    def refused(*_):
        raise AssertionError("a matrix for each entry")

    expected = listwise.fit(frame, COLUMNS, [3995], plan, calibration_events=10)
    monkeypatch.setattr(listwise, "_event_sums", refused)
    ranker = listwise.fit(frame, COLUMNS, [1000, 3995], plan, calibration_events=10)
    assert np.allclose(ranker.beta[1], expected.beta[0], atol=1e-9)
