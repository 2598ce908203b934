"""Scores, rules, simulation, models and records on hand data."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import rows
from cutline.plans import classes, evaluate, models, record, rules, simulate


def score(spark, plan, ps, winner, podium, places=3):
    preds = spark.createDataFrame([(1, i, float(p)) for i, p in ps.items()], "event bigint, entity bigint, p double")
    ids = set(ps) | {winner} | set(podium)
    actual = spark.createDataFrame([(1, i, int(i == winner), int(i in podium)) for i in ids], "event bigint, entity bigint, won int, podium int")
    return evaluate.score_events(preds, actual, plan, places=places).first()


def test_uniform_scores_one_over_n(spark, plan):
    r = score(spark, plan, {i: 1.0 for i in range(20)}, 7, [7, 3, 19])
    assert math.isclose(r["winner_hit"], 1 / 20) and math.isclose(r["podium_hits"], 9 / 20) and math.isclose(r["log_loss"], math.log(20))


def test_oracle_scores_everything(spark, plan):
    r = score(spark, plan, {1: 0.9, 2: 0.06, 3: 0.03, 4: 0.01}, 1, [1, 2, 3])
    assert (r["winner_hit"], r["podium_hits"]) == (1.0, 3.0)


def test_ties_at_the_cut_are_shared(spark, plan):
    r = score(spark, plan, {1: 0.5, 2: 0.2, 3: 0.1, 4: 0.1, 5: 0.1}, 1, [1, 3, 4])
    assert math.isclose(r["podium_hits"], 1 + 2 / 3)


def test_winner_outside_the_field_costs_one(spark, plan):
    r = score(spark, plan, {1: 0.5, 2: 0.5}, 9, [9, 1, 2])
    assert math.isclose(r["brier"], 1.5) and r["undefined"] == "winner_not_in_field" and math.isclose(r["log_loss"], -math.log(1e-9))
    assert score(spark, plan, {1: 1.0, 2: 0.0}, 2, [1, 2])["undefined"] == "winner_at_zero"


def test_class_scores(spark):
    df = spark.createDataFrame([(1, 0, .5, .25, .25), (2, 1, .1, .8, .1), (2, 1, .1, .8, .1)], "event int, y int, a double, b double, c double")
    got = {r["event"]: r for r in evaluate.class_scores(df, ["event"], ["a", "b", "c"], "y").collect()}
    assert math.isclose(got[1]["log_loss"], -math.log(.5)) and math.isclose(got[2]["log_loss"], -math.log(.8)) and math.isclose(got[2]["brier"], .06)


def test_calibration_edges_and_error(spark):
    df = spark.createDataFrame([(0, 0.3, 1), (0, 0.95, 1), (0, 1.0, 1), (0, 0.0, 0)], "run int, p double, y int")
    table = evaluate.calibration_table(df, ["run"])
    assert {r["bin"]: r["n"] for r in table.collect()} == {2: 1, 9: 2, 0: 1}  # 0.3 lies below the fourth edge
    good = spark.createDataFrame([(0, 0.25, y) for y in (1, 0, 0, 0)], "run int, p double, y int")
    assert evaluate.calibration_error(evaluate.calibration_table(good, ["run"]), ["run"]).first()["ece"] == 0


def test_intervals_bracket_the_mean_and_identical_runs_do_not_differ(spark):
    rng = np.random.default_rng(1)
    data = [("a", i, float(v)) for i, v in enumerate(rng.normal(2, 1, 200))]
    a = spark.createDataFrame(data, "run string, event bigint, log_loss double")
    r = evaluate.bootstrap(a, ["run"], "log_loss", draws=500).first()
    assert r["lo"] < r["mean"] < r["hi"] and 0.2 < r["hi"] - r["lo"] < 0.36
    assert not evaluate.paired_difference(a, a, ["run"], "log_loss", 200).first()["significant"]
    worse = a.withColumn("log_loss", F.col("log_loss") + 1)
    assert evaluate.paired_difference(worse, a, ["run"], "log_loss", 200).first()["significant"]


def test_bootstrap_shares_weights_and_spreads_work(spark):
    """Means of replicates as the weights give them, for runs of different events; few rows are still dealt over many tasks."""
    from cutline.functions.chance import poisson_table

    data = [(run, e, (e % 7) / 3 + len(run)) for e in range(300) for run in ("a", "bb", "ccc") if run != "bb" or e % 2]
    scores = spark.createDataFrame([*data, ("a", 500, None)], "run string, event long, v double").coalesce(1)
    means = evaluate.replicate_means(scores, ["run"], "v", "event", 40, 5)
    got = {(r["run"], r["replicate"]): r["mean"] for r in means.collect()}
    weights = poisson_table(np.arange(300), 40, 5).astype(int)
    for run in ("a", "bb", "ccc"):
        e, v = np.array([(e, v) for r, e, v in data if r == run]).T
        want = (v @ weights[e.astype(int)]) / weights[e.astype(int)].sum(axis=0)
        assert np.allclose([got[run, i] for i in range(40)], want)
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "MapInArrow" in plan


def entries(spark, n=40, field=6, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for e in range(n):
        order = rng.permutation(field)
        for place, i in enumerate(order):
            out.append((e, 1000 + e, 2000 + e // 10, int(i), int(i) % 3, place + 1, "R" if place == field - 1 else str(place + 1), place == field - 1,
                        int((i + e) % field), "v"))
    return spark.createDataFrame(out, "event bigint, ord bigint, season bigint, entity bigint, grp bigint, finish bigint, code string, retired boolean, grid bigint, venue string")


def test_position_prior_learns_only_from_earlier_events(spark, plan):
    df = rules.scored_entries(entries(spark), plan)
    got = {(r["event"], r["entity"]): r["p"] for r in rules.position_prior(df, "grid", plan, plan).collect()}
    wins, starts, every = {}, {}, 0
    for _, g in df.toPandas().sort_values(["ord", "entity"]).groupby("ord"):
        for r in g.itertuples():
            want = (wins.get(r.grid, 0) + 1) / (starts.get(r.grid, 0) + 20) if r.grid > 0 else 1 / (every + 1)
            assert math.isclose(got[(r.event, r.entity)], want)
        for r in g.itertuples():
            if r.grid > 0:
                starts[r.grid] = starts.get(r.grid, 0) + 1
                wins[r.grid] = wins.get(r.grid, 0) + r.won
                every += 1


def test_events_without_a_winner_or_field_are_left_out(spark, plan):
    df = entries(spark, 3).withColumn("code", F.when((F.col("event") == 1) & (F.col("finish") == 1), "R").when(
        (F.col("event") == 2) & (F.col("finish") > 2), "W").otherwise(F.col("code")))
    assert {r["event"] for r in rules.scored_entries(df, plan).select("event").distinct().collect()} == {0}


def brute_elo(frame):
    rating, out = {}, {}
    for e, g in frame.sort_values(["ord", "finish"]).groupby("ord", sort=True):
        for r in g.itertuples():
            out[(r.event, r.entity)] = rating.get(r.entity, 1500.0)
        ids = g.loc[~g["retired"], "entity"].tolist()
        delta = dict.fromkeys(ids, 0.0)
        for i, a in enumerate(ids):
            for b in ids[i + 1:]:
                expected = 1 / (1 + 10 ** ((rating.get(b, 1500.0) - rating.get(a, 1500.0)) / 400))
                delta[a] += 24 / (len(ids) - 1) * (1 - expected)
                delta[b] -= 24 / (len(ids) - 1) * (1 - expected)
        for i, d in delta.items():
            rating[i] = rating.get(i, 1500.0) + d
    assert abs(sum(rating.values()) - 1500 * len(rating)) < 1e-6
    return out


def test_elo_equals_the_pairwise_fold(spark):
    df = entries(spark)
    want = brute_elo(df.toPandas())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # events straddle batches
    try:
        got = {(r["event"], r["entity"]): r["rating"] for r in rules.elo(df, "venue").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_streamed_ratings_equal_the_batch(spark):
    from cutline.plans.q_streaming import stored_stream
    from cutline.streaming import streams

    df = entries(spark, 30).withColumn("ts", F.timestamp_millis(F.col("ord")))
    want = brute_elo(df.drop("ts").toPandas())
    stream, end = stored_stream(df, "t", "ts")
    out = streams.run_to_table(streams.rating_stream(stream, "venue", "ts", "0 seconds"), "t-out", closing=end)
    got = {(r["event"], r["entity"]): r["rating"] for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)


def test_simulation_is_a_distribution_and_first_place_follows_the_strengths(spark, plan):
    p = {0: 0.5, 1: 0.3, 2: 0.15, 3: 0.05}
    df = spark.createDataFrame([(1, i, v, 0.0) for i, v in p.items()], "event bigint, entity bigint, p double, q double")
    out = {r["entity"]: r for r in simulate.marginals(simulate.position_distribution(df, "p", 4000, plan)).collect()}
    for i, v in p.items():
        assert abs(out[i]["p_win"] - v) < 0.03 and math.isclose(sum(out[i]["distribution"]), 1.0)
    assert math.isclose(sum(r["p_podium"] for r in out.values()), 3.0)
    certain = simulate.top_k_with_retirements(df, "p", "q", 2, 500, plan, name="t")
    plain = {r["entity"]: r["count"] for r in simulate.draw_orders(df, "p", 500).where("position <= 2").groupBy("entity").count().collect()}
    assert all(abs(r["t"] - plain[r["entity"]] / 500) < 0.1 for r in certain.collect())
    gone = simulate.top_k_with_retirements(df.withColumn("q", F.lit(1.0)), "p", "q", 2, 50, plan, name="t")
    assert all(r["t"] == 0 for r in gone.collect())


def test_distribution_summary(spark):
    df = spark.createDataFrame([([0.05, 0.5, 0.2, 0.15, 0.1],)], "distribution array<double>")
    r = simulate.distribution_summary(df).first()
    assert (r["mode"], r["low"], r["high"]) == (2, 2, 4)


def test_class_rules_fall_back_from_venue_to_season_to_last_season(spark, plan):
    data = [(1, 1, 2000, "a", 1, 1, 3), (2, 2, 2001, "b", 1, 1, 1), (3, 3, 2001, "a", 1, 1, 2)]
    df = spark.createDataFrame(data, "event bigint, ord bigint, season bigint, venue string, entity bigint, grp bigint, stops bigint")
    got = {r["event"]: r for r in classes.class_history(df, plan).collect()}
    assert [got[1][f"rule_venue_{k}"] for k in range(3)] == [1 / 3] * 3
    assert [got[2][f"rule_venue_{k}"] for k in range(3)] == [0.25, 0.25, 0.5]   # last season
    assert [got[3][f"rule_venue_{k}"] for k in range(3)] == [0.25, 0.25, 0.5]   # the venue's own
    assert [got[3][f"rule_season_{k}"] for k in range(3)] == [0.5, 0.25, 0.25]  # this season so far


def training(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [1.5, -0.7] - 0.4)))).astype(int)
    x[rng.random(n) < 0.1, 0] = np.nan
    data = [(i // 5, i % 5, i // 5, 2000 + i // 100, *[None if np.isnan(v) else float(v) for v in x[i]], int(y[i])) for i in range(n)]
    return spark.createDataFrame(data, "event bigint, entity bigint, ord bigint, season bigint, a double, b double, win int")


def test_folds_solve_their_own_penalised_problem(spark, plan):
    df = training(spark)
    cuts = models.season_cuts(df)
    fits = models.fit_folds(df, ["a", "b"], ["win"], cuts, plan)
    frame = df.toPandas()
    for f, cut in enumerate(cuts):
        tr = frame[frame["ord"] < cut]
        assert fits.rows[f] == len(tr)
        if not len(tr):
            continue
        x = tr[["a", "b"]].fillna(tr[["a", "b"]].median()).to_numpy()
        z = (x - x.mean(0)) / x.std(0)
        z1, y = np.hstack([np.ones((len(z), 1)), z]), tr["win"].to_numpy()
        beta = fits.beta[f, 0]
        gradient = 0.5 * z1.T @ (1 / (1 + np.exp(-z1 @ beta)) - y) + np.r_[0, beta[1:]]
        assert np.abs(gradient).max() < 1e-6
    got = models.predict(df, fits, plan, min_train=100).toPandas()
    assert got["event"].min() == cuts[1]  # the first fold has nothing to train on
    one = got.merge(frame[["event", "entity", "a", "b", "season"]], on=["event", "entity"]).query("season_x == 2003").iloc[0]
    tr = frame[frame["ord"] < cuts[3]]
    v = pd.Series([one.a, one.b]).fillna(pd.Series(tr[["a", "b"]].median().to_numpy())).to_numpy()
    z = (v - fits.means[3]) / fits.deviations[3]
    assert math.isclose(one.p, 1 / (1 + math.exp(-(fits.beta[3, 0, 0] + z @ fits.beta[3, 0, 1:]))), rel_tol=1e-9)


def test_fits_never_see_the_fold_they_predict(spark, plan):
    df = training(spark)
    cuts = models.season_cuts(df)
    poisoned = df.withColumn("win", F.when(F.col("ord") >= cuts[2], 1 - F.col("win")).otherwise(F.col("win")))
    a, b = (models.fit_folds(d, ["a", "b"], ["win"], cuts[:3], plan).beta for d in (df, poisoned))
    assert np.allclose(a, b)


def test_temperature_recovers_the_scale(spark, plan):
    rng = np.random.default_rng(0)
    data = []
    for e in range(300):
        z = rng.normal(size=6)
        winner = rng.choice(6, p=np.exp(z) / np.exp(z).sum())
        data += [(e, int(i == winner), float(3 * z[i])) for i in range(6)]
    df = spark.createDataFrame(data, "event bigint, win int, score double")
    assert 2.0 < models.temperature(df, plan) < 4.5


def test_deadlines_and_the_revision_that_counts(spark):
    s = [(1, "Practice 1", 1), (1, "Qualifying", 5), (1, "Race", 9), (2, "Practice 1", 1), (2, "Sprint", 4), (2, "Qualifying", 6), (2, "Race", 9),
         (3, "Sprint Qualifying", 3), (3, "Sprint", 4), (3, "Qualifying", 6)]
    got = {(r["event"], r["snapshot"]): (r["deadline"], r["refused"]) for r in record.deadlines(spark.createDataFrame(s, "event int, session string, starts_at int")).collect()}
    assert got[(1, "pre_weekend")] == (1, None) and got[(1, "post_practice")] == (5, None) and got[(1, "post_qualifying")] == (9, None)
    assert got[(2, "post_practice")] == (None, "sprint qualifying time missing") and got[(3, "post_practice")] == (3, None)
    assert got[(3, "post_qualifying")] == (None, "no race time")
    revs = spark.createDataFrame([(1, 1, 2), (1, 2, 4), (1, 3, 5), (2, 1, 9)], "event int, revision int, generated_at int")
    due = spark.createDataFrame([(1, 5), (2, 9)], "event int, deadline int")
    assert rows(record.mark_revisions(revs, due, ["event"]), "event", "revision", "late", "effective") == [
        (1, 1, False, False), (1, 2, False, True), (1, 3, True, False), (2, 1, True, False)]


def test_append_new_never_rewrites(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "event int, v string")
    path = str(tmp_path / "ledger")
    assert record.append_new(spark, df, path, ["event"]) == 2
    changed = spark.createDataFrame([(2, "other"), (3, "c")], "event int, v string")
    assert record.append_new(spark, changed, path, ["event"]) == 1
    assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "b"), (3, "c")]
    record.write_once(df, str(tmp_path / "once"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        record.write_once(df, str(tmp_path / "once"))


def test_publishing_refuses_missing_inputs(spark):
    ok = spark.createDataFrame([(1, i, 1.0, 2.0) for i in range(12)], "event int, entity int, timed double, q double")
    record.require_inputs(ok, "timed", ["q"])
    for column in ("timed", "q"):
        with pytest.raises(ValueError, match="inputs missing"):
            record.require_inputs(ok.withColumn(column, F.when(F.col("entity") > 10, None if column == "q" else None).otherwise(
                F.col(column) if column == "q" else F.when(F.col("entity") < 3, 1.0))), "timed", ["q"])


def test_a_name_is_registered_once():
    from cutline import registry

    registry.load_all()
    with pytest.raises(ValueError):
        registry.query("elo")(lambda star: None)


def test_the_frame_is_built_in_stored_parts_of_which_the_last_stays(spark):
    from pathlib import Path

    from cutline.plans import features as P
    from cutline.session import checkpoint_root
    from cutline.sources.star import Star

    def folders(name):
        return set(Path(checkpoint_root(spark).removeprefix("file:")).glob(f"cutline-{name}-*"))

    parts = ("frame-entity", "frame-group", "frame-venue", "frame-standing")
    before = {p: folders(p) for p in parts}
    df = P.build(Star(spark, "/root/testdata/sf0.001").feature_tables(), P.PRE)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [len(folders(p) - before[p]) for p in parts] == [0, 0, 0, 1]
    assert df.count() == df.select("event", "entity").distinct().count() > 0


def test_the_audit_builds_a_given_whole_frame_no_second_time(spark):
    from types import SimpleNamespace

    from cutline.plans import features as P

    names, built = P.features_for(P.PRE), []
    events = spark.createDataFrame([(1, 1998), (2, 1999)], "event bigint, season bigint")

    def frame(t, snapshot, value=0.0):
        built.append(t)
        return t.events.select("event", F.lit(1).alias("entity"), *[F.lit(value).alias(n) for n in names])

    t = SimpleNamespace(events=events, before=lambda cut: SimpleNamespace(events=events.where(F.col("season") < cut)))
    whole = frame(t, P.PRE, 1.0)
    found = P.leakage_audit(t, P.PRE, 1999, frame, whole=whole)
    assert found.count() == len(names) and len(built) == 2


def test_a_list_that_documents_share_is_written_once_and_in_parts(spark):
    items = spark.createDataFrame([(1, i) for i in range(95)] + [(2, 7), (2, None)], "event bigint, absent bigint")
    found = record.shared_list_documents(["event"], items, "absences", ["absent"], 10)
    read = found.withColumn("d", F.from_json("document", "event bigint, absences array<struct<absent: bigint>>")).collect()
    held = {e: sorted((x["absent"] for r in read if r["event"] == e for x in r["d"]["absences"]), key=str) for e in (1, 2)}
    assert held == {1: sorted(range(95), key=str), 2: [7, None]}
    assert max(len(r["d"]["absences"]) for r in read) < 40 and len([r for r in read if r["event"] == 1]) > 5


def test_full_documents_gathers_no_absences_per_author(spark):
    import __spark_entry__ as entry

    path = "/root/testdata/sf0.001"
    plan = entry.queries()["full_documents"](spark, path)._jdf.queryExecution().optimizedPlan().toString()
    lists = [line for line in plan.splitlines() if "collect_list" in line and "absent" in line]
    assert lists and not any("author" in line for line in lists)


def test_scores_read_outcomes_beside_the_chances(spark, plan):
    """Outcomes that stand beside the chances are not joined again, and the scores are the same."""
    data = [(e, i, (i + 1.0) / 10 if e != 3 else 0.0, int(i == e % 4), int(i < 3)) for e in range(8) for i in range(4)]
    both = spark.createDataFrame(data, "event long, entity long, p double, won int, podium int")
    actual = both.select("event", "entity", "won", "podium")
    told = evaluate.score_events(both, actual, plan)
    assert sorted(told.collect()) == sorted(evaluate.score_events(both.drop("won", "podium"), actual, plan).collect())
    assert told._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_histories_of_the_frame_are_cut_as_the_entries_are_and_not_computed_for_it(spark):
    from types import SimpleNamespace

    from cutline.operators.spans import Spans
    from cutline.plans import features as P

    asked = []

    def plan(df, keys, order):
        asked.append((df, tuple(keys), order))
        return Spans(tuple(keys), order)

    entries = spark.createDataFrame([(1, 1, 1, 5)], "event bigint, entity bigint, grp bigint, ord bigint")
    of_frame = P._history_plan(SimpleNamespace(plan=plan, entries=entries))
    summed = entries.groupBy("grp", "ord").count()
    for df in (entries, summed, summed):
        assert of_frame(df, ["grp"], "ord").keys == ("grp",)
    of_frame(summed, ["event", "grp"], "ord")
    assert [(df is entries, keys) for df, keys, _ in asked] == [(True, ("grp",)), (False, ("event", "grp"))]


def test_standings_that_must_be_looked_at_are_computed_once(spark, monkeypatch):
    from cutline.operators import dense, peers
    from cutline.operators.spans import Spans

    kept = []
    monkeypatch.setattr(peers, "stored", lambda df, name: kept.append(name) or df)

    def plan(df, keys, order):
        return Spans(tuple(keys), order)

    plan.looks = lambda df, keys: True
    entries = spark.createDataFrame([(1, 1, 7, 3.0, "1"), (1, 1, 8, 1.0, "2"), (1, 2, 8, 4.0, "1")], "season bigint, round bigint, entity bigint, points double, code string")
    got = dense.standings(entries, entries.select("season", "round"), "entity", plan)
    assert {(r["round"], r["entity"]): (r["standing_points"], r["standing_position"]) for r in got.collect()} == {(1, 7): (3.0, 1), (1, 8): (1.0, 2), (2, 7): (3.0, 2), (2, 8): (5.0, 1)}
    assert kept == ["standings-cells"]
