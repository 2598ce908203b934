"""Operators on small hand-made frames with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from helpers import rows
from cutline.operators import checks as C, corrections as K, dense, diff, flags, form, identity, lookup, peers, profile, runs

CORRECTIONS = "table string, primary_key string, column string, old_value string, new_value string, reason string, evidence_type string, evidence_source string"


def test_trailing_mean_of_last_three(spark, plan):
    q = [(1, 1, 10, 2.0), (2, 1, 10, 3.0), (3, 1, 10, 4.0), (4, 1, 20, 3.0), (5, 1, 20, 5.0)]
    measured = spark.createDataFrame(q, "ord bigint, entity bigint, grp bigint, position double")
    field = spark.createDataFrame([(1, 1), (4, 1), (6, 1)], "ord bigint, entity bigint")
    got = rows(form.trailing_mean(field, measured, "entity", "position", 3, "m", plan), "ord", "m")
    assert got == [(1, None), (4, 3.0), (6, 4.0)]


def test_trend_needs_three_events_and_is_zero_when_flat(spark, plan):
    data = [(1, o, f, False) for o, f in ((1, 8), (2, 6), (3, 4), (4, 2))] + [(2, o, 5, False) for o in (1, 2, 3)]
    h = spark.createDataFrame(data, "grp bigint, ord bigint, finish bigint, retired boolean")
    got = rows(form.trailing_trend(h, "grp", plan), "grp", "ord", "trend")
    assert got == [(1, 1, None), (1, 2, None), (1, 3, -2.0), (1, 4, -2.0), (2, 1, None), (2, 2, None), (2, 3, 0.0)]


def test_groups_without_a_key_are_left_out(spark, plan):
    df = spark.createDataFrame([(1, 1, None, 3.0), (1, 2, None, 5.0), (1, 3, 7, 1.0), (1, 4, 7, 2.0)], "event bigint, entity bigint, grp bigint, x double")
    assert rows(form.peer_means(df, ["event", "grp"], "x", plan), "entity", "mate_mean") == [(3, 2.0), (4, 1.0)]


def test_mate_gap_is_to_the_best_other(spark, plan):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 2, 12.0), (1, 3, 11.0), (1, 4, None), (2, 5, 9.0)], "g bigint, m bigint, v double")
    got = rows(peers.gap_to_best_peer(df, ["g"], "v", "m", "gap", plan), "m", "gap")
    assert got == [(1, -1.0), (2, 2.0), (3, 1.0), (4, None), (5, None)]


@pytest.mark.parametrize("values", [[1], [1, 2], [5, 5, 5, 9], [3, 1, 2], [1, 2, 3, 100], [None, 4, 6]])
def test_exact_median(spark, plan, values):
    import statistics

    df = spark.createDataFrame([(1, v) for v in values], "g int, v bigint")
    assert peers.exact_median(df, ["g"], "v", plan).first()["median"] == statistics.median(v for v in values if v is not None)


def test_round_to_total_puts_the_residue_on_the_largest(spark, plan):
    df = spark.createDataFrame([(1, i, 1 / 3) for i in range(3)], "g int, m bigint, p double")
    got = [r[0] for r in peers.round_to_total(df, ["g"], "p", "m", F.lit(1.0), "r", plan).orderBy("m").select("r").collect()]
    assert math.isclose(sum(got), 1.0, abs_tol=1e-12) and got == [0.333334, 0.333333, 0.333333]


def test_practice_ignores_short_stints_and_takes_the_softest_run(spark, plan):
    laps = [(1, 1, 1, 1, 100 + i, True, True, "HARD") for i in range(5)] + [(1, 1, 1, 2, 50, True, True, "SOFT")] + \
        [(1, 2, 1, 1, 90, True, True, "SOFT") for _ in range(5)] + [(1, 2, 1, None, 10, True, True, "SOFT"), (1, 2, 1, 9, 5, False, True, "SOFT")]
    df = spark.createDataFrame(laps, "event bigint, entity bigint, session bigint, stint bigint, lap_ms bigint, accurate boolean, green boolean, compound string")
    out = {r["entity"]: r for r in runs.practice_frame(df, plan).collect()}
    assert (out[1]["practice_laps"], out[1]["practice_long_run_laps"], out[1]["practice_compounds"]) == (6, 5, 2)
    assert out[1]["practice_long_run_gap_ms"] == 12.0 and out[2]["practice_long_run_gap_ms"] == 0.0
    assert out[1]["practice_softest_long_run_gap_ms"] is None and out[2]["practice_best_gap_ms"] == 0


def test_dense_totals_carry_through_missed_rounds(spark):
    df = spark.createDataFrame([(2000, 1, 7, 10.0), (2000, 3, 7, 5.0), (2000, 2, 8, 1.0)], "season bigint, round bigint, entity bigint, points double")
    got = rows(dense.dense_cumulative(df, df, "entity", {"total": F.col("points")}), "entity", "round", "total")
    assert got == [(7, 1, 10.0), (7, 2, 10.0), (7, 3, 15.0), (8, 1, 0.0), (8, 2, 1.0), (8, 3, 1.0)]


def test_islands_split_after_more_than_four_idle_years(spark):
    a = spark.createDataFrame([(117, 1959), (117, 1960), (5, 2000), (5, 2004), (None, 1990)], "key bigint, yr bigint")
    b = spark.createDataFrame([(117, 2021), (117, 2022), (6, 2000), (6, 2005)], "key bigint, yr bigint")
    blocks = identity.islands(identity.active_years([a, b], "key", "yr"), "key", "yr")
    assert rows(blocks, "identity") == [("117-1959",), ("117-2021",), ("5-2000",), ("6-2000",), ("6-2005",)]
    inside = spark.createDataFrame([(5, 2002), (117, 1990)], "key bigint, yr bigint")
    assert rows(identity.assign_identity(inside, blocks, "key", "yr"), "key", "identity") == [(117, None), (5, "5-2000")]
    assert rows(identity.island_report(blocks, "key", 2018), "key", "active_blocks", "largest_gap", "affects_modern") == [
        (117, "1959-1960; 2021-2022", 61, True), (6, "2000-2000; 2005-2005", 5, False)]


def test_ids_are_kept_and_minted_in_order(spark):
    existing = spark.createDataFrame([("b", 4), ("z", 9)], "ref string, id bigint")
    refs = spark.createDataFrame([("c",), ("a",), ("b",), ("c",)], "ref string")
    want = [("a", 10, True), ("b", 4, False), ("c", 11, True), ("z", 9, False)]
    assert rows(identity.id_map(existing, refs), "ref", "id", "is_new") == want


def test_rows_are_numbered_in_order_over_all_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), (F.col("id") % 3).alias("w")).repartition(9)
    got = rows(identity.number_rows(df, ["w", "v"], "n", 10), "n", "w", "v")
    assert sorted(r[0] for r in got) == list(range(10, 5010)) and [r[1:] for r in sorted(got)] == sorted(r[1:] for r in got)
    assert identity.number_rows(df.limit(0), ["v"], "n").count() == 0


def table3(spark):
    return spark.createDataFrame([(1, 10, 1.0, "Argentinian "), (1, 11, 2.0, "x"), (2, 10, None, "y")], "raceId int, driverId int, grid double, nat string")


def correction(spark, *rows_):
    return spark.createDataFrame([("t", *r, "why", "official", "register") for r in rows_], CORRECTIONS)


def test_corrections_apply_and_log(spark):
    fixed, log = K.apply(table3(spark), correction(spark, ("1|10", "grid", "1", "5"), ("1|10", "nat", "Argentinian ", "Argentine"),
                                                   ("2|10", "grid", "", "7"), ("1|11", "nat", "*", "\\N")), "t", ["raceId", "driverId"])
    assert rows(fixed) == sorted([(1, 10, 5.0, "Argentine"), (1, 11, 2.0, None), (2, 10, 7.0, "y")], key=repr)
    assert log.count() == 4


@pytest.mark.parametrize("bad, message", [(("1|10", "grid", "9", "5"), "old value differs"), (("1|99", "grid", "1", "5"), "exactly one"),
                                          (("1", "grid", "1", "5"), "parts"), (("1|10", "nope", "", "5"), "unknown column"),
                                          (("1|10", "nat", "Argentinian", "A"), "old value differs")])
def test_corrections_refuse(spark, bad, message):
    with pytest.raises(ValueError, match=message):
        K.apply(table3(spark), correction(spark, bad), "t", ["raceId", "driverId"])


def test_corrections_need_evidence(spark):
    c = correction(spark, ("1|10", "grid", "1", "5")).withColumn("evidence_source", F.lit(" "))
    with pytest.raises(ValueError, match="no evidence"):
        K.apply(table3(spark), c, "t", ["raceId", "driverId"])


def test_diff_numbers_text_and_null(spark):
    a = spark.createDataFrame([(1, "25", "x ", None), (2, "3", "y", "q"), (3, "1", "z", "r")], "k int, n string, t string, u string")
    b = spark.createDataFrame([(1, "25.0", "x", None), (2, "4", "y", None), (4, "1", "z", "r")], "k int, n string, t string, u string")
    got = rows(diff.diff_summary(a, b, ["k"], ["n", "t", "u"]), "column", "conflicts", "matched", "only_left", "only_right")
    assert got == [("n", 1, 2, 1, 1), ("t", 0, 2, 1, 1), ("u", 1, 2, 1, 1)]
    assert rows(diff.diff_cells(a, b, ["k"], ["n", "t", "u"])) == [(2, "n", "3", "4"), (2, "u", "q", None)]


def test_fingerprints_ignore_order_and_see_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    same, other = a.orderBy(F.desc("a")), a.withColumn("b", F.upper("b"))

    def of(df, name):
        return diff.fingerprint(df, ["a", "b"]).withColumn("table", F.lit(name))

    old = of(a, "t").unionByName(of(a, "u")).unionByName(of(a, "gone"))
    new = of(same, "t").unionByName(of(other, "u")).unionByName(of(a, "new"))
    assert rows(diff.verify_fingerprints(old, new)) == [("gone", "missing"), ("new", "added"), ("t", "same"), ("u", "changed")]


def test_checks_report_skips_and_fail_loudly(spark):
    df = spark.createDataFrame([(1, 1), (1, 3), (2, 1), (2, 2)], "g int, v int")
    report = C.run_checks(spark, [C.Check("A", "dense", C.not_dense(df, ["g"], "v")), C.Check("A", "unique", C.not_unique(df, ["g", "v"])),
                                  C.Check("B", "history", None, "one season only")])
    assert rows(report, "name", "status", "detail") == [("dense", "FAIL", ""), ("history", "SKIP", "one season only"), ("unique", "PASS", "")]
    with pytest.raises(ValueError, match="dense"):
        C.require(report)


def test_unknown_stays_apart_from_false(spark):
    df = spark.createDataFrame([(1, True, False, False), (2, True, True, False), (3, True, False, True), (4, None, False, False)],
                               "id int, beyond boolean, early boolean, suspect boolean")
    out = df.withColumns(flags.completed_lap(F.col("beyond"), F.col("early"), F.col("suspect")))
    assert rows(out, "id", "counts_as_completed", "completed_reason") == [
        (1, False, "flagged mid lap"), (2, False, "declared early"), (3, None, "attribution suspect"), (4, True, None)]
    assert C.flag_mismatch(out, "counts_as_completed", F.col("suspect"), "completed_reason",
                           ["flagged mid lap", "declared early", "attribution suspect"]).count() == 0


def test_range_lookup(spark):
    eras = spark.createDataFrame([(1950, 1959, "a"), (1960, None, "b")], "f bigint, l bigint, era string")
    df = spark.createDataFrame([(1950,), (1959,), (1960,), (2024,), (1900,)], "season bigint")
    want = sorted([(1950, "a"), (1959, "a"), (1960, "b"), (2024, "b"), (1900, None)], key=repr)
    assert rows(lookup.range_lookup(df, eras, "season", "f", "l", ["era"]), "season", "era") == want
    whole = spark.createDataFrame([(v / 4,) for v in range(-8, 120)] + [(None,), (1e12,), (-1e12,)], "v double")
    spans = [(0.5, 2.25, "p"), (2.0, 9.0, "q"), (20.0, None, "r"), (4.0, 4.0, "s"), (8.0, 7.0, "never"), (None, 3.0, "no start")]
    held = spark.createDataFrame(spans, "f double, l double, name string")
    want = [(v, n) for (v,) in whole.collect() for n in ([n for f, l, n in spans if f is not None and v is not None and f <= v and (l is None or v <= l)] or [None])]
    assert rows(lookup.range_lookup(whole, held, "v", "f", "l", ["name"]), "v", "name") == sorted(want, key=repr)
    assert lookup.range_lookup(df, eras.limit(0), "season", "f", "l", ["era"]).where("era IS NULL").count() == 5


def test_group_totals_are_the_same_however_large_the_groups(spark, plan):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (None, 1, 4.0), (None, 1, 5.0), (None, None, 6.0)], "a int, b int, x double")
    small = peers.with_totals(df, ["a", "b"], plan, s=F.sum("x"), n=F.count("*"))

    class Cut:
        cuts = True

    large = peers.with_totals(df, ["a", "b"], lambda *a: Cut, s=F.sum("x"), n=F.count("*"))
    assert rows(small) == rows(large) == sorted([(1, 1, 2.0, 5.0, 2), (1, 1, 3.0, 5.0, 2), (None, 1, 4.0, 9.0, 2), (None, 1, 5.0, 9.0, 2), (None, None, 6.0, 6.0, 1)], key=repr)


def test_a_new_value_must_fit_its_column(spark):
    bad = correction(spark, ("1|10", "grid", "1", "abc"), ("1|11", "grid", "2", "\\N"), ("2|10", "nat", "y", "abc"))
    assert rows(K.violations(table3(spark), bad, "t", ["raceId", "driverId"]), "primary_key", "problem") == [("1|10", "new value does not fit the column")]
    with pytest.raises(ValueError, match="does not fit"):
        K.apply(table3(spark), bad, "t", ["raceId", "driverId"])


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    assert rows(profile.column_profile(df, "t"), "column", "nulls", "all_null") == [("a", 1, False), ("b", 2, True)]


@pytest.mark.parametrize("accuracy", [2000, 20, 3])
def test_quantiles_are_exact_in_every_group(spark, plan, accuracy):
    import numpy as np

    rng = np.random.default_rng(4)
    values = {"hot": rng.lognormal(0, 3, 3000), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), None: rng.normal(size=99)}
    data = [(k, float(x)) for k, v in values.items() for x in v] + [("none", None), ("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r.k, r.q): r.x for r in peers.exact_quantiles(df, ["k"], "v", qs, plan, "x", accuracy).collect()}
    assert got.keys() == {(k, q) for k in values for q in qs}
    for (k, q), x in got.items():
        assert x == pytest.approx(np.quantile(values[k], q), rel=1e-12, abs=1e-12)
    assert peers.exact_quantiles(df.where("false"), ["k"], "v", qs, plan).count() == 0


def version(spark, data):
    return spark.createDataFrame(data, "k long, a string, b double")


def test_changed_keys_equal_a_full_comparison(spark, monkeypatch):
    import random

    draw = random.Random(5)
    old = {k: (f"v{k % 9}", k / 7) for k in draw.sample(range(-5000, 60_000), 900)}
    new = dict(old)
    for k in draw.sample(sorted(old), 40):
        new[k] = ("other", new[k][1])
    for k in draw.sample(sorted(old), 30):
        new.pop(k)
    new |= {k: ("new", 0.0) for k in (-9000, 70_000, 70_001)}
    want = {k: "added" if k not in old else "missing" if k not in new else "changed" for k in {*old, *new} if old.get(k) != new.get(k)}
    frames = [version(spark, [(k, *v) for k, v in d.items()]) for d in (old, new)]
    for ranges in (64, 3, 10_000):
        monkeypatch.setattr(diff, "_RANGES", ranges)
        assert {r.k: r.state for r in diff.changed_keys(*frames, "k", ["a", "b"]).collect()} == want
    assert diff.changed_keys(frames[0], frames[0], "k", ["a", "b"]).count() == 0


def test_a_row_that_only_changed_its_key_is_found(spark):
    old, new = version(spark, [(1, "x", 1.0), (2, "y", 2.0)]), version(spark, [(900_000, "x", 1.0), (2, "y", 2.0)])
    assert {r.k: r.state for r in diff.changed_keys(old, new, "k", ["a", "b"]).collect()} == {1: "missing", 900_000: "added"}
    swapped = version(spark, [(2, "x", 1.0), (1, "y", 2.0)])
    assert {r.k: r.state for r in diff.changed_keys(old, swapped, "k", ["a", "b"]).collect()} == {1: "changed", 2: "changed"}


def test_changed_keys_of_null_repeated_and_no_rows(spark):
    old = version(spark, [(None, "x", 1.0), (1, "x", 1.0), (1, "x", 1.0), (2, None, None)])
    new = version(spark, [(None, "y", 1.0), (1, "x", 1.0), (2, None, None)])
    assert {r.k: r.state for r in diff.changed_keys(old, new, "k", ["a", "b"]).collect()} == {None: "changed", 1: "changed"}
    empty = version(spark, [])
    assert {r.k: r.state for r in diff.changed_keys(empty, new, "k", ["a", "b"]).collect()} == {None: "added", 1: "added", 2: "added"}
    assert diff.changed_keys(empty, empty, "k", ["a", "b"]).count() == 0


def test_only_ranges_that_differ_are_read(spark, tmp_path):
    rows = spark.range(100_000).select(F.col("id").alias("k"), F.lit("x").alias("a"), F.col("id").cast("double").alias("b"))
    rows.write.parquet(str(tmp_path / "old"))
    rows.withColumn("a", F.when(F.col("k") == 77_777, "y").otherwise(F.col("a"))).write.parquet(str(tmp_path / "new"))
    found = diff.changed_keys(*[spark.read.parquet(str(tmp_path / n)) for n in ("old", "new")], "k", ["a", "b"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(k,77" in plan
    assert [tuple(r) for r in found.collect()] == [(77_777, "changed")]


def test_tree_adds_up(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("a"))
    tree = diff.digest_tree(df, "k", ["k", "a"], 0, 4, 2).collect()
    totals = {level: (sum(r.rows for r in tree if r.level == level), sum(r.digest for r in tree if r.level == level)) for level in range(3)}
    assert totals[0] == totals[1] == totals[2] and totals[0][0] == 1000


def test_row_checks_of_a_table_share_one_scan(spark, tmp_path):
    spark.createDataFrame([(1, 5, None), (1, -1, 2), (2, 3, 3)], "g int, v int, w int").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    checks = [C.RowCheck("a", "v is positive", t, F.col("v") <= 0), C.RowCheck("a", "w is known", t, F.col("w").isNull()), C.RowCheck("a", "w is small", t, F.col("w") > 9)]
    report = C.run_checks(spark, checks)
    assert report._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert {r["name"]: (r["status"], r["violations"]) for r in report.collect()} == {"v is positive": ("FAIL", 1), "w is known": ("FAIL", 1), "w is small": ("PASS", 0)}
    both = C.run_checks(spark, [C.RowCheck("b", "pairs", t, F.count("*") != 2, ("g",)), C.RowCheck("b", "sum", t, F.sum("v") > 3, ("g",)), *checks])
    assert {r["name"]: r["violations"] for r in both.collect()} == {"pairs": 1, "sum": 1, "v is positive": 1, "w is known": 1, "w is small": 0}


def test_a_failed_guard_leaves_nothing_published(spark, tmp_path):
    from cutline.plans import record

    path, df = str(tmp_path / "p"), spark.createDataFrame([(1, 0.5), (2, None)], "id int, p double")
    assert record.published(spark, path, df.schema).count() == 0
    with pytest.raises(ValueError, match=r"chance is missing \(1 rows\)"):
        record.publish(df, path, "one", {"chance is missing": F.col("p").isNull(), "above one": F.col("p") > 1})
    assert record.published(spark, path, df.schema).count() == 0
    assert record.publish(df, path, "one", {"above one": F.col("p") > 1}) == 2
    assert record.publish(df.where("id = 1"), path, "two", {}) == 1
    with pytest.raises(ValueError, match="published already"):
        record.publish(df, path, "one", {})
    assert rows(record.published(spark, path, df.schema).groupBy("batch").count()) == [("one", 2), ("two", 1)]
