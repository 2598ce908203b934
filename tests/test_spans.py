"""Windows over a key that holds most rows equal the plain windows."""

import random

from pyspark.sql import Window, functions as F

from helpers import rows
from cutline.operators.spans import LIMIT_KEY, Right, Spans, expanding, latest_before, numbered, plan_spans, trailing


def hot(spark, n=600, seed=3):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        key = None if i % 50 == 0 else (1 if rng.random() < 0.7 else rng.randrange(2, 6))
        data.append((i, key, rng.randrange(200), None if rng.random() < 0.2 else rng.randrange(50)))
    return spark.createDataFrame(data, "id bigint, key bigint, ord bigint, x bigint")


def test_large_keys_are_cut_and_small_ones_are_not(spark):
    df = hot(spark)
    spans = plan_spans(df, ["key"], "ord", limit=40)
    keys = {r["key"] for r in spans.cuts.collect()}
    assert 1 in keys and None not in keys
    assert plan_spans(df, ["key"], "ord", rows=600, limit=1000).cuts is None
    largest = spans.tag(df.where("key IS NOT NULL")).groupBy("key", "_span").count().agg(F.max("count")).first()[0]
    assert largest < 200


def test_expanding(spark):
    df = hot(spark)
    aggregates = {"s": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("x"))}
    for inclusive in (False, True):
        plain = expanding(df, Spans(("key",), "ord"), aggregates, inclusive)
        split = expanding(df, plan_spans(df, ["key"], "ord", limit=40), aggregates, inclusive)
        assert rows(plain) == rows(split)


def test_trailing_and_numbered(spark):
    df = hot(spark)

    def columns(w):
        return {"s": F.sum("x").over(w.rowsBetween(-6, 0)), "before": F.lag("id", 2).over(w)}

    plain = trailing(df, Spans(("key",), "ord"), 7, columns, ["id"])
    split = trailing(df, plan_spans(df, ["key"], "ord", limit=25), 7, columns, ["id"])
    assert rows(plain) == rows(split, *plain.columns)
    for kind in ("row_number", "rank"):
        a = numbered(df, Spans(("key",), "ord"), "n", [F.col("id")], kind)
        b = numbered(df, plan_spans(df, ["key"], "ord", limit=25), "n", [F.col("id")], kind)
        assert rows(a) == rows(b, *a.columns)


def test_as_of_keeps_a_null_payload_and_excludes_equal_order(spark):
    left = spark.createDataFrame([(1, 5), (1, 6), (2, 1)], "key bigint, ord bigint")
    right = spark.createDataFrame([(1, 3, 7), (1, 5, None)], "key bigint, ord bigint, v bigint")
    strict = latest_before(left, [Right(right, ("v",))], Spans(("key",), "ord"))
    assert rows(strict, "key", "ord", "v") == sorted([(1, 5, 7), (1, 6, None), (2, 1, None)], key=repr)
    loose = latest_before(left, [Right(right, ("v",))], Spans(("key",), "ord"), strict=False)
    assert (1, 5, None) in rows(loose, "key", "ord", "v")


def test_as_of_split_equals_brute_force(spark):
    df = hot(spark)
    left, right = df.where("id % 3 = 0").select("id", "key", "ord"), df.where("id % 3 <> 0").select("key", "ord", "x", "id")
    got = latest_before(left, [Right(right, ("x",), ("id",))], plan_spans(right, ["key"], "ord", limit=25))
    have = [tuple(r) for r in right.collect()]
    want = []
    for r in left.collect():
        earlier = [h for h in have if h[0] == r["key"] and h[0] is not None and h[1] < r["ord"]]
        want.append((r["id"], max(earlier, key=lambda h: (h[1], h[3]))[2] if earlier else None))
    assert rows(got, "id", "x") == sorted(want, key=repr)


def test_plain_plan_has_one_shuffle(spark, capsys):
    df = hot(spark).where("key IS NOT NULL")
    spans = plan_spans(df, ["key"], "ord", rows=600)
    out = expanding(df, spans, {"s": ("sum", F.col("x"))}).withColumn(
        "m", F.avg("x").over(Window.partitionBy("key").orderBy("ord").rowsBetween(-2, 0)))
    out.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


def test_even_source_keys_are_not_computed(spark, tmp_path):
    """A frame grouped by an event is not computed to find its large groups where the source table has none; one whose source has
    them, or that is grouped by something else, is."""
    from cutline.sources.star import Star

    even = [(i // 4, i % 7, 1.0) for i in range(400)]
    for name, rows in (("even", even), ("uneven", even + [(5000, i, 1.0) for i in range(400)])):
        spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
    before = spark.conf.get(LIMIT_KEY, None)
    spark.conf.set(LIMIT_KEY, "100")
    try:
        star = Star(spark, f"{tmp_path}/even")
        never = spark.range(500).select(F.raise_error(F.lit("computed")).cast("long").alias("event"), F.col("id").alias("season"), F.col("id").alias("ord"))
        plan = star.planner()
        assert star.spans(never, ["event"], "ord").cuts is None and not plan.looks(never, ["season", "event"])
        assert plan.looks(never, ["season"])
        big = Star(spark, f"{tmp_path}/uneven")
        rows = big.table("lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("ord"))
        assert big.planner().looks(rows, ["event"])
        assert [r["event"] for r in big.spans(rows, ["event"], "ord").cuts.collect()] == [5000]
    finally:
        spark.conf.unset(LIMIT_KEY) if before is None else spark.conf.set(LIMIT_KEY, before)


def test_counts_are_kept_where_the_plan_looks_at_them(spark, tmp_path):
    """A median's counts are written once where its plan computes them to find large groups; lines are exchanged before they become laps."""
    from cutline.operators import peers
    from cutline.sources.star import Star

    lines = [(i // 4, i % 7, i, 1, float(i % 9), float(i), "F") for i in range(400)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get(LIMIT_KEY, None)
    spark.conf.set(LIMIT_KEY, "360")
    try:
        star = Star(spark, str(tmp_path))
        laps = star.laps()
        tree = laps._jdf.queryExecution().optimizedPlan().toString()
        assert 0 <= tree.index("Generate") < tree.index("RepartitionByExpression")
        kept = peers.exact_median(laps, ["compound"], "lap_ms", star.planner(times=9))
        assert any("median-counts" in f for f in kept.inputFiles())
        want = laps.groupBy("compound").agg(F.percentile("lap_ms", 0.5).alias("median"))
        assert rows(kept) == rows(want)
        flagged = peers.ratio_flag(laps, ["event"], "lap_ms", 3.0, "slow", star.planner(times=9), "m")
        assert not any("median-counts" in f for f in flagged.inputFiles()) and "m" in flagged.columns
    finally:
        spark.conf.unset(LIMIT_KEY) if before is None else spark.conf.set(LIMIT_KEY, before)
