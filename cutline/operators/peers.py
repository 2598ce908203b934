"""Comparisons inside one event: gaps, ranks, ratios, rescaling, pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cutline.operators.spans import Spans, expanding, numbered
from cutline.session import stored


def looked_at(df: DataFrame, keys: Sequence[str], plan, name: str) -> DataFrame:
    """The frame, written once if the plan has to compute it to find its large groups, so that this is not done twice."""
    looks = getattr(plan, "looks", None)
    return stored(df, name) if looks is not None and looks(df, list(keys)) else df


def with_totals(df: DataFrame, keys: Sequence[str], plan, **aggregates: Column) -> DataFrame:
    """Add aggregates of each row's group.

    Where no group is large this is one window pass. A large group is aggregated map-side and joined back instead, so it
    never lands in a single task. Either way rows with a null key are a group like any other."""
    if plan(df.select(*keys, F.lit(0).alias("_zero")), list(keys), "_zero").cuts is None:
        group = Window.partitionBy(*keys)
        return df.select("*", *[c.over(group).alias(n) for n, c in aggregates.items()])
    names = {k: f"_of_{k}" for k in keys}
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]).withColumnsRenamed(names)
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(names[k])), keys, F.lit(True))
    return df.join(totals, same, "left").drop(*names.values())


def gaps_to_best(df: DataFrame, keys: Sequence[str], gaps: dict[str, str], plan) -> DataFrame:
    """Distance of each value column to the group's smallest; null where the value is null.
    `gaps` maps a value column to the name of its gap."""
    least = {f"_least_{v}": F.min(v) for v in gaps}
    sized = with_totals(df, keys, plan, **least)
    return sized.select(*df.columns, *[(F.col(v) - F.col(f"_least_{v}")).alias(n) for v, n in gaps.items()])


def gap_to_best_peer(df: DataFrame, keys: Sequence[str], value: str, member: str, name: str, plan) -> DataFrame:
    """Distance to the best value among the other members of the group; null where the value
    or a key is null, or nobody else has a value.

    The best other is the group's smallest value, or the second smallest for whoever holds it,
    so members are ranked and never paired."""
    group = [*keys, "_timed"]
    known = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.col(value).isNotNull())
    marked = df.withColumn("_timed", known)
    ranked = numbered(marked, plan(marked, group, value), "_rank", ties=[F.col(member)])
    sized = with_totals(ranked, group, plan, _first=F.min(F.when(F.col("_rank") == 1, F.col(value))),
                        _second=F.min(F.when(F.col("_rank") == 2, F.col(value))))
    other = F.when(F.col("_rank") == 1, F.col("_second")).otherwise(F.col("_first"))
    return sized.select(*df.columns, F.when(F.col("_timed"), F.col(value) - other).alias(name))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, plan, name: str = "median",
                 weight: Column | None = None, rows: str | None = None) -> DataFrame:
    """Exact median per group: the mean of the middle two values. A row may stand for `weight` equal ones. `rows` names a column
    for how many values the group has.

    Values are counted per group before any ordering, then a running count finds
    the middle. `percentile` would hold a large group's values in one buffer."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        (F.count("*") if weight is None else F.sum(weight)).alias("_c"))
    counts = looked_at(counts, keys, plan, "median-counts")
    running = expanding(counts, plan(counts, list(keys), "_v"), {"_before": ("sum", F.col("_c"))}, order_by=[])
    sized = with_totals(running, keys, plan, _n=F.sum("_c"))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)

    def holds(rank: Column) -> Column:
        return (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c"))

    return sized.where(holds(low) | holds(high)).groupBy(*keys).agg(
        ((F.min("_v") + F.max("_v")) / 2.0).alias(name), *([] if rows is None else [F.max("_n").alias(rows)]))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], plan, name: str = "quantile",
                    accuracy: int = 2000) -> DataFrame:
    """(keys, q, name): several exact quantiles of each group, interpolated between neighbours; nulls and NaN are left out.

    A sketch of fixed size per group says between which two values each quantile lies. One more visit counts what is below these
    and, by distinct value, what is between them: about 4 / `accuracy` of a group for each quantile, spread by value, so that no group
    is sorted or gathered. Where the sketch was wrong the interval is the whole group."""
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    margin = 2.0 / accuracy
    edges = [max(0.0, min(1.0, q + side * margin)) for q in quantiles for side in (-1, 1)]
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("_v", edges, accuracy).alias("_e"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
    asked = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.get("_e", F.lit(2 * i)).alias("lo"), F.get("_e", F.lit(2 * i + 1)).alias("hi"),
                                         F.floor(F.lit(float(q)) * (F.col("_n") - 1)).alias("first")) for i, q in enumerate(quantiles)])).alias("_a")
    wanted = stored(sketch.select(*keys, "_low", "_high", "_n", asked).select(*keys, "_low", "_high", "_n", "_a.*"), "quantile-brackets")
    found = _between(rows, wanted, keys, plan)
    missing = wanted.join(found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("q").alias("_q")),
                          reduce(lambda a, ik: a & F.col(ik[1]).eqNullSafe(F.col(f"_k{ik[0]}")), enumerate(keys), F.col("q") == F.col("_q")), "left_anti")
    missing = stored(missing.withColumns({"lo": F.col("_low"), "hi": F.col("_high")}), "quantiles-missing")
    if not missing.isEmpty():
        found = found.unionByName(_between(rows, missing, keys, plan))
    return found.withColumnRenamed("_value", name)


def _between(rows: DataFrame, wanted: DataFrame, keys: list[str], plan) -> DataFrame:
    """The quantiles whose two neighbours lie inside their intervals."""
    listed = wanted.groupBy(*keys).agg(F.collect_list(F.struct("q", "lo", "hi")).alias("_l")).withColumnsRenamed({k: f"_of_{k}" for k in keys})  # one entry a quantile
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_of_{k}")), keys, F.lit(True))
    hits = F.filter("_l", lambda x: F.col("_v") <= x["hi"])
    counted = (rows.join(listed, same).select(*keys, "_v", F.explode(hits).alias("_x"))
               .groupBy(*keys, F.col("_x.q").alias("q"), F.when(F.col("_v") >= F.col("_x.lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c")))
    group = [*keys, "q"]
    # What is below an interval has no value and comes first.
    placed = looked_at(counted.withColumn("_order", F.coalesce("_v", F.lit(float("-inf")))), group, plan, "quantile-counts")
    running = expanding(placed, plan(placed, group, "_order"), {"_before": ("sum", F.col("_c"))}, order_by=[])
    of = wanted.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("q").alias("_q"), "first", "_n")
    matched = running.join(of, same & (F.col("q") == F.col("_q")))
    next_ = F.least(F.col("first") + 1, F.col("_n") - 1)
    before = F.coalesce("_before", F.lit(0))

    def at(rank: Column) -> Column:
        return F.max(F.when((before <= rank) & (rank < before + F.col("_c")), F.col("_v")))

    both = matched.groupBy(*keys, "q").agg(at(F.col("first")).alias("_a"), at(next_).alias("_b"), F.first("_n").alias("_n"), F.first("first").alias("first"))
    share = F.col("q") * (F.col("_n") - 1) - F.col("first")
    return both.where("_a IS NOT NULL AND _b IS NOT NULL").select(*keys, "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * share).alias("_value"))


def ratio_flag(df: DataFrame, keys: Sequence[str], value: str, ratio: float, name: str, plan, median: str | None = None) -> DataFrame:
    """True where a value is at least `ratio` times its group's median, which is kept as `median` if asked."""
    medians = exact_median(df, keys, value, plan, "_median")
    flagged = df.join(medians, list(keys), "left").withColumn(name, F.coalesce(F.col(value) >= ratio * F.col("_median"), F.lit(False)))
    return flagged.drop("_median") if median is None else flagged.withColumnRenamed("_median", median)


def running_number(df: DataFrame, spans: Spans, condition: Column, name: str, ties: Sequence[Column]) -> DataFrame:
    """Number only the rows that meet a condition, 1, 2, ... in order; null elsewhere."""
    counted = expanding(df, spans, {"_seen": ("sum", condition.cast("bigint"))}, inclusive=True, order_by=ties)
    return counted.withColumn(name, F.when(condition, F.col("_seen"))).drop("_seen")


def rescale(df: DataFrame, keys: Sequence[str], p: str, places: int, name: str, plan,
            low: float = 1e-6, high: float = 1 - 1e-6) -> DataFrame:
    """Scale a group's chances to fill min(places, n) places, then clip."""
    sized = with_totals(df, keys, plan, _sum=F.sum(p), _n=F.count("*"))
    filled = F.coalesce(F.try_divide(F.col(p) * F.least(F.lit(places), F.col("_n")), F.col("_sum")), F.lit(0.0))
    return sized.withColumn(name, F.least(F.greatest(filled, F.lit(low)), F.lit(high))).drop("_sum", "_n")


def normalise(df: DataFrame, keys: Sequence[str], p: str, name: str, plan, floor: float = 1e-9) -> DataFrame:
    """Floor and divide by the group's sum."""
    held = F.greatest(F.col(p), F.lit(floor))
    return with_totals(df.withColumn("_held", held), keys, plan, _sum=F.sum("_held")).withColumn(
        name, F.coalesce(F.try_divide("_held", "_sum"), F.lit(0.0))).drop("_held", "_sum")


def round_to_total(df: DataFrame, keys: Sequence[str], p: str, member: str, total: Column, name: str, plan,
                   places: int = 6) -> DataFrame:
    """Round a group's values and put what rounding lost on its largest one."""
    rounded = df.withColumn("_r", F.round(F.col(p), places))
    sized = with_totals(rounded, keys, plan, _sum=F.sum("_r"), _top=F.max_by(
        F.col(member), F.struct(F.col("_r"), -F.col(member))))
    lost = F.round(total - F.col("_sum"), places)
    return sized.withColumn(
        name, F.round(F.col("_r") + F.when(F.col(member) == F.col("_top"), lost).otherwise(0.0), places)
    ).drop("_r", "_sum", "_top")


def pairs_of_two(df: DataFrame, keys: Sequence[str], member: str, values: Sequence[str]) -> DataFrame:
    """The two members of each group that has exactly two, lower member first.

    One aggregate per group: no self-join, so a large group costs nothing."""
    row = F.struct(member, *values)
    sides = df.where(reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min(row).alias("_a"), F.max(row).alias("_b")).where("_n = 2")
    return sides.select(*keys, *[F.col(f"_{s}")[c].alias(f"{c}_{s}") for c in (member, *values) for s in ("a", "b")])
