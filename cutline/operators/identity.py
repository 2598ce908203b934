"""Identities over time, and integer ids for references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cutline.operators.spans import expanding
from cutline.session import stored


def active_years(sources: Sequence[DataFrame], key: str, year: str) -> DataFrame:
    """Distinct (key, year) pooled over tables: every table must agree on where breaks fall."""
    pooled = None
    for s in sources:
        rows = s.where(F.col(key).isNotNull() & F.col(year).isNotNull()).select(key, year).distinct()
        pooled = rows if pooled is None else pooled.unionByName(rows)
    return pooled.distinct()


def islands(years: DataFrame, key: str, year: str, gap: int = 4) -> DataFrame:
    """Blocks of activity per key. More than `gap` idle years start a new identity,
    named `key-firstYear`. A key has at most one row per year here, so its window is small."""
    w = Window.partitionBy(key).orderBy(year)
    starts = years.withColumn("_start", F.coalesce((F.col(year) - F.lag(year).over(w) > gap).cast("int"), F.lit(1)))
    numbered = starts.withColumn("_block", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_block").agg(
        F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count("*").alias("active_years"),
    ).select(key, F.concat_ws("-", F.col(key).cast("string"), F.col("first_year").cast("string")).alias("identity"),
             "first_year", "last_year", "active_years")


def assign_identity(df: DataFrame, blocks: DataFrame, key: str, year: str) -> DataFrame:
    """The identity covering each row's year, idle years inside a block included.

    Blocks are unrolled to the years they cover, so this is an equality join."""
    covered = blocks.select(key, "identity", F.explode(F.sequence("first_year", "last_year")).alias(year))
    return df.join(covered, [key, year], "left")


def island_report(blocks: DataFrame, key: str, modern_from: int) -> DataFrame:
    """Keys with more than one block: the blocks as text, the longest gap, and whether a
    block reaches the modern years. The blocks of one key are few."""
    per_key = blocks.groupBy(key).agg(
        F.count("*").alias("n_blocks"), F.array_sort(F.collect_list(F.struct("first_year", "last_year"))).alias("_b"),
        F.max("last_year").alias("_last")).where("n_blocks > 1")
    gaps = F.transform(F.slice("_b", F.lit(2), F.greatest(F.size("_b") - 1, F.lit(0))), lambda b, i: b["first_year"] - F.get("_b", i)["last_year"])
    text = F.transform("_b", lambda b: F.concat_ws("-", b["first_year"].cast("string"), b["last_year"].cast("string")))
    return per_key.select(key, "n_blocks", F.array_join(text, "; ").alias("active_blocks"),
                          F.array_max(gaps).alias("largest_gap"), (F.col("_last") >= modern_from).alias("affects_modern"))


def number_rows(df: DataFrame, order_by: Sequence[str], name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers in a total order.

    The frame is written range-partitioned by the order; each range is numbered by itself and shifted by the rows before it."""
    ranged = stored(df.repartitionByRange(*order_by).withColumn("_range", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").count().select(
        "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order_by))
    return ranged.withColumn("_local", local).join(offsets, "_range").withColumn(
        name, (F.col("_local") + F.col("_offset") + (start - 1)).cast("bigint")).drop("_range", "_local", "_offset")


def id_map(existing: DataFrame, refs: DataFrame, ref: str = "ref", id_: str = "id") -> DataFrame:
    """Keep existing ids; give new references ids in sorted order after the largest."""
    start = (existing.agg(F.max(id_)).first()[0] or 0) + 1
    new = refs.select(ref).where(F.col(ref).isNotNull()).distinct().join(existing, ref, "left_anti")
    minted = number_rows(new, [ref], id_, start)
    return existing.select(ref, F.col(id_).cast("bigint").alias(id_), F.lit(False).alias("is_new")).unionByName(
        minted.select(ref, id_, F.lit(True).alias("is_new")))


def surrogate_keys(df: DataFrame, event: str, order: str, within: Column, name: str, plan, start: int = 1) -> DataFrame:
    """Unique ids that follow (event order, order within the event) without a global sort
    of the rows: events are counted, their counts summed in order, and each row takes its
    event's offset plus its own place. `within` is the row's place in its event, from 1."""
    counts = df.groupBy(event, order).agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0))
    offsets = expanding(counts, plan(counts, ["_all"], order), {"_offset": ("sum", F.col("_n"))})
    return df.join(offsets.select(event, "_offset"), event).withColumn(
        name, (F.col("_offset") + within + (start - 1)).cast("bigint")).drop("_offset")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def preferred_union(sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """Union with widened columns and a source tag; where sources share a key the first listed wins."""
    both = None
    for rank, (name, df) in enumerate(sources):
        tagged = df.withColumn("source", F.lit(name)).withColumn("_rank", F.lit(rank))
        both = tagged if both is None else both.unionByName(tagged, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_rank")
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_rank")


