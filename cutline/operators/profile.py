"""Profiles of tables: columns, coverage, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def column_profile(df: DataFrame, table: str) -> DataFrame:
    """Type, nulls, their share, and whether all are null, per column: one pass."""
    total = F.count("*")
    per = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), (total - F.count(c)).alias("nulls")) for c, t in df.dtypes])
    return df.agg(total.alias("rows"), per.alias("p")).select("rows", F.explode("p").alias("c")).select(
        F.lit(table).alias("table"), "c.column", "c.type", "rows", "c.nulls",
        F.when(F.col("rows") > 0, F.col("c.nulls") / F.col("rows")).alias("null_share"),
        ((F.col("rows") > 0) & (F.col("c.nulls") == F.col("rows"))).alias("all_null"))


def coverage(df: DataFrame, events: DataFrame, table: str) -> DataFrame:
    """First and last season a table reaches through its events, events covered, and the last one.
    Events are made distinct before the join, so it is one row per event."""
    seen = df.select("event").distinct().join(events.select("event", "season", "ord"), "event")
    return seen.agg(F.min("season").alias("first_season"), F.max("season").alias("last_season"),
                    F.count("*").alias("events_covered"), F.max_by("event", "ord").alias("last_event")).select(
        F.lit(table).alias("table"), "first_season", "last_season", "events_covered", "last_event")


def season_completeness(df: DataFrame, events: DataFrame, table: str) -> DataFrame:
    """Per season: events scheduled, events the table holds."""
    held = df.select("event").distinct().withColumn("_held", F.lit(1))
    return events.join(held, "event", "left").groupBy("season").agg(
        F.count("*").alias("scheduled"), F.count("_held").alias("present")).select(F.lit(table).alias("table"), "season", "scheduled", "present")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("rows"))


def bands(value: Column, edges: Sequence[float]) -> Column:
    """Index of the half-open band [edge, next edge) a value falls in; below the first is null."""
    band = F.lit(None).cast("int")
    for i, edge in enumerate(edges):
        band = F.when(value >= edge, i).otherwise(band)
    return band


def banded_histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(bands(F.col(value), edges).alias("band")).agg(F.count("*").alias("rows"))


def top_labels(df: DataFrame, code: str, label: str, k: int) -> DataFrame:
    """The k commonest labels per code, ties by label."""
    from pyspark.sql import Window

    counts = df.groupBy(code, label).agg(F.count("*").alias("rows"))
    order = Window.partitionBy(code).orderBy(F.col("rows").desc(), label)
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def pivot_sum(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, value: str) -> DataFrame:
    """Long to wide. The values are given, so Spark need not run the query once to find them."""
    return df.groupBy(*keys).pivot(column, list(values)).agg(F.sum(value))
