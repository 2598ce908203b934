"""Derived flags that keep unknown apart from false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def completed_lap(beyond: Column, declared_early: Column, suspect: Column) -> dict[str, Column]:
    """Whether a timed lap counts, and why not. A lap of doubtful attribution is
    unknown, whatever else holds."""
    past = F.coalesce(beyond, F.lit(False))
    counts = F.when(suspect, F.lit(None).cast("boolean")).when(past, False).otherwise(True)
    reason = F.when(suspect, "attribution suspect").when(past & declared_early, "declared early").when(past, "flagged mid lap")
    return {"counts_as_completed": counts, "completed_reason": reason}


def lap_count_suspect(results: DataFrame, laps: DataFrame) -> DataFrame:
    """True where the classified laps differ from the laps recorded; unknown where none are."""
    recorded = laps.groupBy("event", "entity").agg(F.count("*").alias("_recorded"))
    return results.join(recorded, ["event", "entity"], "left").withColumn(
        "lap_data_suspect", F.col("laps") != F.col("_recorded")).drop("_recorded")


def fill_flag(df: DataFrame, facts: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Fill an unknown flag from a table of facts; a known one is kept."""
    known = facts.groupBy(*keys).agg(F.bool_or(flag).alias("_fact"))
    return df.join(known, keys, "left").withColumn(flag, F.coalesce(flag, "_fact")).drop("_fact")


def hold_to_convention(df: DataFrame, columns: list[str], off: Column) -> DataFrame:
    """Clear columns on rows that break a source's convention for them."""
    return df.select(*[F.when(F.coalesce(off, F.lit(False)), None).otherwise(F.col(c)).alias(c) if c in columns else c
                       for c in df.columns])


def override(df: DataFrame, overrides: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """A copy of a column in which documented exceptions replace the value."""
    chosen = overrides.select(*keys, F.struct(F.col("value").alias("v")).alias("_o"))
    return df.join(chosen, keys, "left").withColumn(
        name, F.when(F.col("_o").isNotNull(), F.col("_o.v")).otherwise(F.col(column))).drop("_o")
