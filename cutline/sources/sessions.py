"""Timing sessions: raw laps, results, weather and messages to typed tables with ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cutline.functions import scalars as S
from cutline.operators.lookup import group_of, resolve_entities

# The time columns of a lap and of a session result.
LAP_TIMES = ("LapTime", "Sector1Time", "Sector2Time", "Sector3Time", "PitInTime", "PitOutTime", "LapStartTime")
RESULT_TIMES = ("Q1", "Q2", "Q3", "Time")
WEATHER = ("AirTemp", "TrackTemp", "Humidity", "Pressure", "Rainfall", "WindDirection", "WindSpeed")
MESSAGES = ("Time", "Category", "Message", "Status", "Flag", "Scope", "Sector", "Lap")
KEYS = ("season", "event", "session")


def interval_ms(value: Column) -> Column:
    """A day-time interval in milliseconds, half away from zero."""
    value = value.cast("interval day to second")
    return F.round(F.extract(F.lit("SECOND"), value).cast("double") * 1000 + F.extract(F.lit("MINUTE"), value) * 60_000
                   + F.extract(F.lit("HOUR"), value) * 3_600_000 + F.extract(F.lit("DAY"), value) * 86_400_000).cast("bigint")


def _ms_columns(df: DataFrame, times: Sequence[str]) -> list[Column]:
    types = dict(df.dtypes)
    out = []
    for c in df.columns:
        if c in times:
            value = interval_ms(F.col(c)) if types[c].startswith("interval") else F.col(c).cast("bigint")
            out.append(value.alias(f"{c}Ms"))
        else:
            out.append(F.col(c))
    return out


def participants(results: DataFrame, entities: DataFrame, numbers: DataFrame, raced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every (session, number) with its entity, how it was found, and a key of its own where
    there is none; and the table of those that stay unmapped or are in doubt."""
    seen = results.select(*KEYS, F.col("DriverNumber").alias("number"), F.col("DriverId").alias("ref"), F.col("LastName").alias("surname"),
                          F.trim(F.concat_ws(" ", "FirstName", "LastName")).alias("name"), F.col("TeamId").alias("group_ref"))
    found = resolve_entities(seen, entities, numbers, raced, numbers)
    stand_in = S.stand_in_key(F.col("season"), F.col("name"), F.col("event"), F.col("session"), F.col("number"))
    keyed = found.withColumn("stand_in", F.when(F.col("entity").isNull(), stand_in))
    doubts = keyed.where("entity IS NULL OR note IS NOT NULL").select(
        *KEYS, "number", "ref", "name", "group_ref", "stand_in",
        F.when(F.col("entity").isNull(), "practice participant").otherwise("number mismatch").alias("kind"),
        F.coalesce("reason", "note").alias("reason"))
    return keyed, doubts


def laps_table(laps: DataFrame, who: DataFrame) -> DataFrame:
    typed = laps.select(*_ms_columns(laps, LAP_TIMES)).withColumnRenamed("DriverNumber", "number")
    return typed.join(who.select(*KEYS, "number", "entity", "ref", "via", "stand_in", "is_entrant"), [*KEYS, "number"], "left").withColumn(
        "is_entrant", F.coalesce("is_entrant", F.lit(False)))


def results_table(results: DataFrame, who: DataFrame, raced_group: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Session results with entity and group, and the rows whose group stays unknown."""
    keep = [c for c in results.columns if c not in ("DriverId", "FirstName", "LastName", "TeamId")]
    typed = results.select(*keep)
    typed = typed.select(*_ms_columns(typed, RESULT_TIMES)).withColumnRenamed("DriverNumber", "number")
    joined = typed.join(who.select(*KEYS, "number", "entity", "ref", "via", "stand_in", "is_entrant", "group_ref"), [*KEYS, "number"], "left")
    placed = group_of(joined, raced_group, groups)
    gaps = placed.where("grp IS NULL").select(*KEYS, "number", "ref", F.lit("unmapped group").alias("kind"), F.col("group_reason").alias("reason"))
    return placed.drop("group_reason"), gaps


def weather_table(weather: DataFrame) -> DataFrame:
    typed = weather.select(*_ms_columns(weather, ("Time",)))
    return typed.select(*KEYS, F.col("TimeMs").alias("time_ms"), *[c for c in WEATHER if c in typed.columns])


def messages_table(messages: DataFrame) -> DataFrame:
    return messages.select(*KEYS, *[(F.col(c).cast("string") if c == "Time" else F.col(c)).alias(c) for c in MESSAGES if c in messages.columns])


def reviewed_groups(unresolved: DataFrame, official: DataFrame, reviewed: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attach a group to participants without an id: from the official classification where no
    name was given, else from a reviewed map of team names. What neither knows is listed.

    `unresolved`: season, event, session, number, name, team, stand_in. `official`: event,
    session, number, name, group_ref. `reviewed`: team_key, group_ref. `groups`: group_ref, grp."""
    named = official.select("event", "session", "number", F.col("name").alias("_name"), F.col("group_ref").alias("_ref"))
    own_name = F.nullif(F.trim(F.coalesce("name", F.lit(""))), F.lit(""))
    joined = unresolved.join(named, ["event", "session", "number"], "left").withColumn(
        "_official", own_name.isNull() & F.col("_name").isNotNull())
    mapped = joined.withColumn("team_key", S.name_key(F.col("team"))).join(
        reviewed.select("team_key", F.col("group_ref").alias("_mapped")), "team_key", "left")
    ref = F.when(F.col("_official"), F.col("_ref")).otherwise(F.col("_mapped"))
    placed = mapped.withColumn("group_ref", F.coalesce(ref, "_mapped")).join(groups.select("group_ref", "grp"), "group_ref", "left")
    name = F.when(F.col("_official"), F.col("_name")).otherwise(own_name)
    key = F.when(F.col("_official"), S.stand_in_key(F.col("season"), F.col("_name"), F.col("event"), F.col("session"), F.col("number"))).otherwise(F.col("stand_in"))
    source = F.when(F.col("grp").isNull(), "unresolved").when(F.col("_official"), "official classification").otherwise("reviewed map")
    out = placed.select("season", "event", "session", "number", name.alias("name"), "team", key.alias("stand_in"), "grp", source.alias("source"))
    gaps = out.where("grp IS NULL").withColumn("issue", F.when(
        F.coalesce(F.trim("team"), F.lit("")) != "", "team name not in the reviewed map").otherwise("no team given or listed"))
    return out, gaps


def stand_in_identities(appearances: DataFrame, numbers: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per stand-in: where it appeared, and the entity whose number that season and
    surname both match. `numbers`: season, number, entity. `entities`: entity, entity_surname."""
    last = S.name_key(F.element_at(F.split(F.trim("name"), r"\s+"), -1))
    known = numbers.join(entities, "entity").select("season", "number", S.name_key(F.col("entity_surname")).alias("_last"), F.col("entity").alias("_entity"))
    matched = appearances.withColumn("_last", last).join(known, ["season", "number", "_last"], "left")
    return matched.groupBy("stand_in", "season").agg(
        F.max("name").alias("name"), F.array_join(F.array_sort(F.collect_set(F.col("number").cast("string"))), "|").alias("numbers"),
        F.array_join(F.array_sort(F.collect_set(F.col("grp").cast("string"))), "|").alias("groups"), F.min("_entity").alias("entity"),
        F.countDistinct("event", "session").alias("sessions"), F.countDistinct("event").alias("events"))
