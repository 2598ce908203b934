"""Joins that attach reference data: ranges, resolution with fallbacks, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cutline.functions import scalars as S

BUCKETS_PER_RANGE = 4


def range_lookup(df: DataFrame, ranges: DataFrame, value: str, low: str, high: str, payload: Sequence[str]) -> DataFrame:
    """Join each row to every range [low, high] that holds its value, whole or not; an open end has a null high.

    The line is cut into equal buckets, about four for each range, and a range has a row for each bucket it touches: an
    equality join on the bucket, checked by the bounds. Values beyond the last bound share one bucket, which open ranges
    touch too."""
    columns = [low, high, *payload]
    held = ranges.select(*columns).where(F.col(low).isNotNull())
    edge = held.agg(F.min(low).cast("double").alias("first"), F.max(F.coalesce(high, low)).cast("double").alias("last"), F.count("*").alias("n")).first()
    first, last = edge["first"] or 0.0, edge["last"] or 0.0
    width = (last - first) / (BUCKETS_PER_RANGE * max(1, edge["n"])) or 1.0
    beyond = int((last - first) / width) + 1

    def bucket(at: Column) -> Column:
        return F.greatest(F.lit(-1), F.least(F.lit(beyond), F.floor((at.cast("double") - first) / width))).cast("bigint")

    end = F.when(F.col(high).isNull(), F.lit(beyond).cast("bigint")).otherwise(bucket(F.col(high)))
    spread = held.where(F.col(high).isNull() | (F.col(high) >= F.col(low))).select(F.explode(F.sequence(bucket(F.col(low)), end)).alias("_bucket"), *columns)
    inside = (F.col("_of") == F.col("_bucket")) & (F.col(value) >= F.col(low)) & (F.col(high).isNull() | (F.col(value) <= F.col(high)))
    return df.withColumn("_of", bucket(F.col(value))).join(spread, inside, "left").drop("_of", "_bucket", low, high)


def match_counts(df: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """Keys whose lookup did not give exactly one row."""
    return df.groupBy(*keys).agg(F.count(payload).alias("matches")).where("matches <> 1")


def key_lookup(df: DataFrame, table: DataFrame, key: Sequence[str], payload: Sequence[str], prefer: Column) -> DataFrame:
    """Attach a payload by key; where a key repeats, the row ordered first by `prefer` is used."""
    chosen = table.groupBy(*key).agg(F.min_by(F.struct(*payload), prefer).alias("_p"))
    return df.join(chosen, list(key), "left").select(*df.columns, *[F.col("_p")[c].alias(c) for c in payload])


def unique_numbers(table: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """(season, number) pairs with how many entities used them, and the entity where it is one."""
    return table.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(
        F.min(entity).alias("_low"), F.max(entity).alias("_high")).select(
        *keys, F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("_by_number"),
        (F.col("_low") != F.col("_high")).alias("_ambiguous"))


def resolve_entities(seen: DataFrame, entities: DataFrame, numbers: DataFrame, raced: DataFrame,
                     numbers_of: DataFrame) -> DataFrame:
    """Resolve participants: by reference, else by a (season, number) only one entity used,
    else reject with a reason. A number unknown for a matched entity, or a surname that
    differs, is noted, not refused.

    `seen`: season, event, ref, number, surname. `entities`: ref, entity, entity_surname.
    `numbers`: season, number, entity. `raced`: event, entity. `numbers_of`: season, entity, number.
    """
    ref = F.nullif(F.trim("ref"), F.lit(""))
    ref = F.when(~F.lower(ref).isin("nan", "none"), ref)
    given = seen.withColumns({"ref": ref, "_given": F.col("number"), "number": S.number(F.col("number").cast("string")).cast("bigint")})
    by_ref = given.join(entities.select("ref", F.col("entity").alias("_by_ref")), "ref", "left")
    both = by_ref.join(unique_numbers(numbers, ["season", "number"], "entity"), ["season", "number"], "left")
    via = F.when(F.col("_by_ref").isNotNull(), "ref").when(F.col("_by_number").isNotNull(), "number")
    reason = (
        F.when(via.isNotNull(), None)
        .when(F.col("ref").isNotNull(), "reference unknown and number did not resolve it")
        .when(F.col("_ambiguous"), "no reference and several entities used the number")
        .otherwise("no reference and number unknown")
    )
    resolved = both.withColumn("entity", F.coalesce("_by_ref", "_by_number")).withColumn("via", via).withColumn("reason", reason)
    known = numbers_of.where("number IS NOT NULL").select("season", "entity", "number").distinct()
    own = known.withColumn("_own", F.lit(True))
    any_number = known.groupBy("season", "entity").agg(F.lit(True).alias("_any"))
    names = entities.select("entity", "entity_surname")
    out = (
        resolved.join(own, ["season", "entity", "number"], "left").join(any_number, ["season", "entity"], "left")
        .join(names, "entity", "left")
        .join(raced.select("event", "entity").distinct().withColumn("_raced", F.lit(True)), ["event", "entity"], "left")
    )
    number_note = F.when((F.col("via") == "ref") & F.col("number").isNotNull() & F.col("_any") & F.col("_own").isNull(),
                         "number not recorded for the entity that season")
    surname_note = F.when(F.col("entity").isNotNull() & F.col("surname").isNotNull() & (F.trim("surname") != "")
                          & (S.name_key(F.col("surname")) != S.name_key(F.col("entity_surname"))), "surname differs")
    shown = [F.col("_given").alias("number") if c == "number" else F.col(c) for c in seen.columns]
    return out.select(*shown, "entity", "via", "reason", F.coalesce("_raced", F.lit(False)).alias("is_entrant"),
                      F.nullif(F.concat_ws("; ", number_note, surname_note), F.lit("")).alias("note"))


def group_of(resolved: DataFrame, raced_group: DataFrame, groups: DataFrame) -> DataFrame:
    """The group an entity raced for in the event; else the one its reference names; else a reason."""
    own = resolved.join(raced_group.select("event", "entity", F.col("grp").alias("_own")), ["event", "entity"], "left")
    ref = F.nullif(F.trim("group_ref"), F.lit(""))
    named = own.withColumn("group_ref", ref).join(groups.select("group_ref", F.col("grp").alias("_named")), "group_ref", "left")
    reason = F.when(F.coalesce("_own", "_named").isNotNull(), None).when(
        F.col("group_ref").isNotNull(), "group reference unknown").otherwise("no group reference")
    return named.withColumn("grp", F.coalesce("_own", "_named")).withColumn("group_reason", reason).drop("_own", "_named")


def name_match(wanted: DataFrame, table: DataFrame, full: str, last: str, payload: str) -> DataFrame:
    """Match an official name by full name, else by its last word, ignoring case and accents."""
    keyed = wanted.withColumn("_full", S.name_key(F.col("name"))).withColumn(
        "_last", S.name_key(F.element_at(F.split(F.trim("name"), r"\s+"), -1)))
    by_full = table.groupBy(S.name_key(F.col(full)).alias("_full")).agg(F.max(payload).alias("_by_full"))
    by_last = table.groupBy(S.name_key(F.col(last)).alias("_last")).agg(F.max(payload).alias("_by_last"))
    return keyed.join(by_full, "_full", "left").join(by_last, "_last", "left").select(
        *wanted.columns, F.coalesce("_by_full", "_by_last").alias(payload),
        F.when(F.col("_by_full").isNotNull(), "full").when(F.col("_by_last").isNotNull(), "last").alias("matched_by"))
