"""Running totals on a complete grid of keys and rounds, and what they are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cutline.operators.peers import looked_at
from cutline.operators.spans import Spans, numbered, trailing


def dense_cumulative(points: DataFrame, calendar: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Running totals of each key after every round of its season, carried through rounds it missed.

    `points`: season, round, the key and what `values` (name -> expression) read. `calendar`:
    season, round. A key's rounds become one small map, which its season's rounds look up:
    no pivot, and no product of keys and rounds to join back."""
    per_round = points.groupBy("season", key, "round").agg(*[F.sum(c).alias(n) for n, c in values.items()])
    per_key = per_round.groupBy("season", key).agg(
        F.map_from_entries(F.collect_list(F.struct("round", F.struct(*values)))).alias("_held"))
    rounds = calendar.groupBy("season").agg(F.collect_set("round").alias("_rounds"))
    cells = per_key.join(rounds, "season").select("season", key, "_held", F.explode("_rounds").alias("round")).select(
        "season", key, "round", F.try_element_at("_held", F.col("round")).alias("_v"))
    # A (season, key) has at most one row per round, so its window is small.
    running = Window.partitionBy("season", key).orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return cells.select("season", key, "round", *[
        F.coalesce(F.sum(F.col("_v")[n]).over(running), F.lit(0)).alias(n) for n in values])


def standings(entries: DataFrame, calendar: DataFrame, key: str, plan) -> DataFrame:
    """Points, wins and rank of every key after every round; ties share the better rank."""
    table = dense_cumulative(entries.where(F.col(key).isNotNull()), calendar, key, {
        "standing_points": F.col("points"), "wins": (F.col("code") == "1").cast("bigint")})
    down = looked_at(table.withColumn("_down", -F.col("standing_points")), ["season", "round"], plan, "standings-cells")
    return numbered(down, plan(down, ["season", "round"], "_down"), "standing_position", kind="rank").drop("_down")


def previous_round(events: DataFrame) -> DataFrame:
    """Each round of a season with the round before it; null in the first."""
    rounds = events.select("season", "round").distinct()
    return trailing(rounds, Spans(("season",), "round"), 1, lambda w: {"previous_round": F.lag("round").over(w)})


def standing_before(field: DataFrame, table: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """The standing entering the event: after the previous round of the same season."""
    return (
        field.join(previous_round(events), ["season", "round"], "left")
        .join(table.select("season", F.col("round").alias("previous_round"), key, "standing_position", "standing_points"),
              ["season", "previous_round", key], "left")
        .drop("previous_round")
    )


def recompute_totals(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Points per key summed over several sources, null counted as nothing."""
    both = sources[0].select(*keys, "points")
    for s in sources[1:]:
        both = both.unionByName(s.select(*keys, "points"))
    return both.groupBy(*keys).agg(F.coalesce(F.sum("points"), F.lit(0.0)).alias("points"))


def compare_totals(published: DataFrame, recomputed: DataFrame, keys: list[str], exact_from: int,
                   excused: DataFrame | None = None) -> DataFrame:
    """Published totals against recomputed ones. From `exact_from` on they must be
    equal; before it, dropped scores may only lower the published total. Documented
    exceptions (`excused`, by key) are marked, not dropped."""
    both = published.select(*keys, F.col("points").alias("published")).join(
        recomputed.select(*keys, F.col("points").alias("computed")), keys, "full")
    diff = F.round(F.coalesce("computed", F.lit(0.0)) - F.coalesce("published", F.lit(0.0)), 6)
    wrong = F.when(F.col("season") >= exact_from, F.abs("difference") > 1e-9).otherwise(F.col("difference") < -1e-9)
    out = both.withColumn("difference", diff)
    if excused is not None:
        out = out.join(F.broadcast(excused.select(*keys, F.lit(True).alias("excused"))), keys, "left")
    else:
        out = out.withColumn("excused", F.lit(None).cast("boolean"))
    status = F.when(~wrong, "ok").when(F.col("excused"), "excused").otherwise("differs")
    return out.select(*keys, "published", "computed", "difference", status.alias("status"))
