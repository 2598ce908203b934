"""Simple rules every model is measured against, each learning only from earlier events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cutline.functions import scalars as S
from cutline.operators.peers import pairs_of_two, with_totals
from cutline.operators.spans import expanding

FLOOR = 1e-9
PLACES = 20  # fixed value: the field size the smoothing assumes


def scored_entries(entries: DataFrame, plan, min_field: int = 5) -> DataFrame:
    """Starters of events that can be scored: enough of them, and a classified winner.
    Events left out are not learned from either."""
    started = entries.where(F.col("code") != S.WITHDRAWN).select(
        "event", "ord", "season", "entity", "grp", "finish", "code", "retired",
        *[c for c in entries.columns if c in ("grid", "venue", "quali_position", "standing_position", "practice_rank")])
    won = F.col("code") == "1"
    sized = with_totals(started.withColumn("won", won.cast("int")), ["event"], plan, _n=F.count("*"), _w=F.sum("won"))
    return sized.where((F.col("_n") >= min_field) & (F.col("_w") > 0)).withColumnsRenamed({"_n": "field"}).drop("_w")


def uniform_rule(df: DataFrame) -> Column:
    return 1.0 / F.col("field")


def _seen_by_place(df: DataFrame, position: str, plan, sums: dict) -> tuple[DataFrame, DataFrame]:
    """The rows with their place as `_slot`, null where it is unknown, and the same rows with what earlier events had at that
    place. Rows of unknown place are no group: they go past the window, with nothing seen."""
    slot = df.withColumn("_slot", F.when(F.coalesce(F.col(position) > 0, F.lit(False)), F.col(position)))
    placed = slot.where("_slot IS NOT NULL")
    seen = expanding(placed, plan(placed, ["_slot"], "ord"), sums)
    unplaced = slot.where("_slot IS NULL").select("*", *[F.lit(0).cast(dict(seen.dtypes)[n]).alias(n) for n in sums])
    return slot, seen.unionByName(unplaced)


def position_prior(df: DataFrame, position: str, plan, plan_events, alpha: float = 1.0, name: str = "p") -> DataFrame:
    """Chance to win from a position: (wins + a) / (starts + 20 a) over earlier events;
    a / (all starts + a) where the position is unknown. A whole event is excluded at once."""
    slot, seen = _seen_by_place(df, position, plan, {"_wins": ("sum", F.col("won")), "_starts": ("sum", F.lit(1))})
    totals = slot.groupBy("event", "ord").agg(F.count("_slot").alias("_c")).withColumn("_all", F.lit(0))
    before = expanding(totals, plan_events(totals, ["_all"], "ord"), {"_every": ("sum", F.col("_c"))})
    placed = seen.where("_slot IS NOT NULL").withColumn(name, (F.col("_wins") + alpha) / (F.col("_starts") + alpha * PLACES))
    # Only rows of unknown place need the starts of all places.
    unplaced = slot.where("_slot IS NULL").join(before.select("event", "_every"), "event").withColumn(name, alpha / (F.col("_every") + alpha))
    columns = [*df.columns, F.greatest(name, F.lit(FLOOR)).alias(name)]
    return placed.select(*columns).unionByName(unplaced.select(*columns))


def position_rate(df: DataFrame, position: str, hit: Column, k: int, plan, name: str, alpha: float = 1.0) -> DataFrame:
    """Chance to finish in the top k from a position; k / 20 where it is unknown."""
    _, seen = _seen_by_place(df, position, plan, {"_hits": ("sum", hit.cast("int")), "_seen": ("sum", F.lit(1))})
    rate = (F.col("_hits") + alpha * k) / (F.col("_seen") + alpha * PLACES)
    return seen.withColumn(name, F.when(F.col("_slot").isNotNull(), rate).otherwise(k / PLACES)).drop("_slot", "_hits", "_seen")


def mate_rule(df: DataFrame, position: str, plan_events) -> DataFrame:
    """For each pair of mates, the chance that the first finishes ahead: the rate at which
    the better placed mate did so in earlier events, one half where places are equal or unknown."""
    pairs = pairs_of_two(df, ["event", "ord", "grp"], "entity", [position, "finish"])
    a, b = F.col(f"{position}_a"), F.col(f"{position}_b")
    comparable = a.isNotNull() & b.isNotNull() & (a != b)
    ahead = (F.col("finish_a") < F.col("finish_b"))
    better_won = F.when(comparable, (ahead == (a < b)).cast("int"))
    per_event = pairs.groupBy("event", "ord").agg(
        F.coalesce(F.sum(better_won), F.lit(0)).alias("_w"), F.count(better_won).alias("_c")).withColumn("_all", F.lit(0))
    before = expanding(per_event, plan_events(per_event, ["_all"], "ord"), {"_won": ("sum", F.col("_w")), "_n": ("sum", F.col("_c"))})
    rate = (F.col("_won") + 1) / (F.col("_n") + 2)
    p = F.when(~F.coalesce(comparable, F.lit(False)), 0.5).when(a < b, rate).otherwise(1 - rate)
    return pairs.join(before.select("event", "_won", "_n"), "event").select(
        "event", "ord", "grp", "entity_a", "entity_b", p.alias("p"), ahead.cast("int").alias("y"))


_CELLS = 1 << 20


def elo_update(ratings: Sequence[float], k: float, scale: float) -> list[float]:
    """New ratings of classified finishers, best first: every pair is one comparison, all
    against the ratings before the event, with k shared over the comparisons.

    Comparisons are taken some rows at a time, so memory stays linear in the field."""
    n = len(ratings)
    if n < 2:
        return list(ratings)
    held = np.asarray(ratings, dtype=float)
    expected = np.empty(n)
    rows = max(1, _CELLS // n)
    for at in range(0, n, rows):
        expected[at:at + rows] = (1.0 / (1.0 + 10.0 ** ((held[None, :] - held[at:at + rows, None]) / scale))).sum(axis=1) - 0.5  # less the one with oneself
    return (held + k / (n - 1) * (n - 1 - np.arange(n) - expected)).tolist()


def elo(entries: DataFrame, pool: str, k: float = 24.0, scale: float = 400.0, start: float = 1500.0) -> DataFrame:
    """Chance to win by a rating per entity, updated after each event.

    A rating is a fold: the events of a pool must be taken in order. Each event is one row, its entities in finishing order;
    pools run in parallel, and each is streamed through its task in sorted batches, so memory holds the ratings and a batch of
    events, never the pool."""
    types = dict(entries.dtypes)
    fields = entries.groupBy(pool, "ord", "event").agg(F.array_sort(F.collect_list(F.struct("finish", "entity", "retired"))).alias("_f"))
    ordered = fields.select(pool, "ord", "event", F.transform("_f", lambda x: x["entity"]).alias("entities"), F.transform("_f", lambda x: x["retired"]).alias("retired")).repartition(
        pool).sortWithinPartitions(pool, "ord", "event")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ratings: dict[int, float] = {}
        current = None
        for batch in batches:
            out = []
            for name, _, event, entities, retired in batch.itertuples(index=False, name=None):
                if name != current:
                    current, ratings = name, {}
                rated = np.array([ratings.get(e, start) for e in entities])
                strength = 10.0 ** ((rated - rated.max()) / scale)
                chance = np.maximum(strength / strength.sum(), FLOOR)
                out += zip([event] * len(entities), entities, rated.tolist(), chance.tolist(), strict=True)
                finished = ~retired.astype(bool)
                ratings.update(zip(entities[finished].tolist(), elo_update(rated[finished], k, scale), strict=True))
            yield pd.DataFrame(out, columns=["event", "entity", "rating", "p"])

    return ordered.mapInPandas(fold, f"event {types['event']}, entity {types['entity']}, rating double, p double")
