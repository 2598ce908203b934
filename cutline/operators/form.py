"""Trailing form: windows over an entity's or a group's earlier entries, read at a later event."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cutline.operators.peers import with_totals
from cutline.operators.spans import Right, Spans, expanding, latest_before, numbered, trailing

PlanSpans = Callable[[DataFrame, list[str], str], Spans]

KEY_ORDER = ("finish", "entity")  # total order of entries that share an event


def form_state(history: DataFrame, key: str, plan: PlanSpans, short: int = 5, long: int = 10) -> DataFrame:
    """Form of each key just after each of its rows: finishers' mean finish and points
    rate over `short` rows, retirement rate over `long`, and rows seen."""
    spans = plan(history, [key], "ord")
    needed = dict.fromkeys([key, "ord", "points", "retired", *KEY_ORDER])
    base = history.where(F.col(key).isNotNull()).select(*needed)

    def columns(window):
        recent = window.rowsBetween(-(short - 1), 0)
        longer = window.rowsBetween(-(long - 1), 0)
        return {
            "finish_mean": F.avg(F.when(~F.col("retired"), F.col("finish"))).over(recent),
            "points_rate": F.avg("points").over(recent),
            "dnf_rate": F.avg(F.col("retired").cast("int")).over(longer),
        }

    ties = [F.col(c) for c in KEY_ORDER]
    return numbered(trailing(base, spans, max(short, long), columns, KEY_ORDER), spans, "seen", ties)


FORM = ("finish_mean", "points_rate", "dnf_rate", "seen")


def as_of(field: DataFrame, state: DataFrame, key: str, payload: Sequence[str], plan: PlanSpans,
          right_ties: Sequence[str] = ()) -> DataFrame:
    """The state of a key strictly before each field row's event."""
    return latest_before(field, [Right(state, tuple(payload), tuple(right_ties))], plan(state, [key], "ord"))


def trailing_form(field: DataFrame, history: DataFrame, key: str, plan: PlanSpans,
                  short: int = 5, long: int = 10) -> DataFrame:
    state = form_state(history, key, plan, short, long)
    return as_of(field, state, key, FORM, plan, KEY_ORDER)


def trailing_mean(field: DataFrame, measured: DataFrame, key: str, value: str, n: int, name: str,
                  plan: PlanSpans) -> DataFrame:
    """Mean of the last n measurements of the key before the event. `measured` holds
    one row per (key, ord)."""
    known = measured.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(key, "ord", value)
    state = trailing(known, plan(known, [key], "ord"), n,
                     lambda w: {name: F.avg(value).over(w.rowsBetween(-(n - 1), 0))})
    return as_of(field, state, key, [name], plan)


def slope(values: Column) -> Column:
    """Least-squares slope of an ordered array against its index; null under three values."""
    n = F.size(values)
    centre = (n - 1) / 2
    indexed = F.transform(values, lambda y, i: y * (i - centre))
    total = F.aggregate(indexed, F.lit(0.0), lambda a, x: a + x)
    spread = n * (n * n - 1) / 12
    return F.when(n >= 3, total / spread)


def trailing_trend(history: DataFrame, key: str, plan: PlanSpans, n: int = 5, name: str = "trend") -> DataFrame:
    """Slope of the key's mean finish over its last n events, after each of them.
    Only finishers count; an event without any is skipped."""
    per_event = (
        history.where(~F.col("retired") & F.col(key).isNotNull())
        .groupBy(key, "ord").agg(F.avg("finish").alias("_mean"))
    )
    recent = trailing(per_event, plan(per_event, [key], "ord"), n,
                      lambda w: {"_recent": F.collect_list("_mean").over(w.rowsBetween(-(n - 1), 0))})
    return recent.select(key, "ord", slope(F.col("_recent")).alias(name))


def peer_means(entries: DataFrame, group: Sequence[str], value: str, plan: PlanSpans) -> DataFrame:
    """Leave-one-out mean per group of two or more: (sum - x) / (n - 1)."""
    known = entries.where(F.col(value).isNotNull())
    for g in group:
        known = known.where(F.col(g).isNotNull())
    sized = with_totals(known, group, plan, _sum=F.sum(value), _n=F.count(value)).where("_n > 1")
    return sized.withColumn("mate_mean", (F.col("_sum") - F.col(value)) / (F.col("_n") - 1)).drop("_sum", "_n")


def relative_form(history: DataFrame, plan: PlanSpans, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Two states per entity: mean finish against its mates over the last n events
    where both sides finished, and its share of the group's points over the last n."""
    finished = history.where(~F.col("retired")).select("event", "entity", "grp", "ord", "finish")
    pairs = peer_means(finished, ["event", "grp"], "finish", plan).select(
        "entity", "ord", (F.col("finish") - F.col("mate_mean")).alias("_gap"))
    against = trailing(pairs, plan(pairs, ["entity"], "ord"), n,
                       lambda w: {"mate_gap": F.avg("_gap").over(w.rowsBetween(-(n - 1), 0))}).drop("_gap")

    scored = history.select("event", "entity", "grp", "ord", F.coalesce("points", F.lit(0.0)).alias("points"))
    totals = with_totals(scored, ["event", "grp"], plan, _team=F.sum("points"))
    joined = totals.select("entity", "ord", "points", F.when(F.col("grp").isNotNull(), F.col("_team")).alias("_team"))

    def columns(w):
        frame = w.rowsBetween(-(n - 1), 0)
        own, team = F.coalesce(F.sum("points").over(frame), F.lit(0.0)), F.coalesce(F.sum("_team").over(frame), F.lit(0.0))
        return {"points_share": F.when(team > 0, own / team)}

    shares = trailing(joined, plan(joined, ["entity"], "ord"), n, columns).drop("points", "_team")
    return against, shares


def venue_history(history: DataFrame, events: DataFrame, plan: PlanSpans) -> DataFrame:
    """Per event: earlier events at the venue, mean |grid - finish| where a grid is
    known, and the share of retirements. Entries are summed per event first."""
    moved = F.when(F.col("grid") > 0, F.abs(F.col("grid") - F.col("finish")))
    per_event = history.groupBy("event").agg(
        F.sum(moved).alias("_moved"), F.count(moved).alias("_known"),
        F.sum(F.col("retired").cast("int")).alias("_out"), F.count("*").alias("_rows"))
    dated = events.select("event", "ord", "venue").join(per_event, "event", "left")
    spans = plan(dated, ["venue"], "ord")
    totals = expanding(dated, spans, {
        "prior_events": ("sum", F.col("_rows").isNotNull().cast("bigint")),
        "_m": ("sum", F.col("_moved")), "_k": ("sum", F.col("_known")),
        "_o": ("sum", F.col("_out")), "_r": ("sum", F.col("_rows")),
    })
    return totals.select(
        "event", "ord", "venue", "prior_events",
        F.when(F.col("_k") > 0, F.col("_m") / F.col("_k")).alias("position_change"),
        F.when(F.col("_r") > 0, F.col("_o") / F.col("_r")).alias("venue_dnf_rate"),
    )


def key_venue_state(history: DataFrame, key: str, plan: PlanSpans) -> DataFrame:
    """Entries and finishers' mean finish of a key at a venue, after each event there."""
    per_event = history.where(F.col(key).isNotNull()).groupBy(key, "venue", "ord").agg(
        F.count("*").alias("_n"), F.sum(F.when(~F.col("retired"), F.col("finish"))).alias("_s"),
        F.count(F.when(~F.col("retired"), F.col("finish"))).alias("_f"))
    spans = plan(per_event, [key, "venue"], "ord")
    totals = expanding(per_event, spans, {
        "venue_entries": ("sum", F.col("_n")), "_fs": ("sum", F.col("_s")), "_fn": ("sum", F.col("_f")),
    }, inclusive=True)
    return totals.select(key, "venue", "ord", "venue_entries",
                         F.when(F.col("_fn") > 0, F.col("_fs") / F.col("_fn")).alias("venue_finish_mean"))
