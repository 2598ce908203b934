"""Scores of probabilistic predictions, their uncertainty and their calibration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cutline.functions.chance import poisson_table
from cutline.operators.peers import with_totals
from cutline.operators.spans import numbered

FLOOR = 1e-9
BINARY_FLOOR = 1e-6
METRICS = ("log_loss", "brier", "winner_hit", "podium_hits")


def duplicated_entities(preds: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Entities predicted twice in an event: an error to be fixed before scoring."""
    return preds.groupBy(*run, "event", "entity").agg(F.count("*").alias("rows")).where("rows > 1")


def overlap_credit(rank: Column, ties: Column, k: int) -> Column:
    """The chance that a row is among the top k when ties at the cut are drawn at random."""
    return F.least(F.greatest((k + 1 - rank) / ties, F.lit(0.0)), F.lit(1.0))


def tie_fair(df: DataFrame, keys: Sequence[str], p: str, plan, **credits: int) -> DataFrame:
    """Add each row's share of the top k by probability, ties split evenly: one new column per
    `name=k`, all read from one ranking."""
    down = df.withColumn("_down", -F.col(p))
    ranked = numbered(down, plan(down, list(keys), "_down"), "_rank", kind="rank", peers_name="_ties")
    return ranked.select(*df.columns, *[overlap_credit(F.col("_rank"), F.col("_ties"), k).alias(n) for n, k in credits.items()])


def score_events(preds: DataFrame, actual: DataFrame, plan, run: Sequence[str] = (), places: int = 3) -> DataFrame:
    """One row per (run, event): log loss, Brier, and the expected winner and podium hits.

    `preds`: run columns, event, entity, p. `actual`: event, entity, won, podium (0/1); where `preds` have these two as well, they are
    not looked up again. Ties are settled by expectation. A winner outside the field costs a full Brier point."""
    keys = [*run, "event"]
    told = {"won", "podium"} <= set(preds.columns)
    fair = tie_fair(preds, keys, "p", plan, _top=1, _place=places)
    # A field given nothing at all keeps nothing, and has no favourites.
    sized = with_totals(fair, keys, plan, _sum=F.sum("p"), _size=F.count("*"))
    some = F.col("_sum") > 0
    held = sized.withColumns({
        "p": F.coalesce(F.try_divide("p", "_sum"), F.lit(0.0)), "_top": F.when(some, F.col("_top")).otherwise(0.0),
        "_place": F.when(some | (F.col("_size") <= places), F.col("_place")).otherwise(0.0)})
    joined = held if told else held.join(actual.select("event", "entity", "won", "podium"), ["event", "entity"], "left")
    won, podium = F.coalesce("won", F.lit(0)), F.coalesce("podium", F.lit(0))
    scored = joined.groupBy(*keys).agg(
        F.sum(won).alias("_in_field"), F.sum(F.when(won == 1, F.col("p"))).alias("_p"),
        F.sum(F.pow(F.col("p") - won, 2)).alias("_b"), F.sum(F.col("_top") * won).alias("winner_hit"),
        F.sum(F.col("_place") * podium).alias("podium_hits"), F.count("*").alias("field"))
    winners = actual.where("won = 1").select("event").distinct()
    return scored.join(winners, "event", "left_semi").select(
        *keys, (-F.log(F.greatest(F.coalesce("_p", F.lit(0.0)), F.lit(FLOOR)))).alias("log_loss"),
        (F.col("_b") + F.when(F.col("_in_field") == 0, 1.0).otherwise(0.0)).alias("brier"), "winner_hit", "podium_hits",
        F.when(F.col("_in_field") == 0, "winner_not_in_field").when(F.coalesce("_p", F.lit(0.0)) <= 0, "winner_at_zero")
        .alias("undefined"), "field")


def defined_log_loss(scores: DataFrame) -> DataFrame:
    """A log loss that only measures the floor is withheld, and the reason kept."""
    return scores.withColumn("log_loss", F.when(F.col("undefined").isNull(), F.col("log_loss")))


def summarise(scores: DataFrame, run: Sequence[str], places: int = 3) -> DataFrame:
    return scores.groupBy(*run).agg(
        F.count("*").alias("events"), F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"),
        F.avg("winner_hit").alias("winner_hit_rate"), F.sum("podium_hits").alias("podium_hits"),
        (F.sum("podium_hits") / (F.count("*") * places)).alias("podium_rate"))


def binary_scores(df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """Mean log loss and squared error per group of rows."""
    held = F.least(F.greatest(F.col(p), F.lit(BINARY_FLOOR)), F.lit(1 - BINARY_FLOOR))
    loss = -(F.col(y) * F.log(held) + (1 - F.col(y)) * F.log(1 - held))
    return df.groupBy(*keys).agg(F.avg(loss).alias("log_loss"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def class_scores(df: DataFrame, keys: Sequence[str], chances: Sequence[str], y: str) -> DataFrame:
    """The same for several classes; `y` is the index of the class that happened."""
    of = F.element_at(F.array(*chances), F.col(y).cast("int") + 1)
    square = sum(F.pow(F.col(c) - (F.col(y) == i).cast("int"), 2) for i, c in enumerate(chances))
    held = F.least(F.greatest(of, F.lit(BINARY_FLOOR)), F.lit(1.0))
    return df.groupBy(*keys).agg(F.avg(-F.log(held)).alias("log_loss"), F.avg(square).alias("brier"))


_EVENTS_AT_ONCE = 64  # events whose weights a task holds together


def replicate_means(scores: DataFrame, run: Sequence[str], value: str, event: str, draws: int, seed: int) -> DataFrame:
    """Mean of every bootstrap replicate. Each (event, replicate) draws its own weight from a counter, so there is no join
    with a resample. An event's rows of all runs lie together and share its weights; the rows are few bytes for much work, so they
    are dealt over a fixed number of tasks, each of which sends at most `draws` partial sums per run through the shuffle."""
    spark = scores.sparkSession
    known = scores.where(F.col(value).isNotNull() & F.col(event).isNotNull()).select(F.struct(*run, F.lit(0).alias("_")).alias("_run"), F.col(event).cast("bigint").alias("_e"), F.col(value).cast("double").alias("_v"))
    names = {r: f"_run.{r}" for r in run}
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keyed = known.select(F.to_json("_run").alias("_key"), "_e", "_v").repartition(tasks, "_e").sortWithinPartitions("_e")

    def sums(batches: Iterator) -> Iterator:
        import pandas as pd
        import pyarrow as pa

        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            event_of, events = pd.factorize(batch.column("_e").to_numpy())
            run_of, runs = pd.factorize(batch.column("_key").to_pandas())
            rows, v = len(runs), batch.column("_v").to_numpy()
            for key in runs:
                totals.setdefault(key, np.zeros((2, draws)))
            # Rows lie in order of their events.
            for at in range(0, len(events), _EVENTS_AT_ONCE):
                some = slice(*np.searchsorted(event_of, [at, at + _EVENTS_AT_ONCE]))
                cells = run_of[some] * _EVENTS_AT_ONCE + event_of[some] - at
                each = np.stack([np.bincount(cells, w, rows * _EVENTS_AT_ONCE) for w in (None, v[some])]).reshape(2 * rows, _EVENTS_AT_ONCE)
                weights = poisson_table(events[at:at + _EVENTS_AT_ONCE], draws, seed).astype(float)
                added = (each[:, :len(weights)] @ weights).reshape(2, rows, draws)
                for i, key in enumerate(runs):
                    totals[key] += added[:, i]
        for key, (n, s) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * draws), pa.array(np.arange(draws, dtype=np.int32)), pa.array(n), pa.array(s)], names=["_key", "replicate", "_n", "_s"])

    added = keyed.mapInArrow(sums, "_key string, replicate int, _n double, _s double").groupBy("_key", "replicate").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    back = F.from_json("_key", known.schema["_run"].dataType.simpleString()).alias("_run")
    return added.where("_n > 0").select(back, "replicate", (F.col("_s") / F.col("_n")).alias("mean")).select(*[F.col(c).alias(r) for r, c in names.items()], "replicate", "mean")


def bootstrap(scores: DataFrame, run: Sequence[str], value: str, event: str = "event", draws: int = 2000,
              seed: int = 20260922) -> DataFrame:
    """Mean with a 95% percentile interval from resampling events."""
    means = replicate_means(scores, run, value, event, draws, seed)
    spread = means.groupBy(*run).agg(F.percentile("mean", 0.025).alias("lo"), F.percentile("mean", 0.975).alias("hi"))
    centre = scores.where(F.col(value).isNotNull()).groupBy(*run).agg(F.count("*").alias("events"), F.avg(value).alias("mean"))
    if run:
        return centre.join(spread, list(run))
    return centre.crossJoin(F.broadcast(spread))  # one row each


def paired_difference(a: DataFrame, b: DataFrame, run: Sequence[str], value: str, draws: int = 2000,
                      seed: int = 20260922) -> DataFrame:
    """Mean of a - b over the events both scored, with its interval and whether that excludes zero."""
    both = a.select(*run, "event", F.col(value).alias("_a")).join(b.select("event", F.col(value).alias("_b")), "event")
    diff = both.withColumn("difference", F.col("_a") - F.col("_b"))
    out = bootstrap(diff, run, "difference", "event", draws, seed)
    return out.withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


def bin_edges(bins: int) -> list[float]:
    """Edges as a float sum gives them: the fourth of ten is a hair above 0.3."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def calibration_table(preds: DataFrame, run: Sequence[str], bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """Reliability per bin: rows, mean prediction, observed rate, edges."""
    edges = bin_edges(bins)
    inside = F.lit(0)
    for edge in edges[1:-1]:
        inside = inside + (F.col(p) >= edge).cast("int")
    table = preds.where(F.col(p).isNotNull()).withColumn("bin", inside).groupBy(*run, "bin").agg(
        F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("observed"))
    edge_array = F.array(*[F.lit(e) for e in edges])
    return table.withColumn("edge_lo", F.get(edge_array, F.col("bin"))).withColumn("edge_hi", F.get(edge_array, F.col("bin") + 1))


def calibration_error(table: DataFrame, run: Sequence[str]) -> DataFrame:
    gap = F.abs(F.col("predicted") - F.col("observed"))
    return table.groupBy(*run).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def common_events(scores: DataFrame, run: str) -> DataFrame:
    """Events that every run scored."""
    runs = scores.agg(F.countDistinct(run)).first()[0]
    return scores.groupBy("event").agg(F.countDistinct(run).alias("_n")).where(F.col("_n") == runs).select("event")


def last_events(scores: DataFrame, events: DataFrame, n: int) -> DataFrame:
    """Scores of the last n events that were scored: a distributed top n, then a semi join."""
    scored = events.join(scores.select("event").distinct(), "event", "left_semi")
    return scores.join(F.broadcast(scored.orderBy(F.col("ord").desc()).limit(n).select("event")), "event", "left_semi")


def select_candidate(scores: DataFrame, errors: DataFrame, run: str, reference: str) -> DataFrame:
    """The run with the smallest mean log loss on the events all runs scored, and whether
    its calibration error exceeds twice the reference's."""
    shared = scores.join(common_events(scores, run), "event", "left_semi")
    table = shared.groupBy(run).agg(F.avg("log_loss").alias("log_loss"), F.count("*").alias("events")).join(errors, run)
    best = table.agg(F.min_by(F.struct(run, "log_loss", "ece", "events"), F.struct("log_loss", run)).alias("b"),
                     F.max(F.when(F.col(run) == reference, F.col("ece"))).alias("reference_ece"))
    return best.select(F.col(f"b.{run}").alias("chosen"), "b.log_loss", "b.ece", "b.events", "reference_ece",
                       (F.col("b.ece") > 2 * F.col("reference_ece")).alias("guard_tripped"))


def scored_once(scores: DataFrame, events: DataFrame, run: str, reference: str, border: Column) -> DataFrame:
    """Choose a run on the events before the border and score it once on those from it on, beside the reference: chosen, the events and
    mean log loss of both parts, and whether it beats the reference in each. Only events that all runs scored count. `border` is a
    condition on `events` that is true for the held out ones; they have no part in the choice."""
    held = scores.join(events.select("event", border.alias("_held")), "event")
    shared = held.join(common_events(scores, run), "event", "left_semi")
    table = shared.groupBy(run).agg(*[x for name, part in (("selection", ~F.col("_held")), ("holdout", F.col("_held"))) for x in (
        F.count_if(part).alias(f"{name}_events"), F.avg(F.when(part, F.col("log_loss"))).alias(f"{name}_log_loss"))])
    row = F.struct(run, "selection_events", "selection_log_loss", "holdout_events", "holdout_log_loss")
    best = table.agg(F.min_by(row, F.struct("selection_log_loss", run)).alias("b"), F.max(F.when(F.col(run) == reference, row)).alias("r"))
    return best.select(F.col(f"b.{run}").alias("chosen"), "b.selection_events", "b.selection_log_loss", "b.holdout_events", "b.holdout_log_loss",
                       F.col("r.selection_log_loss").alias("reference_selection"), F.col("r.holdout_log_loss").alias("reference_holdout"),
                       (F.col("b.holdout_log_loss") < F.col("r.holdout_log_loss")).alias("beats_reference"))


def incoherence(df: DataFrame, p: str, below: str, above: str, run: Sequence[str] = ()) -> DataFrame:
    """Shares of rows where a chance contradicts its neighbours."""
    return df.groupBy(*run).agg(
        F.avg((F.col(p) > F.col(above) + 1e-9).cast("int")).alias("above_points"),
        F.avg((F.col(p) < F.col(below) - 1e-9).cast("int")).alias("below_win"))


def model_report(scores: DataFrame, preds: DataFrame, run: Sequence[str], bar: DataFrame, draws: int = 2000) -> DataFrame:
    """Every metric of every run with its interval, calibration error, and the difference to a bar."""
    out = summarise(scores, run)
    for metric in ("log_loss", "brier"):
        ci = bootstrap(scores, run, metric, draws=draws).select(*run, F.col("lo").alias(f"{metric}_lo"), F.col("hi").alias(f"{metric}_hi"))
        out = out.join(ci, list(run))
    against = paired_difference(scores, bar, run, "log_loss", draws).select(
        *run, F.col("mean").alias("vs_bar"), F.col("lo").alias("vs_bar_lo"), F.col("hi").alias("vs_bar_hi"),
        F.when(~F.col("significant"), "indistinguishable").when(F.col("mean") < 0, "beats the bar").otherwise("loses to the bar").alias("verdict"))
    return out.join(against, list(run)).join(calibration_error(calibration_table(preds, run), run), list(run), "left")
