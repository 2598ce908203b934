"""A ranker that learns what sets a winner apart from its own field: a softmax over the entries of each event.

The loss of an event is minus the logarithm of the winner's share of exp(score), with scores linear in standardised inputs. Its
gradient couples the entries of the event, so a field lies together: one row per event, with the inputs of its entries as one array.
A field above _PART entries lies in several rows, whose sums of exp(score), of inputs and of their products are added up before the
event counts, so no event is gathered in one task. Folds hold each other, as in `models`: events lie in order, a pass visits them
once, all folds take their Newton steps together, and each fold is solved where its sums are."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from cutline.operators.peers import with_totals
from cutline.plans import models
from cutline.session import stored

_PART = 1024  # entries of one row
GRID = tuple(float(v) for v in np.geomspace(0.05, 20.0, 40))


@dataclass
class Ranker:
    """Coefficients of each fold on standardised inputs, and its temperature."""

    columns: tuple[str, ...]
    cuts: np.ndarray
    medians: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    events: np.ndarray
    beta: np.ndarray
    temperature: np.ndarray


def fields(df: DataFrame, columns: Sequence[str], plan) -> DataFrame:
    """One row per event (or part of a large one): event, ord, parts, the inputs of its entries one after the other, and who won. Only
    events with one winner say anything."""
    sized = with_totals(df, ["event"], plan, _field=F.count("*"), _won=F.sum("win")).where("_won = 1")
    parts = F.ceil(F.col("_field") / _PART).cast("int")
    rows = sized.select(F.col("event").cast("long").alias("event"), F.col("ord").cast("long").alias("ord"), parts.alias("parts"), F.pmod(F.xxhash64("entity"), parts).cast("int").alias("part"),
                        F.struct("entity", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns]).alias("x"), F.col("win").cast("double").alias("y")).alias("e"))
    held = rows.groupBy("event", "ord", "parts", "part").agg(F.sort_array(F.collect_list("e")).alias("e"))  # about _PART entries
    return held.select("event", "ord", "parts", F.flatten(F.transform("e", lambda e: e["x"])).alias("x"), F.transform("e", lambda e: e["y"]).alias("y"))


def _events(batches: Iterator, p: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of fields in ascending order: event, ord, parts, inputs of all entries, who won, and where each row's entries begin."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.argsort(batch.column("ord").to_numpy(), kind="stable")
        held = batch.take(pa.array(at))
        event, order, parts = (held.column(c).to_numpy() for c in ("event", "ord", "parts"))
        y = held.column("y")
        edges = y.offsets.to_numpy()
        x = held.column("x")
        yield event, order, parts, x.values.to_numpy(zero_copy_only=False)[x.offsets.to_numpy()[0]:x.offsets.to_numpy()[-1]].reshape(-1, p), y.values.to_numpy(zero_copy_only=False)[edges[0]:edges[-1]], edges - edges[0]


def _standard(x: np.ndarray, medians: np.ndarray, means: np.ndarray, deviations: np.ndarray) -> np.ndarray:
    return (np.where(np.isnan(x), medians, x) - means) / deviations


def _event_sums(z: np.ndarray, y: np.ndarray, starts: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By row of fields: the sum of exp(score), of exp(score) x inputs, of exp(score) x products of inputs, and the winner's inputs."""
    w = np.exp(np.clip(z @ beta, -300, 300))
    p = z.shape[1]
    products = (z[:, :, None] * z[:, None, :]).reshape(len(z), p * p)
    return (np.add.reduceat(w, starts), np.add.reduceat(w[:, None] * z, starts), np.add.reduceat(w[:, None] * products, starts), np.add.reduceat(y[:, None] * z, starts))


def _whole_events(z: np.ndarray, y: np.ndarray, starts: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the loss of events that lie whole, added up. Each entry weighs its share of its event, so the products
    of inputs are one matrix product over all entries, and no entry has a matrix of its own."""
    score = np.exp(np.clip(z @ beta, -300, 300))
    share = score / np.repeat(np.add.reduceat(score, starts), np.diff(np.append(starts, len(z))))
    weighted = z * share[:, None]
    mean = np.add.reduceat(weighted, starts)
    return np.concatenate([(share - y) @ z, (weighted.T @ z - mean.T @ mean).ravel()])


def _contribution(total: np.ndarray, first: np.ndarray, second: np.ndarray, won: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the loss of events, from their sums, added up."""
    mean = first / total[:, None]
    curvature = (second / total[:, None]).sum(axis=0) - (mean.T @ mean).ravel()
    return np.concatenate([(mean - won).sum(axis=0), curvature])


_SUMS = "fold bigint, event bigint, at bigint, value double"


def _pass(held: DataFrame, edges: np.ndarray, p: int, state: tuple[np.ndarray, ...], beta: np.ndarray, live: np.ndarray) -> DataFrame:
    """Rows (fold, at, value): gradient, then curvature, of each live fold."""
    import pyarrow as pa

    medians, means, deviations = state
    k, cells = len(edges), p + p * p

    def run(batches: Iterator) -> Iterator:
        total = np.zeros((k, cells))
        for event, order, parts, x, y, starts in _events(batches, p):
            whole = parts == 1
            lengths = np.diff(starts)
            of_whole = np.repeat(whole, lengths)
            event, part_order, part_starts = event[~whole], order[~whole], np.append(0, np.cumsum(lengths[~whole]))
            whole_starts = np.append(0, np.cumsum(lengths[whole]))
            for f in np.flatnonzero(live):
                rows = np.searchsorted(order[whole], edges[f], "left")
                if rows:
                    entries = whole_starts[rows]
                    z = _standard(x[of_whole][:entries] if len(part_order) else x[:entries], medians[f], means[f], deviations[f])
                    total[f] += _whole_events(z, (y[of_whole] if len(part_order) else y)[:entries], whole_starts[:rows], beta[f])
                rows = np.searchsorted(part_order, edges[f], "left")
                if rows:
                    entries = part_starts[rows]
                    z = _standard(x[~of_whole][:entries], medians[f], means[f], deviations[f])
                    table = np.column_stack(_event_sums(z, y[~of_whole][:entries], part_starts[:rows], beta[f]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(table.size, f)), pa.array(np.repeat(event[:rows], table.shape[1])), pa.array(np.tile(np.arange(table.shape[1]), rows)), pa.array(table.ravel())], names=["fold", "event", "at", "value"])
        fold, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(fold), pa.array(np.zeros(len(fold), np.int64), mask=np.ones(len(fold), bool)), pa.array(at), pa.array(total[fold, at])], names=["fold", "event", "at", "value"])

    def joined(key, part):
        """A large event from its sums: 1, inputs, products, the winner's inputs."""
        sums = np.zeros(1 + p + p * p + p)
        sums[part.column("at").to_numpy()] = part.column("value").to_numpy()
        found = _contribution(sums[:1], sums[None, 1:1 + p], sums[None, 1 + p:1 + p + p * p], sums[None, 1 + p + p * p:])
        return pa.table({"fold": np.full(len(found), key[0].as_py()), "at": np.arange(len(found)), "value": found})

    found = held.mapInArrow(run, _SUMS).groupBy("fold", "event", "at").agg(F.sum("value").alias("value"))
    plain = found.where("event IS NULL").select("fold", "at", "value")
    if held.where("parts > 1").limit(1).count():
        plain = stored(found, "listwise-sums")
        large = plain.where("event IS NOT NULL").groupBy("fold", "event").applyInArrow(joined, "fold bigint, at bigint, value double")
        plain = plain.where("event IS NULL").select("fold", "at", "value").unionByName(large).groupBy("fold", "at").agg(F.sum("value").alias("value"))
    return plain


def _step(beta: np.ndarray, p: int, C: float):
    def solved(fold, part):
        import pyarrow as pa

        f, sums = fold[0].as_py(), np.zeros(p + p * p)
        sums[part.column("at").to_numpy()] = part.column("value").to_numpy()
        return pa.table({"fold": [f], "step": [np.linalg.solve(C * sums[p:].reshape(p, p) + np.eye(p), C * sums[:p] + beta[f])]})

    return solved


def calibration_borders(df: DataFrame, cuts: Sequence[int], events: int) -> list[int]:
    """For each cut where the last `events` events before it begin, or the cut itself if there are not more than twice as many. Only
    that many events of each stretch between cuts reach the driver."""
    dated = models.cuts_up_to(df.groupBy("event").agg(F.min("ord").alias("ord")), F.col("ord"), cuts, "stretch").where(F.col("stretch") < len(cuts))
    held = {r.stretch: r.n for r in dated.groupBy("stretch").agg(F.count("*").alias("n")).collect()}
    last = Window.partitionBy("stretch").orderBy(F.desc("ord"))
    late = dated.withColumn("no", F.row_number().over(last)).where(F.col("no") <= events).select("stretch", "ord").collect()
    out = []
    for f, cut in enumerate(cuts):
        before = sorted((r.ord for r in late if r.stretch <= f), reverse=True)
        out.append(before[events - 1] if sum(n for s, n in held.items() if s <= f) > 2 * events else cut)
    return out


def fit(df: DataFrame, columns: Sequence[str], cuts: Sequence[int], plan, C: float = 0.5, calibration_events: int = 25, iterations: int = 40, tolerance: float = 1e-8) -> Ranker:
    """A ranker for each cut, fitted on the events before it but for the last `calibration_events`, on which its temperature is
    chosen. Minimises C x the sum of losses + |w|^2 / 2; inputs are imputed and scaled as by the fold's own rows."""
    columns, p, k = tuple(columns), len(columns), len(cuts)
    borders = np.asarray(calibration_borders(df, cuts, calibration_events), dtype=np.int64)
    medians, means, deviations, _, events = models.standardising(df, columns, ["win"], borders)
    held, beta = stored(fields(df, columns, plan), "fields"), np.zeros((k, p))
    state, live = (medians, means, deviations), np.ones(k, bool)
    for _ in range(iterations):
        found = _pass(held, borders, p, state, beta, live).groupBy("fold").applyInArrow(_step(beta, p, C), "fold bigint, step array<double>").toPandas()
        step = np.zeros_like(beta)
        for f, one in zip(found["fold"], found["step"], strict=True):
            step[f] = one
        # Far from the optimum a whole step may go too far.
        longest = np.abs(step).max(axis=1, keepdims=True)
        beta = beta - step * np.minimum(1.0, 2.0 / np.maximum(longest, 1e-12))
        live &= longest[:, 0] >= tolerance  # a fold that has arrived is not visited again
        if not live.any():
            break
    ranker = Ranker(columns, np.asarray(cuts, dtype=np.int64), medians, means, deviations, events[:, 0], beta, np.ones(k))
    ranker.temperature = _temperatures(df, ranker, borders, plan)
    return ranker


def scored(df: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows from the first cut on, with `fold` and the `score` by the fold's coefficients."""
    rows = [(f, [float(v) for v in ranker.beta[f]], [float(v) for v in ranker.medians[f]], [float(v) for v in ranker.means[f]], [float(v) for v in ranker.deviations[f]], float(ranker.temperature[f]), float(ranker.events[f]))
            for f in range(len(ranker.cuts))]
    table = df.sparkSession.createDataFrame(rows, "fold int, _beta array<double>, _medians array<double>, _means array<double>, _deviations array<double>, temperature double, trained double")
    at = models.cuts_up_to(df, F.col("ord"), ranker.cuts.tolist(), "fold").withColumn("fold", F.col("fold") - 1).join(F.broadcast(table), "fold")
    return at.withColumn("score", _score(ranker.columns)).drop("_beta", "_medians", "_means", "_deviations")


def _score(columns: Sequence[str]):
    terms = [(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.get("_medians", F.lit(i))) - F.get("_means", F.lit(i))) / F.get("_deviations", F.lit(i)) * F.get("_beta", F.lit(i)) for i, c in enumerate(columns)]
    return sum(terms[1:], terms[0])


def _temperatures(df: DataFrame, ranker: Ranker, borders: np.ndarray, plan) -> np.ndarray:
    """For each fold the temperature of the grid at which it best predicts the winners of its calibration events. An event may serve
    several folds; there are as many as folds x calibration events."""
    out = np.ones(len(ranker.cuts))
    rows = [(f, int(b), int(c), [float(v) for v in ranker.beta[f]], [float(v) for v in ranker.medians[f]], [float(v) for v in ranker.means[f]], [float(v) for v in ranker.deviations[f]])
            for f, (b, c) in enumerate(zip(borders, ranker.cuts, strict=True)) if b < c]
    if not rows:
        return out
    table = df.sparkSession.createDataFrame(rows, "fold int, _from bigint, _to bigint, _beta array<double>, _medians array<double>, _means array<double>, _deviations array<double>")
    late = df.join(F.broadcast(table), (F.col("ord") >= F.col("_from")) & (F.col("ord") < F.col("_to"))).select("fold", "event", "entity", "win", _score(ranker.columns).alias("score"))
    late = stored(late, "calibration-scores")
    one = with_totals(late, ["fold", "event"], plan, _w=F.sum("win"), _top=F.max("score")).where("_w = 1")
    tried = one.select("fold", "event", "win", "score", "_top", F.explode(F.array(*[F.lit(g) for g in GRID])).alias("T"))
    e = F.exp((F.col("score") - F.col("_top")) / F.col("T"))
    each = tried.groupBy("fold", "event", "T").agg(F.sum(e).alias("all"), F.sum(F.when(F.col("win") == 1, e)).alias("winner"))
    loss = each.groupBy("fold", "T").agg(F.avg(-F.log(F.greatest(F.col("winner") / F.col("all"), F.lit(1e-9)))).alias("loss"))
    for r in loss.groupBy("fold").agg(F.min_by("T", F.struct("loss", "T")).alias("T")).collect():
        out[r.fold] = r["T"]
    return out


def chances(df: DataFrame, ranker: Ranker, plan, min_events: int = 10) -> DataFrame:
    """(event, entity, season, ord, win, podium, p): each entry's share of exp(score / temperature) in its event, for events whose fold
    was fitted on at least `min_events`."""
    asked = scored(df, ranker).where(F.col("trained") >= min_events).withColumn("score", F.col("score") / F.col("temperature"))
    top = with_totals(asked, ["event"], plan, _top=F.max("score"))
    e = top.withColumn("_e", F.exp(F.col("score") - F.col("_top")))
    return with_totals(e, ["event"], plan, _all=F.sum("_e")).select("event", "entity", "season", "ord", "win", "podium", (F.col("_e") / F.col("_all")).alias("p"))
