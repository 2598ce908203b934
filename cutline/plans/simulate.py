"""Simulated finishing orders and the chances read from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cutline.functions.chance import gumbel, uniform
from cutline.operators.peers import pairs_of_two, with_totals
from cutline.operators.spans import Spans, numbered
from cutline.plans import order_counts
from cutline.session import stored

SEED = 20260923
FIELD = ("event", "entity")
_LARGEST_FIELD = 2048  # entries of an event that one task simulates
_BLOCK_CELLS = 1 << 23  # draws x entries of a block of draws
_BATCH_EVENTS = 512


def draw_orders(df: DataFrame, p: str, draws: int, seed: int = SEED, p_out: str | None = None, plan=None) -> DataFrame:
    """(event, entity, draw, position): Plackett-Luce orders by the Gumbel trick, a row for each entry and draw.

    Draws are exploded next to each entry and ranked per (event, draw), so a large
    event spreads over its draws. Every number comes from a counter, not a stream.
    With `p_out`, retirements are drawn too and place behind all who finish."""
    strength = F.log(F.greatest(F.col(p), F.lit(1e-12)))
    out = F.lit(False) if p_out is None else None
    drawn = df.select(*FIELD, strength.alias("_z"), *([F.col(p_out).alias("_q")] if p_out else []),
                      F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    if p_out is not None:
        out = uniform(F.col("event"), F.col("entity"), F.col("draw"), seed=seed + 1) < F.col("_q")
    key = F.col("_z") + gumbel(uniform(F.col("event"), F.col("entity"), F.col("draw"), seed=seed))
    keyed = drawn.select(*FIELD, "draw", out.alias("out"), F.when(out, 1e9).otherwise(-key).alias("_key"))
    spans = plan(keyed, ["event", "draw"], "_key") if plan else Spans(("event", "draw"), "_key")
    return numbered(keyed, spans, "position", ties=[F.col("entity")]).drop("_key")


_COUNTS = "event long, entity long, field long, blocks int, every array<long>, ended array<long>"


def _field_counts(df: DataFrame, p: str, draws: int, seed: int, p_out: str | None) -> DataFrame:
    """For events whose fields are known (`_field`) and fit a task: each entry's counts by place, of all draws and of those it
    finishes in. The draws of a larger field are cut into blocks, each a row of its own, whose counts are added up."""
    import pyarrow as pa

    # Rows of one event: at most _LARGEST_FIELD.
    of = df.groupBy("event").agg(F.array_sort(F.collect_list(F.struct("entity", F.col(p).cast("double").alias("p"), (F.col(p_out).cast("double") if p_out else F.lit(None).cast("double")).alias("q")))).alias("f"))
    size = F.size("f")
    blocks = F.when(size <= order_counts.BY_SETS, 1).otherwise(F.least(F.lit(draws), F.ceil(size * F.lit(draws) / F.lit(_BLOCK_CELLS)))).cast("int")
    asked = (of.select("event", F.transform("f", lambda e: e["entity"]).alias("entity"), F.transform("f", lambda e: e["p"]).alias("p"),
                       F.transform("f", lambda e: e["q"]).alias("q"), blocks.alias("blocks"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _BATCH_EVENTS):
                yield from counted(batch.slice(start, _BATCH_EVENTS))

    def counted(batch):
        events, blocks_, block = (batch.column(c).to_numpy() for c in ("event", "blocks", "block"))
        lists = {c: batch.column(c) for c in ("entity", "p", "q")}
        edges = lists["p"].offsets.to_numpy()
        flat = {c: lists[c].values.to_numpy(zero_copy_only=False) for c in lists}
        size = np.diff(edges)
        for n in np.unique(size).tolist():
            which = np.flatnonzero(size == n)
            if n <= order_counts.BY_SETS:
                at = edges[which][:, None] + np.arange(n)
                every, ended = order_counts.by_sets(seed, events[which], flat["p"][at].astype(float), flat["q"][at].astype(float) if p_out else None, draws)
                yield rows(events[which], flat["entity"][at], n, np.ones(len(which), np.int32), every, ended)
                continue
            for i in which.tolist():
                cut = slice(edges[i], edges[i + 1])
                share = draws // int(blocks_[i]) + (block[i] < draws % int(blocks_[i]))
                every, ended = order_counts.drawn(seed, int(events[i]), int(block[i]), flat["p"][cut].astype(float), flat["q"][cut].astype(float) if p_out else None, int(share))
                yield rows(events[i:i + 1], flat["entity"][cut][None], n, blocks_[i:i + 1], every[None], ended[None])

    def rows(event, entity, n, blocks_, every, ended):
        total = len(event) * n
        edges = np.arange(0, total * n + 1, n, dtype=np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x.ravel())) for x in (every, ended)]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(event, n)), pa.array(entity.ravel().astype(np.int64)), pa.array(np.full(total, n, np.int64)),
                                           pa.array(np.repeat(blocks_, n).astype(np.int32)), *lists], names=["event", "entity", "field", "blocks", "every", "ended"])

    found = asked.select(F.col("event").cast("long").alias("event"), F.col("entity").cast("array<long>").alias("entity"), "p", "q", "blocks", "block").mapInArrow(run, _COUNTS)
    return found


def order_counts_of(df: DataFrame, p: str, draws: int, plan, seed: int = SEED, p_out: str | None = None) -> DataFrame:
    """(event, entity, field, every, ended): in how many of `draws` simulated orders each entry takes each place, and in how many
    it does so and finishes. Fields of at most `order_counts.BY_SETS` are drawn by sets; those beyond _LARGEST_FIELD
    are ranked row by row, so no event is gathered that a task can't hold. Rows that repeat an entry are one, its strongest."""
    out = [F.max(F.col(p_out).cast("double")).alias("_q")] if p_out else []
    single = df.groupBy(*FIELD).agg(F.max(F.col(p).cast("double")).alias("_p"), *out)
    sized = stored(with_totals(single, ["event"], plan, _field=F.count("*")), "fields")
    found = stored(_field_counts(sized.where(F.col("_field") <= _LARGEST_FIELD), "_p", draws, seed, "_q" if p_out else None), "order-counts")
    whole = found.where("blocks = 1").drop("blocks")
    if found.where("blocks > 1").limit(1).count():
        added = (found.where("blocks > 1").select(*FIELD, "field", F.posexplode(F.arrays_zip("every", "ended")).alias("at", "c"))
                 .groupBy(*FIELD, "field", "at").agg(F.sum("c.every").alias("every"), F.sum("c.ended").alias("ended")))
        ordered = F.array_sort(F.collect_list(F.struct("at", "every", "ended")))
        whole = whole.unionByName(added.groupBy(*FIELD, "field").agg(ordered.alias("c")).select(
            *FIELD, "field", F.transform("c", lambda c: c["every"]).alias("every"), F.transform("c", lambda c: c["ended"]).alias("ended")))
    large = sized.where(F.col("_field") > _LARGEST_FIELD)
    if large.limit(1).count():
        placed = draw_orders(large, "_p", draws, seed, "_q" if p_out else None, plan).groupBy(*FIELD, "position").agg(F.count("*").alias("c"), F.count_if(~F.col("out")).alias("e"))
        maps = placed.groupBy(*FIELD).agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct("c", "e")))).alias("m"))
        sizes = large.select(*FIELD, F.col("_field").alias("field"))

        def at_places(c: str) -> Column:
            return F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("field")), lambda k: F.coalesce(F.try_element_at("m", k)[c], F.lit(0).cast("long")))

        at = [at_places("c").alias("every"), at_places("e").alias("ended")]
        whole = whole.unionByName(maps.join(sizes, list(FIELD)).select(*FIELD, "field", *at))
    return whole


def position_distribution(df: DataFrame, p: str, draws: int, plan, seed: int = SEED) -> DataFrame:
    """Each entry's chance of every position, add-one smoothed: an array as long as the field."""
    counts = order_counts_of(df, p, draws, plan, seed)
    return counts.select(*FIELD, "field", F.transform("every", lambda c: (c + 1.0) / (draws + F.col("field"))).alias("distribution"))


def first_k(distribution: str, k: int) -> Column:
    return F.aggregate(F.slice(distribution, 1, k), F.lit(0.0), lambda a, x: a + x)


def marginals(df: DataFrame, distribution: str = "distribution") -> DataFrame:
    """Win, podium, top ten and expected position from the distribution."""
    expected = F.aggregate(F.transform(distribution, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return df.withColumns({"p_win": F.get(distribution, F.lit(0)), "p_podium": first_k(distribution, 3),
                           "p_top10": first_k(distribution, 10), "expected_position": expected})


def distribution_summary(df: DataFrame, distribution: str = "distribution", low: float = 0.1, high: float = 0.9) -> DataFrame:
    """The likeliest position, and the first ones whose running chance reaches a low and a high mark."""
    d = F.col(distribution)

    def reaches(q: float) -> Column:
        """One pass: the running chance, and how many positions it has stayed below the mark."""
        def step(s: Column, x: Column) -> Column:
            total = s["total"] + x
            return F.struct(total.alias("total"), (s["below"] + (total < q - 1e-9).cast("int")).alias("below"))

        return F.aggregate(d, F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("below")), step, lambda s: F.least(s["below"] + 1, F.size(d)))

    return df.withColumns({"mode": F.array_position(d, F.array_max(d)).cast("int"), "low": reaches(low), "high": reaches(high)})


def top_k_with_retirements(df: DataFrame, p: str, p_out: str, k: int, draws: int, plan, seed: int = SEED, name: str = "p_top") -> DataFrame:
    """Chance to be among the first k of those who finish."""
    counts = order_counts_of(df, p, draws, plan, seed, p_out)
    return counts.select(*FIELD, (F.aggregate(F.slice("ended", 1, k), F.lit(0).cast("long"), lambda a, c: a + c) / F.lit(draws)).alias(name))


def clamp(p: Column, at_least: Column, at_most: Column) -> Column:
    """Raise to one neighbour, then cap at the other."""
    return F.least(F.greatest(p, at_least), at_most)


def pair_odds(df: DataFrame, p: str) -> DataFrame:
    """Chance that the first of two mates beats the second: p_a / (p_a + p_b)."""
    pairs = pairs_of_two(df, ["event", "grp"], "entity", [p])
    return pairs.withColumn("p_ahead", F.col(f"{p}_a") / (F.col(f"{p}_a") + F.col(f"{p}_b")))


