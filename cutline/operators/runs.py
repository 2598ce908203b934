"""Pace over runs of laps: long runs within stints, and the softest compound first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cutline.operators.peers import exact_median, gaps_to_best, with_totals

ENTRY = ["event", "entity"]
STINT = [*ENTRY, "session", "stint"]


def clean_laps(laps: DataFrame) -> DataFrame:
    """Accurate laps under green with a time; unknown counts as not."""
    return laps.where("coalesce(accurate, false) AND coalesce(green, false) AND lap_ms IS NOT NULL")


def long_run_laps(clean: DataFrame, min_laps: int, plan, stint: Sequence[str] = STINT) -> DataFrame:
    """The laps of stints with at least `min_laps` clean laps. A lap without a stint belongs to none."""
    known = clean.where("session IS NOT NULL AND stint IS NOT NULL")
    return with_totals(known, stint, plan, _n=F.count("*")).where(F.col("_n") >= min_laps).drop("_n")


def practice_frame(laps: DataFrame, plan, min_laps: int = 5,
                   softest_first: Sequence[str] = ("SOFT", "MEDIUM", "HARD")) -> DataFrame:
    """Per entry: laps run, gap of its best lap, long-run laps and pace gap, compounds
    run, and the long-run gap on the softest compound it ran."""
    rank = F.coalesce(*[F.when(F.col("compound") == c, i) for i, c in enumerate(softest_first)])
    clean = clean_laps(laps).withColumn("_rank", rank)
    is_clean = F.coalesce("accurate", F.lit(False)) & F.coalesce("green", F.lit(False)) & F.col("lap_ms").isNotNull()
    counts = laps.withColumn("_rank", F.when(is_clean, rank)).groupBy(*ENTRY).agg(
        F.count("*").alias("practice_laps"), F.min(F.when(is_clean, F.col("lap_ms"))).alias("_best"),
        sum((F.coalesce(F.max(F.when(F.col("_rank") == i, 1)), F.lit(0)) for i in range(len(softest_first))), F.lit(0)).alias("_set"))
    paced = exact_median(long_run_laps(clean, min_laps, plan), ENTRY, "lap_ms", plan, "_pace", rows="practice_long_run_laps")
    dry = with_totals(clean.where("_rank IS NOT NULL"), ENTRY, plan, _softest=F.min("_rank"))
    soft = exact_median(long_run_laps(dry.where("_rank = _softest"), min_laps, plan), ENTRY, "lap_ms", plan, "_soft")
    out = counts.withColumn("practice_compounds", F.nullif("_set", F.lit(0))).drop("_set")
    for part in (paced, soft):
        out = out.join(part, ENTRY, "left")
    out = gaps_to_best(out, ["event"], {"_best": "practice_best_gap_ms", "_pace": "practice_long_run_gap_ms",
                                        "_soft": "practice_softest_long_run_gap_ms"}, plan)
    return out.withColumn("practice_long_run_laps", F.coalesce("practice_long_run_laps", F.lit(0))).drop(
        "_best", "_pace", "_soft")
