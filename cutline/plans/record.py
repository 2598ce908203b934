"""The record of what was predicted: deadlines, revisions, audits, scores, published documents."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from cutline.operators.spans import Right, expanding, latest_before
from cutline.plans.evaluate import defined_log_loss, score_events
from cutline.plans.features import POST, PRACTICE, PRE

# The names of an event's sessions.
SPRINT, SPRINT_QUALIFYING, QUALIFYING, RACE = "Sprint", "Sprint Qualifying", "Qualifying", "Race"
POINTERS = ("superseded_by", "superseded_reason")


def deadlines(sessions: DataFrame) -> DataFrame:
    """(event, snapshot, deadline, refused): before the first session, before the first
    qualifying, before the race. A deadline that would have to be guessed is refused.

    `sessions`: event, session, starts_at, one row each."""
    def at(*names: str) -> Column:
        return F.min(F.when(F.col("session").isin(*names), F.col("starts_at")))

    per = sessions.groupBy("event").agg(
        F.min("starts_at").alias("first"), at(SPRINT).alias("sprint"), at(SPRINT_QUALIFYING).alias("sq"),
        at(QUALIFYING).alias("quali"), at(RACE).alias("race"), at(SPRINT_QUALIFYING, QUALIFYING, SPRINT).alias("firsts"))
    unsure = F.col("sprint").isNotNull() & F.col("sq").isNull() & (F.col("quali") > F.col("sprint"))
    practice = F.when(F.coalesce(unsure, F.lit(False)), "sprint qualifying time missing").when(
        F.col("firsts").isNull(), "no qualifying time")
    row = [F.struct(F.lit(PRE).alias("snapshot"), F.col("first").alias("deadline"), F.lit(None).cast("string").alias("refused")),
           F.struct(F.lit(PRACTICE).alias("snapshot"), F.when(practice.isNull(), F.col("firsts")).alias("deadline"), practice.alias("refused")),
           F.struct(F.lit(POST).alias("snapshot"), F.col("race").alias("deadline"),
                    F.when(F.col("race").isNull(), "no race time").alias("refused"))]
    return per.select("event", F.explode(F.array(*row)).alias("d")).select("event", "d.*")


def mark_revisions(revisions: DataFrame, deadline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every revision with whether it was late, and whether it is the one that counts: the
    latest one generated strictly before the deadline."""
    timed = revisions.join(deadline.select(*keys, "deadline"), list(keys), "left")
    late = timed.withColumn("late", F.col("generated_at") >= F.col("deadline"))
    counts = late.where("NOT late").groupBy(*keys).agg(F.max("revision").alias("_effective"))
    return late.join(counts, list(keys), "left").withColumn(
        "effective", F.coalesce(F.col("revision") == F.col("_effective"), F.lit(False))).drop("_effective")


def audit_links(revisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Breaks in a chain of revisions. `revisions`: keys, revision, name, supersedes,
    superseded_by, reason. Neighbours meet by an equality join, so a long chain is no window."""
    after = revisions.select(*keys, (F.col("revision") - 1).alias("revision"), F.col("name").alias("_next"),
                             F.col("supersedes").alias("_back"), F.col("reason").alias("_why"))
    last = revisions.groupBy(*keys).agg(F.max("revision").alias("_last"), F.count("*").alias("_n"), F.min("revision").alias("_first"))
    linked = revisions.join(after, [*keys, "revision"], "left").join(last, list(keys))
    is_last = F.col("revision") == F.col("_last")
    problems = F.array_compact(F.array(
        F.when((F.col("revision") == F.col("_first")) & ((F.col("_first") != 1) | (F.col("_last") != F.col("_n"))), "revisions are not 1..n"),
        F.when(F.col("_next").isNotNull() & ~F.col("superseded_by").eqNullSafe(F.col("_next")), "wrong superseded_by"),
        F.when(F.col("_next").isNotNull() & ~F.col("_back").eqNullSafe(F.col("name")), "successor does not point back"),
        F.when(F.col("_next").isNotNull() & (F.coalesce(F.trim("_why"), F.lit("")) == ""), "successor gives no reason"),
        F.when(is_last & F.col("superseded_by").isNotNull(), "latest revision claims to be superseded")))
    return linked.select(*keys, "revision", F.explode(problems).alias("problem"))


def content_digest(df: DataFrame, exclude: Sequence[str] = POINTERS) -> Column:
    """Digest of a row's content, its late pointers left out, columns in name order."""
    kept = [F.col(c) for c in sorted(df.columns) if c not in exclude]
    return F.sha2(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}), 256)


def audit_history(versions: DataFrame, plan) -> DataFrame:
    """Breaks of the append-only rule. `versions`: document, version, digest, superseded_by.
    Content must never change; the pointer may be set once and must then stay."""
    first = versions.groupBy("document").agg(F.min_by("digest", "version").alias("_first"))
    changed = versions.join(first, "document").where("digest <> _first").select(
        "document", "version", F.lit("content changed").alias("problem"))
    pointed = versions.where("superseded_by IS NOT NULL").select("document", "version", F.col("superseded_by").alias("_set"))
    read = latest_before(versions, [Right(pointed, ("_set",))], plan(versions, ["document"], "version"))
    moved = read.where("_set IS NOT NULL AND NOT (superseded_by <=> _set)").select(
        "document", "version", F.lit("pointer changed").alias("problem"))
    return changed.unionByName(moved)


def score_published(published: DataFrame, results: DataFrame, ledger: DataFrame, plan, series: Sequence[str] = ()) -> DataFrame:
    """Ledger entries for events not in the ledger yet. Predicted entities that did not start
    are dropped and the rest renormalised; a log loss that would be a floor is withheld.

    `published`: series, event, entity, p. `results`: event, entity, won, podium of starters."""
    keys = [*series, "event"]
    fresh = published.join(ledger.select(*keys), keys, "left_anti")
    started = fresh.join(results.select("event", "entity"), ["event", "entity"], "left_semi")
    return defined_log_loss(score_events(started, results, plan, series))


def track_record(entries: DataFrame, series: Sequence[str], minimum: int = 4) -> DataFrame:
    """Per series, never pooled: mean log loss over the events that have one, the baseline's
    over the same events, how many were undefined; no means below `minimum` events."""
    paired = F.col("log_loss").isNotNull() & F.col("baseline_log_loss").isNotNull()
    # Compared as decimals: a tie is a tie, whatever the last bits of two sums.
    better = F.col("log_loss").cast("decimal(18,9)") < F.col("baseline_log_loss").cast("decimal(18,9)")
    out = entries.groupBy(*series).agg(
        F.count("*").alias("events"), F.count("log_loss").alias("defined"),
        F.avg("log_loss").alias("_mean"), F.avg(F.when(paired, F.col("baseline_log_loss"))).alias("_bar"),
        F.count(F.when(paired & better, 1)).alias("model_better"))
    enough = F.col("events") >= minimum
    return out.select(*series, "events", (F.col("events") - F.col("defined")).alias("undefined"), "model_better",
                      F.when(enough, F.col("_mean")).alias("mean_log_loss"), F.when(enough, F.col("_bar")).alias("baseline_log_loss"))


def documents(published: DataFrame, keys: Sequence[str], columns: Sequence[str], by: str) -> DataFrame:
    """One JSON document per key with its entries in order. An entry list is as long as a field."""
    row = F.struct(F.col(by).alias("_by"), *columns)
    gathered = published.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    entries = F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in columns]))
    return gathered.select(*keys, F.to_json(F.struct(*keys, entries.alias("entries"))).alias("document"))


def declared_absences(predicted: DataFrame, started: DataFrame) -> DataFrame:
    """Starters without a prediction, and predicted entities that did not start."""
    a, b = predicted.select("event", "entity").distinct(), started.select("event", "entity").distinct()
    held = b.join(a.select("event").distinct(), "event", "left_semi")
    return held.join(a, ["event", "entity"], "left_anti").withColumn("kind", F.lit("unpredicted starter")).unionByName(
        a.join(b, ["event", "entity"], "left_anti").withColumn("kind", F.lit("predicted non-starter")))


def preferred_snapshot(published: DataFrame) -> DataFrame:
    """The latest snapshot published per event."""
    rank = F.when(F.col("snapshot") == POST, 0).when(F.col("snapshot") == PRACTICE, 1).otherwise(2)
    return published.groupBy("event").agg(F.min_by("snapshot", rank).alias("snapshot"))


TOLERANCE = 1e-6


def document_violations(df: DataFrame) -> DataFrame:
    """Problems of published predictions: (event, problem, rows). `df`: event, entity, p_win,
    p_podium, p_top10, distribution."""
    size = F.count("*")
    per_event = df.groupBy("event").agg(
        size.alias("n"), F.sum("p_win").alias("w"), F.sum("p_podium").alias("d"), F.sum("p_top10").alias("t"))
    unique = df.groupBy("event", "entity").agg(size.alias("c")).where("c > 1").groupBy("event").agg(size.alias("rows"))
    total = F.aggregate("distribution", F.lit(0.0), lambda a, x: a + x)
    rows = df.join(per_event.select("event", "n"), "event").select("event", F.explode(F.array_compact(F.array(
        F.when(F.col("p_win") > F.col("p_podium") + TOLERANCE, "win above podium"),
        F.when(F.col("p_podium") > F.col("p_top10") + TOLERANCE, "podium above top ten"),
        F.when(F.size("distribution") != F.col("n"), "distribution length"),
        F.when(F.abs(total - 1) > TOLERANCE, "distribution sum")))).alias("problem"))
    sums = per_event.select("event", F.explode(F.array_compact(F.array(
        F.when(F.abs(F.col("w") - 1) > TOLERANCE, "win sum"),
        F.when(F.abs(F.col("d") - F.least(F.lit(3), F.col("n"))) > TOLERANCE, "podium sum"),
        F.when(F.abs(F.col("t") - F.least(F.lit(10), F.col("n"))) > TOLERANCE, "top ten sum")))).alias("problem"))
    found = rows.unionByName(sums).groupBy("event", "problem").agg(size.alias("rows"))
    return found.unionByName(unique.select("event", F.lit("entity appears twice").alias("problem"), "rows"))


def partly_filled(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Groups where an optional column is set on some rows only; it is all or none."""
    return df.groupBy(*keys).agg(F.count(column).alias("filled"), F.count("*").alias("rows")).where("filled <> 0 AND filled <> rows")


def undefined_rule_violations(scores: DataFrame) -> DataFrame:
    """A log loss is null exactly where a reason is given, and such an event is no winner hit."""
    return scores.where("(log_loss IS NULL) <> (undefined IS NOT NULL) OR (undefined IS NOT NULL AND winner_hit > 0)")


def reference_violations(published: DataFrame, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Ids in published documents that no reference table has: (column, value)."""
    out = None
    for column, (table, key) in references.items():
        bad = published.select(F.col(column).cast("string").alias("value")).distinct().join(
            table.select(F.col(key).cast("string").alias("value")).distinct(), "value", "left_anti").select(
            F.lit(column).alias("column"), "value")
        out = bad if out is None else out.unionByName(bad)
    return out


def venue_facts(entries: DataFrame, events: DataFrame, plan_events) -> DataFrame:
    """Per event, what happened at its venue before: events, first and last season, and how
    often slot one started and won. Nothing is made up where there is no history."""
    per = entries.groupBy("event").agg(
        F.max((F.col("grid") == 1).cast("int")).alias("_front"),
        F.max(((F.col("grid") == 1) & (F.col("finish") == 1)).cast("int")).alias("_won"))
    dated = events.select("event", "ord", "venue", "season").join(per, "event", "left")
    held = F.col("_front").isNotNull()
    out = expanding(dated, plan_events(dated, ["venue"], "ord"), {
        "prior_events": ("sum", held.cast("bigint")), "first_season": ("min", F.when(held, F.col("season"))),
        "last_season": ("max", F.when(held, F.col("season"))), "_f": ("sum", F.col("_front")), "_w": ("sum", F.col("_won"))})
    some = F.col("prior_events") > 0
    return out.select("event", "venue", "prior_events", "first_season", "last_season",
                      F.when(some, F.col("_f")).alias("front_events"), F.when(some, F.col("_w")).alias("front_wins"))


def schedule_rows(events: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """(event, key, season, round, venue, state): every event with the key it is served under. One that has results keeps its own; one that
    has none yet gets a provisional key from its season and round, which no real event can have, and is `upcoming`, or `missing` if it
    should have been held. Of several without results in one round each has a place of its own, by `ord`."""
    held = results.select("event").distinct().withColumn("_held", F.lit(True))
    tagged = events.join(held, "event", "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("season", "round", "_held").orderBy("ord"))  # events of one round
    provisional = -(F.col("season") * 100_000_000 + F.col("round") * 1_000_000 + place)
    state = F.when(F.col("_held"), "completed").when(F.col("starts_at") > as_of, "upcoming").otherwise("missing")
    return tagged.select("event", F.when(F.col("_held"), F.col("event")).otherwise(provisional).cast("bigint").alias("key"), "season", "round", "venue", state.alias("state"))


def summary(tables: dict[str, DataFrame], season: str = "season") -> DataFrame:
    """(table, rows, first_season, last_season): one aggregate a table; seasons are null where a table has none."""
    out = None
    for name, df in tables.items():
        of = F.col(season).cast("bigint") if season in df.columns else F.lit(None).cast("bigint")
        row = df.agg(F.count("*").alias("rows"), F.min(of).alias("first_season"), F.max(of).alias("last_season")).select(F.lit(name).alias("table"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def full_documents(keys: Sequence[str], values: DataFrame, lists: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One JSON document per row of `values` (keys and single values), with lists of rows of other tables under their names, ordered by
    their columns. A key without rows in a table has an empty list. A list is as long as what one document shows."""
    out, singles = values, [c for c in values.columns if c not in keys]
    for name, (df, columns) in lists.items():
        gathered = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(f"_{name}"))
        kind = gathered.schema[f"_{name}"].dataType.simpleString()
        out = out.join(gathered, list(keys), "left").withColumn(name, F.coalesce(f"_{name}", F.array().cast(kind))).drop(f"_{name}")
    return out.select(*keys, F.to_json(F.struct(*keys, *singles, *lists)).alias("document"))


_LIST_PART = 1000  # about as many items of a shared list lie in one document


def shared_list_documents(keys: Sequence[str], items: DataFrame, name: str, columns: Sequence[str], part_items: int = _LIST_PART) -> DataFrame:
    """(keys, part, document): a list that all documents of a key share, as documents of its own beside them instead of a copy in each.
    A long list lies in several parts, so neither rows nor text grow with documents x items."""
    sizes = items.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(part_items)).cast("int").alias("_parts"))
    dealt = items.join(sizes, list(keys)).withColumn("part", F.pmod(F.xxhash64(*columns), F.col("_parts")).cast("int"))
    gathered = dealt.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))  # about part_items
    return gathered.select(*keys, "part", F.to_json(F.struct(*keys, "part", name)).alias("document"))


def current_state(events: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """One row: the last event with results and the next one still to run."""
    held = results.select("event").distinct().withColumn("_held", F.lit(True))
    tagged = events.join(held, "event", "left")
    return tagged.agg(F.max_by("event", F.when(F.col("_held"), F.col("ord"))).alias("last_event"),
                      F.min_by("event", F.when(F.col("_held").isNull() & (F.col("starts_at") > as_of), F.col("ord"))).alias("next_event"))


def append_new(spark, df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Append the rows whose key the table does not hold yet; return how many. What is
    there is never rewritten."""
    try:
        held = spark.read.schema(df.schema).parquet(path).select(*keys).distinct()
        fresh = df.join(held, list(keys), "left_anti")
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        fresh = df
    from cutline.session import cut_lineage

    fresh = cut_lineage(fresh)
    count = fresh.count()
    if count:
        fresh.write.mode("append").parquet(path)
    return count


def write_once(df: DataFrame, path: str) -> None:
    """Write a result that may exist once; a second write is refused."""
    df.write.mode("errorifexists").parquet(path)


def publish(df: DataFrame, path: str, batch: str, guards: dict[str, Column]) -> int:
    """Publish rows as a batch, or nothing: the guards (conditions that no row may meet) are counted by the write itself, in one visit
    of the rows. The batch is listed, and so seen by `published`, only if none was met; else an error names those that were. An
    unknown condition is not met. A batch that is listed already is refused. Returns the number of rows."""
    spark, seen = df.sparkSession, Observation()
    if not _listed(spark, path).where(F.col("batch") == batch).isEmpty():
        raise ValueError(f"batch {batch} is published already")
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"g{i}") for i, c in enumerate(guards.values())]
    attempt = uuid.uuid4().hex
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.parquet(f"{path}/rows/attempt={attempt}")
    found = seen.get
    broken = {name: found[f"g{i}"] for i, name in enumerate(guards) if found[f"g{i}"]}
    if broken:
        raise ValueError(f"batch {batch} is not published: " + ", ".join(f"{n} ({k} rows)" for n, k in broken.items()))
    spark.createDataFrame([(batch, attempt, found["rows"])], _BATCHES).coalesce(1).write.mode("append").parquet(f"{path}/batches")
    return found["rows"]


_BATCHES = "batch string, attempt string, rows bigint"


def _listed(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(_BATCHES).parquet(f"{path}/batches")
    except AnalysisException:  # nothing published yet
        return spark.createDataFrame([], _BATCHES)


def published(spark, path: str, schema) -> DataFrame:
    """The rows of all published batches, with their batch. Rows of refused attempts are not read."""
    listed = _listed(spark, path).collect()  # one row a batch
    out = None
    for r in listed:
        rows = spark.read.schema(schema).parquet(f"{path}/rows/attempt={r.attempt}").withColumn("batch", F.lit(r.batch))
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], schema).withColumn("batch", F.lit("")) if out is None else out


def require_inputs(features: DataFrame, timed: str, needed: Sequence[str], minimum: int = 10) -> None:
    """Refuse to publish events whose inputs are missing, instead of filling them in."""
    per = features.groupBy("event").agg(F.count("*").alias("n"), F.count(timed).alias("timed"),
                                        *[F.count(c).alias(f"_{c}") for c in needed])
    short = F.col("timed") < F.greatest(F.lit(minimum), F.floor(F.col("n") / 2))
    missing = F.lit(False)
    for c in needed:
        missing = missing | (F.col(f"_{c}") < F.col("n"))
    bad = per.where(short | missing).limit(5).collect()
    if bad:
        raise ValueError(f"inputs missing for events {[r['event'] for r in bad]}")


def upcoming_rows(rows: DataFrame, history: DataFrame, ids: DataFrame, provisional: int) -> DataFrame:
    """History plus the rows of an event that has not run, under a provisional key. No id is
    minted: a reference without one is refused. The inputs are not changed."""
    unknown = rows.join(ids, "ref", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"references without a reviewed id: {[r['ref'] for r in unknown]}")
    if history.where(F.col("event") == provisional).limit(1).count():
        raise ValueError(f"event {provisional} already has rows")
    keyed = rows.join(ids, "ref").drop("ref").withColumn("event", F.lit(provisional).cast(dict(history.dtypes)["event"]))
    repeated = keyed.groupBy("entity").count().where("count > 1").limit(1).count()
    if repeated:
        raise ValueError("an entity appears twice in the event")
    return history.unionByName(keyed, allowMissingColumns=True)


