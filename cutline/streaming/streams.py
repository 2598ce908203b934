"""Structured Streaming forms of the batch operators. Each gives, once its input is through,
what the batch operator gives on the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from cutline.operators.diff import diff_cells
from cutline.session import checkpoint_root


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one stream's progress and output, in the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    """The Parquet files of a folder (those matching a pattern) as a stream, with the schema of
    a batch read of them."""
    reader = spark.readStream.schema(like.schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(df: DataFrame, name: str, mode: str = "append", closing: tuple[str, DataFrame] | list[tuple[str, DataFrame]] | None = None) -> DataFrame:
    """Run a stream over all input there is, into Parquet, and read it back. State is kept in RocksDB, on disk, which custom
    processors need and large state wants; the session's own choice of state store is restored.

    `closing`, a folder that the stream reads and rows to add to it at the end, ends the input: rows later than all others
    move the watermark past them, so nothing stays open. A stream of several inputs has one for each."""
    spark = df.sparkSession
    folder = work_folder(spark, name)
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        for last in (False, True) if closing else (True,):
            if closing and last:
                for into, rows in closing if isinstance(closing, list) else [closing]:
                    rows.write.mode("append").parquet(into)
            q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option(
                "checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


# ----------------------------------------------------------- incremental upsert
class Buckets:
    """A table that is upserted: hash buckets of its key, each with a compacted part and the rows of later batches.

    `compacted/upto=<batch>/bucket=<b>` holds a bucket as it was after a batch, `delta/batch_id=<batch>/bucket=<b>` the rows that a batch
    brought. What stands in a bucket is the newest row of each key among its last compacted part and the deltas after it. A bucket
    is compacted when `most` deltas lie on it; nothing is changed in place, so a batch that is repeated after a failure writes its
    own folders again and reads none of them."""

    def __init__(self, spark: SparkSession, folder: str, like: DataFrame, keys: Sequence[str], buckets: int, most: int):
        self.spark, self.folder, self.keys, self.buckets, self.most = spark, folder, list(keys), buckets, most
        self.columns, self.schema = like.columns, like.schema
        self.upto = dict.fromkeys(range(buckets), -1)
        self.pending = {b: set() for b in range(buckets)}

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def _read(self, kind: str, paths: list[str]) -> DataFrame:
        """Folders of buckets, with the batch that wrote them."""
        number = "upto" if kind == "compacted" else "batch_id"
        schema = StructType([*self.schema.fields, StructField("bucket", LongType()), StructField(number, LongType())])
        if not paths:
            return self.spark.createDataFrame([], schema).withColumnRenamed(number, "_batch")
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*paths).withColumnRenamed(number, "_batch")

    def rows(self, buckets: Sequence[int], before: int | None = None) -> DataFrame:
        """The newest row of each key of some buckets, before a batch or now, and no other file is read."""
        compacted = [f"{self.folder}/compacted/upto={self.upto[b]}/bucket={b}" for b in buckets if (b, self.upto[b]) in self.written]
        deltas = [f"{self.folder}/delta/batch_id={n}/bucket={b}" for b in buckets for n in sorted(self.pending[b]) if before is None or n < before]
        both = self._read("compacted", compacted).unionByName(self._read("delta", deltas))
        return both.groupBy(*self.keys).agg(F.max_by(F.struct(*self.columns), "_batch").alias("_r")).select("_r.*")

    def _write(self, rows: DataFrame, path: str) -> list[int]:
        """Write rows by bucket; which buckets have any."""
        held = rows.withColumn("bucket", self.bucket())
        held.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return sorted(r.bucket for r in self.spark.read.schema("bucket int").parquet(path).select("bucket").distinct().collect())  # at most `buckets`

    def start(self, table: DataFrame) -> None:
        self.written = {(b, -1) for b in self._write(table, f"{self.folder}/compacted/upto=-1")}

    def add(self, rows: DataFrame, batch_id: int) -> list[int]:
        """The rows of a batch, one per key; the buckets they lie in."""
        touched = self._write(rows, f"{self.folder}/delta/batch_id={batch_id}")
        for b in touched:
            self.pending[b].add(batch_id)
        return touched

    def compact(self, batch_id: int) -> None:
        """Write anew what has too many deltas, up to a batch."""
        due = [b for b, some in self.pending.items() if len(some) >= self.most]
        if due:
            for b in self._write(self.rows(due), f"{self.folder}/compacted/upto={batch_id}"):
                self.written.add((b, batch_id))
            for b in due:
                self.upto[b], self.pending[b] = batch_id, set()


def upsert_changes(stream: DataFrame, current: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, buckets: int = 32, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Apply a stream of re-fetched rows to a table, logging every cell that changed.

    A batch reads and compacts only the buckets of the key that it touches (`Buckets`). Of several rows of a key in one batch the
    greatest by the columns, in their order, counts. Each batch has its own folders, so a batch that is repeated after a
    failure replaces what it wrote.
    Returns the table after the stream, and the change log."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    log_schema = ", ".join(f"`{k}` {dict(current.dtypes)[k]}" for k in keys) + ", `column` string, `left` string, `right` string, batch_id bigint"
    table = Buckets(spark, folder, current, keys, buckets, most)
    table.start(current)

    def apply(batch: DataFrame, batch_id: int) -> None:
        others = [c for c in current.columns if c not in keys]
        one = batch.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_r")).select(*keys, "_r.*").select(*current.columns)
        touched = table.add(one, batch_id)
        latest = spark.read.schema(current.schema).parquet(f"{folder}/delta/batch_id={batch_id}")
        before = table.rows(touched, batch_id).join(latest.select(*keys), list(keys), "left_semi")
        diff_cells(before, latest, keys, columns).write.mode("overwrite").parquet(f"{folder}/log/batch_id={batch_id}")
        table.compact(batch_id)

    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return table.rows(range(buckets)), spark.read.schema(log_schema).parquet(f"{folder}/log")


# ------------------------------------------------------------ provisional window
def split_late(stream: DataFrame, arrived: str, happened: str, days: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows that arrive within the provisional window of what they describe, and later ones
    in a table of their own: nothing is dropped."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    is_late = F.col(arrived) > F.col(happened) + F.expr(f"INTERVAL {days} DAYS")

    def route(batch: DataFrame, batch_id: int) -> None:
        for kind, rows in (("on_time", batch.where(~is_late)), ("late", batch.where(is_late))):
            rows.write.mode("overwrite").parquet(f"{folder}/{kind}/batch_id={batch_id}")

    q = stream.writeStream.foreachBatch(route).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    read = spark.read.schema(stream.schema)
    return read.parquet(f"{folder}/on_time"), read.parquet(f"{folder}/late")


FINAL_OUT = "key bigint, kind string, arrived timestamp, row string"


class Provisional(StatefulProcessor):
    """A row per key that may be replaced until its window closes. The newest arrival within the window counts, whatever order rows
    come in; a timer at the end of the window makes it final. Rows that arrived later are given as late; nothing is dropped.

    A state holds a share of all keys, as one for each key would be asked and answered once a key. Whether rows are late is said of
    many at once, without any state. The best rows of keys wait in parts by the time at which their windows close, so nothing that
    waits is written again. The share has one timer, at the first of these times, which takes all that are due, some at a time. Memory
    is _HELD_ROWS keys, what closes at one time, and a number for each such time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "closes bigint, part bigint", "rows string")
        self.open = handle.getValueState("open", "timer bigint, parts string")

    def state(self) -> tuple[int | None, dict[int, int]]:
        """The timer that is set, and the number of parts that wait for each time."""
        timer, parts = self.open.get() if self.open.exists() else (None, "[]")
        return timer, dict(json.loads(parts))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, parts = self.state()
        held, n = [], 0
        for batch in rows:
            late = (batch["arrived"] > batch["closes"]) | (batch["closes"].isna() & batch["arrived"].notna())
            yield pd.DataFrame({"key": batch["key"], "kind": np.where(late, "late", "provisional"), "arrived": batch["arrived"], "row": batch["row"]})
            held.append(newest(batch[~late & batch["arrived"].notna()]))
            n += len(held[-1])
            if n >= _HELD_ROWS:
                self.keep(newest(pd.concat(held)), parts)
                held, n = [], 0
        if n:
            self.keep(newest(pd.concat(held)), parts)
        self.wake(timer, parts)

    def wake(self, timer: int | None, parts: dict[int, int]) -> None:
        """Set the timer to the first time that anything waits for."""
        first = min(parts, default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if first is None:
            self.open.clear()
        else:
            self.open.update((first, json.dumps(list(parts.items()))))

    def keep(self, rows: pd.DataFrame, parts: dict[int, int]) -> None:
        """Add a part to each time at which windows of these rows close."""
        at, closes = (rows[c].to_numpy("datetime64[us]").astype(np.int64) for c in ("arrived", "closes"))
        times, of = np.unique(closes // 1000 + 1, return_inverse=True)
        order = np.argsort(of, kind="stable")
        for time, some in zip(times.tolist(), np.split(order, np.flatnonzero(np.diff(of[order])) + 1), strict=True):
            self.waiting.updateValue((time, parts.get(time, 0)), (json.dumps([rows["key"].iloc[some].tolist(), at[some].tolist(), rows["row"].iloc[some].tolist()]),))
            parts[time] = parts.get(time, 0) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        _, parts = self.state()
        found, n = [], 0
        for time in sorted(t for t in parts if t <= now):
            for part in range(parts.pop(time)):
                keys, at, rows = json.loads(self.waiting.getValue((time, part))[0])
                found.append(pd.DataFrame({"key": keys, "arrived": np.asarray(at, "datetime64[us]").astype("datetime64[ns]"), "row": rows}))
                n += len(keys)
                self.waiting.removeKey((time, part))
            if n >= _HELD_ROWS:
                yield final(found)
                found, n = [], 0
        if n:
            yield final(found)
        self.wake(None, parts)

    def close(self) -> None:
        pass


def final(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return newest(pd.concat(parts)).assign(kind="final")[["key", "kind", "arrived", "row"]]


def newest(rows: pd.DataFrame) -> pd.DataFrame:
    """The last arrival of each key, of several at one time the greatest row."""
    return rows.sort_values(["arrived", "row"], kind="stable").drop_duplicates("key", keep="last")


def provisional(stream: DataFrame, key: str, arrived: str, closes: str, columns: Sequence[str], delay: str, shares: int = 16) -> DataFrame:
    """(key, kind, arrived, row): every accepted version of a key's row as `provisional`, the one that stands when its window closes
    as `final`, and what arrives after that as `late`. `row` is the columns as JSON; `closes` must be the same for all rows of a key.
    The watermark follows `arrived`, so a window closes once nothing that arrived within it can still come. Keys are dealt over `shares`
    states; rows without a key have one of their own."""
    rows = stream.select(F.col(key).cast("bigint").alias("key"), F.col(arrived).cast("timestamp").alias("arrived"), F.col(closes).cast("timestamp").alias("closes"),
                         F.to_json(F.struct(*columns)).alias("row"))
    dealt = rows.withColumn("share", F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(shares))).cast("bigint"))
    return dealt.withWatermark("arrived", delay).groupBy("share").transformWithStateInPandas(Provisional(), FINAL_OUT, outputMode="Append", timeMode="EventTime")


EFFECTIVE_OUT = "key bigint, revision bigint, made timestamp, deadline timestamp"


class Effective(StatefulProcessor):
    """Revisions and deadlines of a key, in any order of arrival. The deadline sent last counts; a timer at it gives the last revision
    made before it, if there is one, and forgets the key's rows. A key is closed by its deadline once; revisions and deadlines that
    come after that say nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.made = handle.getMapState("made", "at bigint, revision bigint", "seen boolean")
        self.deadline = handle.getValueState("deadline", "at bigint, sent bigint, given boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, sent, given = self.deadline.get() if self.deadline.exists() else (None, None, False)
        before = at
        for batch in rows:
            for r in batch.itertuples(index=False):
                made = int(pd.Timestamp(r.ts).value // 1000)
                if given:
                    continue
                if not pd.isna(r.revision):
                    self.made.updateValue((made, int(r.revision)), (True,))
                elif not pd.isna(r.deadline):
                    new = int(pd.Timestamp(r.deadline).value // 1000)
                    if sent is None or (made, new) > (sent, at):
                        at, sent = new, made
        if at is not None and at != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + 1)
            self.handle.registerTimer(at // 1000 + 1)
        if at is not None:
            self.deadline.update((at, sent, given))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, sent, given = self.deadline.get()
        if given:
            return
        best = max(((k[1], k[0]) for k in self.made.keys() if k[0] < at), default=None)
        self.made.clear()
        self.deadline.update((at, sent, True))
        if best is not None:
            yield pd.DataFrame([(key[0], best[0], pd.Timestamp(best[1] * 1000), pd.Timestamp(at * 1000))], columns=["key", "revision", "made", "deadline"])

    def close(self) -> None:
        pass


def effective_revisions(revisions: DataFrame, deadlines: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """(key, revision, made, deadline), a row when a key's deadline has passed: the greatest of its revisions made before the deadline.
    `revisions`: key, revision, time; `deadlines`: key, deadline and the same time, at which it was sent. Both are streams with
    watermarks of their own, and the slower one is waited for; a deadline may be moved by a later one until it has passed."""
    both = [s.select(F.col(key).cast("bigint").alias("key"), r.cast("bigint").alias("revision"), d.cast("timestamp").alias("deadline"), F.col(time).cast("timestamp").alias("ts")).withWatermark("ts", delay)
            for s, r, d in ((revisions, F.col("revision"), F.lit(None)), (deadlines, F.lit(None), F.col("deadline")))]
    return both[0].unionByName(both[1]).groupBy("key").transformWithStateInPandas(Effective(), EFFECTIVE_OUT, outputMode="Append", timeMode="EventTime")


# -------------------------------------------------------------- on-time revisions
def mark_stream(revisions: DataFrame, deadlines: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """Revisions marked late or not against static deadlines, repeats within the delay removed."""
    once = revisions.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, "revision"])
    return once.join(deadlines, list(keys), "left").withColumn("late", F.col(time) >= F.col("deadline"))


# -------------------------------------------------------------- windowed session counts
def session_counts(stream: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """Rows per session of activity: a gap longer than `gap` starts a new one."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(
        F.count("*").alias("rows")).select(key, F.col("w.start").alias("starts_at"), F.col("w.end").alias("ends_at"), "rows")


def slow_laps(stream: DataFrame, time: str, value: str, window: str, ratio: float, delay: str, group: str) -> DataFrame:
    """Per window and group: rows, total, slowest, and whether the slowest is at least `ratio`
    times the mean. Three numbers per window are all the state there is."""
    timed = stream.withWatermark(time, delay)
    return timed.groupBy(F.window(time, window).alias("w"), group).agg(
        F.count("*").alias("rows"), F.sum(value).alias("total"), F.max(value).alias("slowest")).select(
        group, F.col("w.start").alias("starts_at"), "rows", "total", "slowest",
        (F.col("slowest") >= ratio * F.col("total") / F.col("rows")).alias("suspended"))


# ------------------------------------------------------------------ predict, then learn
RATE_OUT = StructType([StructField("event", LongType()), StructField("entity", LongType()), StructField("slot", LongType()), StructField("p", DoubleType())])
RATING_OUT = StructType([StructField("event", LongType()), StructField("entity", LongType()), StructField("rating", DoubleType())])


_HELD_ROWS = 1 << 16  # rows that are cut into slices at once


class EventOrder(StatefulProcessor):
    """Rows of a key, taken in event-time order whatever order they arrive in.

    Rows wait in a map keyed by slice of time, `slice_ms` long, and part: what arrives later for a slice is a part of its own, so nothing
    that waits is written again. Each slice has a timer, which fires when the watermark has passed its end. Timers fire in order of
    time, so a timer takes one slice and nothing else is read: memory is one slice and _HELD_ROWS rows that arrive, however long the
    history of a key is or however much of it one batch brings."""

    def __init__(self, slice_ms: int = 1):
        self.slice_ms = slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice bigint, part bigint", "rows string")
        self.parts = handle.getMapState("parts", "slice bigint", "n bigint")

    def columns(self, rows: pd.DataFrame) -> list[np.ndarray]:
        """What is kept of the rows beside time, event and entity."""
        raise NotImplementedError

    def take(self, key, due: list[np.ndarray]) -> pd.DataFrame:
        """Rows of a slice as columns (time, event, entity and `columns`), sorted by them."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in rows:
            held.append(batch)
            n += len(batch)
            if n >= _HELD_ROWS:
                self.keep(pd.concat(held))
                held, n = [], 0
        if n:
            self.keep(pd.concat(held))
        return iter([])

    def keep(self, rows: pd.DataFrame) -> None:
        """Add a part to each slice that rows lie in."""
        at = rows["ts"].to_numpy("datetime64[ns]").astype(np.int64) // 1_000_000
        kept = [at, *[rows[c].to_numpy(np.int64) for c in ("event", "entity")], *self.columns(rows)]
        slices = at // self.slice_ms
        order = np.argsort(slices, kind="stable")
        edges = np.flatnonzero(np.diff(slices[order], prepend=slices[order[0]] - 1))
        for some in np.split(order, edges[1:]):
            slice_ = int(slices[some[0]])
            part = self.parts.getValue((slice_,))[0] if self.parts.containsKey((slice_,)) else 0
            if part == 0:
                self.handle.registerTimer((slice_ + 1) * self.slice_ms)
            self.parts.updateValue((slice_,), (part + 1,))
            self.waiting.updateValue((slice_, part), (json.dumps([c[some].tolist() for c in kept]),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slice_ = expiredTimerInfo.getExpiryTimeInMs() // self.slice_ms - 1
        found = []
        for part in range(self.parts.getValue((slice_,))[0]):
            found.append(json.loads(self.waiting.getValue((slice_, part))[0]))
            self.waiting.removeKey((slice_, part))
        self.parts.removeKey((slice_,))
        due = [np.concatenate(c) for c in zip(*found, strict=True)]
        order = np.lexsort(due[::-1])
        yield self.take(key, [c[order] for c in due])

    def close(self) -> None:
        pass


def by_event(due: list[tuple]) -> Iterator[list[tuple]]:
    """Runs of rows that share a time and an event."""
    return (list(g) for _, g in groupby(due, key=lambda r: r[:2]))


class PredictThenLearn(EventOrder):
    """Rate of success per slot: each event is predicted from the counts before it, then counted."""

    def __init__(self, slice_ms: int = 1, alpha: float = 1.0, places: int = 20):
        super().__init__(slice_ms)
        self.alpha, self.places = alpha, places

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counts = handle.getValueState("counts", "wins double, starts double")

    def columns(self, rows: pd.DataFrame) -> list[np.ndarray]:
        return [rows["won"].to_numpy(float)]

    def take(self, key, due: list[np.ndarray]) -> pd.DataFrame:
        at, event, entity, won = due
        wins, starts = self.counts.get() if self.counts.exists() else (0.0, 0.0)
        # The counts before a row's event are those before the event's first row.
        new = np.append(True, (at[1:] != at[:-1]) | (event[1:] != event[:-1]))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        before = np.append(0.0, np.cumsum(won))[first]
        p = (wins + before + self.alpha) / (starts + first + self.alpha * self.places)
        self.counts.update((wins + float(won.sum()), starts + len(won)))
        return pd.DataFrame({"event": event, "entity": entity, "slot": np.full(len(p), int(key[0])), "p": p})


class RatingFold(EventOrder):
    """Ratings of one pool, updated event by event."""

    def __init__(self, slice_ms: int = 1, k: float = 24.0, scale: float = 400.0, start: float = 1500.0):
        super().__init__(slice_ms)
        self.k, self.scale, self.start = k, scale, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ratings = handle.getMapState("ratings", "entity bigint", "rating double")

    def columns(self, rows: pd.DataFrame) -> list[np.ndarray]:
        return [rows["finish"].to_numpy(np.int64), rows["retired"].to_numpy(bool)]

    def take(self, key, due: list[np.ndarray]) -> pd.DataFrame:
        from cutline.plans.rules import elo_update

        due = list(zip(*[c.tolist() for c in due]))
        touched = {r[2] for r in due}
        now = {e: self.ratings.getValue((e,))[0] if self.ratings.containsKey((e,)) else self.start for e in touched}
        out = []
        for rows in by_event(due):
            out += [(r[1], r[2], now[r[2]]) for r in rows]
            order = [r[2] for r in sorted(rows, key=lambda r: r[3]) if not r[4]]
            now.update(zip(order, elo_update([now[e] for e in order], self.k, self.scale)))
        for e in touched:
            self.ratings.updateValue((e,), (now[e],))
        return pd.DataFrame(out, columns=["event", "entity", "rating"])


def predict_then_learn(stream: DataFrame, slot: str, time: str, delay: str, slice_ms: int = 1) -> DataFrame:
    """`stream`: event, entity, slot, won and an event time that orders events strictly. Rows of `slice_ms` are taken together."""
    rows = stream.select("event", "entity", F.col(slot).cast("bigint").alias("slot"), "won", F.col(time).alias("ts"))
    return rows.withWatermark("ts", delay).groupBy("slot").transformWithStateInPandas(
        PredictThenLearn(slice_ms), RATE_OUT, outputMode="Append", timeMode="EventTime")


def rating_stream(stream: DataFrame, pool: str, time: str, delay: str, slice_ms: int = 1) -> DataFrame:
    """`stream`: pool, event, entity, finish, retired and such an event time."""
    rows = stream.select(F.col(pool).alias("pool"), "event", "entity", "finish", "retired", F.col(time).alias("ts"))
    return rows.withWatermark("ts", delay).groupBy("pool").transformWithStateInPandas(
        RatingFold(slice_ms), RATING_OUT, outputMode="Append", timeMode="EventTime")
