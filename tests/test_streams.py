"""Streams with state: any order of arrival, many small batches, and hot keys give what a batch gives."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cutline.streaming import streams

START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


def in_files(spark, rows, schema, files, path):
    """Rows as a folder of several files, to be read one file a batch in their order."""
    size = -(-len(rows) // files)
    for n in range(files):
        spark.createDataFrame(rows[n * size:(n + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return streams.read_stream(spark, path, spark.read.parquet(path), files_per_batch=1)


def shuffled(rows, seed):
    """Rows out of order by at most about ten places."""
    draw = random.Random(seed)
    return [r for _, r in sorted(((i + draw.uniform(0, 10), r) for i, r in enumerate(rows)), key=lambda x: x[0])]


@pytest.mark.parametrize("slice_ms", [1, 3_600_000, 86_400_000])
def test_rates_of_a_hot_key_in_many_batches(spark, tmp_path, slice_ms):
    draw = random.Random(1)
    rows = [(e, i, 1 if draw.random() < 0.6 else 2, float(draw.random() < 0.4), at(e)) for e in range(120) for i in range(3)]
    want, wins, starts = {}, {1: 0, 2: 0}, {1: 0, 2: 0}
    for e in range(120):
        some = [r for r in rows if r[0] == e]
        want |= {(e, r[1]): (wins[r[2]] + 1) / (starts[r[2]] + 20) for r in some}
        for r in some:
            wins[r[2]] += r[3]
            starts[r[2]] += 1
    schema = "event bigint, entity bigint, grid bigint, won double, ts timestamp"
    path = str(tmp_path / "in")
    stream = in_files(spark, shuffled(rows, 2), schema, 8, path)
    end = spark.createDataFrame([(-1, -1, -1, 0.0, at(10**6))], schema)
    out = streams.run_to_table(streams.predict_then_learn(stream, "grid", "ts", "30 hours", slice_ms), "t", closing=(path, end))
    got = {(r.event, r.entity): r.p for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_rows_become_final_whatever_their_order(spark, tmp_path):
    draw = random.Random(3)
    rows = [(k, v, at(h), at(24 + k)) for k in range(12) for v, h in enumerate(sorted(draw.uniform(0, 50) for _ in range(draw.randrange(1, 7))))]
    rows.sort(key=lambda r: r[2])
    schema = "k bigint, v bigint, arrived timestamp, closes timestamp"
    path = str(tmp_path / "in")
    stream = in_files(spark, shuffled(rows, 4), schema, 6, path)
    end = spark.createDataFrame([(-1, -1, at(10**6), at(0))], schema)
    out = streams.run_to_table(streams.provisional(stream, "k", "arrived", "closes", ["v"], "60 hours"), "t", closing=(path, end)).where("key >= 0")
    got = [(r.key, r.kind, r.row) for r in out.collect()]
    shown = [(k, f'{{"v":{v}}}', a, c) for k, v, a, c in rows]
    want = [(k, "late" if a > c else "provisional", r) for k, r, a, c in shown]
    for key in range(12):
        inside = [(a, r) for k, r, a, c in shown if k == key and a <= c]
        want += [(key, "final", max(inside)[1])] if inside else []
    assert sorted(got) == sorted(want)


def test_keys_share_the_states_that_make_rows_final(spark, tmp_path, monkeypatch):
    """No state is kept for each key: few of them are asked, however many keys there are; a key may come again in a later part."""
    monkeypatch.setattr(streams, "_HELD_ROWS", 7)
    rows = [(k, v, at(5 * v + k % 3), at(12 if k % 2 else 13)) for v in range(4) for k in range(60)]
    schema = "k bigint, v bigint, arrived timestamp, closes timestamp"
    path = str(tmp_path / "in")
    stream = in_files(spark, rows, schema, 3, path)
    end = spark.createDataFrame([(-1, -1, at(10**6), at(0))], schema)
    found = streams.provisional(stream, "k", "arrived", "closes", ["v"], "60 hours", shares=4)
    out = streams.run_to_table(found, "shared", closing=(path, end)).where("key >= 0").collect()
    assert {r.key: r.row for r in out if r.kind == "final"} == {k: f'{{"v":{max(v for kk, v, a, c in rows if kk == k and a <= c)}}}' for k in range(60)}
    assert sum(r.kind == "final" for r in out) == 60 and sum(r.kind == "late" for r in out) == sum(a > c for _, _, a, c in rows)


def test_the_effective_revision_waits_for_its_deadline_and_moves_with_it(spark, tmp_path):
    draw = random.Random(5)
    revisions = sorted(((k, n, at(5 * n + draw.uniform(0, 4))) for k in range(10) for n in range(draw.randrange(1, 9))), key=lambda r: r[2])
    first = {k: at(8 + draw.uniform(0, 20)) for k in range(10)}
    moved = {k: at(30 + draw.uniform(0, 20)) for k in range(0, 10, 2)}
    sent = [(k, first[k], at(0)) for k in first] + [(k, moved[k], at(1)) for k in moved]
    want = {}
    for k in range(10):
        due = moved.get(k, first[k])
        on_time = [(n, t) for key, n, t in revisions if key == k and t < due]
        if on_time:
            want[k] = (*max(on_time), due)
    paths = [str(tmp_path / n) for n in "ab"]
    schemas = "event bigint, revision bigint, ts timestamp", "event bigint, deadline timestamp, ts timestamp"
    made = in_files(spark, shuffled(revisions, 6), schemas[0], 5, paths[0])
    due = in_files(spark, shuffled(sent, 7), schemas[1], 3, paths[1])
    ends = [(paths[0], spark.createDataFrame([(-1, -1, at(10**6))], schemas[0])), (paths[1], spark.createDataFrame([(-1, at(10**6), at(10**6))], schemas[1]))]
    out = streams.run_to_table(streams.effective_revisions(made, due, "event", "ts", "30 hours"), "t", closing=ends).where("key >= 0")
    assert {r.key: (r.revision, r.made, r.deadline) for r in out.collect()} == want


def test_streams_of_no_rows(spark, tmp_path):
    schema = "k bigint, v bigint, arrived timestamp, closes timestamp"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), spark.read.schema(schema).parquet(str(tmp_path / "in")))
    assert streams.run_to_table(streams.provisional(stream, "k", "arrived", "closes", ["v"], "0 seconds"), "t").where(F.lit(True)).count() == 0


def test_upserts_read_only_their_buckets_and_equal_a_plain_fold(spark, tmp_path, monkeypatch):
    draw = random.Random(9)
    table = {k: (f"v{k % 5}", k * 1.0) for k in range(200)}
    batches = [{k: (draw.choice("ab"), float(draw.randrange(3))) for k in draw.sample(range(220), draw.choice([1, 2, 30]))} for _ in range(14)]
    schema = "k bigint, a string, b double"
    current = spark.createDataFrame([(k, *v) for k, v in table.items()], schema)
    path, log, now = str(tmp_path / "in"), [], dict(table)
    for some in batches:
        spark.createDataFrame([(k, *v) for k, v in some.items()], schema).coalesce(1).write.mode("append").parquet(path)
        for k, new in some.items():
            log += [(k, c, str(o), str(n)) for c, o, n in zip("ab", now.get(k, new), new, strict=True) if o != n]
            now[k] = new
    read = []
    plain = streams.Buckets.rows

    def watched(self, buckets, before=None):
        out = plain(self, buckets, before)
        read.append((set(buckets), out.inputFiles(), len(self.pending[next(iter(buckets), 0)])))
        return out

    monkeypatch.setattr(streams.Buckets, "rows", watched)
    stream = streams.read_stream(spark, path, current, files_per_batch=1)
    after, changes = streams.upsert_changes(stream, current, ["k"], ["a", "b"], "t", buckets=16, most=3)
    assert {r.k: (r.a, r.b) for r in after.collect()} == now
    assert sorted((r.k, r.column, r.left, r.right) for r in changes.collect()) == sorted(log)
    assert len(read) > 14
    for buckets, files, deltas in read:
        assert {int(f.split("bucket=")[1].split("/")[0]) for f in files} <= buckets and deltas <= 3


def test_upserts_into_no_rows_and_of_no_rows(spark, tmp_path):
    schema = "k bigint, a string"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, "x"), (1, "y")], schema)
    one.write.parquet(str(tmp_path / "one"))
    none.write.parquet(str(tmp_path / "none"))
    table, _ = streams.upsert_changes(streams.read_stream(spark, str(tmp_path / "one"), one), none, ["k"], ["a"], "t")
    assert [tuple(r) for r in table.collect()] == [(1, "y")]
    table, _ = streams.upsert_changes(streams.read_stream(spark, str(tmp_path / "none"), none), one.where("a = 'x'"), ["k"], ["a"], "t")
    assert [tuple(r) for r in table.collect()] == [(1, "x")]


class Kept:
    """A state map that counts what is written to it."""

    def __init__(self):
        self.held, self.written = {}, 0

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value
        self.written += len(str(value[0]))

    def removeKey(self, key):
        del self.held[key]


def test_waiting_rows_are_not_written_again_when_more_arrive():
    """Forty arrivals in one slice write about forty times what one does, not eight hundred times."""
    import pandas as pd

    class Handle:
        maps, timers = {}, []

        def getMapState(self, name, *_):
            return self.maps.setdefault(name, Kept())

        def getValueState(self, *_):
            class One:
                value = None
                exists = lambda self: self.value is not None
                get = lambda self: self.value

                def update(self, value):
                    self.value = value

            return One()

        def registerTimer(self, at):
            self.timers.append(at)

    class Expired:
        def getExpiryTimeInMs(self):
            return 86_400_000

    handle, state = Handle(), streams.PredictThenLearn(86_400_000)
    state.init(handle)
    sizes = []
    for n in range(40):
        some = pd.DataFrame({"event": range(100 + n, 110 + n), "entity": range(10), "slot": 1, "won": 1.0, "ts": pd.Timestamp(3_600_000_000_000)})
        list(state.handleInputRows((1,), iter([some]), None))
        sizes.append(handle.maps["waiting"].written)
    assert handle.timers == [86_400_000] and sizes[-1] < 45 * sizes[0]
    (out,) = state.handleExpiredTimer((1,), None, Expired())
    assert len(out) == 400 and out.event.is_monotonic_increasing and not handle.maps["waiting"].held
    assert out.p.iloc[0] == 1 / 20 and out[out.event == 101].p.tolist() == [2 / 21] * 2
