"""Contamination against brute force, in one block of windows and in many, exact and by share."""

import hashlib
import math
import random

import pytest

from cutline.llm import decontaminate
from cutline.llm.words import words_of


def brute(docs, items, window, shingle, threshold):
    out = []
    for id_, text in docs:
        words, hit, named = words_of(None if text is None else text.encode()), set(), set()
        for item, body in items:
            own = words_of(None if body is None else body.encode())
            for start in range(max(1, len(own) - window + 1) if own else 0):
                w = own[start:start + window]
                k = min(shingle, len(w))
                need = max(1, math.ceil(threshold * (len(w) - k + 1) - 1e-9))
                for at in range(len(words) - len(w) + 1):
                    there = words[at:at + len(w)]
                    if there == w or sum(there[j:j + k] == w[j:j + k] for j in range(len(w) - k + 1)) >= need:
                        hit |= set(range(at, at + len(w)))
                        named |= {item} - {None}
        listed = ",".join(sorted(map(str, named)))
        out.append((id_, len(words), len(hit), len(named), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "threshold"), [(1 << 17, 1.0), (7, 1.0), (1 << 17, 0.6), (5, 0.6)])
def test_equals_brute_force(spark, block, threshold):
    rng = random.Random(8)
    vocabulary = [*"abcde", "é", "日本", "x1"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.choice([3, 6, 9]))) for i in range(8)] + [(20, None), (21, ""), (22, "!!"), (None, "e e d c"), (23, "A-b, C"), (23, "A-b, C"), (24, "zz")]
    docs = [(i, prose(rng.choice([0, 1, 2, 5, 40, 90]))) for i in range(40)] + [(100, None), (101, ""), (102, "zz ZZ"), (103, "a b c"), (103, "a b c"), (None, "a b c"), (104, items[0][1])]
    rows = spark.createDataFrame([(*d, "clash", 0) for d in docs], "doc_id long, text string, items string, n_words int").repartition(3)
    found = decontaminate.contamination(rows, spark.createDataFrame(items, "item_id long, text string"), window=6, shingle=2, threshold=threshold, block=block)
    assert sorted(map(tuple, decontaminate.digest(found).collect()), key=repr) == brute(docs, items, 6, 2, threshold)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontaminate.digest(decontaminate.contamination(docs, items.limit(0))).first()["contaminated"] is False
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def test_a_block_is_released_before_the_next(spark, monkeypatch):
    context, kind, alive, most = type(spark.sparkContext), decontaminate.Broadcast, set(), 0
    broadcast, destroy = context.broadcast, kind.destroy

    def send(self, value):
        nonlocal most
        sent = broadcast(self, value)
        alive.add(id(sent.value))
        most = max(most, len(alive))
        return sent

    def end(self, *args):
        alive.discard(id(self.value))
        destroy(self, *args)

    monkeypatch.setattr(context, "broadcast", send)
    monkeypatch.setattr(kind, "destroy", end)
    items = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i}") for i in range(8)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a1 b1 c1 d1 a5 b5 c5 d5"), (2, "a b")], "doc_id long, text string")
    found = {r["id"]: r for r in decontaminate.contamination(docs, items, window=4, block=3).collect()}
    assert found[1]["items"] == [1, 5] and found[1]["n_hit"] == 8 and found[2]["items"] == []
    assert most == 1 and len(alive) == 1
