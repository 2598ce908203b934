"""Reply trees against walking them one by one, and the template against its reader."""

import random

from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from cutline.llm import chat

PIECES = ["<|im_start|>", "<|im_end|>\n", "<", "|", "\\", "\n", "\\n", "a", "é🙂", "<\\|", "</s>[INST]", " "]


def brute(messages, top):
    by = {m[0]: m for m in messages}
    parents = {m[1] for m in messages}
    out = {}
    for leaf in by:
        if leaf in parents:
            continue
        path, seen = [leaf], {leaf}
        while by[path[-1]][1] in by:
            path.append(by[path[-1]][1])
            if path[-1] in seen:
                path = []
                break
            seen.add(path[-1])
        if path:
            out.setdefault(path[-1], []).append((-sum(by[i][2] for i in path) / len(path), leaf, path[::-1]))
    return {(p[1], root, n + 1): p[2] for root, paths in out.items() for n, p in enumerate(sorted(paths)[:top])}


def test_best_paths_equal_walking(spark):
    rng = random.Random(1)
    messages = []
    for i in range(400):
        parent = rng.choice([None, None, 99999, *range(max(0, i - 40), i)]) if i % 50 else None
        messages.append((i, parent, rng.choice([0.0, 0.5, 1.0, 2.0])))
    messages += [(1000 + i, 999 + i if i else None, 1.0) for i in range(130)]  # one long path
    messages += [(2000, 2002, 1.0), (2001, 2000, 1.0), (2002, 2001, 1.0), (2003, 2002, 1.0)]  # a cycle and what hangs on it
    messages += [(3000, None, 1.0), *((3001 + i, 3000, 1.0) for i in range(90))]  # ties
    df = spark.createDataFrame(messages, "id long, parent long, score double").repartition(5)
    for top in (1, 3):
        got = {}
        for r in sorted(chat.best_paths(df, top).collect(), key=lambda r: r["place"]):
            path = got.setdefault((r["leaf"], r["root"], r["rank"]), [])
            assert r["place"] == len(path)
            path.append(r["id"])
        assert got == brute(messages, top)


@given(st.lists(st.sampled_from(PIECES), max_size=8).map("".join))
def test_unescaping_undoes_escaping(text):
    import re

    assert chat.unescape(re.sub(r"<(\\*)\|", r"<\1\\|", text)) == text


def test_formatted_texts_are_read_back(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\n<|b\\", None]), rng.choice([None, "", "".join(rng.choices(PIECES, k=12))]))
            for c in (1, 2, 3, None) for t in range(9)]
    rows += [(4, None, None, None), (5, 0, "user", "x"), (5, 0, "assistant", "y"), (5, 0, "assistant", "y")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, id string").repartition(4)
    got = {chat_id: r for r in chat.conversations(chat.chains(df)).withColumn("c", chat.conversation_of(F.col("leaf"))).collect() for chat_id in [r["c"]]}
    assert len(got) == 6
    for c, row in got.items():
        own = sorted((r for r in rows if r[0] == c), key=lambda r: tuple((x is not None, x or "") if not isinstance(x, int) else (True, x) for x in r[1:]))
        turns = [(r or "", t or "") for _, _, r, t in own]
        assert list(chat.turns_of(row["text"])) == turns
        assert [chat.unescape(row["text"][s["start"]:s["end"]]) for s in row["loss"] if s["end"] - s["start"] < 10**9] == [
            t for r, t in turns if r == "assistant"] or any("🙂" in t for _, t in turns)
        assert row["text"].count("<|") == 2 * len(turns)


def test_repeated_messages_and_no_messages(spark):
    schema = "id long, parent long, score double, role string, text string"
    rows = [(1, None, None, "user", "b"), (1, None, None, "user", "a"), (1, None, None, "user", "b"), (2, 1, 1.0, "assistant", "c"), (None, 1, 1.0, "x", "y")]
    (row,) = chat.conversations(spark.createDataFrame(rows, schema)).collect()
    assert list(chat.turns_of(row["text"])) == [("user", "b"), ("assistant", "c")]
    assert chat.conversations(spark.createDataFrame([], schema)).count() == 0
