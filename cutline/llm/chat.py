"""Conversations as training texts: reply trees, their best paths, and a template that can be read back.

Messages point at the message they answer. Ancestors are found by doubling: after round r every message knows the message
2^r steps above it and the sum of scores in between, so rounds grow with the logarithm of the longest path. Each round is one
self-join on ids, without texts, written to the shared folder. Leaves are ranked by the mean score of their path; the chosen
paths are walked up by the same jumps, largest first, so that every message of a path is made once.

Template: `<|im_start|>role`, a line end, the text, `<|im_end|>` and a line end for each turn. Inside a text or role a
backslash is put behind the `<` of anything that reads `<|`, or `<`, backslashes and `|`, so no marker can occur there; one
backslash is taken away on reading. A role's line ends are escaped too.

A null text or role is empty. A parent that doesn't exist, and a null parent, make a root. Messages on a cycle have no root
and are in no path. Repeated rows of one message id: the greatest (role, text) counts. Ties between leaves: the least id."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cutline.llm.frames import per_batch, stored

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(column: Column) -> Column:
    return F.regexp_replace(column, r"<(\\*)\|", r"<$1\\|")


def _escaped_role(column: Column) -> Column:
    """Line ends, and the escape character itself, as two characters; then as any text."""
    return escape(F.regexp_replace(F.regexp_replace(column, r"\\", r"\\\\"), "\n", r"\\n"))


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(text: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(text))


def jumps(messages: DataFrame) -> list[DataFrame]:
    """Frames (id, up, top, total, steps): `up` is the message 2^r steps above, if there is one; `top` the highest message at
    most 2^r steps above, `total` and `steps` the scores and number of messages from here up to before `up`. In the last frame
    no message has an `up`, but those on or under a cycle."""
    known = messages.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    up = F.when(F.col("there"), F.col("parent"))
    level = stored(messages.join(known, "parent", "left").select("id", up.alias("up"), F.coalesce(up, "id").alias("top"), F.col("score").cast("double").alias("total"),
                                                                 F.lit(1).cast("long").alias("steps")), "jumps")
    out, most = [level], max(1, messages.count()).bit_length()
    while len(out) <= most and not level.where("up is not null").isEmpty():
        far = level.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("total").alias("total2"), F.col("steps").alias("steps2"))
        higher = level.where("up is not null").join(far, "up").select("id", F.col("up2").alias("up"), F.col("top2").alias("top"), (F.col("total") + F.col("total2")).alias("total"),
                                                                    (F.col("steps") + F.col("steps2")).alias("steps"))
        level = stored(higher.unionByName(level.where("up is null")), "jumps")  # only messages still on their way are joined
        out.append(level)
    return out


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(leaf, root, rank, id, place): for each root its `top` best leaves and the messages of their paths, place 0 being the
    root. `messages` has distinct id, parent and score."""
    levels = jumps(messages)
    ends = levels[0].where("up is null").select(F.col("id").alias("top"))
    rooted = levels[-1].join(ends, "top", "left_semi").select("id", F.col("top").alias("root"), "total", "steps")
    parents = levels[0].where("up is not null").select(F.col("up").alias("id")).distinct()
    leaves = rooted.join(parents, "id", "left_anti").withColumn("mean", F.col("total") / F.col("steps"))
    if top == 1:  # with map-side minima, as one root may have most of the leaves
        best = leaves.groupBy("root").agg(F.min_by(F.struct("id", "steps"), F.struct((-F.col("mean")).alias("mean"), F.col("id"))).alias("best"))
        chosen = best.select(F.col("best.id").alias("leaf"), "root", F.lit(1).alias("rank"), F.col("best.steps").alias("steps"))
    else:
        order = Window.partitionBy("root").orderBy(F.desc("mean"), "id")
        chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(F.col("id").alias("leaf"), "root", "rank", "steps")
    paths = stored(chosen.select("leaf", "root", "rank", F.col("leaf").alias("id"), (F.col("steps") - 1).alias("place")), "path-leaves")
    for r in range(len(levels) - 1, -1, -1):
        up = levels[r].where("up is not null").select("id", "up")
        higher = paths.join(up, "id").select("leaf", "root", "rank", F.col("up").alias("id"), (F.col("place") - (1 << r)).alias("place"))
        paths = stored(paths.unionByName(higher), "paths")
    return paths


def conversations(messages: DataFrame, top: int = 1) -> DataFrame:
    """(leaf, root, rank, text, loss): the best paths of reply trees, formatted. `messages` has id, parent, score, role and
    text; other columns are ignored."""
    once = stored(messages.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("role", "text", "parent", "score")).alias("row")).select("id", "row.*"), "messages")
    paths = best_paths(once.select("id", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), top)
    texts = formatted(paths.join(once.select("id", "role", "text"), "id"))
    return texts.join(paths.where("id = leaf").select("leaf", "root", "rank"), "leaf").select("leaf", "root", "rank", "text", "loss")


def formatted(turns: DataFrame, key: str = "leaf") -> DataFrame:
    """(key, text, loss): each conversation as one text, and where the assistant's texts are in it (start and end
    characters). `turns` has the key, place, role and text of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(START), _escaped_role(role), F.lit("\n"))
    rows = turns.select(key, F.struct("place", head.alias("head"), escape(text).alias("body"), (role == "assistant").alias("learn")).alias("turn"))
    whole = rows.groupBy(key).agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    text_of = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    size = F.transform("turns", lambda t: F.struct(F.char_length(t["head"]).alias("head"), F.char_length(t["body"]).alias("body"), t["learn"].alias("learn")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + t["head"]
        end = begin + t["body"]
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(t["learn"], F.concat(state["spans"], one)).otherwise(state["spans"]).alias("spans"))

    return whole.select(key, text_of.alias("text"), F.aggregate(size, start, step, lambda s: s["spans"]).alias("loss"))


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    for part in text.split(START)[1:]:
        role, _, body = part.partition("\n")
        yield unescape_role(role), unescape(body.removesuffix(END))


_DIGEST = T.StructType([T.StructField("key", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
                        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])


def digests(conversations: DataFrame, key: str = "leaf") -> DataFrame:
    """What formatted conversations say when they are read back: number and digest of turns, length and digest of what is
    learned, and the length of the whole."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for name, text, loss in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "loss")), strict=True):
            turns = list(turns_of(text))
            learned = "".join(unescape(text[s["start"]:s["end"]]) for s in loss)
            rows.append((name, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned),
                         hashlib.sha256(learned.encode()).hexdigest(), len(text)))
        return {f: [r[i] for r in rows] for i, f in enumerate(_DIGEST.fieldNames())}

    return per_batch(conversations.select(F.col(key).alias("key"), "text", "loss"), run, _DIGEST, rows=500)


def chains(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Plain conversations, rows by turn, as messages: each answers the one before it. An id is the conversation's and the
    place in it. Rows with one turn number are ordered by role and text, nulls first."""
    order = Window.partitionBy(conv_id).orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    conv, n = F.coalesce(F.col(conv_id).cast("string"), F.lit("")), F.row_number().over(order)
    return rows.select(F.concat_ws(":", conv, n.cast("string")).alias("id"), F.when(n > 1, F.concat_ws(":", conv, (n - 1).cast("string"))).alias("parent"),
                       F.lit(0.0).alias("score"), F.col(role).alias("role"), F.col(text).alias("text"))


def conversation_of(message: Column) -> Column:
    """The conversation that a message of `chains` belongs to."""
    name = F.substring_index(message, ":", 1)
    return F.when(name != "", name).cast("long")
