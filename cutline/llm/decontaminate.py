"""Passages of evaluation items inside documents: a prefix-filtered set join on word shingles.

An item's windows are its runs of `window` consecutive words (an item of fewer words is one window). A window is a set of
shingles at fixed places. First the shingles of all windows are counted over all documents. A window that shares at least
`threshold` of its shingles with some place must share one of its rarest few (prefix filter), so only those are looked up
in the documents. Each match fixes where the window would begin; the length bound drops windows longer than the document,
the positional bound those that would begin before or end after it. What is left is compared word for word.

The windows go to the executors in blocks of at most `block` windows, a fixed size, whatever the number of items; one block
passes all documents without a shuffle. Of several, the hits of each but the last are written before the next is sent, and meet
the documents by id and digest of the text. The items are read one by one on the driver, which holds two blocks at most.

A null or wordless text has no words and no hits; an item without words has no windows. An item with a null id marks words
but is not listed. Repeated items count once, repeated documents are rows of their own; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from cutline.llm.frames import lists, per_batch, stored
from cutline.llm.words import Block, blocks, shingles, signed, utf8, words_of

_FOUND = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()),
                       T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
                       T.StructField("items", T.ArrayType(T.LongType()))])


@dataclass
class Windows:
    """A block of distinct windows. `hashes` has a row of word hashes for each, zero beyond its `lengths`; `items` the ids
    of the items that hold it."""

    texts: list[bytes]
    hashes: np.ndarray
    lengths: np.ndarray
    items: list[list[int]]


class Lookup:
    """Which numbers of an array are among some keys, and which key each is."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.mask = np.uint64((1 << max(12, min(24, int(len(self.keys)).bit_length() + 5))) - 1)
        self.seen = np.zeros(int(self.mask) + 1, bool)
        self.seen[self.keys & self.mask] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.seen[values & self.mask])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
        same = self.keys[key] == values[at]
        return at[same], key[same]


def item_windows(items: DataFrame, item_id: str, text: str, window: int, block: int) -> Iterator[Windows]:
    """The distinct windows of all items, block by block; only one block is held at a time."""
    held: dict[bytes, set] = {}

    def full() -> Windows:
        texts = list(held)
        split = [t.split(b" ") for t in texts]
        lengths = np.array([len(w) for w in split], np.int64)
        hashes = np.zeros((len(texts), window), np.uint64)
        hashes[np.arange(window) < lengths[:, None]] = np.concatenate([b.hashes for b in blocks(texts)])
        return Windows(texts, hashes, lengths, [sorted(i for i in held[t] if i is not None) for t in texts])

    for row in items.select(F.col(item_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).where(F.col("text").isNotNull()).toLocalIterator():
        words = words_of(bytes(row["text"]))
        for start in range(max(1, len(words) - window + 1) if words else 0):
            held.setdefault(b" ".join(words[start:start + window]), set()).add(row["id"])
            if len(held) >= block:
                yield full()
                held = {}
    if held:
        yield full()


def _window_shingles(found: Windows, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By shingle length: the windows with such shingles and a row of shingles for each."""
    for n in np.unique(found.lengths):
        which = np.flatnonzero(found.lengths == n)
        k = min(length, int(n))
        rows = found.hashes[which, :n]
        yield k, which, np.stack([shingles(rows[:, j:j + k].T.copy(), k)[0] for j in range(n - k + 1)], axis=1)


def _count(docs: DataFrame, shared: Broadcast) -> dict[int, int]:
    """How often each shingle of a block of windows occurs in all documents."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])

    def run(batch: pa.RecordBatch) -> dict:
        keys, counts = [], []
        for k, lookup in shared.value.items():
            total = np.zeros(len(lookup.keys), np.int64)
            for block in blocks(utf8(batch.column("text"))):
                at, key = lookup.find(shingles(block.hashes, k))
                owner = block.owners()
                inside = owner[at] == owner[at + k - 1] if len(at) else at.astype(bool)
                total += np.bincount(key[inside], minlength=len(total))
            keys.append(lookup.keys[total > 0])
            counts.append(total[total > 0])
        return {"key": signed(np.concatenate(keys)), "n": np.concatenate(counts)}

    # The rows are at most the shingles of one block of windows.
    return {r["key"]: r["n"] for r in per_batch(docs.select("text"), run, schema).groupBy("key").agg(F.sum("n").alias("n")).collect()}


def _prefixes(found: Windows, counts: dict[int, int], length: int, threshold: float) -> dict:
    """By shingle length, the rarest necessary shingles: their lookup, and for each key the windows and the places in them."""
    prefix: dict[int, list[tuple]] = {}
    needed = np.zeros(len(found.lengths), np.int64)
    for k, which, rows in _window_shingles(found, length):
        m = rows.shape[1]
        need = max(1, math.ceil(threshold * m - 1e-9))
        needed[which] = need
        often = np.array([counts.get(int(x), 0) for x in signed(rows.ravel())], np.int64).reshape(rows.shape)
        order = np.lexsort((rows, often), axis=1)[:, : m - need + 1]
        for column in order.T:
            keep = often[np.arange(len(which)), column] > 0  # a shingle of no document can't match
            prefix.setdefault(k, []).append((rows[np.arange(len(which)), column][keep], which[keep], column[keep]))
    out = {}
    for k, parts in prefix.items():
        keys, windows, places = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        lookup = Lookup(keys)
        first = np.searchsorted(keys[order], lookup.keys, "left")
        out[k] = (lookup, first, np.searchsorted(keys[order], lookup.keys, "right") - first, windows[order], places[order])
    return {"prefix": out, "needed": needed}


def _occurrences(block: Block, found: Windows, index: dict, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word places in the block where windows begin, and which windows."""
    starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    owner = block.owners()
    for k, (lookup, first, many, window, place) in index["prefix"].items():
        at, key = lookup.find(shingles(block.hashes, k))
        if not len(at):
            continue
        repeat = many[key]
        row = np.repeat(first[key] - np.concatenate([[0], np.cumsum(repeat)[:-1]]), repeat) + np.arange(repeat.sum())
        start, w = np.repeat(at, repeat) - place[row], window[row]
        end = start + found.lengths[w]
        doc = owner[np.repeat(at, repeat)]
        inside = (start >= block.offsets[doc]) & (end <= block.offsets[doc + 1])
        start, w = start[inside], w[inside]
        for n in np.unique(found.lengths[w]):
            of = found.lengths[w] == n
            s, v = start[of], w[of]
            for part in range(0, len(s), 1 << 16):
                p, q = s[part:part + (1 << 16)], v[part:part + (1 << 16)]
                same = block.hashes[p[:, None] + np.arange(n)] == found.hashes[q, :n]
                size = min(length, int(n))
                runs = np.lib.stride_tricks.sliding_window_view(same, size, axis=1).all(axis=2).sum(axis=1)
                ok = runs >= index["needed"][q]
                starts.append(p[ok])
                windows.append(q[ok])
    start, w = np.concatenate(starts), np.concatenate(windows)
    pairs = np.unique(np.stack([start, w], axis=1), axis=0)
    exact = [index["needed"][w] < found.lengths[w] - min(length, int(found.lengths[w])) + 1
             or b" ".join(block.words(s, s + found.lengths[w])) == found.texts[w] for s, w in pairs]
    pairs = pairs[np.array(exact, bool)] if len(pairs) else pairs
    return pairs[:, 0], pairs[:, 1]


def _marks(df: DataFrame, shared: Broadcast, length: int) -> DataFrame:
    """One block's hits in each row; a column `key`, if there is one, is kept."""
    keyed = "key" in df.columns

    def run(batch: pa.RecordBatch) -> dict:
        found, index = shared.value
        n_words = np.zeros(batch.num_rows, np.int64)
        starts: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        items: list[list[int]] = []
        for block in blocks(utf8(batch.column("text"))):
            n_words[block.first:block.first + len(block)] = np.diff(block.offsets)
            s, w = _occurrences(block, found, index, length)
            edge = np.searchsorted(s, block.offsets)
            for i in range(len(block)):
                a, b, base = edge[i], edge[i + 1], block.offsets[i]
                p, e = union(s[a:b] - base, s[a:b] - base + found.lengths[w[a:b]])
                starts.append(p)
                ends.append(e)
                items.append(sorted({x for v in w[a:b] for x in found.items[v]}))
        out = {"id": batch.column("id"), "n_words": n_words, "items": items} | _spans(starts, ends)
        return out | {"key": batch.column("key")} if keyed else out

    return per_batch(df, run, T.StructType([*_FOUND.fields, T.StructField("key", T.StringType())]) if keyed else _FOUND)


def _spans(starts: list[np.ndarray], ends: list[np.ndarray]) -> dict:
    return {n: lists(np.concatenate(x), np.cumsum([0] + [len(y) for y in x]), pa.int64()) for n, x in (("starts", starts), ("ends", ends))}


def _merged(marks: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows with the hits of other blocks added; rows of one id and text have the same hits."""
    other = hits.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(
        F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("more"), F.flatten(F.collect_list("items")).alias("more_items"))
    both = marks.join(other, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select(
        "id", "n_words", *[F.concat(n, F.coalesce(F.col(f"more.{n}"), F.array().cast("array<bigint>"))).alias(n) for n in ("starts", "ends")],
        F.array_sort(F.array_union("items", F.coalesce("more_items", F.array().cast("array<bigint>")))).alias("items"))

    def run(batch: pa.RecordBatch) -> dict:
        joined = [union(np.array(s, np.int64), np.array(e, np.int64)) for s, e in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)]
        return {n: batch.column(n) for n in ("id", "n_words", "items")} | _spans([s for s, _ in joined], [e for _, e in joined])

    return per_batch(both, run, _FOUND)


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching stretches joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([new[1:], [True]])]


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 10, shingle: int = 3, threshold: float = 1.0, block: int = 1 << 17) -> DataFrame:
    """One row per document: id, n_words, spans (start and end words of joined hits), n_hit and items (sorted ids)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    none = Windows([], np.zeros((0, window), np.uint64), np.zeros(0, np.int64), [])
    rest = item_windows(items, item_id, item_text, window, block)
    found, following = next(rest, none), next(rest, None)
    if following is not None:  # several blocks: the hits of a row meet by its id and text
        docs = docs.withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    hits = None
    while True:
        keys: dict[int, list[np.ndarray]] = {}
        for k, _, rows in _window_shingles(found, shingle):
            keys.setdefault(k, []).append(rows.ravel())
        counts = {}
        if keys:
            lookups = spark.sparkContext.broadcast({k: Lookup(np.concatenate(v)) for k, v in keys.items()})
            counts = _count(docs, lookups)
            lookups.destroy()
        shared = spark.sparkContext.broadcast((found, _prefixes(found, counts, shingle, threshold)))
        out = _marks(docs, shared, shingle)
        if following is None:
            break
        # The hits of all blocks but the last are written, and their broadcasts end with them.
        part = stored(out.where(F.size("starts") > 0).dropDuplicates(["id", "key"]), "block-hits")
        shared.destroy()
        hits = part if hits is None else hits.unionByName(part)
        found, following = following, next(rest, None)
    if hits is not None:
        out = _merged(out, hits)
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    return out.select("id", "n_words", spans.alias("spans"),
                      F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"]).alias("n_hit"), "items")


def digest(found: DataFrame) -> DataFrame:
    """The columns of a contamination report: counts, the digest of the listed items, and whether any word is hit."""
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
