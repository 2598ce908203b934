"""Byte-level BPE: texts to token ids by a table of ranks, and ids back to bytes.

A text of at most `chunk` characters is encoded whole by the library. A longer one is cut into chunks that overlap, and the
chunks are pre-tokenised in parallel, wherever they lie. Two neighbours agree from the first place in the overlap at which
both have a boundary between pre-tokens: matching goes from left to right, so the same place with the same text behind it
gives the same pieces. Each junction is cut at the last such place; the pieces between cuts are encoded in parallel, every
pre-token by itself, and joined by part number. If a junction has none (an unbroken run longer than the overlap), the rest of
that text goes on as one piece, so that results never depend on the chunks.

A null text is an empty text: no ids. Repeated rows give repeated results; a null id is an id like any other."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cutline.llm.frames import lists, per_batch, stored

_LARGEST_VOCABULARY = 64 << 20
_MARGIN = 8  # characters at a chunk's end on which a match may still depend
_PART = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("part", T.LongType()),
                      T.StructField("ids", T.ArrayType(T.IntegerType()))])
_loaded: dict[str, _Codec] = {}


class Vocabulary:
    """Ranks and pattern; small (its size is checked) and sent to the executors once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            content = file.read()
        if len(content) > _LARGEST_VOCABULARY:
            raise ValueError(f"{path} is larger than {_LARGEST_VOCABULARY} bytes")
        self.shared: Broadcast = spark.sparkContext.broadcast((hashlib.sha256(content).hexdigest() + pattern, content, pattern))


class _Codec:
    """Built once per Python worker, each part when it is first needed: `texts` encodes whole texts, `single` one pre-token,
    `pattern` finds pre-tokens."""

    def __init__(self, content: bytes, pattern: str):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        self.split = pattern

    @cached_property
    def texts(self):
        return self._encoding(self.split)

    @cached_property
    def single(self):
        return self._encoding(r"(?s:.+)")

    @cached_property
    def pattern(self):
        return regex.compile(self.split)

    def _encoding(self, pattern: str):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})


def _codec(shared: Broadcast) -> _Codec:
    name, content, pattern = shared.value
    if name not in _loaded:
        _loaded[name] = _Codec(content, pattern)
    return _loaded[name]


def boundaries(text: str, pattern: regex.Pattern) -> list[int]:
    """Where matches begin or end."""
    return sorted({0, *(x for m in pattern.finditer(text) for x in m.span())})


def _part_rows(ids: list, batch: pa.RecordBatch, part) -> dict:
    flat = np.concatenate([np.array(x, np.int32) for x in ids])
    return {"id": batch.column("id"), "key": batch.column("key"), "part": part, "ids": lists(flat, np.cumsum([0, *map(len, ids)]), pa.int32())}


def _id_lists(column: pa.ListArray) -> list[list[int]]:
    """A list column as Python lists, by way of its flat values."""
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _whole(docs: DataFrame, shared: Broadcast) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        texts = _codec(shared).texts
        return _part_rows([texts.encode_ordinary(t) if t else [] for t in batch.column("text").to_pylist()], batch, [0] * batch.num_rows)

    return per_batch(docs, run, _PART, rows=512)


def _cuts(chunks: DataFrame, shared: Broadcast, chunk: int, overlap: int) -> DataFrame:
    """For each long text the places where its chunks are stitched, up to the first junction that does not resynchronise."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("no", T.LongType()),
                           T.StructField("head", T.ArrayType(T.LongType())), T.StructField("tail", T.ArrayType(T.LongType()))])

    def run(batch: pa.RecordBatch) -> dict:
        pattern = _codec(shared).pattern
        head, tail = [], []
        for no, text in zip(batch.column("no").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = boundaries(text, pattern)
            head.append([no * chunk + x for x in found if x <= overlap - _MARGIN])
            tail.append([no * chunk + x for x in found if chunk <= x < len(text) - _MARGIN])
        return {"id": batch.column("id"), "key": batch.column("key"), "no": batch.column("no"), "head": head, "tail": tail}

    marks = stored(per_batch(chunks, run, schema, rows=64), "bpe-boundaries")
    after = marks.select(F.col("id").alias("i"), F.col("key").alias("k"), (F.col("no") - 1).alias("n"), F.col("head").alias("next"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")) & (F.col("no") == F.col("n"))
    joined = marks.join(after, same).select("id", "key", "no", F.coalesce(F.array_max(F.array_intersect("tail", "next")), F.lit(-1)).alias("cut"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("no", "cut"))), lambda x: x["cut"])
    lost = F.array_position("cuts", -1)
    return joined.groupBy("id", "key").agg(ordered.alias("cuts")).withColumn("cuts", F.when(lost > 0, F.slice("cuts", 1, (lost - 1).cast("int"))).otherwise(F.col("cuts")))


def _pieces(long: DataFrame, cuts: DataFrame, shared: Broadcast) -> DataFrame:
    """Encode what lies between the cuts; the text behind a piece is read a little further, so that its last match is whole."""
    of = cuts.select(F.col("id").alias("i"), F.col("key").alias("k"), "cuts")
    edges = F.concat(F.array(F.lit(0)).cast("array<long>"), F.coalesce("cuts", F.array().cast("array<long>")), F.array(F.char_length("text").cast("long")))
    rows = (long.join(of, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left").withColumn("edges", edges)
            .select("id", "key", "text", "edges", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("no"))
            .withColumn("start", F.element_at("edges", F.col("no") + 1)).withColumn("size", F.element_at("edges", F.col("no") + 2) - F.col("start"))
            .select("id", "key", F.col("no").cast("long").alias("part"), "size",
                    F.substring("text", (F.col("start") + 1).cast("int"), (F.col("size") + 2 * _MARGIN).cast("int")).alias("text"))
            .repartition("id", "key", "part"))

    def run(batch: pa.RecordBatch) -> dict:
        single, pattern = _codec(shared).single, _codec(shared).pattern
        known: dict[str, list[int]] = {}
        ids = []
        for text, size in zip(batch.column("text").to_pylist(), batch.column("size").to_pylist(), strict=True):
            out: list[int] = []
            for match in pattern.finditer(text):
                if match.start() >= size:
                    break
                piece = match.group()
                if piece not in known:
                    known[piece] = single.encode_ordinary(piece)
                out += known[piece]
            ids.append(out)
        return _part_rows(ids, batch, batch.column("part"))

    return per_batch(rows, run, _PART, rows=64)


def encode(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", chunk: int = 1 << 15, overlap: int = 1 << 10) -> tuple[DataFrame, DataFrame]:
    """Token ids as rows (id, key, part, ids): first the texts of one part each, then those of several parts, to be taken in
    the order of `part` within (id, key); `key` tells texts of one id apart."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    short = F.char_length("text") <= chunk
    whole = _whole(docs.where(short).select("id", F.lit("").alias("key"), "text"), vocabulary.shared)
    # A repeated long row is encoded once; its number of copies is kept in the key.
    long = docs.where(~short).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    long = stored(long.groupBy("id", "key").agg(F.max("text").alias("text"), F.count("*").alias("copies"))
                  .withColumn("key", F.concat_ws(":", "key", "copies")).drop("copies"), "bpe-long")
    last = F.ceil((F.char_length("text") - overlap) / chunk).cast("int") - 1
    chunks = (long.select("id", "key", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), last))).alias("no"))
              .select("id", "key", F.col("no").cast("long").alias("no"), F.substring("text", F.col("no") * chunk + 1, F.lit(chunk + overlap)).alias("text"))
              .repartition("id", "key", "no"))
    return whole, _pieces(long, _cuts(chunks, vocabulary.shared, chunk, overlap), vocabulary.shared)


def decode(parts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The rows of `encode` with the raw bytes of their ids in `bytes`, those of the tokens one after the other."""
    shared = vocabulary.shared

    def run(batch: pa.RecordBatch) -> dict:
        texts = _codec(shared).texts
        return {n: batch.column(n) for n in _PART.fieldNames()} | {"bytes": [texts.decode_bytes(x) for x in _id_lists(batch.column("ids"))]}

    return per_batch(parts, run, T.StructType([*_PART.fields, T.StructField("bytes", T.BinaryType())]), rows=512)


_DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digests(whole: DataFrame, parts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, the digest of the ids and that of the bytes they decode to, from the two frames of `encode`. The parts
    of a text come in order and are folded one by one."""
    shared = vocabulary.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _codec(shared).texts
        numbers = [str(i) for i in range(texts.n_vocab)]
        at, held = None, None
        out: list[tuple] = []

        def close() -> None:
            copies = int(at[1].rpartition(":")[2] or 1)
            out.extend([(at[0], held[0], held[1].hexdigest(), held[2].hexdigest())] * copies)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], names=_DIGEST.fieldNames())

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                plain = (some.column(n).to_pylist() for n in ("id", "key", "part"))
                for id_, key, part, ids in zip(*plain, _id_lists(some.column("ids")), strict=True):
                    if at is None or at != (id_, key) or part == 0:
                        if at is not None:
                            close()
                        at, held = (id_, key), [0, hashlib.sha256(), hashlib.sha256()]
                    held[1].update((("," if held[0] and ids else "") + ",".join([numbers[x] for x in ids])).encode())
                    held[0] += len(ids)
                    held[2].update(texts.decode_bytes(ids))
            yield batch_of(out)
            out.clear()
        if at is not None:
            close()
            yield batch_of(out)

    return whole.mapInArrow(run, _DIGEST).unionByName(
        parts.repartition("id", "key").sortWithinPartitions("id", "key", "part").mapInArrow(run, _DIGEST))
