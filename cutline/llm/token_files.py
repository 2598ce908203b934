"""Token files: whole texts as token ids in a compact binary format, and back.

Ids are renumbered by how often they occur in all texts, so that most ranks are small. A rank takes one to four bytes, low
byte first; the lengths of four ranks are in one control byte, two bits each, and control bytes stand apart from the data.
A reader turns control bytes into lengths by table lookup, so a block is decoded by a few array operations.

The files are Parquet rows, one per block of documents in ascending id order (nulls first): `part` and `seq` give the order
of blocks, `first` the number of ids in all blocks before it, `docs` and `counts` the ids and lengths of its documents,
`control` and `data` the two streams. A second table `ranks` has the id of each rank; it is as long as the vocabulary in use.
A block holds at most `block` ids, or one document.

A null text is an empty text and has only the end id. Rows with one id stand next to each other in the order of their
content. No rows give an empty file."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from cutline.llm.frames import per_batch
from cutline.session import checkpoint_root

_LARGEST_VOCABULARY = 64 << 20
_CACHE = 400_000  # pre-tokens whose ids a Python worker keeps
_loaded: dict[str, Encoder] = {}

# Texts of these characters are normalised by lower-casing alone; any other goes through the whole tokenizer.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ \\n]*")
_PLAIN_PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \\na-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """Each character beyond ASCII as the letters that byte-level models write for its UTF-8 bytes: a printable Latin-1
    byte stands for itself, the others follow from 256 in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(printable))}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class Pieces(dict):
    """The ids of each pre-token as bytes of unsigned 32-bit numbers. Of what is no longer held here, the last half of the
    cache is still at hand, so frequent pre-tokens are merged once."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.letters, self.older = tokenizer.model, _byte_letters(), {}

    def __missing__(self, piece: str) -> bytes:
        value = self.older.get(piece)
        if value is None:
            word = piece if piece.isascii() else piece.translate(self.letters)
            value = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        if len(self) >= _CACHE // 2:
            self.older = dict(self)
            self.clear()
        self[piece] = value
        return value


class Encoder:
    """Texts to ids, as bytes of unsigned 32-bit numbers, by the tokenizer's own merges.

    A tokenizer that is `plain` lower-cases, splits by the pieces above and then merges bytes: its texts of common characters
    are split here, and each distinct pre-token is merged once. All else is encoded by the whole tokenizer, string by string
    between spaces and line ends if it is `plain`, else text by text."""

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.plain = b"'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in content and b'"type":"Lowercase"' in content
        self.pieces = Pieces(self.tokenizer)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.plain:
            return self.whole(text)
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, _PLAIN_PIECES.findall(text.lower())))
        return b"".join([self.encode(x) if _PLAIN.fullmatch(x) and "<|" not in x else self.whole(x) for x in text.replace("\n", " ").split(" ")])


def _encoder(shared: Broadcast) -> Encoder:
    name, content = shared.value
    if name not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[name] = Encoder(content)
    return _loaded[name]


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n and the compressed ids of each whole text, with `end_id` at the end."""
    with open(tokenizer_path, "rb") as file:
        content = file.read()
    if len(content) > _LARGEST_VOCABULARY:
        raise ValueError(f"{tokenizer_path} is larger than {_LARGEST_VOCABULARY} bytes")
    shared = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(content).hexdigest(), content))
    end = np.array([end_id], np.uint32).tobytes()
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> dict:
        encoder, packer = _encoder(shared), zstandard.ZstdCompressor(level=1)
        out, sizes = [], []
        for t in batch.column("text").to_pylist():
            ids = np.frombuffer(encoder.encode(t or "") + end, np.uint32)
            sizes.append(len(ids))
            out.append(packer.compress(_narrow(ids)))
        return {"id": batch.column("id"), "n": sizes, "ids": out}

    return per_batch(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")), run, schema)


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as a marker byte and numbers of two or four bytes."""
    return b"\2" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def _wide(packed: bytes, unpacker: zstandard.ZstdDecompressor) -> np.ndarray:
    raw = unpacker.decompress(packed)
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1).astype(np.uint32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    two_bits = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    two_bits[: len(ranks)] = size - 1
    control = two_bits.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    quads = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), quads[np.arange(4) < size[:, None]].tobytes()


# For each control byte the lengths of its four numbers: a rule, kept as a table for lookup.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The `n` numbers of a block."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _ranks(staged: DataFrame) -> list[tuple[int, int]]:
    """(id, count) of all ids in use, most frequent first: one row per entry of the vocabulary."""
    schema = T.StructType([T.StructField("token", T.LongType()), T.StructField("n", T.LongType())])

    def run(batch: pa.RecordBatch) -> dict:
        unpacker, total = zstandard.ZstdDecompressor(), np.zeros(1, np.int64)
        for packed in batch.column("ids").to_pylist():
            counts = np.bincount(_wide(packed, unpacker), minlength=len(total))
            counts[: len(total)] += total
            total = counts
        used = np.flatnonzero(total)
        return {"token": used, "n": total[used]}

    counts = per_batch(staged.select("ids"), run, schema, rows=10_000).groupBy("token").agg(F.sum("n").alias("n"))
    return [(r["token"], r["n"]) for r in counts.orderBy(F.desc("n"), "token").collect()]


_BLOCK = T.StructType([T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("n", T.LongType()),
                       T.StructField("docs", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType())),
                       T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())])


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", block: int = 1 << 20) -> None:
    """Token files of all texts in `folder`, which all executors share."""
    spark = docs.sparkSession
    tokenize(docs, tokenizer_path, end_id, doc_id, text).write.option("compression", "none").parquet(f"{folder}/staged")
    staged = spark.read.parquet(f"{folder}/staged")
    ranked = _ranks(staged)
    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ranked)], "rank long, token long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(max((t for t, _ in ranked), default=0) + 1, np.uint32)
    rank_of[[t for t, _ in ranked]] = np.arange(len(ranked))
    shared = spark.sparkContext.broadcast(rank_of)
    names = _BLOCK.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size, unpacker = TaskContext.get().partitionId(), 0, [], 0, zstandard.ZstdDecompressor()

        def emit() -> pa.RecordBatch:
            control, data = pack(shared.value[np.concatenate([x for _, x in held])])
            row = (part, seq, size, [d for d, _ in held], [len(x) for _, x in held], control, data)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)], names=names)

        for batch in batches:
            for id_, packed in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = _wide(packed, unpacker)
                if held and size + len(ids) > block:
                    yield emit()
                    seq, held, size = seq + 1, [], 0
                held.append((id_, ids))
                size += len(ids)
        if held:
            yield emit()

    blocks = (staged.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "ids")
              .select("id", "ids").mapInArrow(run, _BLOCK))
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """id, start, n_tokens and ids (bytes of little-endian unsigned 32-bit numbers) of each document in the files."""
    token_of = np.array([r["token"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], np.uint32)
    shared = spark.sparkContext.broadcast(token_of)
    blocks = spark.read.parquet(f"{folder}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))  # a row per file
    before = parts.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = blocks.select("part", "seq", "n").withColumn("within", F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n"))
    first = within.join(before, F.col("part") == F.col("of")).select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("before") + F.col("within")).alias("first"))
    placed = blocks.join(first, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).select("first", "n", "docs", "counts", "control", "data")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"id": [], "start": [], "n_tokens": [], "ids": []}
        for row in batch.to_pylist():
            ids = shared.value[unpack(row["control"], row["data"], row["n"])] if row["n"] else np.zeros(0, np.uint32)
            edges = np.concatenate([[0], np.cumsum(row["counts"])]).astype(np.int64)
            out["id"] += row["docs"]
            out["start"] += (edges[:-1] + row["first"]).tolist()
            out["n_tokens"] += row["counts"]
            out["ids"] += [ids[a:b].astype("<u4").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out

    return per_batch(placed, run, schema, rows=1)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def crc32(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


