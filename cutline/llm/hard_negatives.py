"""Hard negatives: for each anchor and each of its nearest rows of the same label, the best rows of other labels whose score is close
to that positive's.

Vectors are whole numbers, floor(scale * x), and a score is their inner product, exact. Around the scores stands a filter of one-bit
codes. A vector is rotated (three rounds of fixed random signs and a Hadamard transform, which keep inner products); its code is the
signs of the result, and with it are stored its length and its alignment: the inner product with its own code taken as a unit
vector. With u the code of a row, r the rotated row, s the rotated anchor, a = <r, u> and e = r - a u, which is orthogonal to u:

    <r, s> = a <u, s> + <e, s>,   |<e, s>| <= |e| |s - <u, s> u| = sqrt(|r|^2 - a^2) sqrt(|s|^2 - <u, s>^2)

<u, s> is found by popcounts: s is rounded to `planes` bits a coordinate, and each plane of bits is counted against the code. The
rounding error is known and widens the interval, so the true score always lies inside: nothing is lost, whatever the data. Only rows
whose interval can still matter (the best ones so far, the band of a positive) are scored as whole numbers.

Rows and anchors go in blocks of fixed size. Each block of rows meets each block of anchors once, by an equality join on a group
number, so nothing is collected or broadcast; a task holds one pair of blocks. What leaves a pair is at most `positives` (then
`positives` x `negatives`) rows an anchor. The best of all blocks are ranked by a window with a limit, which Spark applies before the
exchange. No label is ever gathered, so one label may hold any share of the rows.

Rows take no part whose id, label or vector is null, that have a null or non-finite component, or whose whole numbers are so large
that a score may not fit a long (squared length of 2^62 or more). Vectors may differ in length: what is missing counts as 0.
Rows that repeat an id are one row, the greatest by label, then by numbers. An anchor without positives, or a positive without rows
in its band (as when its score is below 0), gives no row. No rows give none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cutline.llm.frames import among, not_among, stored
from cutline.llm.words import mix

_ROUNDS = 3
_SLACK = 1e-9  # of |r| |s|, for the rounding of floating point
_BLOCK = 2048  # rows of a block
_GROUP_BLOCKS = 8  # blocks of rows that meet one copy of the anchors
_BATCH_PAIRS = 4  # pairs of blocks that go to Python at once
_EXACT = float(1 << 52)

_BLOCK_FIELDS = [T.StructField("ids", T.BinaryType()), T.StructField("labels", T.BinaryType()), T.StructField("numbers", T.BinaryType()),
                 T.StructField("codes", T.BinaryType()), T.StructField("shape", T.BinaryType())]
_FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor_id", "vec_id", "score")])
_CHOSEN = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor_id", "positive_id", "positive_score", "vec_id", "score")])


def rotated(numbers: np.ndarray) -> np.ndarray:
    """Vectors, padded with zeros to a power of two, after a fixed rotation."""
    n, d = numbers.shape
    width = 1 << max(6, (d - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :d] = numbers
    for step in range(_ROUNDS):
        draw = mix(np.arange(step * width, (step + 1) * width, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        x *= np.where(draw >> np.uint64(63), 1.0, -1.0)
        half = 1
        while half < width:
            y = x.reshape(n, -1, 2, half)
            x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, width)
            half *= 2
        x /= np.sqrt(width)
    return x


def coded(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one-bit codes of vectors, as words of 64 bits, and for each its length and its alignment with its code."""
    x = rotated(numbers)
    codes = np.packbits(x >= 0, axis=1, bitorder="little").view(np.uint64)
    return codes, np.stack([np.sqrt((x * x).sum(axis=1)), np.abs(x).sum(axis=1) / np.sqrt(x.shape[1])], axis=1)


class Query:
    """An anchor as planes of bits to be counted against codes."""

    def __init__(self, x: np.ndarray, planes: int):
        self.width, self.length = len(x), float(np.sqrt((x * x).sum()))
        low, high = float(x.min()), float(x.max())
        self.low, self.step = low, (high - low) / ((1 << planes) - 1) or 1.0
        level = np.rint((x - low) / self.step).astype(np.int64)
        self.error = float(np.sqrt(((x - low - self.step * level) ** 2).sum()))
        self.bits = [np.packbits((level >> p & 1).astype(np.uint8), bitorder="little").view(np.uint64) for p in range(planes)]
        self.total = float(level.sum())

    def bounds(self, codes: np.ndarray, ones: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Below and above the score of each row, from its code, the ones in it, and its length and alignment."""
        counted = np.zeros(len(codes))
        for p, bits in enumerate(self.bits):
            counted += np.bitwise_count(codes & bits).sum(axis=1, dtype=np.int64) * float(1 << p)
        # Coordinates of the code are 1 and -1, over the root of the width.
        estimate = (self.step * (2 * counted - self.total) + self.low * (2.0 * ones - self.width)) / np.sqrt(self.width)
        length, alignment = shape[:, 0], shape[:, 1]
        rest = np.sqrt(np.maximum(0.0, length * length - alignment * alignment))
        least = np.maximum(0.0, np.abs(estimate) - self.error)
        reach = rest * np.sqrt(np.maximum(0.0, self.length * self.length - least * least)) + alignment * self.error + _SLACK * (length * self.length + 1.0)
        return alignment * estimate - reach, alignment * estimate + reach


class Block:
    """Some vectors of one width: ids, labels, whole numbers, codes, and lengths with alignments."""

    def __init__(self, ids: bytes, labels: bytes, numbers: bytes, codes: bytes, shape: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        n = len(self.ids)
        self.numbers = np.frombuffer(numbers, np.int32).reshape(n, -1)
        self.codes = np.frombuffer(codes, np.uint64).reshape(n, -1)
        self.shape = np.frombuffer(shape, np.float64).reshape(n, 2)
        self.ones = np.bitwise_count(self.codes).sum(axis=1, dtype=np.int64)
        # Products and sums of small numbers are exact as doubles, and much faster.
        self.fast = self.numbers.astype(np.float64) if n and float(self.shape[:, 0].max()) ** 2 < _EXACT else None

    def scores(self, which: np.ndarray, anchor: np.ndarray, small: bool) -> np.ndarray:
        if self.fast is not None and small:
            return (self.fast[which] @ anchor.astype(np.float64)).astype(np.int64)
        return (self.numbers[which].astype(np.int64) * anchor.astype(np.int64)).sum(axis=1)


def _best(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """The places of the first n by score, ties by id."""
    if len(ids) > 4 * n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:n]]
    return np.lexsort((ids, -scores))[:n]


def nearest_same(rows: Block, anchors: Block, planes: int, n: int) -> Iterator[tuple[int, int, int]]:
    """The first n other rows of the anchor's label, for each anchor: anchor, row, score."""
    turned = rotated(anchors.numbers)
    for i, anchor_id in enumerate(anchors.ids.tolist()):
        same = np.flatnonzero((rows.labels == anchors.labels[i]) & (rows.ids != anchor_id))
        if not len(same):
            continue
        low, high = Query(turned[i], planes).bounds(rows.codes[same], rows.ones[same], rows.shape[same])
        if len(same) > n:  # at least n rows score no less than the n-th best lower end
            same = same[high >= np.partition(low, len(low) - n)[len(low) - n]]
        scores = rows.scores(same, anchors.numbers[i], anchors.fast is not None)
        for k in _best(rows.ids[same], scores, n):
            yield anchor_id, int(rows.ids[same[k]]), int(scores[k])


def band(positive: int, share: tuple[int, int]) -> tuple[int, int]:
    """The least and greatest whole score s with share * positive <= s <= positive, share being a fraction; the least is above the
    greatest where there is none."""
    top, bottom = share
    return -(-positive * top // bottom), positive


def nearest_other(rows: Block, anchors: Block, wanted: list[list[tuple[int, int]]], planes: int, n: int, share: tuple[int, int]) -> Iterator[tuple[int, int, int, int, int]]:
    """For each anchor and each of its positives (id, score) the first n rows of other labels in the positive's band."""
    turned = rotated(anchors.numbers)
    for i, anchor_id in enumerate(anchors.ids.tolist()):
        limits = [(p, s, *band(s, share)) for p, s in wanted[i]]
        limits = [x for x in limits if x[2] <= x[3]]
        other = np.flatnonzero(rows.labels != anchors.labels[i])
        if not limits or not len(other):
            continue
        low, high = Query(turned[i], planes).bounds(rows.codes[other], rows.ones[other], rows.shape[other])
        chosen = np.zeros(len(other), bool)
        for _, _, least, most in limits:
            may = (high >= least) & (low <= most)
            # Rows that are surely in the band: n of them score no less than the n-th best lower end.
            sure = low[(low >= least) & (high <= most)]
            if len(sure) > n:
                may &= high >= np.partition(sure, len(sure) - n)[len(sure) - n]
            chosen |= may
        some = other[chosen]
        scores = rows.scores(some, anchors.numbers[i], anchors.fast is not None)
        for positive, score, least, most in limits:
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            for k in _best(rows.ids[some[inside]], scores[inside], n):
                yield anchor_id, positive, score, int(rows.ids[some[inside[k]]]), int(scores[inside[k]])


def whole_numbers(vectors: DataFrame, label: Column, vec_id: str, vector: str, scale: int) -> DataFrame:
    """id, label and whole numbers (binary, 32 bits each) of the rows that take part, one row per id."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.LongType()), T.StructField("numbers", T.BinaryType())])
    limit = float(1 << 62)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("x")
            flat, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            kept, numbers = [], []
            with np.errstate(all="ignore"):
                scaled = np.floor(scale * flat)
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    x = scaled[a:b]
                    if float((x * x).sum()) < limit:  # false as well where a component is not finite
                        kept.append(i)
                        numbers.append(x.astype(np.int32).tobytes())
            chosen = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([chosen.column("id"), chosen.column("label"), pa.array(numbers, pa.binary())], names=schema.fieldNames())

    x = F.col("x").cast("array<double>")
    rows = (vectors.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("x")).withColumn("x", x)
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull())))
    found = stored(rows.mapInArrow(run, schema), "whole-numbers")
    twice = stored(found.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    if twice.isEmpty():
        return found
    one = among(found, twice, "id", "id").groupBy("id").agg(F.max(F.struct("label", "numbers")).alias("row")).select("id", "row.*")
    return not_among(found, twice, "id", "id").select("id", "label", "numbers").unionByName(one)


def _blocks(rows: DataFrame, width: int, extra: T.StructType | None = None) -> DataFrame:
    """Rows (id, label, numbers) in blocks, each with the numbers of its rows padded to one width; more columns are kept as lists."""
    more = list(extra.fields) if extra else []
    schema = T.StructType([*_BLOCK_FIELDS, *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(table: pa.Table) -> pa.RecordBatch:
            numbers = np.zeros((len(table), width), np.int32)
            for i, data in enumerate(table.column("numbers").to_pylist()):
                numbers[i, :len(data) // 4] = np.frombuffer(data, np.int32)
            codes, shape = coded(numbers)
            ids, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
            values = [[x.tobytes()] for x in (ids, labels, numbers, codes, shape)]
            kept = [pa.array([table.column(f.name).to_pylist()], pa.list_(table.schema.field(f.name).type)) for f in more]
            return pa.RecordBatch.from_arrays([*[pa.array(v, pa.binary()) for v in values], *kept], names=schema.fieldNames())

        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= _BLOCK:
                table = pa.Table.from_batches(held)
                yield emit(table.slice(0, _BLOCK))
                held = table.slice(_BLOCK).to_batches()
                count -= _BLOCK
        if count:
            yield emit(pa.Table.from_batches(held))

    return rows.select("id", "label", "numbers", *[f.name for f in more]).mapInArrow(run, schema)


def _meeting(rows: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """Each block of rows beside each block of anchors, by group numbers: the anchors are copied for each group."""
    names = [f.name for f in _BLOCK_FIELDS]
    left = rows.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")).repartition(groups, "group")
    copies = anchors.select(*[F.col(c).alias(f"anchor_{c}") for c in anchors.columns], F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    kept = [c for c in anchors.columns if c not in names]
    return (left.join(copies.repartition(groups, "group").hint("merge"), "group")
            .select(*names, *[f"anchor_{c}" for c in names], *[F.col(f"anchor_{c}").alias(c) for c in kept]))


def _pairs_of(row: pa.RecordBatch, i: int) -> tuple[Block, Block]:
    names = [f.name for f in _BLOCK_FIELDS]
    return tuple(Block(*[row.column(p + c)[i].as_py() for c in names]) for p in ("", "anchor_"))


def _rows(found: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    table = np.array(found, np.int64).reshape(-1, len(schema))
    return pa.RecordBatch.from_arrays([pa.array(table[:, k]) for k in range(len(schema))], names=schema.fieldNames())


def _first(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows of each key by score, ties by id, with their rank."""
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def mined(vectors: DataFrame, is_anchor: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, positives: int = 5,
          negatives: int = 5, share: tuple[int, int] = (4, 5), planes: int = 6) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (`is_anchor`, over the column `id`)
    and each of its `positives` best other rows of the same label, the `negatives` best rows of other labels whose score is at most
    the positive's and at least `share` of it. Ties go to the smaller id."""
    rows = whole_numbers(vectors, label, vec_id, vector, scale)
    bytes_, total, chosen = rows.agg(F.max(F.length("numbers")), F.count("*"), F.count_if(is_anchor)).first()
    width = max(1, (bytes_ or 0) // 4)
    blocks = stored(_blocks(rows, width), "vector-blocks")
    parts = chosen // _BLOCK + 1
    anchors = rows.where(is_anchor)
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, min(total // 256 + 1, max(shuffles, total // (_BLOCK * _GROUP_BLOCKS))))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _rows(list(nearest_same(*_pairs_of(batch, i), planes, positives)), _FOUND)

    near = _meeting(blocks, stored(_blocks(anchors.repartition(parts, "id"), width), "anchor-blocks"), groups).mapInArrow(same, _FOUND)
    best = stored(_first(stored(near, "near-of-blocks", _BATCH_PAIRS), ["anchor_id"], positives), "positives")
    pair = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    wanted = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "score"))).alias("wanted"))  # at most `positives` each
    known = _blocks(anchors.join(wanted, F.col("id") == F.col("anchor_id")).repartition(parts, "id"), width, T.StructType([T.StructField("wanted", T.ArrayType(pair))]))

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                listed = [[(p["vec_id"], p["score"]) for p in one] for one in batch.column("wanted")[i].as_py()]
                yield _rows(list(nearest_other(*_pairs_of(batch, i), listed, planes, negatives, share)), _CHOSEN)

    found = stored(_meeting(blocks, stored(known, "anchors-with-positives"), groups).mapInArrow(other, _CHOSEN), "others-of-blocks", _BATCH_PAIRS)
    return (_first(found, ["anchor_id", "positive_id"], negatives)
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
