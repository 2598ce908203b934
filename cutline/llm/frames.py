"""Small helpers on frames that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cutline import session

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def stored(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Write a frame to the shared folder and read it back. Texts go to Python in batches of at most `rows` meanwhile, so
    that a task holds few of them; the session's own setting is restored."""
    conf = df.sparkSession.conf
    before = conf.get(_BATCH_ROWS)
    conf.set(_BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        return session.stored(df, name)
    finally:
        conf.set(_BATCH_ROWS, before)


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")


def per_batch(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: T.StructType, rows: int = 2000) -> DataFrame:
    """`function` turns some rows, at most `rows`, into columns by name; it may give more or fewer rows than it gets."""
    names = schema.fieldNames()
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                columns = function(whole.slice(start, rows))
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, arrow.field(n).type) for n, c in ((n, columns[n]) for n in names)], schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(),
            T.BinaryType: pa.binary(), T.BooleanType: pa.bool_()}[type(kind)]


def lists(values, offsets, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the offsets between its rows."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def few(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """A stored frame in no more partitions than its rows fill. Steps between frames of one partition need no exchange."""
    return df.coalesce(-(-max(1, df.count()) // rows))


_BITS = 1 << 24


def marked(df: DataFrame, ids: DataFrame, column: str, id_column: str) -> DataFrame:
    """The rows with `_may`: false where the id is certainly not among `ids`, true where it is, and for few others.

    A bitmap of fixed size (at most 262,144 rows of 64 bits, 4 MB) is broadcast, so rows that need not meet the ids are never
    dealt out; where ids are so many that it fills up, it only stops helping."""
    def place(name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(_BITS))

    words = (ids.where(F.col(id_column).isNotNull()).select(place(id_column).alias("_p"))
             .groupBy(F.shiftright("_p", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_p % 64 AS INT))")).alias("_bits")))
    held = df.withColumn("_p", place(column)).withColumn("_w", F.shiftright("_p", 6)).join(F.broadcast(words), F.col("_w") == F.col("_word"), "left")
    hit = F.expr("shiftrightunsigned(_bits, CAST(_p % 64 AS INT)) & 1") == 1
    return held.withColumn("_may", F.coalesce(hit, F.lit(False)) & F.col(column).isNotNull()).drop("_p", "_w", "_word", "_bits")


def among(df: DataFrame, ids: DataFrame, column: str, id_column: str) -> DataFrame:
    """Rows whose id is among `ids`; only those that may be are dealt out."""
    right = ids.select(F.col(id_column).cast("long").alias("_id")).distinct()
    return marked(df, ids, column, id_column).where("_may").drop("_may").join(right, F.col(column).cast("long") == F.col("_id"), "left_semi")


def not_among(df: DataFrame, ids: DataFrame, column: str, id_column: str) -> DataFrame:
    """The other rows, those with a null id included."""
    right = ids.select(F.col(id_column).cast("long").alias("_id")).distinct()
    rows = marked(df, ids, column, id_column)
    return rows.where("NOT _may").drop("_may").unionByName(rows.where("_may").drop("_may").join(right, F.col(column).cast("long") == F.col("_id"), "left_anti"))


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo a number: which labelled rows are held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def one_label(labels: DataFrame, column: str, doc_id: str = "doc_id") -> DataFrame:
    """One label per document: the highest, where there are several; null ids and null labels say nothing."""
    return (labels.where(F.col(doc_id).isNotNull() & F.col(column).isNotNull())
            .groupBy(doc_id).agg(F.max(column).cast("int").alias(column)))


__all__ = ["among", "arrow_type", "few", "lists", "marked", "not_among", "one_label", "per_batch", "remainder", "stored", "table"]
