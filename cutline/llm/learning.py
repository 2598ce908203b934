"""What the two classifiers share: bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cutline.llm.frames import one_label, stored

SAMPLE_ROWS = 20_000


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """id, text, label and a uniform `part` from 0 to 1 of at most `rows` labelled documents, those with the least hash of
    their id: a bounded sample, whatever the number of labels. `learn` says which ids may be learned from; `docs` has id and
    text. One row per id; of several the one with the greatest text."""
    known = one_label(labels, label).select(F.col("doc_id").cast("long").alias("id"), F.col(label).alias("label")).where(learn)
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)  # a few bytes for each row, so that its size is bounded too
    found = docs.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("text").alias("text"), F.first("label").alias("label"))
    part = (F.crc32(F.concat(F.lit("part"), F.col("id").cast("string")).cast("binary")) % 10_000) / 10_000
    return stored(found.select("id", "text", "label", part.alias("part")), f"sample-{label}")


def both_classes(rows: DataFrame) -> bool:
    return rows.select("label").distinct().count() == 2


def base_rate(rows: DataFrame) -> float:
    found = rows.agg(F.avg("label")).first()[0]
    return 0.0 if found is None else float(found)
