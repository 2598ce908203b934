"""WARC archives: write captures, read records, and put each capture's records together again.

A capture is three records: a response, or a revisit if another capture already has the same payload; a request; and a
metadata record. Request and metadata name the response in WARC-Concurrent-To. Files are written and read by Spark's text
source alone, as gzip files of at most `per_file` records: a record is one string whose separator is the blank line that
ends it, and reading splits at the version line. Where a payload holds such a line itself, the reader puts the pieces
together by Content-Length; it holds one record at a time.

A null payload is empty. Line ends in an address are percent-encoded, a null address is left out. Rows with a null id are
responses and are never referred to. Of repeated rows one is the response and the others revisit it. Records that end too
early, or have no length, are rows of type `damaged`. A request or metadata record whose response is missing is left out of
the captures; a revisit whose response is missing keeps its declared digest and has no length."""

from __future__ import annotations

import functools
import hashlib
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from cutline.llm.frames import stored

_VERSION = "WARC/1.1\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "application/http;msgtype="


def _uuid(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    pieces = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _record(block: Column, **fields: Column | str) -> Column:
    """One record without its version line's separator; fields that are null are left out."""
    lines = []
    for name, value in fields.items():
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(name.replace("_", "-") + ": "), value, F.lit("\r\n"))).otherwise(""))
    return F.concat(F.lit(_VERSION), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def planned(pages: DataFrame, page_id: str, url: str, payload: str, least: int) -> DataFrame:
    """Each page with its payload's digest and size, its capture's record id, and what a revisit refers to."""
    rows = (pages.select(F.col(page_id).cast("long").alias("page_id"), F.regexp_replace(F.regexp_replace(F.col(url).cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
                         F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
            .withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("size", F.octet_length("payload").cast("long")))
    # Rows equal in all three are told apart by a number; there are none as a rule, so that payloads are not dealt out for it.
    same = ("page_id", "url", "digest")
    twice = stored(rows.groupBy(*same).count().where("count > 1").select(*(F.col(c).alias(f"_{c}") for c in same)), "warc-twice")
    if twice.isEmpty():
        rows = rows.withColumn("copy", F.lit(1))
    else:
        match = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same))
        rows = (rows.join(twice, match, "left_anti").withColumn("copy", F.lit(1))
                .unionByName(rows.join(twice, match, "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy(*same).orderBy("size")))))
    key = (F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.col("digest"), F.col("copy").cast("string"), F.coalesce("url", F.lit("")))
    rows = rows.withColumn("record_id", _uuid(*key))
    first = (rows.where(F.col("page_id").isNotNull() & (F.col("size") >= least)).groupBy("digest")
             .agg(F.min(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"), "copy", "record_id"))["record_id"].alias("first_id")))
    again = F.col("page_id").isNotNull() & (F.col("size") >= least) & (F.col("record_id") != F.col("first_id"))
    return rows.join(first, "digest", "left").withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id")


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 100,
          date: str = "2000-01-01T00:00:00Z", per_file: int = 30_000) -> None:
    """Archive all pages. Payloads of at least `least` bytes are kept once."""
    plan = planned(pages, page_id, url, payload, least)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    common = {"WARC_Date": date, "WARC_Target_URI": F.col("url")}
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    response = _record(F.concat(head, "payload"), WARC_Type="response", WARC_Record_ID=F.col("record_id"), **common, WARC_Payload_Digest=digest, Content_Type=_HTTP + "response")
    revisit = _record(head, WARC_Type="revisit", WARC_Record_ID=F.col("record_id"), **common, WARC_Payload_Digest=digest, WARC_Profile=_REVISIT,
                      WARC_Refers_To=F.col("refers_to"), Content_Type=_HTTP + "response")
    path = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), F.coalesce(path, F.lit("")))), F.lit(" HTTP/1.1\r\nHost: "),
                   F.coalesce(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")), F.lit("\r\n\r\n"))
    request = _record(ask, WARC_Type="request", WARC_Record_ID=_uuid(F.lit("request"), F.col("record_id")), **common, WARC_Concurrent_To=F.col("record_id"), Content_Type=_HTTP + "request")
    about = F.when(F.col("page_id").isNotNull(), F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit("\r\n"))).otherwise("")
    metadata = _record(about, WARC_Type="metadata", WARC_Record_ID=_uuid(F.lit("metadata"), F.col("record_id")), **common, WARC_Concurrent_To=F.col("record_id"), Content_Type="application/warc-fields")
    records = plan.select(F.explode(F.array(request, F.when(F.col("refers_to").isNull(), response).otherwise(revisit), metadata)).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


_RECORD = T.StructType([T.StructField(n, T.StringType()) for n in (
    "type", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "declared_digest", "content_type", "http_head")]
    + [T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType())])
_FIELDS = ("warc-type", "warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest", "content-type")


def _lines(head: bytes) -> dict[str, str]:
    """Header fields by lower-cased name; a line that begins with white space continues the one before it."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _size(piece: bytes) -> tuple[dict[str, str], int, int] | None:
    """Fields, start and length of a record's block, as soon as its header is whole."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = _lines(piece[:end])
    length = fields.get("content-length", "")
    return (fields, end + 4, int(length)) if length.isdigit() else None


def _row(fields: dict[str, str], block: bytes) -> tuple:
    head, payload = None, block
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        head = head.decode("utf-8", "replace")
    return (*(fields.get(n) for n in _FIELDS), head, payload, len(payload), hashlib.sha256(payload).hexdigest())


_DAMAGED = ("damaged", *[None] * 8, None, None, None)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(f.name, {"payload": pa.binary(), "payload_bytes": pa.int64()}.get(f.name, pa.string())) for f in _RECORD.fields])
    file, size, held, length = None, None, [], 0  # `held`: the pieces of the record at hand, `length` bytes so far
    rows: list[tuple] = []
    weight = 0

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    for batch in batches:
        for name, piece in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if name != file:
                if any(held):
                    rows.append(_DAMAGED)
                file, size, held, length = name, None, [], 0
            held.append(piece)
            length += len(piece) + (len(_VERSION) if len(held) > 1 else 0)
            size = size or _size(_VERSION.encode().join(held) if len(held) < 3 else b"")
            if size is None and not piece and len(held) == 1:
                held, length = [], 0  # what stands before a file's first version line
            if size is None or length < size[1] + size[2]:
                continue
            whole = _VERSION.encode().join(held)
            rows.append(_row(size[0], whole[size[1]:size[1] + size[2]]))
            weight += size[2]
            size, held, length = None, [], 0
            if weight > 1 << 23 or len(rows) >= 5000:
                yield emit()
                rows.clear()
                weight = 0
    if any(held):
        rows.append(_DAMAGED)
    yield emit()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record. The digest is that of the payload as read; `declared_digest` is what its header says."""
    pieces = spark.read.option("lineSep", _VERSION).text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(_parse, _RECORD)


def captures(records: DataFrame, payloads: bool = True) -> DataFrame:
    """One nested row per capture: the response or revisit, with its request and metadata; payload size and digest are those
    of the full payload, which a revisit takes from the response that it refers to. Without `payloads` the bytes are left
    out; sizes and digests are always there."""
    heads = stored(records.withColumn("about", F.when(F.col("type") == "metadata", F.col("payload").cast("string"))).drop("payload"), "warc-records")
    main = heads.where(F.col("type").isin("response", "revisit"))
    requests = heads.where("type = 'request'").groupBy("concurrent_to").agg(F.min(F.struct("record_id", "http_head")).alias("request"))
    page = F.regexp_extract("about", "(?m)^page_id: (-?[0-9]+)", 1)
    metadata = (heads.where("type = 'metadata'").groupBy("concurrent_to")
                .agg(F.min(F.struct("record_id", "about", F.when(page != "", page).cast("long").alias("page_id"))).alias("metadata")))
    whole = (main.join(requests.withColumnRenamed("concurrent_to", "record_id"), "record_id", "left")
             .join(metadata.withColumnRenamed("concurrent_to", "record_id"), "record_id", "left"))
    origin = whole.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("origin_bytes"),
                                                     F.col("payload_digest").alias("origin_digest"), F.col("metadata.page_id").alias("refers_to_page"))
    nested = (F.struct(F.col("http_head").alias("head")).alias("response"), "request", "metadata")
    own = whole.where("type = 'response'").select("record_id", F.col("type").alias("record_type"), "target_uri", "date", "refers_to", F.lit(None).cast("long").alias("refers_to_page"),
                                                  "payload_bytes", "payload_digest", *nested)
    again = whole.where("type = 'revisit'").join(origin, "refers_to", "left").select(
        "record_id", F.col("type").alias("record_type"), "target_uri", "date", "refers_to", "refers_to_page", F.col("origin_bytes").alias("payload_bytes"),
        F.coalesce("origin_digest", F.regexp_replace("declared_digest", "^sha256:", "")).alias("payload_digest"), *nested)
    out = own.unionByName(again)
    if not payloads:
        return out
    bodies = records.where("type = 'response'").select(F.col("record_id").alias("body_of"), "payload")
    return out.join(bodies, F.coalesce("refers_to", "record_id") == F.col("body_of"), "left").drop("body_of")
