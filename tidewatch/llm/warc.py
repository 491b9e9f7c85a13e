"""WARC archives by way of a chunked record table."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import checkpoint_dir, staged

CHUNK_BYTES = 1 << 16
LEAST_SHARED = 100  # bytes; shorter payloads are never revisits
BROADCAST_RECORDS = 500_000  # so many narrow rows about revisits are sent to all tasks at most
VERSION = "WARC/1.1"  # fixed value: the first line of a record
_END = "\r\n\r\n"
_NEXT = f"{_END}{VERSION}"
_DATE = "2024-01-01T00:00:00Z"


# --- the chunked record table -------------------------------------------------------------------

def chunk_records(records: DataFrame, payload: Column, *keep: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(record_no, keep..., chunk_no, data, so_far, digest, last): payloads as bounded rows, in order within a task.

    `so_far` and `digest` (SHA-256, hex) cover the payload up to and with this chunk: the state goes from row to row, no
    task puts a payload together. Where a payload's bytes would read as the border between two archived records, it is
    cut once more. A null payload is one empty chunk. record_no is unique within one write of the table (see `staged`).
    """
    whole = F.coalesce(payload.cast("binary"), F.lit(b""))
    rows = records.select(F.monotonically_increasing_id().alias("record_no"), *keep, whole.alias("_p"))
    parts = F.greatest(F.ceil(F.octet_length("_p") / float(chunk_bytes)), F.lit(1)).cast("int")
    pieces = rows.select("record_no", *keep, F.octet_length("_p").cast("long").alias("_size"), "_p",
                         F.explode(F.sequence(F.lit(0), parts - 1)).alias("_at")).select(
        "record_no", *keep, "_size", F.substring("_p", F.col("_at") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"))
    names = ["record_no", *keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*names).schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, state, so_far, number = None, None, 0, 0
        for batch in batches:
            # A few MB at a time, whatever the batch holds.
            for low in range(0, batch.num_rows, 64):
                some = batch.slice(low, 64)
                source, out = [], {k: [] for k in ("chunk_no", "data", "so_far", "digest", "last")}
                for k, (this, size, data) in enumerate(zip(*(some.column(c).to_pylist() for c in ("record_no", "_size", "data")))):
                    if this != record:
                        record, state, so_far, number = this, hashlib.sha256(), 0, 0
                    for piece in safe_pieces(data):
                        state.update(piece)
                        so_far += len(piece)
                        for name, value in zip(out, (number, piece, so_far, state.hexdigest(), so_far == size)):
                            out[name].append(value)
                        source.append(k)
                        number += 1
                kinds = (pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_())
                kept = some.select(names).take(pa.array(source, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(v, t) for v, t in zip(out.values(), kinds))], names=[*names, *out])

    return pieces.mapInArrow(cut, f"{schema}, chunk_no int, data binary, so_far long, digest string, last boolean")


def safe_pieces(data: bytes) -> list[bytes]:
    """`data` cut so that no piece holds the border of two records or, right after a header, begins like one."""
    border, begin = _NEXT.encode(), VERSION.encode()
    out = []
    while True:
        at = data.find(border)
        cut = at + len(_END) + 1 if at >= 0 else 0
        for lead in (b"", b"\r\n"):  # each piece follows a header's empty line
            if data.startswith(lead + begin):
                cut = len(lead) + 1
        if not cut:
            return [*out, data]
        out.append(data[:cut])
        data = data[cut:]


# --- archives -------------------------------------------------------------------------------------

def _urn(number: Column) -> Column:
    return F.concat(F.lit("<urn:x-record:"), number.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; line breaks in values become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.translate(value.cast("string"), "\r\n", "  "), F.lit("\r\n")), F.lit(""))


def with_types(chunks: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(record_no, refers_no, refers_to) of the records that revisit another one.

    Of records with equal payloads of `least` bytes or more the one with the smallest page_id (null last, then the
    smallest record_no) holds the payload.
    """
    heads = chunks.where(F.col("last") & (F.col("so_far") >= least)).select("record_no", "page_id", "digest")
    order = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "record_no")
    holders = heads.groupBy("digest").agg(F.min(order).alias("h"), F.count("*").alias("n")).where("n > 1")
    return heads.join(holders, "digest").where(F.col("record_no") != F.col("h.record_no")).select(
        "record_no", F.col("h.record_no").alias("refers_no"), F.col("h.page_id").alias("refers_to"))


def write_archives(chunks: DataFrame, path: str, compression: str = "gzip", least: int = LEAST_SHARED) -> None:
    """WARC files of all records of a chunk table with page_id and url.

    A record of several chunks is a response and continuations with segment numbers, as the standard has it; a revisit
    has headers only. Spark's own writer puts the files into any file system; one row is one record of the file.
    """
    revisits = staged(with_types(chunks, least))
    rows = chunks.join(F.broadcast(revisits) if revisits.count() <= BROADCAST_RECORDS else revisits, "record_no", "left")
    again, first = F.col("refers_no").isNotNull(), F.col("chunk_no") == 0
    rows = rows.where(~again | F.col("last"))
    one = first & F.col("last")
    kind = F.when(again, "revisit").when(first, "response").otherwise("continuation")
    name = F.when(again | first, _urn(F.col("record_no"))).otherwise(
        _urn(F.concat(F.col("record_no").cast("string"), F.lit("-"), (F.col("chunk_no") + 1).cast("string"))))
    segment = F.when(~again & ~one, F.col("chunk_no") + 1)
    header = F.concat(
        F.lit(f"{VERSION}\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", name), _line("WARC-Date", F.lit(_DATE)),
        _line("WARC-Target-URI", F.when(again | first, F.col("url"))), _line("X-Page-Id", F.when(again | first, F.col("page_id"))),
        _line("WARC-Refers-To", _urn(F.col("refers_no"))), _line("X-Refers-To-Page-Id", F.col("refers_to")),
        _line("WARC-Segment-Number", segment), _line("WARC-Segment-Origin-ID", F.when(segment > 1, _urn(F.col("record_no")))),
        _line("WARC-Segment-Total-Length", F.when(segment.isNotNull() & F.col("last"), F.col("so_far"))),
        _line("WARC-Payload-Digest", F.when(again | F.col("last"), F.concat(F.lit("sha256:"), F.col("digest")))),
        _line("X-Digest-So-Far", F.when(~again & ~F.col("last"), F.concat(F.lit("sha256:"), F.col("digest")))),
        _line("Content-Type", F.when(again | first, "text/html; charset=utf-8")),
        _line("Content-Length", F.when(again, 0).otherwise(F.octet_length("data"))), F.lit("\r\n"))
    body = F.when(again, F.lit("")).otherwise(F.col("data").cast("string"))
    rows.select(F.concat(header, body).alias("value")).write.option("lineSep", _END).option("compression", compression).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per archived record or segment: its headers' values and `data`, cut by Content-Length.

    Needs archives whose payloads don't hold a record border, as `write_archives` makes them.
    """
    rows = spark.read.option("lineSep", f"{_NEXT}\r\n").schema("value string").text(path)
    head = F.substring_index("value", _END, 1)
    rows = rows.select(F.col("value").cast("binary").alias("raw"), head.alias("head"))

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract(F.col("head"), rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))

    def number(column: Column, part: int = 1) -> Column:
        return F.nullif(F.regexp_extract(column, r"^<urn:x-record:(\d+)", part), F.lit("")).cast("long")

    size = field("Content-Length").cast("long")
    record = number(field("WARC-Record-ID"))
    data = F.substring(F.col("raw"), F.octet_length("head") + len(_END) + 1, size.cast("int"))
    return rows.select(
        F.coalesce(number(field("WARC-Segment-Origin-ID")), record).alias("record_no"), field("WARC-Type").alias("warc_type"),
        field("X-Page-Id").cast("long").alias("page_id"), field("WARC-Target-URI").alias("url"),
        F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(0)).alias("segment"),
        number(field("WARC-Refers-To")).alias("refers_no"), field("X-Refers-To-Page-Id").cast("long").alias("refers_to"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        F.substring_index(field("X-Digest-So-Far"), ":", -1).alias("so_far_digest"), size.alias("size"), data.alias("data"))


def payloads(segments: DataFrame) -> DataFrame:
    """(record_no, page_id, payload_bytes, payload_digest) of records that hold a payload, streamed and checked.

    Segments of a record are sorted by number and hashed one after another; records of one segment need no shuffle. A
    length or digest other than the archive says fails the job.
    """
    held = segments.where("warc_type <> 'revisit'").select("record_no", "page_id", "segment", "size", "payload_digest", "so_far_digest", "data")
    single, several = held.where("segment = 0"), held.where("segment > 0")
    several = several.repartition("record_no").sortWithinPartitions("record_no", "segment")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = page = state = None
        total = expected = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                some = batch.slice(low, 64)
                out = []
                for this, page_id, segment, size, digest, so_far, data in zip(*(c.to_pylist() for c in some.columns)):
                    if this != record:
                        record, page, state, total, expected = this, page_id, hashlib.sha256(), 0, min(segment, 1)
                    if segment != expected or len(data) != size:
                        raise ValueError(f"record {this}: segment {segment} of {size} bytes, not {expected} of {len(data)}")
                    state.update(data)
                    total, expected = total + size, segment + 1
                    if (digest or so_far) != state.hexdigest():
                        raise ValueError(f"record {this}: segment {segment} doesn't match its digest")
                    if digest:
                        out.append((this, page, total, digest))
                columns = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                                 names=["record_no", "page_id", "payload_bytes", "payload_digest"])

    schema = "record_no long, page_id long, payload_bytes long, payload_digest string"
    return single.mapInArrow(read, schema).unionByName(several.mapInArrow(read, schema))


def archive_and_read(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write `pages` (page_id, url, html) as WARC and read it back: a row per page.

    (page_id, payload_bytes, payload_digest, record_type, refers_to). The payload is the html in UTF-8, null is empty. Rows
    with a null or repeated page_id, a null url or an empty html are records like others; other columns are not
    read. A revisit's length and digest are those of the record it refers to, read from the archive.
    """
    spark = pages.sparkSession
    chunks = staged(chunk_records(pages, F.encode("html", "UTF-8"), "page_id", "url", chunk_bytes=chunk_bytes))
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(chunks, path)
    segments = read_archives(spark, path)
    held = staged(payloads(segments))
    revisits = segments.where("warc_type = 'revisit'").select("page_id", "refers_no", "refers_to", F.col("payload_digest").alias("said"))
    source = held.select(F.col("record_no").alias("refers_no"), "payload_bytes", "payload_digest")
    again = revisits.join(source, "refers_no", "left").select(
        "page_id", "payload_bytes",
        F.when(F.col("payload_digest") == F.col("said"), F.col("said")).otherwise(F.raise_error("a revisit refers to another payload")).alias("payload_digest"),
        F.lit("revisit").alias("record_type"), "refers_to")
    return held.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
                       F.lit(None).cast("long").alias("refers_to")).unionByName(again)
