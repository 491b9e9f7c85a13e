"""Archives: exact round trips, the format itself, revisits."""

import gzip
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import warc
from tidewatch.session import checkpoint_dir, staged

BIG = "<p>é日\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3000
PAGES = [(4, "http://a/", "x" * 100), (2, None, "x" * 100), (9, "http://b/\r\nX: y", "x" * 99), (8, "", "x" * 99), (1, "u", None), (None, "u", ""), (5, "u", BIG),
         (6, "u", BIG), (7, "u", "WARC/1.1\r\n"), (7, "u", "\r\n\r\n"), (3, "u", "tail\r\n\r\nWARC/1.1"), (10, "u", "y" * 200), (10, "u", "y" * 200)]


def expected(pages):
    out, holder = [], {}
    for i, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            holder[data] = min(i, holder.get(data, i))
    used = set()
    for i, _, html in pages:
        data = (html or "").encode()
        first = data not in holder or (holder[data] == i and data not in used)
        used |= {data} if first else set()
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if first else "revisit", None if first else holder[data]))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [7, 1000, 1 << 16])
def test_pages_come_back(spark, chunk):
    pages = PAGES if chunk > 7 else [p for p in PAGES if p[2] != BIG]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, record_no string")
    assert sorted((tuple(r) for r in warc.archive_and_read(df, chunk).collect()), key=str) == expected(pages)


def test_empty_table(spark):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.sampled_from([b"\r\n\r\n", b"WARC/1.1", b"\r\n", b"W", b"\r\n\r\nWARC/1.1\r\n"]), max_size=6))
def test_pieces_hold_no_border(data, parts):
    data = b"".join(parts) + data + b"".join(reversed(parts))
    pieces = warc.safe_pieces(data)
    assert b"".join(pieces) == data
    file = b"".join(b"WARC/1.1\r\nh: 1\r\n\r\n" + p + b"\r\n\r\n" for p in pieces)
    records = file.removeprefix(b"WARC/1.1\r\n").split(b"\r\n\r\nWARC/1.1\r\n")
    assert [r.split(b"\r\n\r\n", 1)[1][:len(p)] for r, p in zip(records, pieces, strict=True)] == pieces
    assert all(len(r.split(b"\r\n\r\n", 1)[1]) == len(p) for r, p in zip(records[:-1], pieces))


def test_chunks_carry_digests(spark):
    df = spark.createDataFrame([(1, "a" * 25), (2, "")], "page_id long, html string")
    rows = sorted(warc.chunk_records(df, F.col("html"), "page_id", chunk_bytes=10).collect(), key=lambda r: (r.page_id, r.chunk_no))
    assert [(r.page_id, r.chunk_no, bytes(r.data), r.so_far, r.last) for r in rows] == [
        (1, 0, b"a" * 10, 10, False), (1, 1, b"a" * 10, 20, False), (1, 2, b"a" * 5, 25, True), (2, 0, b"", 0, True)]
    assert [r.digest for r in rows] == [hashlib.sha256(b"a" * n).hexdigest() for n in (10, 20, 25, 0)]


def test_files_are_warc(spark, tmp_path):
    df = spark.createDataFrame([(k, "http://x/", html) for k, (_, _, html) in enumerate(PAGES)], "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archives(staged(warc.chunk_records(df, F.col("html"), "page_id", "url", chunk_bytes=50_000)), path)
    found = {}
    for file in (tmp_path / "archive").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:  # a reader that only knows the standard
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            size = int(fields["Content-Length"])
            assert lines[0] == "WARC/1.1" and rest[size:size + 4] == b"\r\n\r\n"
            origin = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
            found.setdefault(origin, []).append((int(fields.get("WARC-Segment-Number", 1)), fields, rest[:size]))
            data = rest[size + 4:]
    payloads = {}
    for parts in found.values():
        parts.sort(key=lambda p: p[0])
        if parts[0][1]["WARC-Type"] == "response":
            payloads[int(parts[0][1]["X-Page-Id"])] = b"".join(p[2] for p in parts)
            assert parts[-1][1]["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payloads[int(parts[0][1]["X-Page-Id"])]).hexdigest()
    assert payloads == {k: (h or "").encode() for k, (_, _, h) in enumerate(PAGES) if k not in (1, 7, 12)}


def test_damage_is_noticed(spark):
    df = spark.createDataFrame([(1, "u", "x" * 300)], "page_id long, url string, html string")
    path = f"{checkpoint_dir(spark)}/damaged-archive-{spark.sparkContext.applicationId}"
    warc.write_archives(staged(warc.chunk_records(df, F.col("html"), "page_id", "url")), path, compression="none")
    broken = warc.read_archives(spark, path).withColumn("data", F.encode(F.lit("y" * 300), "UTF-8"))
    with pytest.raises(Exception, match="digest"):
        warc.payloads(broken).collect()
