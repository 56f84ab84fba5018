"""WARC archives as a chunked record table.

Writing: one record per page.  Payloads above ``chunk_bytes`` are cut natively
into segments, each a row of its own (record id, chunk number), so no stage
needs a buffer for a whole oversized record; archives are written by Spark's
text writer, whose line separator is the end of a WARC record.  Reading: each
archive is streamed in order; every chunk becomes a row that carries the
running SHA-256 of its record up to there, and the last one the digest of the
full payload.

Of records with equal payloads of at least ``min_revisit`` bytes, the one with
the smallest page id is a response and the others are revisits of it.

Defined results: null html is an empty payload; rows repeated with one page id
and payload are all written, alike; a null page id sorts last and is written as
an empty id; a null url is left out; control characters and spaces in a url are
percent-encoded; an empty table writes an archive folder without records.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, scratch_dir, small_batches

CHUNK_BYTES, MIN_REVISIT = 1 << 16, 100
#: Fixed values of the WARC 1.1 format.
VERSION, END = "WARC/1.1\r\n", "\r\n\r\n"
#: What Spark splits archives at: a record's end and the next one's first line.
SPLIT = END + VERSION
CHUNK = "record_id string, page_id long, url string, record_type string, refers_to long, chunk_no int, last boolean, chunk_bytes long, payload_bytes long, running_sha256 string, data binary"


def _field(name: str, value: Column) -> Column:
    """A header line; nothing for null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def _safe_url(url: Column) -> Column:
    for code in (*range(0x21), 0x7F):
        if code in (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x00, 0x7F):
            url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def payload_digests(pages: DataFrame) -> DataFrame:
    """Per page: page_id, digest (binary SHA-256), bytes."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", F.unhex(F.sha2(html, 256)).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))


def records(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """One row per WARC record segment: its text, without the end of the record."""
    repeated = cut(
        payload_digests(pages).where(F.col("bytes") >= min_revisit)
        .groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).where("n > 1 and first_page is not null").drop("n")
    )
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.cast("binary").alias("payload"),
        F.sha2(html, 256).alias("hex"), F.octet_length(html).alias("bytes"),
    )
    # AQE broadcasts the repeated digests only if they measure small; otherwise it splits hot ones.
    rows = rows.join(repeated, F.unhex("hex") == F.col("digest"), "left")
    revisit = F.coalesce(F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page")), F.lit(False))
    rows = rows.withColumn("revisit", revisit).withColumn("refers", F.when(F.col("revisit"), F.col("first_page")))
    segments = F.when(F.col("revisit"), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("bytes") / chunk_bytes)).cast("int"))
    rows = rows.withColumn("segments", segments)
    # All segments of a payload are cut before the rows multiply, so that none of these carries the whole payload.
    part = lambda no: F.when(F.col("revisit"), F.lit("").cast("binary")).when(F.col("segments") == 1, F.col("payload")).otherwise(F.substring(F.col("payload"), (no - 1) * chunk_bytes + 1, F.lit(chunk_bytes)))
    parts = F.transform(F.sequence(F.lit(1), F.col("segments")), lambda no: F.struct(no.alias("no"), part(no).alias("body")))
    rows = rows.select("page_id", "url", "hex", "bytes", "revisit", "refers", "segments", F.inline(parts))
    first = F.col("no") == 1
    head = F.when(first, F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))).otherwise(F.lit(""))
    origin = F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.substring("hex", 1, 16), F.lit(">"))
    parted = F.col("segments") > 1
    kind = F.when(~first, F.lit("continuation")).when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))
    text = F.concat(
        F.lit(VERSION), _field("WARC-Type", kind),
        _field("WARC-Record-ID", F.when(first, origin).otherwise(F.concat(F.rtrim(origin, F.lit(">")), F.lit(":"), F.col("no").cast("string"), F.lit(">")))),
        _field("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _field("WARC-Target-URI", _safe_url(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("hex"))),
        _field("WARC-Refers-To", F.when(F.col("revisit"), F.concat(F.lit("<urn:x-page:"), F.col("refers").cast("string"), F.lit(":"), F.substring("hex", 1, 16), F.lit(">")))),
        _field("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _field("WARC-Segment-Number", F.when(parted, F.col("no").cast("string"))),
        _field("WARC-Segment-Origin-ID", F.when(~first, origin)),
        _field("WARC-Segment-Total-Length", F.when(parted & (F.col("no") == F.col("segments")), F.col("bytes").cast("string"))),
        _field("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        _field("Content-Length", (F.octet_length(head) + F.octet_length("body")).cast("string")),
        F.lit("\r\n"), head, F.col("body").cast("string"),
    )
    return rows.select(text.alias("value"))


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, min_revisit: int = MIN_REVISIT) -> None:
    """Write gzipped archives under ``path``, one per partition of ``pages``, in any store Spark writes."""
    records(pages, chunk_bytes, min_revisit).write.option("lineSep", END).option("compression", "gzip").text(path)


_HEADER = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")
_PAGE = re.compile(r"<urn:x-page:(-?\d*):[0-9a-f]*>")


def _page(record_id: str) -> int | None:
    m = _PAGE.fullmatch(record_id)
    return int(m[1]) if m and m[1] else None


class _Reader:
    """Chunk rows of one archive, fed with Spark's pieces of it in order."""

    def __init__(self):
        self.held: list[bytes] = []
        self.missing = 0
        self.open: dict[str, list] = {}  # segmented records under way: digest, bytes, first header

    def feed(self, piece: bytes):
        """Rows of the records that ``piece`` completes; payloads may hold the separator, lengths decide."""
        if self.missing > 0:
            # The separator was part of a payload.
            self.held += [SPLIT.encode(), piece]
            self.missing -= len(SPLIT) + len(piece)
            if self.missing > 0:
                return
            piece, self.held = b"".join(self.held), []
        piece = piece.removeprefix(VERSION.encode())
        head_end = piece.index(b"\r\n\r\n") + 4
        head = {k.lower(): v.decode("utf-8", "replace") for k, v in _HEADER.findall(piece[: head_end - 2])}
        length = int(head[b"content-length"])
        if len(piece) - head_end < length:
            self.held, self.missing = [VERSION.encode(), piece], head_end + length - len(piece)
            return
        yield self.row(head, piece[head_end : head_end + length])

    def row(self, head: dict, block: bytes) -> tuple:
        kind, no = head[b"warc-type"], int(head.get(b"warc-segment-number", "1"))
        record_id = head.get(b"warc-segment-origin-id", head[b"warc-record-id"])
        declared = None
        if no == 1:
            start = block.index(b"\r\n\r\n") + 4
            declared = int(re.search(rb"(?im)^Content-Length:\s*(\d+)", block[:start])[1])
            block = block[start:]
        if kind == "revisit":
            digest, total, last = head[b"warc-payload-digest"].removeprefix("sha256:"), declared, True
        elif b"warc-segment-number" not in head:
            digest, total, last = hashlib.sha256(block).hexdigest(), len(block), True
        else:
            if no == 1:
                self.open[record_id] = [hashlib.sha256(), 0, 1, head]
            state = self.open[record_id]
            if state[2] != no:
                raise ValueError(f"segment {no} of {record_id} is out of order")
            state[0].update(block)
            state[1] += len(block)
            state[2] += 1
            last = b"warc-segment-total-length" in head
            digest, total = state[0].hexdigest(), state[1]
            if last:
                head = self.open.pop(record_id)[3]
        stated = head.get(b"warc-payload-digest")
        if last and stated != f"sha256:{digest}":
            raise ValueError(f"the payload of {record_id} doesn't match its digest")
        refers = head.get(b"warc-refers-to")
        kind = "response" if kind == "continuation" else kind
        return record_id, _page(record_id), head.get(b"warc-target-uri"), kind, _page(refers) if refers else None, no - 1, last, len(block), total, digest, block


def read_archives(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The chunk rows of all archives under ``path``; gzipped archives are each read by one task, in order."""
    small_batches(spark, "8m")

    def chunks(batches):
        reader = _Reader()
        for pdf in batches:
            rows = [row if with_data else (*row[:-1], None) for piece in pdf["value"] for row in reader.feed(piece)]
            frame = pd.DataFrame(rows, columns=[x.split()[0] for x in CHUNK.split(", ")])
            for c in ("page_id", "refers_to", "payload_bytes"):
                frame[c] = frame[c].astype("Int64")
            yield frame
        if reader.missing > 0 or reader.open:
            raise ValueError("an archive ends inside a record")

    return spark.read.option("lineSep", SPLIT).text(path).select(F.col("value").cast("binary").alias("value")).mapInPandas(chunks, CHUNK)


def page_records(chunks: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return chunks.where("last").select("page_id", "payload_bytes", F.col("running_sha256").alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared scratch folder and read every record back."""
    path = scratch_dir(pages.sparkSession)
    write_archives(pages, path, chunk_bytes)
    return page_records(read_archives(pages.sparkSession, path, with_data=False))
