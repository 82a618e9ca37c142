"""WARC archives: one gzip member for each record, written and read in sequence.

An archive is a row of a table with a binary column ``content``: the table may be what
``write_archives`` returned or ``spark.read.format("binaryFile")`` over .warc.gz files.

Defined results: null html counts as no bytes; payloads are equal when their bytes are;
of equal payloads of at least ``least`` bytes one row is the response, that with the
smallest page_id (where rows repeat it, the smallest url, then any of those alike), and
the others are revisits; a null page_id comes after all others and its record carries no
id, so where the response has none its revisits refer to nothing.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, skew
from .shared import Scratch, picked

#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
READ_BYTES = 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version line, named fields, blank line, block, two line ends."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def header_value(text: str | None) -> str | None:
    """A field's value on one line."""
    return None if text is None else " ".join(text.splitlines())


def page_record(page_id: int | None, url: str | None, payload: bytes, revisit: bool = False, refers: int | None = None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    return record(
        [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
            ("WARC-Target-URI", header_value(url)),
            ("WARC-Date", "2020-01-01T00:00:00Z"),
            ("WARC-Profile", PROFILE if revisit else None),
            ("WARC-Refers-To", f"<urn:page:{refers}>" if refers is not None else None),
            ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
            ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
            ("WARC-Payload-Length", str(len(payload))),
            ("Content-Type", "application/http;msgtype=response"),
        ],
        block,
    )


def write_archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """A table of archives (content binary) with a record for each row of pages(page_id, url, html).

    Only ids and digests are grouped. A page meets its payload's response in a join on the
    digest, where a very common payload is dealt to several tasks.
    """
    page = picked(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    page = page.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).withColumn("size", F.octet_length("html"))
    key, place = ["digest", "size"], F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "url")
    known = Scratch(pages.sparkSession).written(page.select(*key, "page_id", "url"), "pages")
    first = known.where(F.col("size") >= least).groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(*key, "first")
    # of rows alike one alone can be the response: they are folded and numbered
    alike = known.groupBy(*key, "page_id", "url").agg(F.count("*").alias("n")).where("n > 1")
    if alike.isEmpty():
        page = page.withColumn("copy", F.lit(1))
    else:
        folded = page.groupBy("page_id", "url", "html", *key).agg(F.count("*").alias("n"))
        page = folded.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    joined = skew.hot(known.select(*key, "page_id"), key).joined(page, first, "page_id", "left")
    is_first = F.col("first").isNull() | (place.eqNullSafe(F.col("first")) & (F.col("copy") == 1))
    refers = F.when(~is_first, F.col("first.page_id"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        held = 0
        for batch in batches:
            for page_id, url, html, revisit, refer in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "revisit", "refers"))):
                parts.append(member(page_record(page_id, url, html.encode(), revisit, refer)))
                held += len(parts[-1])
                if held >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])
                    parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])

    return joined.select("page_id", "url", "html", (~is_first).alias("revisit"), refers.alias("refers")).transform(arrays.mapped, write, "content binary")


def members(content: bytes) -> Iterator[bytes]:
    """Each gzip member's bytes, inflated a part at a time."""
    at = 0
    while at < len(content):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(content):
                raise ValueError("archive ends inside a member")
            part = content[at : at + READ_BYTES]
            out.append(inflate.decompress(part))
            at += len(part) - len(inflate.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (lower-case names) and block of one record, framed by its content length."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:size]


def page_of(identity: str) -> int | None:
    number = identity.strip("<>").rpartition(":")[2]
    return int(number) if number else None


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read_archives(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """A row for each record; a wrong block or payload digest, or a cut member, is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for data in members(content.as_py() or b""):
                    fields, block = parse(data)
                    if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
                        raise ValueError(f"block digest of {fields['warc-record-id']} is wrong")
                    payload = block.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else None
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if payload is not None and digest != base32_sha1(payload):
                        raise ValueError(f"payload digest of {fields['warc-record-id']} is wrong")
                    refers = fields.get("warc-refers-to")
                    rows.append((page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], refers and page_of(refers), digest, int(fields["warc-payload-length"]) if payload is None else len(payload), payload if keep_payload else None))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
                for a in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 512]), kinds)], names=names)

    return archives.select("content").transform(arrays.mapped, read, RECORDS)
