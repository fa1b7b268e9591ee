"""WARC archives: written with an index, read back by coalesced byte ranges of the records that the index selects."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .files import Roll, opened, ranges

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:rankweave:page").int >> 64 << 64


def record_id(page_id: int | None) -> str:
    """The record id of a page; its low 64 bits are the page's number.  A page without one gets a random id."""
    return f"<urn:uuid:{uuid.UUID(int=SPACE | (page_id & (1 << 64) - 1)) if page_id is not None else uuid.uuid4()}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = n & (1 << 64) - 1
    return (low - (1 << 64) if low >> 63 else low) if n >> 64 << 64 == SPACE else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _block(pairs: list[tuple[str, object]], start: bytes) -> bytes:
    lines = [start, *(f"{k}: {v}".encode() for k, v in pairs)]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the response's headers alone."""
    name, kind = digest(payload), "response" if refers is None else "revisit"
    http = _block([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], b"HTTP/1.1 200 OK")
    body = http + (payload if refers is None else b"")
    pairs = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    pairs += [("WARC-Target-URI", "".join(url.split()))] if url else []
    pairs += [("WARC-Payload-Digest", f"sha1:{name}")]
    pairs += [("WARC-Refers-To", record_id(refers)), ("WARC-Profile", PROFILE)] if refers is not None else []
    pairs += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(_block(pairs, VERSION) + body + b"\r\n\r\n") + z.flush()


def _headers(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}, rest


def parse(member: bytes) -> dict:
    """A record of one gzip member; a response's payload is held against its digest."""
    raw = zlib.decompress(member, 31)
    if not raw.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    warc, rest = _headers(raw)
    block = rest[: int(warc["content-length"])]
    http, payload = _headers(block)
    name = warc["warc-payload-digest"].removeprefix("sha1:")
    if warc["warc-type"] == "response" and digest(payload) != name:
        raise ValueError(f"payload of {warc['warc-record-id']} doesn't have its digest")
    return {
        "page_id": page_of(warc["warc-record-id"]), "url": warc.get("warc-target-uri"), "payload_bytes": int(http["content-length"]), "payload_digest": name, "record_type": warc["warc-type"],
        "refers_to": page_of(warc["warc-refers-to"]) if "warc-refers-to" in warc else None, "payload": payload if warc["warc-type"] == "response" else None,
    }


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html; other columns are ignored) and returns the index.

    The payload is the html in UTF-8, null an empty one.  Of the rows with equal payloads of at least least_bytes, those
    with the smallest page_id are responses and the others revisits of it; smaller payloads are all responses, and so
    is a row without page_id.  The table that says which payloads occur again holds digests and ids only.
    """
    B.small_batches(pages.sparkSession)
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    pages = pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("sha"))
    again = pages.where(F.length("payload") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    refers = F.when((F.col("first") < F.col("page_id")) & (F.length("payload") >= least_bytes), F.col("first"))
    pages = pages.join(again, "sha", "left").select("page_id", "url", "payload", refers.alias("refers_to"))

    def write(batches):
        roll = Roll(folder, ".warc.gz")
        for b in batches:
            rows = []
            for page, url, body, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                member = record(page, url, body, first)
                name, at = roll.write(member)
                rows.append((page, url, name, at, len(member), digest(body), "response" if first is None else "revisit"))
            names = ("page_id", "url", "file", "offset", "length", "payload_digest", "record_type")
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))
        roll.close()

    return pages.mapInArrow(write, INDEX)


def read_records(index: DataFrame, folder: str, gap: int = 64 << 10, chunk: int = 8 << 20) -> DataFrame:
    """Reads the records that the rows of an index select: their sorted byte ranges, coalesced over holes up to `gap`."""

    def read(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        system, root = opened(folder)
        t = t.sort_by("offset")
        offsets, lengths, out = t["offset"].to_pylist(), t["length"].to_pylist(), []
        with system.open_input_file(f"{root}/{key[0].as_py()}") as f:
            for i, j, at, n in ranges(offsets, lengths, gap, chunk):
                raw = f.read_at(n, at)
                out += [parse(raw[offsets[k] - at : offsets[k] - at + lengths[k]]) for k in range(i, j)]
        names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.table([pa.array([r[c] for r in out], k) for c, k in zip(names, kinds, strict=True)], names=list(names))

    keyed = index.select("file", "offset", "length", F.floor(F.col("offset") / chunk).alias("chunk"))
    return keyed.groupBy("file", "chunk").applyInArrow(read, RECORDS)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Round trip of pages through archives in the shared folder."""
    folder = B.scratch(pages.sparkSession)
    return read_records(B.stored(write_archives(pages, folder, least_bytes)), folder)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """archived() pages: a record for each row, read back by way of the index."""
    out = archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
