"""WARC archives in Zstandard form.

An archive is a leading skippable frame that holds the dictionary, then one
frame per record, so a reader can start at any record once it has the
dictionary. The writer makes archives of bounded size; the reader takes
whole archives as binary values, be they rows of a table in the shared
folder or files read by Spark's binaryFile source, and validates each record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import staged

#: Fixed values of the format.
DICTIONARY_MAGIC, FRAME_MAGIC, ZDICT_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
#: An archive is closed at so many bytes; its dictionary is trained on its first records, so many bytes of them.
ARCHIVE_BYTES, TRAIN_BYTES, DICTIONARY_BYTES, LEVEL = 4 << 20, 2 << 20, 32 << 10, 3
#: The reader hands on so many bytes at a time.
SLICE = 64 << 10
_RECORD = "page_id long, url string, payload binary, payload_digest string, payload_bytes long, refers_to long"
_READ = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, url string, payload binary, error string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _urn(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(page_id & (1 << 64) - 1) | 1 << 126)}>"


def _page(urn: str) -> int:
    low = uuid.UUID(urn.strip()[10:-1]).int & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def record(page_id: int, url: str, payload: bytes, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Target-URI: {''.join(url.split())}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, first: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, rest = data.partition(b"\r\n\r\n")
    start, *lines = head.split(b"\r\n")
    if not gap or not start.startswith(first):
        raise ValueError(f"no {first.decode()} header")
    pairs = [x.decode("utf-8").partition(":") for x in lines]
    if not all(colon for _, colon, _ in pairs):
        raise ValueError("a header without a colon")
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, rest


def parse(data: bytes) -> dict:
    """Fields of a record; ValueError or KeyError if a header, length or digest does not hold."""
    head, rest = _headers(data, b"WARC/1.")
    length = int(head["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length} with a block of {len(rest) - 4} bytes")
    block = rest[:length]
    if head["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest does not match")
    http, payload = _headers(block, b"HTTP/")
    digest, kind, n_bytes = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], int(http["content-length"])
    if kind == "response" and (n_bytes != len(payload) or digest != base32_sha1(payload)):
        raise ValueError("payload length or digest does not match")
    if kind == "revisit" and payload:
        raise ValueError("a revisit with a payload")
    if kind not in ("response", "revisit"):
        raise ValueError(f"unknown record type {kind}")
    return {"page_id": _page(head["warc-record-id"]), "record_type": kind, "payload_digest": digest, "payload_bytes": n_bytes,
            "refers_to": _page(head["warc-refers-to"]) if kind == "revisit" else None, "url": head["warc-target-uri"], "payload": payload if kind == "response" else None, "error": None}


def write_archive(records: list[bytes], sample: list[bytes]) -> bytes:
    """The archive's bytes. Where the sample is too small for a trained dictionary, it serves as a raw one."""
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        trained = b"".join(sample)[:DICTIONARY_BYTES]
    if len(trained) < 8:
        trained = b"\r\n\r\nWARC/1.1"
    stored = zstandard.ZstdCompressor(level=LEVEL).compress(trained)
    maker = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=True)
    return struct.pack("<II", DICTIONARY_MAGIC, len(stored)) + stored + b"".join(map(maker.compress, records))


def frames(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one for each frame; the dictionary comes from the leading skippable frame, if any."""
    at, known = 0, None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", archive, 4)[0]
        stored = archive[8 : 8 + size]
        if len(stored) != size:
            raise ValueError("the dictionary frame is cut off")
        if stored[:4] == struct.pack("<I", FRAME_MAGIC):
            stored = zstandard.ZstdDecompressor().decompress(stored)
        known, at = zstandard.ZstdCompressionDict(stored), 8 + size
    view, left = memoryview(archive)[at:], len(archive) - at
    maker = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    at, held = 0, b""  # held: read, and belongs to the next frame
    while held or at < left:
        one, parts = maker.decompressobj(), []
        while not one.eof:
            if held:
                given, held = held, b""
            elif at < left:
                given = view[at : at + SLICE]
                at += len(given)
            else:
                raise ValueError("the last frame is cut off")
            parts.append(one.decompress(given))
        held = one.unused_data
        yield b"".join(parts)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    records: list[bytes] = []
    size = 0

    def closed() -> pa.RecordBatch:
        sample, room = [], TRAIN_BYTES
        for x in records:
            sample.append(x[:room])
            room -= len(x)
            if room <= 0:
                break
        return pa.RecordBatch.from_pydict({"content": pa.array([write_archive(records, sample)], pa.binary()), "n_records": pa.array([len(records)], pa.int64())})

    for batch in batches:
        for row in batch.to_pylist():
            one = record(row["page_id"], row["url"] or "", row["payload"] or b"", row["payload_digest"], row["payload_bytes"], row["refers_to"])
            records.append(one)
            size += len(one)
            if size >= ARCHIVE_BYTES:
                yield closed()
                records, size = [], 0
    if records:
        yield closed()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("error", pa.string())])
    blank = dict.fromkeys(schema.names)
    for batch in batches:
        for content in batch["content"]:
            rows = []
            try:
                for data in frames(content.as_py() or b""):
                    try:
                        rows.append(parse(data))
                    except (ValueError, KeyError, IndexError) as e:
                        rows.append(blank | {"error": f"record: {e}"})
            except (ValueError, zstandard.ZstdError) as e:
                rows.append(blank | {"error": f"archive: {e}"})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def records_of(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Page, payload and, for later pages of equal payload of least_bytes or more, the first page that holds it.

    Who is first is settled on digests alone; payloads move once, by page, so
    a payload that a third of all pages share makes no large group. A null
    page or url is page 0 or empty. Rows that repeat a page_id are records of
    their own, each with the verdict of its payload.
    """
    page = pages.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
                        F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    narrow = page.select("page_id", F.unhex(F.sha1("payload")).alias("sha"), F.length("payload").cast("long").alias("payload_bytes"))
    narrow = narrow.filter(F.col("payload_bytes") >= least_bytes)
    first = narrow.groupBy("sha", "payload_bytes").agg(F.min("page_id").alias("first"))
    later = narrow.join(first, ["sha", "payload_bytes"]).filter(F.col("page_id") > F.col("first")).select("page_id", "sha", "payload_bytes", F.col("first").alias("refers_to")).distinct()
    keyed = page.withColumns({"sha": F.unhex(F.sha1("payload")), "payload_bytes": F.length("payload").cast("long")})
    return keyed.join(later, ["page_id", "sha", "payload_bytes"], "left").drop("sha", "payload_bytes")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [x.as_py() for x in batch["payload"]]
        refers = batch["refers_to"]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array([p if r is None else None for p, r in zip(payloads, refers.to_pylist())], pa.binary()), pa.array(map(base32_sha1, payloads), pa.string()), pa.array(map(len, payloads), pa.int64()), refers],
            names=["page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to"])


def write(pages: DataFrame, **names) -> DataFrame:
    """content (a whole archive) and n_records, as a table in the shared folder."""
    made = records_of(pages, **names).mapInArrow(_digests, _RECORD).mapInArrow(_write, "content binary, n_records long")
    return staged(made, "warc-archives")


def read(archives: DataFrame) -> DataFrame:
    """A row per record of each archive in the binary column content; damaged records and archives give a row with error."""
    return archives.select("content").mapInArrow(_read, _READ)
