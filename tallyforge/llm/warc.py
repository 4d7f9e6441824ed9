"""WARC archives whose records are Zstandard frames with a shared dictionary.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed; every record is
a frame of its own. Here and there stands MARKER, an empty skippable frame, which decoders pass over.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, scratch
from .files import read_files, write_frames

MARKER = "P*M\x18\x00\x00\x00\x00"
_DICTIONARY_MAGIC, _FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Pages whose records the dictionary is built from, at most, their bytes, and its size.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 300, 1 << 24, 65_536
LEVEL = 3
#: Records are written in runs that end with the one that brings their payloads to this many bytes, and a file ends with
#: this many runs, as files are read whole: about 130 MB of payload, or one record more.
RUN_BYTES, RUNS_PER_FILE = 1 << 21, 64
#: WARC-Date where the caller gives none: pages have no date of their own, and reruns must agree.
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page {page_id}'.encode()).digest())}>"


def _line(value: str) -> str:
    """A header value without line breaks or other controls, which are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, first_url: str | None, date: str) -> bytes:
    """A response record, or a revisit one when refers_to is given: its block then ends with the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url) if url else f'urn:page:{page_id}'}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
        if first_url:
            head.append(f"WARC-Refers-To-Target-URI: {_line(first_url)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC fields, HTTP header, payload)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the records themselves as raw content where they are too few to train on."""
    if not records:
        return b""
    try:
        return zstandard.train_dictionary(size, records, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", _DICTIONARY_MAGIC, len(body)) + body


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame at `at` ends, by its header and block headers."""
    flags = data[at + 4]
    single, checksum, id_size, fcs = flags >> 5 & 1, flags >> 2 & 1, (0, 1, 2, 4)[flags & 3], flags >> 6
    at += 5 + (not single) + id_size + ((1 if single else 0), 2, 4, 8)[fcs]
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * checksum


def frames(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, dictionary, compressed record) of each record of an archive."""
    at, dictionary = 0, b""
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic == _DICTIONARY_MAGIC:
            dictionary = zstandard.ZstdDecompressor().decompress(data[at + 8 : at + 8 + size])
        if magic >> 4 == 0x184D2A5:
            at += 8 + size
        elif magic == _FRAME_MAGIC:
            end = frame_end(data, at)
            yield at, dictionary, data[at:end]
            at = end
        else:
            raise ValueError(f"no frame at {at}")


def _pages(pages: DataFrame) -> DataFrame:
    html = F.coalesce(column(pages, "html", "string"), F.lit("")).cast("binary")
    return pages.select(column(pages, "page_id", "long").alias("page_id"), column(pages, "url", "string").alias("url"), html.alias("payload"))


def trained_dictionary(pages: DataFrame, date: str) -> bytes:
    """The dictionary of SAMPLE pages by hash of their id, at most. Ids are ranked alone; one task then reads one page of
    each, up to SAMPLE_BYTES in all, and only the dictionary comes to the driver."""
    ids = [r[0] for r in pages.filter("page_id is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE).collect()]
    if not ids:
        return b""
    one = pages.filter(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min_by(F.struct("url", "payload"), F.struct(F.sha1("payload"), "url")).alias("p")).select("page_id", "p.url", "p.payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0
        for b in batches:
            for page_id, url, payload in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload"))):
                if size + len(payload) <= SAMPLE_BYTES:
                    records.append(record(page_id, url, payload, None, None, date))
                    size += len(payload)
        yield pa.RecordBatch.from_arrays([pa.array([build_dictionary(records)], pa.binary())], ["dictionary"])

    found = one.repartition(1).sortWithinPartitions("page_id").mapInArrow(run, "dictionary binary").collect()
    return bytes(found[0][0]) if found else b""


def write_warc(pages: DataFrame, path: str, least: int = 0, date: str = DATE) -> None:
    """Archives at path, each with the dictionary in front. Of pages with equal payloads of at least `least` bytes, that with the smallest
    page_id becomes a response and the others revisit it; smaller payloads are all responses."""
    spark = pages.sparkSession
    pages = _pages(pages)
    shared = spark.sparkContext.broadcast(trained_dictionary(pages, date))
    keyed = pages.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    # Who revisits whom is settled on digests alone; payloads meet it once, by page, where no key is hot.
    slim = keyed.filter(F.col("size") >= least).select("page_id", "url", "digest", "size")
    first = slim.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("refers_to"), F.min_by("url", "page_id").alias("first_url")).filter("n > 1")
    revisits = slim.join(first, ["digest", "size"]).filter("page_id <> refers_to").select("page_id", "digest", "size", "refers_to", "first_url").distinct()
    dealt = keyed.join(revisits, ["page_id", "digest", "size"], "left").select("page_id", "url", "payload", "refers_to", "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, held, size, runs = shared.value, [], 0, 0
        front = dictionary_frame(raw)
        tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdCompressor(level=LEVEL)

        def row_of() -> pa.RecordBatch:
            """A row of the frames held; the first of each file begins with the dictionary."""
            value = b"".join([front, *held] if runs % RUNS_PER_FILE == 0 else held)
            return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["value"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "first_url"))):
                held.append(tool.compress(record(*row, date)))
                size += len(row[2])
                if size >= RUN_BYTES:
                    yield row_of()
                    held, size, runs = [], 0, runs + 1
        if held:
            yield row_of()

    write_frames(dealt.mapInArrow(run, "value binary"), path, MARKER, RUNS_PER_FILE)


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives at path: (page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, archive, frame_offset, frame_bytes, payload). A revisit's payload size comes from its HTTP header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows, tool, of = [], None, None
                for at, raw, frame in frames(content.as_py()):
                    if tool is None or raw is not of:
                        tool, of = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor(), raw
                    fields, http, payload = parse_record(tool.decompress(frame))
                    response = fields["WARC-Type"] == "response"
                    length = len(payload) if response else int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    digest = payload_digest(payload) if response else fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    page, first = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    rows.append((page and int(page), fields["WARC-Target-URI"], length, digest, fields["WARC-Type"], first and int(first), name, at, len(frame), payload if payloads and response else None))
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return read_files(spark, path).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, frame_offset long, frame_bytes long, payload binary")


_TYPES = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "archive": pa.string(), "frame_offset": pa.int64(), "frame_bytes": pa.int64(), "payload": pa.binary()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES.values())], list(_TYPES))


def archive_pages(pages: DataFrame, path: str | None = None, least: int = 0, date: str = DATE) -> DataFrame:
    """Writes pages' archives at path (a new folder in the shared one by default) and reads their records back.

    A null html is an empty payload; a null url becomes urn:page:<page_id>; rows that repeat the smallest page_id of
    their payload are responses all; a null page_id revisits nothing. Extra columns are ignored; an empty table gives
    no rows.
    """
    path = path or scratch(pages.sparkSession, "warc")
    write_warc(pages, path, least, date)
    return read_warc(pages.sparkSession, path)
