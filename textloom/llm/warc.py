"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm.common import batches, hot_join, shared_dir, stored, text_of

FRAME_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
#: An empty skippable frame: readers pass over it, so it can end each row of a text file.
ROW_END = "P*M\x18\0\0\0\0"
#: A dictionary is trained on the first records of its archive: this many, and this much of each.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 16_384, 16_384
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("uri", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
        ("error", pa.string()),
    ]
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit has the HTTP head alone; both name length and digest of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (b"" if revisit else payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id))]
    if uri is not None:
        # Control characters would end the field.
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields)]
    return b"\r\n".join(lines) + END + block + END


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s[:SAMPLE_BYTES] for s in samples])
    except zstandard.ZstdError:  # too little to learn from
        return None


def _frames(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("frame", pa.binary())])
    compressor = None

    def rows():
        nonlocal compressor
        for table in tables:
            columns = [table.column(n).to_pylist() for n in ("id", "uri", "payload", "refers_to", "revisit")]
            records = (record(*row) for row in zip(*columns))
            if compressor is None:
                first = [next(records) for _ in range(min(SAMPLE, table.num_rows))]
                if not first:
                    continue
                trained = _dictionary(first)
                if trained is not None:
                    data = trained.as_bytes()
                    yield {"frame": struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data}
                compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
                for data in first:
                    yield {"frame": compressor.compress(data)}
            for data in records:
                yield {"frame": compressor.compress(data)}

    yield from batches(rows(), schema, 500)


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
) -> None:
    """One archive per partition below ``path``, on any file system that Spark writes to.

    Of records with equal payloads of ``min_bytes`` or more, that with the smallest id is the response and the others
    revisit it. Payloads are equal if their SHA-256 is. A null payload counts as empty. Rows without id
    revisit a row that has one, if there is one; rows that share the smallest id are all responses.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(url_col).alias("uri"),
        text_of(payload_col).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    groups = rows.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    joined = hot_join(rows, stored(groups.where("n > 1 and first_id is not null")), ["key"], "n", ["first_id"])
    revisit = (
        F.col("first_id").isNotNull()
        & ~F.col("id").eqNullSafe(F.col("first_id"))
        & (F.octet_length("payload") >= min_bytes)
    )
    typed = joined.select("id", "uri", "payload", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))
    frames = typed.mapInArrow(_frames, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", ROW_END).text(path)


# Reading


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends; follows the sizes of its blocks."""
    place = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    checksum = data[at + 4] & 4
    while True:
        if place + 3 > len(data):
            raise ValueError("frame is cut off")
        head = int.from_bytes(data[place : place + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        place += 3 + (1 if kind == 1 else size)
        if last:
            break
    place += 4 if checksum else 0
    if place > len(data):
        raise ValueError("frame is cut off")
    return place


def _field(fields: dict[str, str], name: str) -> str:
    if name not in fields:
        raise ValueError(f"no field {name}")
    return fields[name]


def _page(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d*)>", name)
    if not found:
        raise ValueError(f"unknown record name {name}")
    return int(found[1]) if found[1] else None


def parse_record(data: bytes) -> dict:
    """A record's columns; ValueError where head, lengths or digest are not right."""
    head, found, rest = data.partition(END)
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC head")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError(f"no field: {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    length = int(_field(fields, "content-length"))
    if len(rest) != length + len(END) or rest[length:] != END:
        raise ValueError(f"content length is {length}, the block has {len(rest) - len(END)} bytes")
    http, found, payload = rest[:length].partition(END)
    size = re.search(rb"(?mi)^content-length:\s*(\d+)\s*$", http)
    if not found or not size:
        raise ValueError("no HTTP head with a length")
    kind, digest = _field(fields, "warc-type"), _field(fields, "warc-payload-digest").removeprefix("sha1:")
    refers = None
    if kind == "revisit":
        refers = _page(_field(fields, "warc-refers-to"))
        if payload:
            raise ValueError("a revisit has a payload")
    elif kind == "response":
        if len(payload) != int(size[1]):
            raise ValueError(f"payload length is {int(size[1])}, the payload has {len(payload)} bytes")
        if digest_of(payload) != digest:
            raise ValueError("payload digest differs")
    else:
        raise ValueError(f"unknown type {kind}")
    return {
        "page_id": _page(_field(fields, "warc-record-id")),
        "uri": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": refers,
        "payload_bytes": int(size[1]),
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
        "error": None,
    }


def records_of(archive: bytes) -> Iterator[dict]:
    """Records of an archive, one per frame; a row with ``error`` for each broken one."""
    data, at = memoryview(archive), 0
    decompressor = zstandard.ZstdDecompressor()
    while at < len(data):
        try:
            if len(data) - at < 8:
                raise ValueError("archive is cut off")
            magic, size = struct.unpack_from("<II", data, at)
            if magic in SKIPPABLE:
                if at + 8 + size > len(data):
                    raise ValueError("skippable frame is cut off")
                if magic == DICTIONARY_MAGIC and at == 0:
                    trained = bytes(data[8 : 8 + size])
                    if trained[:4] == struct.pack("<I", FRAME_MAGIC):
                        trained = zstandard.ZstdDecompressor().decompress(trained)
                    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
                at += 8 + size
                continue
            if magic != FRAME_MAGIC:
                raise ValueError(f"no frame at byte {at}")
            end = frame_end(data, at)
        except (ValueError, zstandard.ZstdError) as problem:
            yield {"error": str(problem)}  # the next frame cannot be found
            return
        try:
            frame = bytes(data[at:end])
            yield parse_record(decompressor.decompressobj().decompress(frame))
        except (ValueError, zstandard.ZstdError) as problem:
            yield {"error": str(problem)}
        at = end


def _read(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for table in tables:
            for content in table.column("content"):
                yield from records_of(content.as_py())

    yield from batches(rows(), RECORDS, 500)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives below ``path``: ``page_id``, ``uri``, ``record_type``, ``refers_to``,
    ``payload_bytes``, ``payload_digest``, ``payload`` (responses), ``error``.

    A record with a wrong head, length or digest has only ``error``. An archive is read as one cell, 2 GB at most.
    """
    kinds = (
        "page_id bigint, uri string, record_type string, refers_to bigint, payload_bytes bigint, "
        "payload_digest string, payload binary, error string"
    )
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, kinds)


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to new archives in the shared folder and read them back; a broken record ends the job."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, path, **options)
    read = read_archives(spark, path)
    bad = F.raise_error(F.concat(F.lit("broken record: "), "error")).cast("bigint")
    return read.withColumn("payload_bytes", F.when(F.col("error").isNull(), F.col("payload_bytes")).otherwise(bad))
