"""WARC archives of web pages, each record its own Zstandard frame, with a dictionary per archive.

An archive is one file: a skippable frame (magic 0x184D2A5D) with a Zstandard dictionary built from records of
that archive, then one frame per WARC record, compressed with it.  Spark's own text writer makes the files, so any
Hadoop file system and its commit protocol serve, and a lost task leaves nothing behind: each row is a frame, and
the line separator is an empty skippable frame, which every Zstandard reader steps over.

Equal payloads: the record of the smallest page_id is ``response``, the others are ``revisit`` records without a
payload that refer to it.  Payload groups are found from narrow rows (page_id, SHA-1, SHA-256), hashed once.  Each task
that reads pages writes an archive as it goes; payloads are not shuffled unless the table of revisits is too large to
be joined where pages are read.  A frame may hold any bytes, the separator too: readers follow frames, not separators.

Defined results: null html is the empty payload; null url leaves out the target header; rows that share both
page_id and payload are all responses; a null page_id is written as a response of its own; an empty table gives no
archive and no rows; only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import ensure_checkpoint_dir

from .common import release, staged

DICT_BYTES = 32_768
DICT_SAMPLE_BYTES = 1_500_000   # what the dictionary of an archive is built from, at most
LEVEL = 3
READ_BYTES = 8_192              # read at first when a frame is opened
DICT_MAGIC, EMPTY_MAGIC = 0x184D2A5D, 0x184D2A50
SEPARATOR = struct.pack("<II", EMPTY_MAGIC, 0).decode("latin-1")
RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "url string, payload binary")
_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                      ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}",
            f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """A row of ``RECORDS``; a response's digest and length are checked against its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines)
    body = rest[:int(h["Content-Length"])]
    if rest[len(body):] != b"\r\n\r\n":
        raise ValueError("record is cut off")
    told, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
    if h["WARC-Type"] == "response" and (digest(body) != told or len(body) != size):
        raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
    number = lambda k: int(h[k]) if k in h else None
    return (number("X-Page-Id"), size, told, h["WARC-Type"], number("X-Refers-To-Page-Id"), h.get("WARC-Target-URI"), body)


def build_dictionary(sample: list[bytes]) -> bytes:
    """A dictionary from a bounded number of an archive's records; too few to train on: their own bytes."""
    pieces = [r[:65536] for r in sample]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces, k=1024, d=8, f=18, split_point=1.0).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[:DICT_BYTES]


def archive_frames(records: Iterable[bytes]) -> Iterator[bytes]:
    """The dictionary's skippable frame, then a frame for each record; nothing for no records.

    Only the records that the dictionary is built from are held, ``DICT_SAMPLE_BYTES`` or a single larger one.
    """
    records, sample, size = iter(records), [], 0
    for r in records:
        sample.append(r)
        size += min(len(r), 65536)
        if size >= DICT_SAMPLE_BYTES:
            break
    if not sample:
        return
    data = build_dictionary(sample)
    yield struct.pack("<II", DICT_MAGIC, len(data)) + data
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data),
                                          write_content_size=True, write_checksum=True)
    for r in chain(sample, records):
        yield compressor.compress(r)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive: dictionary from the leading skippable frame, other skippable frames stepped over."""
    view, at, reader = memoryview(data), 0, None
    while at < len(view):
        magic = struct.unpack_from("<I", view, at)[0]
        if EMPTY_MAGIC <= magic <= EMPTY_MAGIC + 15:
            size = struct.unpack_from("<I", view, at + 4)[0]
            if magic == DICT_MAGIC and reader is None:
                held = zstandard.ZstdCompressionDict(bytes(view[at + 8:at + 8 + size]))
                reader = zstandard.ZstdDecompressor(dict_data=held)
            at += 8 + size
            continue
        one, out, step = (reader or zstandard.ZstdDecompressor()).decompressobj(), [], READ_BYTES
        while not one.eof:
            if at >= len(view):
                raise ValueError("frame is cut off")
            out.append(one.decompress(view[at:at + step]))
            at, step = min(at + step, len(view)), 2 * step
        at -= len(one.unused_data)      # at most what was read last, however long the archive
        yield b"".join(out)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to of every page."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    keys = staged(p.where("page_id IS NOT NULL").where(F.length("payload") >= least_bytes).select(
        "page_id", F.sha1("payload").alias("a"), F.unhex(F.sha2("payload", 256)).alias("b")), "payload-hashes")
    first = keys.groupBy("a", "b").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = staged(keys.join(first, ["a", "b"]).where("page_id > refers_to").select("page_id", "a", "refers_to").distinct()
                   .groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("a", "refers_to"))).alias("first_of")), "revisits")
    release(keys)
    # ``later`` is a table of known size: pages stay where they are read unless it is large.
    refers = F.when(F.col("first_of").isNotNull(), F.try_element_at("first_of", F.sha1("payload")))
    return p.join(later, "page_id", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write all pages as dictionary-compressed archives under ``path``, one for each task that holds pages."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (make_record(*r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        held, size = [], 0
        for f in archive_frames(records):
            held.append(f)
            size += len(f)
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])

    (with_revisits(pages, least_bytes).mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", SEPARATOR).text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row of ``RECORDS`` for each record of the archives under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                got, size = [], 0
                for raw in read_archive(content.as_py()):
                    got.append(parse_record(raw))
                    size += len(raw)
                    if size > 8_000_000:
                        yield _batch(got)
                        got, size = [], 0
                if got:
                    yield _batch(got)

    return files.mapInArrow(rows, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORDS)], schema=_RECORDS)


def archive_path(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
