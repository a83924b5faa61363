"""WARC archives in Zstandard with an embedded dictionary: writer, reader, and duplicate payloads as revisits."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import read_table, written
from marketloom.session import scratch_path

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_REVISIT_BYTES = 100
DICTIONARY_BYTES = 112640
#: Expected bytes of the pages from which the dictionary is built, the largest part taken of one page, and the pieces it is learned from.
SAMPLE_BYTES = 4 << 20
SAMPLE_PAGE_BYTES = 256 << 10
_LEARNED_PIECE = 64 << 10
#: A file is closed once this many compressed bytes are in it.
FILE_BYTES = 64 << 20


def _record(kind: str, page: str, url: str, date: str, digest: str, payload_bytes: int, payload: bytes, first: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head.append(f"Content-Length: {len(http) + len(payload)}\r\n\r\n")
    return b"".join(("\r\n".join(head).encode(), http, payload, b"\r\n\r\n"))


def _safe_url(url: str | None, page: str) -> str:
    """Header text for a target: control characters and blanks escaped; a missing one is named after its page."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"


def page_records(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, first) per page; first is the page to refer to, or null.

    Of pages with equal payloads of at least ``least`` bytes the smallest page_id keeps its payload; ties in page_id
    all keep theirs, and a null page_id refers. Only digests that occur more than once are joined back.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    heads = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1 and head is not null").select("payload_digest", "head")
    joined = rows.join(written(heads, "heads"), "payload_digest", "left")
    return joined.withColumn("first", F.when(F.coalesce(F.col("page_id") != F.col("head"), F.col("head").isNotNull()), F.col("head"))).drop("head")


def train_dictionary(records: DataFrame, sample_bytes: int = SAMPLE_BYTES, date: str = "2026-01-01T00:00:00Z") -> bytes:
    """Zstandard dictionary from records of pages drawn by a hash, ``sample_bytes`` of payload expected.

    Of a page beyond ``SAMPLE_PAGE_BYTES`` a part of that size is drawn, at a place given by its digest, so that large pages are
    learned from too. Empty if there is too little to learn from (a few small records); archives are then written without one.
    """
    part = F.least("payload_bytes", F.lit(SAMPLE_PAGE_BYTES))
    total = records.agg(F.sum(part)).first()[0] or 0
    if not total:
        return b""
    keep = min(1.0, sample_bytes / total)
    place = F.pmod(F.xxhash64("payload_digest"), F.col("payload_bytes") - part + 1) + 1
    drawn = records.where(F.pmod(F.xxhash64("page_id", "payload_digest"), F.lit(1 << 30)) < int(keep * (1 << 30))).withColumn(
        "payload", F.when(F.col("payload_bytes") <= SAMPLE_PAGE_BYTES, F.col("payload")).otherwise(
            F.substring("payload", place.cast("int"), F.lit(SAMPLE_PAGE_BYTES))))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = []
        for batch in batches:
            for row in batch.to_pylist():
                page = "null" if row["page_id"] is None else str(row["page_id"])
                record = _record("response", page, _safe_url(row["url"], page), date, row["payload_digest"], len(row["payload"]), row["payload"], None)
                samples += [record[k: k + _LEARNED_PIECE] for k in range(0, len(record), _LEARNED_PIECE)]
        try:
            found = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes() if samples else b""
        except zstandard.ZstdError:
            found = b""
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], ["dictionary"])
    rows = drawn.select("page_id", "url", "payload", "payload_digest").repartition(1).mapInArrow(train, "dictionary binary").collect()
    return max((bytes(r[0]) for r in rows), key=len, default=b"")


class _File:
    """One archive under a temporary name; it gets its own name when it is complete."""

    def __init__(self, folder: str, dictionary: bytes, date: str, level: int):
        self.fs, path = pafs.FileSystem.from_uri(folder)
        self.path = f"{path}/{uuid.uuid4().hex}.warc.zst"
        self.name = f"{folder}/{self.path.rsplit('/', 1)[1]}"
        self.out = self.fs.open_output_stream(self.path + ".open", compression=None)
        self.bytes = self.records = 0
        options = {}
        if dictionary:
            packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
            options["dict_data"] = zstandard.ZstdCompressionDict(dictionary)
            options["dict_data"].precompute_compress(level=level)
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, **options)
        info = b"software: marketloom\r\nformat: WARC File Format 1.1\r\n"
        self._put(self.packer.compress(
            f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\n"
            f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.packer.compress(record))
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.path + ".open", self.path)
        return {"file": self.name, "records": self.records, "bytes": self.bytes}


def write_archives(records: DataFrame, folder: str, dictionary: bytes, file_bytes: int = FILE_BYTES, level: int = 3,
                   date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of ``page_records`` as .warc.zst files below ``folder`` (any URI that Arrow opens); returns the
    written list (file, records, bytes).

    Each task streams its own files: a leading skippable frame with the dictionary, a warcinfo record, then one frame
    per record. Only listed files count: those of a lost or repeated attempt are in no list. An empty table has no files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, file = [], None
        for batch in batches:
            for page_id, url, payload, size, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if file is None:
                    file = _File(folder, dictionary, date, level)
                page = "null" if page_id is None else str(page_id)
                kind, body = ("response", payload) if first is None else ("revisit", b"")
                file.add(_record(kind, page, _safe_url(url, page), date, digest, size, body, None if first is None else str(first)))
                if file.bytes >= file_bytes:
                    done.append(file.close())
                    file = None
        if file is not None:
            done.append(file.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
    spark = records.sparkSession
    _create(spark, folder)
    rows = records.select("page_id", "url", F.when(F.col("first").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
                          "payload_bytes", "payload_digest", "first")
    return written(rows.mapInArrow(run, "file string, records long, bytes long"), "archives")


def _create(spark: SparkSession, folder: str) -> None:
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of a .warc.zst stream, with or without a dictionary."""
    start = stream.read(8)
    options = {}
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == DICTIONARY_FRAME:
        packed = stream.read(struct.unpack("<I", start[4:])[0])
        if packed[:4] == b"\x28\xb5\x2f\xfd":
            packed = zstandard.ZstdDecompressor().decompress(packed)
        options["dict_data"] = zstandard.ZstdCompressionDict(packed)
        start = b""
    source = io.BufferedReader(_Chained(start, stream))
    text = io.BufferedReader(zstandard.ZstdDecompressor(**options).stream_reader(source, read_across_frames=True), 1 << 20)
    while line := text.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not the start of a record")
        head: dict[str, str] = {}
        while (line := text.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = text.read(size)
        if len(block) != size or text.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield head, block


class _Chained(io.RawIOBase):
    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def readable(self):
        return True

    def readinto(self, into):
        if self.head:
            data, self.head = self.head[: len(into)], self.head[len(into):]
        else:
            data = self.rest.read(len(into))
        into[: len(data)] = data
        return len(data)


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per response and revisit record of the listed files: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest and, if asked for, the payload. A response whose payload does not have its digest is an error."""
    def page(uri: str | None):
        value = uri.strip("<>").rpartition(":")[2] if uri else ""
        return None if value in ("", "null") else int(value)

    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
              ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * payloads
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, listed in ((n, k) for b in batches for n, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            fs, path = pafs.FileSystem.from_uri(name)
            rows, held, seen = [], 0, 0
            with fs.open_input_stream(path, compression=None) as stream:
                for head, block in read_records(stream):
                    if head["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = head["warc-payload-digest"].partition(":")[2]
                    if head["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{name}: {head['warc-record-id']} does not have its digest")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    row = (page(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], page(head.get("warc-refers-to")), size, digest)
                    rows.append(row + (payload,) * payloads)
                    seen += 1
                    held += len(payload) if payloads else 100
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
            if seen != listed:  # a cut-off last frame decompresses to nothing
                raise ValueError(f"{name}: {seen} records instead of {listed}")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    kinds = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    return archives.select("file", "records").repartition(max(1, archives.count())).mapInArrow(run, kinds)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    records = page_records(read_table(spark, sf_dir, "pages"))
    archives = write_archives(records, scratch_path(spark, "warc"), train_dictionary(records))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
heads as (select payload_digest, min(page_id) as head from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest, case when page_id <> head then 'revisit' else 'response' end as record_type,
       case when page_id <> head then head end as refers_to
from p left join heads using (payload_digest)
"""
