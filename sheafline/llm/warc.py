"""WARC archives and the monolithic-gzip normaliser (operator 7).

Archives that were compressed as one gzip stream can be read from the start only.  The normaliser inflates such a file once,
as a stream, and rewrites every record as a gzip member of its own beside a sidecar index of offsets, so that any record
can be read, and files split, without touching what stands before it.

Writer, normaliser and reader each take one archive a task and hold one record at a time.  Files go to the shared folder,
through the file system that its URI names, under names that no other attempt of the task uses; a row that names a finished
file is all that leaves a task, so files of failed or repeated attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.common import delete_path, new_path, prepare, written

#: Revisits are written of payloads of so many bytes and more.
LEAST = 1000
#: A new archive is begun after so many bytes of records.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


@dataclass
class Record:
    """Headers in order, names as written, and the block."""

    headers: dict[str, str]
    block: bytes
    version: str = "WARC/1.1"
    _lower: dict[str, str] = field(init=False, repr=False)

    def __post_init__(self):
        self._lower = {k.lower(): v for k, v in self.headers.items()}

    def get(self, name: str) -> str | None:
        return self._lower.get(name.lower())

    def to_bytes(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.headers.items() if k.lower() != "content-length")
        return f"{self.version}\r\n{head}Content-Length: {len(self.block)}\r\n\r\n".encode() + self.block + b"\r\n\r\n"


def page_record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> Record:
    """A response, or a revisit of the page `refers_to`, whose block has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": name(page_id),
        "WARC-Target-URI": UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page_id}",
        "WARC-Date": date,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
    }
    if refers_to is not None:
        headers |= {"WARC-Refers-To": name(refers_to), "WARC-Profile": PROFILE}
    headers["Content-Type"] = "application/http;msgtype=response"
    return Record(headers, http + (payload if refers_to is None else b""))


def _inflated(source: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or many, a chunk at a time; a file cut short is an error."""
    engine, ended = zlib.decompressobj(31), True
    while data := source.read(CHUNK):
        while data:
            ended = False
            out = engine.decompress(data, CHUNK)
            if out:
                yield out
            data = engine.unconsumed_tail
            if engine.eof:
                data, engine, ended = engine.unused_data, zlib.decompressobj(31), True
    if not ended:
        raise ValueError("the gzip stream ends too early")


def records(source: BinaryIO) -> Iterator[Record]:
    """Records of a gzip-compressed WARC file, however its members are cut."""
    chunks, held = _inflated(source), bytearray()

    def more() -> bool:
        got = next(chunks, None)
        held.extend(got or b"")
        return got is not None

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        end, looked = held.find(b"\r\n\r\n"), 0
        while end < 0:
            looked = max(0, len(held) - 3)
            if not more():
                break
            end = held.find(b"\r\n\r\n", looked)
        if end < 0:
            if held.strip():
                raise ValueError("a record's head is cut short")
            return
        if held[:2] == b"\r\n":  # the rest of a record's end came with this chunk
            continue
        version, *lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(next(v for k, v in headers.items() if k.lower() == "content-length"))
        del held[: end + 4]
        while len(held) < size:
            if not more():
                raise ValueError("a record's block is cut short")
        block = bytes(held[:size])
        del held[:size]
        yield Record(headers, block, version)


def page_of(record: Record) -> tuple:
    """page id (text, None for none), payload bytes, payload digest (hex), type, page referred to."""
    http, _, payload = record.block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http).group(1))
    digest = base64.b32decode(record.get("WARC-Payload-Digest").removeprefix("sha1:")).hex()
    kind = record.get("WARC-Type")
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{record.get('WARC-Record-ID')}: the payload is not the one that was written")
    name = lambda x: x and (x.removeprefix("<urn:page:").removesuffix(">") or None)
    return name(record.get("WARC-Record-ID")), size, digest, kind, name(record.get("WARC-Refers-To"))


def _open(uri: str):
    """File system and path of a URI, by the schemes that Spark uses; local paths without a scheme too."""
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def normalise_stream(source: BinaryIO, out: BinaryIO, index: BinaryIO, level: int = 6) -> int:
    """Every record as a member of its own in `out`; in `index` a line offset, length, type, id for each.  Returns how many."""
    at = n = 0
    for record in records(source):
        engine = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = engine.compress(record.to_bytes()) + engine.flush()
        out.write(member)
        index.write(f"{at}\t{len(member)}\t{record.get('WARC-Type')}\t{record.get('WARC-Record-ID')}\n".encode())
        at += len(member)
        n += 1
    return n


def read_record(uri: str, offset: int, length: int) -> Record:
    """One record of a normalised archive, by its place in the index."""
    where, path = _open(uri)
    with where.open_input_file(path) as f:
        f.seek(offset)
        return next(records(pa.BufferReader(f.read(length))))


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 1, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, n): one-stream archives of pages (page_id, url, payload, refers_to), written once, one or more a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(folder)
        where.create_dir(base)
        out = engine = None
        name, size, n = "", 0, 0

        def close():
            out.write(engine.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["archive", "n"])

        for b in batches:
            for i in range(b.num_rows):
                row = [b.column(k)[i].as_py() for k in range(4)]
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, engine = where.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                data = page_record(*row, date).to_bytes()
                out.write(engine.compress(data))
                size += len(data)
                n += 1
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return written(pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive string, n long"), "warc-archives")


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """(archive, index, n) of the rewritten archives; archives: a column `archive` of URIs.  Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                source_fs, source = _open(uri)
                where, base = _open(folder)
                where.create_dir(base)
                name = f"{uuid.uuid4().hex}.warc.gz"
                with source_fs.open_input_stream(source, compression=None) as f, where.open_output_stream(f"{base}/{name}", compression=None) as out, where.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
                    n = normalise_stream(f, out, index, level)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([f"{folder}/{name}.idx"]), pa.array([n], pa.int64())], names=["archive", "index", "n"])

    return written(_one_a_task(archives.select("archive")).mapInArrow(run, "archive string, index string, n long"), "warc-normalised")


def _one_a_task(archives: DataFrame) -> DataFrame:
    """Archives dealt out evenly: a round robin over as many tasks as there are archives, or 4096."""
    return archives.repartition(max(1, min(4096, archives.count())))


def read_archives(archives: DataFrame, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read through the sidecar indexes.

    A response whose payload does not match its digest is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            for uri, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                where, path = _open(uri)
                index_fs, index_path = _open(index)
                with index_fs.open_input_stream(index_path, compression=None) as f:
                    places = [line.split(b"\t")[:2] for line in f.read().splitlines()]
                with where.open_input_file(path) as f:
                    for at in range(0, len(places), 256):
                        rows = []
                        for offset, length in places[at : at + 256]:
                            f.seek(int(offset))
                            rows.append(page_of(next(records(pa.BufferReader(f.read(int(length)))))))
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    got = _one_a_task(archives.select("archive", "index")).mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return got.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def with_revisits(df: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id", least: int = LEAST) -> DataFrame:
    """page_id, url, payload, refers_to: the page of the largest id among those with the same payload of `least` bytes or more.

    refers_to is null for that page itself, for smaller payloads and for payloads without a copy.  Rows that share the
    largest id are all responses.  A null html is an empty payload.  Copies are counted and revisits listed by ids and
    digests alone; payloads move only if the list of revisits is too long for Spark to send it to all tasks, and then by
    page, so a payload that stands often is in many tasks.  Smaller payloads are in no join.
    """
    pages = df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    large = pages.where(F.octet_length("payload") >= least).withColumn("digest", F.sha1("payload"))
    slim = written(large.select("page_id", "digest"), "warc-digests")
    copies = written(slim.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-copies")
    revisits = written(slim.join(copies, "digest").where("not (largest <=> page_id)").select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "largest").distinct(), "warc-revisits")
    met = large.join(revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left")
    out = met.select("page_id", "url", "payload", F.col("largest").alias("refers_to"))
    return out.union(pages.where(F.octet_length("payload") < least).withColumn("refers_to", F.lit(None).cast(df.schema[page_id].dataType)))


def round_trip(df: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Writes every page to one-stream archives, normalises those and reads the result back: one row per page.

    The one-stream archives are deleted once they are normalised; the normalised ones and their indexes stay, in the folder
    `warc-*` of the shared folder.  An empty table writes no archive and gives an empty result.
    """
    prepare(df.sparkSession)
    spark = df.sparkSession
    raw, folder = new_path(spark, "warc-raw"), new_path(spark, "warc")
    archives = write_archives(with_revisits(df, html, url, page_id), raw)
    tidy = normalise(archives, folder)
    delete_path(spark, raw)
    return read_archives(tidy, df.schema[page_id].dataType.simpleString())
