"""Zstandard-compressed web archives: writing with deduplication, and a validating reader.

An archive is a leading skippable frame that holds the dictionary, then one zstd frame per WARC
record; a task begins a new archive where one has reached ``ARCHIVE_BYTES``. Of records with equal payloads of at least ``SMALLEST`` bytes that of the smallest page_id is
the response and the others are revisits without a body. The reader streams the frames of an archive
of any size, holds and decodes one at a time and checks version, required headers, lengths, terminators and digests.

Defined results: a null html is an empty payload; a null url has no target header; a null page_id
has no id header and reads back as null, and ranks behind all others; rows that share the smallest
page_id of a payload are all responses; an empty table gives no archives and no rows. A damaged
record gives a row with ``error`` set and does not hide the records after it.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimdex.llm.common import session, stored
from skimdex.session import work_dir

SMALLEST = 100
#: magic number of the skippable frame with the dictionary, and of zstd frames
DICTIONARY_FRAME, FRAME = 0x184D2A5D, 0xFD2FB528
#: the dictionary is trained on at most so many pages of at most so many characters
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 300, 20_000, 65_536
LEVEL = 6
#: an archive of so many bytes takes no further record
ARCHIVE_BYTES = 1 << 30
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
COLUMNS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages, itself independent of their order; may be empty."""
    short = pages.where(F.length("html").between(1, SAMPLE_CHARS)).select("html")
    # marks are chosen first, so that only the pages of the sample travel
    marks = F.broadcast(short.select(F.xxhash64("html").alias("mark")).distinct().orderBy(F.xxhash64("mark")).limit(SAMPLE))
    chosen = short.withColumn("mark", F.xxhash64("html")).join(marks, "mark").groupBy("mark").agg(F.first("html").alias("html"))
    rows = chosen.orderBy("mark").collect()
    samples = [r.html.encode() for r in rows]
    if len(samples) < 20:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def _record(page_id, url, payload: bytes, digest: str, first) -> bytes:
    """One WARC record; ``first`` is the page_id of the response that a revisit refers to, else None."""
    urn = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{i}')}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if first is None else b"")
    head = ["WARC-Type: " + ("response" if first is None else "revisit"), f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~%"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(first)}", f"X-Refers-To-Page-ID: {first}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if "://" in path or path.startswith("file:") else f"file://{path}")


def write_archives(pages: DataFrame, folder: str, roll: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives of some ``roll`` bytes below ``folder``; (path, n) of each.

    Every attempt of a task writes drafts of its own, which no reader lists. Those of the attempts that
    Spark committed are moved into place, so a task that ran twice, in another order of rows, leaves
    one set of records. A record is never cut; one larger than ``roll`` fills an archive alone.
    """
    session(pages)
    slim = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha2("html", 256)
    large = slim.where(F.octet_length("html") >= SMALLEST).select("page_id", digest.alias("digest"))
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = large.join(firsts, "digest").where("page_id IS NULL OR page_id <> first").where("first IS NOT NULL")
    again = again.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first").distinct()
    rows = slim.withColumn("digest", digest)
    same = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest"))
    rows = rows.join(again, same, "left").select("page_id", "url", "html", "digest", "first")
    dictionary = train_dictionary(slim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = _filesystem(folder)
        part, mine = TaskContext.get().partitionId(), uuid.uuid4().hex
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True, write_checksum=True)
        lead = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary if dictionary else b""
        k, n, out = 0, 0, None

        def close() -> pa.RecordBatch:
            out.close()
            row = [pa.array([f"{base}/{name}"]) for name in (draft, f"part-{part:06d}-{k:04d}.warc.zst")]
            return pa.RecordBatch.from_arrays([*row, pa.array([n], pa.int64())], ["draft", "path", "n"])

        for batch in batches:
            ids, urls, htmls, digests, firsts = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                if out is None:
                    target.create_dir(base, recursive=True)
                    draft = f"_draft-{part:06d}-{k:04d}-{mine}"
                    out = target.open_output_stream(f"{base}/{draft}")
                    out.write(lead)
                    size, n = len(lead), 0
                payload = htmls[i].as_py().encode()
                frame = press.compress(_record(ids[i].as_py(), urls[i].as_py(), payload, digests[i].as_py(), firsts[i].as_py()))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= roll:
                    yield close()
                    k, out = k + 1, None
        if out is not None:
            yield close()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, _ = _filesystem(folder)
        for batch in batches:
            for draft, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if target.get_file_info(draft).type != fs.FileType.NotFound:  # else moved by an earlier attempt
                    target.move(draft, path)
            yield batch.select(["path", "n"])

    written = stored(rows.mapInArrow(run, "draft string, path string, n long"), "archives-written")
    return stored(written.mapInArrow(settle, "path string, n long"), "archives-settled")


def frames(stream: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(magic, content) of every frame: the body of a skippable one, all of a zstd one.

    Raises ValueError where the file is cut or is no frame.
    """

    def take(size: int) -> bytes:
        got = bytearray()
        while len(got) < size:
            piece = stream.read(size - len(got))
            if not piece:
                raise ValueError("cut frame")
            got += piece
        return bytes(got)

    while first := stream.read(1):
        frame = bytearray(first + take(3))
        (magic,) = struct.unpack("<I", frame)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            yield magic, take(struct.unpack("<I", take(4))[0])
        elif magic == FRAME:
            frame += take(1)
            flags = frame[4]
            frame += take(zstandard.frame_header_size(bytes(frame)) - 5)
            last = False
            while not last:
                head = take(3)
                block = int.from_bytes(head, "little")
                last = bool(block & 1)
                frame += head + take(1 if block >> 1 & 3 == 1 else block >> 3)
            yield magic, bytes(frame + take(4 if flags & 4 else 0))
        else:
            raise ValueError("no frame")


def parse_record(raw: bytes) -> dict:
    """Columns of a record; raises ValueError if it is malformed."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0].encode() != VERSION:
        raise ValueError("no WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"bad header {line[:60]!r}")
        fields[name.lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if need not in fields:
            raise ValueError(f"header {need} missing")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("length does not match")
    http, sep, payload = rest[:size].partition(b"\r\n\r\n")
    told = [line.split(b":", 1)[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    if not sep or len(told) != 1:
        raise ValueError("no HTTP header")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    if kind == "response":
        if int(told[0]) != len(payload) or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("payload does not match")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise ValueError(f"bad record of type {kind}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "payload_bytes": int(told[0]), "payload_digest": digest,
        "record_type": kind, "refers_to": number("x-refers-to-page-id"), "error": None,
    }


def read_archive(archive: bytes | BinaryIO) -> Iterator[dict]:
    """Records of one archive in order; what cannot be read is a row with only ``error``."""
    stream = io.BytesIO(archive) if isinstance(archive, bytes) else archive
    undo = zstandard.ZstdDecompressor()
    try:
        for k, (magic, body) in enumerate(frames(stream)):
            if magic != FRAME:
                if k == 0 and magic == DICTIONARY_FRAME:
                    if body[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be compressed
                        body = zstandard.ZstdDecompressor().decompress(body)
                    undo = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
                continue
            try:
                yield parse_record(undo.decompress(body))
            except (ValueError, zstandard.ZstdError) as problem:
                yield {"error": str(problem)}
    except (ValueError, zstandard.ZstdError) as problem:
        yield {"error": str(problem)}


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record below ``folder``: page_id, url, payload size and digest, type, reference, error.

    Spark lists the archives and deals them by size; their contents are read by the tasks as a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, name = _filesystem(path)
                rows: list[dict] = []
                with source.open_input_stream(name, compression=None, buffer_size=1 << 20) as stream:
                    for row in read_archive(stream):
                        rows.append(row)
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path", "length").mapInArrow(run, COLUMNS)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    names = [c.split() for c in COLUMNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in names], [n for n, _ in names])


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in a fresh shared folder and read them back."""
    spark = session(pages)
    folder = work_dir(spark, "archives")
    if not write_archives(pages, folder).agg(F.sum("n")).head()[0]:
        return spark.createDataFrame([], COLUMNS)
    return read_archives(spark, folder)
