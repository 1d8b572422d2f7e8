"""Lists of files, and readers that open exactly the files of a table of paths: whole bodies, their
hashes, or the header of an image.

Spark's own binary source can leave out files by size and time but not by a long list of paths, and it
lists all files in the driver. Here paths are rows, dealt to tasks by their bytes, and every task lists
or opens its own through Arrow's file systems (``file``, ``hdfs``, ``s3``, also written ``s3a``, and ``gs``).
"""

from __future__ import annotations

import errno
import hashlib
import math
import os
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimdex.session import work_dir

#: schemes that tasks can list and open
SCHEMES = ("file", "hdfs", "s3", "s3a", "gs")
#: folders that a task lists, and entries in one batch
TASK_FOLDERS, BATCH_ENTRIES = 10_000, 10_000
#: bytes hashed at a time
HASHED_BYTES = 8 * 1024 * 1024
#: bytes of files that a task opens, and of bodies in one batch
TASK_BYTES, BATCH_BYTES = 128 * 1024 * 1024, 32 * 1024 * 1024
#: bytes read at a time while looking for the size of an image
HEADER_BYTES = 64


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class _Opener:
    """Opens paths, with one file system per scheme and host."""

    def __init__(self):
        self.known: dict[str, fs.FileSystem] = {}

    def __call__(self, path: str) -> pa.NativeFile:
        if "://" not in path and not path.startswith("file:"):
            local = self.known.setdefault("", fs.LocalFileSystem())
            return local.open_input_file(path)
        scheme, _, rest = path.partition("://")
        host = f"{scheme}://{rest.partition('/')[0]}"
        if host not in self.known:
            self.known[host] = _located(path)[0]
        return self.known[host].open_input_file(_located(path)[1])


def dealt(paths: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows (file_path, file_size, ...) dealt at random to tasks of about ``task_bytes`` of files."""
    row = paths.agg(F.count("*").alias("n"), F.sum("file_size").alias("size")).head()
    cores = paths.sparkSession.sparkContext.defaultParallelism
    return paths.repartition(max(1, min(row.n, max(cores, math.ceil((row.size or 0) / task_bytes)))))


ENTRIES = pa.schema([("path", pa.string()), ("file_size", pa.int64()), ("modified_at", pa.int64()), ("folder", pa.bool_())])


def _entries(folder: str) -> Iterator[tuple[str, int, int, bool]]:
    """(name, size, second, whether a folder) of what a folder holds, links followed; dead links are left out."""
    if "://" in folder:
        where, at = _located(folder)
        for info in where.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if info.type != fs.FileType.NotFound:
                second = (info.mtime_ns or 0) // 10**9
                yield info.base_name, info.size or 0, second, info.type == fs.FileType.Directory
        return
    try:
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    if entry.is_dir():
                        yield entry.name, 0, 0, True
                        continue
                    status = entry.stat()
                except OSError as problem:
                    if problem.errno not in (errno.ENOENT, errno.ELOOP):
                        raise
                    continue
                yield entry.name, status.st_size, status.st_mtime_ns // 10**9, False
    except FileNotFoundError:  # vanished since it was listed
        return


def _hidden(name: str, folder: bool) -> bool:
    """Names that Spark's file sources do not list, among them those that are no UTF-8."""
    if not name.isprintable() and any("\ud800" <= c <= "\udfff" for c in name):
        return True
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def list_tree(folders: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """(file_path, file_size, modified_at) of the files of these ``extensions`` under ``folders`` (path).

    Tasks list the folders, one level after the other, and every level is written; the driver holds only
    how many folders there are. As with Spark's file sources, empty files and names that start with ``_``
    or ``.`` are not listed; a folder that cannot be read fails the listing.
    """
    spark, ends = folders.sparkSession, tuple(f".{e}" for e in extensions)
    out, level = work_dir(spark, "entries"), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for name, size, second, folder in _entries(path):
                    if _hidden(name, folder) or not (folder or (size and name.lower().endswith(ends))):
                        continue
                    held.append((f"{path.rstrip('/')}/{name}", size, second, folder))
                    if len(held) >= BATCH_ENTRIES:
                        yield _entry_batch(held)
                        held = []
        if held:
            yield _entry_batch(held)

    while True:
        n = folders.count()
        parts = max(1, min(n, max(spark.sparkContext.defaultParallelism, math.ceil(n / TASK_FOLDERS))))
        listed = folders.select("path").repartition(parts).mapInArrow(run, "path string, file_size long, modified_at long, folder boolean")
        listed.write.parquet(f"{out}/level={level}")
        folders = spark.read.parquet(f"{out}/level={level}").where("folder")
        if folders.isEmpty():
            break
        level += 1
    return spark.read.parquet(out).where("NOT folder").select(F.col("path").alias("file_path"), "file_size", "modified_at")


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ENTRIES)], schema=ENTRIES)


def hash_files(paths: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``paths`` (file_path, file_size, modified_at) with ``file_hash``, the SHA-256 of the file, read piece by piece.

    A file that has vanished is left out; one that cannot be read fails the scan.
    """
    names = ["file_path", "file_size", "modified_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = _Opener()
        for batch in batches:
            kept, hashes = [], []
            for i, path in enumerate(batch.column(0).to_pylist()):
                digest = hashlib.sha256()
                try:
                    with opener(path) as source:
                        while piece := source.read(HASHED_BYTES):
                            digest.update(piece)
                except FileNotFoundError:
                    continue
                kept.append(i)
                hashes.append(digest.hexdigest())
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hashes, pa.string())], [*names, "file_hash"])

    return dealt(paths.select(*names), task_bytes).mapInArrow(run, "file_path string, file_size long, modified_at long, file_hash string")


def read_bodies(paths: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Every file of ``paths`` (file_path, file_size, modified_at) with its ``content``, opened once.

    A file that has vanished is left out, as if it had not been listed; one that cannot be read fails
    the scan, so it never looks deleted.
    """
    names = ["file_path", "file_size", "modified_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = _Opener()
        for batch in batches:
            kept, bodies, held = [], [], 0
            for i, path in enumerate(batch.column(0).to_pylist()):
                try:
                    with opener(path) as source:
                        bodies.append(source.readall())
                except FileNotFoundError:
                    continue
                kept.append(i)
                held += len(bodies[-1])
                if held > BATCH_BYTES:
                    yield _batch(batch, kept, bodies, names)
                    kept, bodies, held = [], [], 0
            yield _batch(batch, kept, bodies, names)

    return dealt(paths.select(*names), task_bytes).mapInArrow(run, "file_path string, file_size long, modified_at long, content binary")


def _batch(batch: pa.RecordBatch, kept: list[int], bodies: list[bytes], names: list[str]) -> pa.RecordBatch:
    part = batch.take(pa.array(kept, pa.int64()))
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(bodies, pa.binary())], [*names, "content"])


def image_headers(paths: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Per file of ``paths`` (file_path, file_size): width, height, channels, ok, from its header alone.

    PNG, JPEG, GIF, BMP and WebP are told apart by their first bytes. A file of another kind, or with a
    damaged header, has ``ok`` false and nulls; pixels are not read, so damage there is not seen. A file
    that has vanished or cannot be opened counts as damaged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = _Opener()
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                try:
                    with opener(path) as source:
                        found.append(image_size(_pieces(source)) or (None, None, None))
                except OSError:
                    found.append((None, None, None))
            columns = [pa.array([f[i] for f in found], pa.int32()) for i in range(3)]
            columns.append(pa.array([f[0] is not None for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["file_path", "width", "height", "channels", "ok"])

    # a header costs the same in files of any size
    even = paths.select("file_path", F.lit(task_bytes // 10_000).cast("long").alias("file_size"))
    return dealt(even, task_bytes).mapInArrow(run, "file_path string, width int, height int, channels int, ok boolean")


def _pieces(source) -> Callable[[int, int], bytes]:
    """(offset, count) -> bytes of a file, read in small ranges and kept while they serve."""
    held = [0, b""]

    def piece(at: int, count: int) -> bytes:
        start, data = held
        if not start <= at <= at + count <= start + len(data):
            source.seek(at)
            held[:] = at, source.read(max(count, HEADER_BYTES))
            start, data = held
        return data[at - start : at - start + count]

    return piece


def image_size(piece: Callable[[int, int], bytes]) -> tuple[int, int, int] | None:
    """Width, height and channels by the header; None if it cannot be read."""
    try:
        head = piece(0, 16)
        for magic, read in _FORMATS:
            if head.startswith(magic):
                found = read(piece)
                return found if found and found[0] > 0 and found[1] > 0 else None
    except (struct.error, IndexError, ValueError):  # the file ends early
        pass
    return None


def _png(piece: Callable[[int, int], bytes]) -> tuple[int, int, int] | None:
    if piece(12, 4) != b"IHDR":
        return None
    width, height, _, color = struct.unpack(">IIBB", piece(16, 10))
    if color in (0, 4):  # grey, with or without alpha
        return width, height, 1
    if color == 6:
        return width, height, 4
    at = 33
    while True:  # a transparency chunk gives a palette its alpha; it stands ahead of the pixels
        size, kind = struct.unpack(">I4s", piece(at, 8))
        if kind == b"tRNS":
            return width, height, 4 if color == 3 else 3
        if kind in (b"IDAT", b"IEND"):
            return width, height, 3
        at += 12 + size


def _jpeg(piece: Callable[[int, int], bytes]) -> tuple[int, int, int] | None:
    at = 2
    while True:
        mark, kind = piece(at, 2)
        if mark != 0xFF:
            return None
        if kind == 0xFF:  # padding
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width, parts = struct.unpack(">HHB", piece(at + 5, 5))
            return width, height, parts
        elif kind in (0xD9, 0xDA):  # the pixels begin before any frame
            return None
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:  # markers without a body
            at += 2
        else:
            at += 2 + struct.unpack(">H", piece(at + 2, 2))[0]


def _gif(piece: Callable[[int, int], bytes]) -> tuple[int, int, int] | None:
    flags = piece(10, 1)[0]
    at = 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    channels = 3
    while True:
        kind = piece(at, 1)[0]
        if kind == 0x2C:  # the first frame
            width, height = struct.unpack("<HH", piece(at + 5, 4))
            return width, height, channels
        if kind != 0x21:
            return None
        if piece(at + 1, 1)[0] == 0xF9 and piece(at + 3, 1)[0] & 1:
            channels = 4
        at += 2
        while size := piece(at, 1)[0]:
            at += 1 + size
        at += 1


def _bmp(piece: Callable[[int, int], bytes]) -> tuple[int, int, int] | None:
    size = struct.unpack("<I", piece(14, 4))[0]
    if size == 12:
        width, height = struct.unpack("<HH", piece(18, 4))
        return width, height, 3
    width, height, _, depth = struct.unpack("<iiHH", piece(18, 12))
    return width, abs(height), 4 if depth == 32 and size >= 56 and any(piece(66, 4)) else 3


def _webp(piece: Callable[[int, int], bytes]) -> tuple[int, int, int] | None:
    if piece(8, 4) != b"WEBP":
        return None
    kind = piece(12, 4)
    if kind == b"VP8X":
        flags, size = piece(20, 1)[0], piece(24, 6)
        return int.from_bytes(size[:3], "little") + 1, int.from_bytes(size[3:], "little") + 1, 4 if flags & 0x10 else 3
    if kind == b"VP8L" and piece(20, 1) == b"\x2f":
        bits = struct.unpack("<I", piece(21, 4))[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 4 if bits >> 28 & 1 else 3
    if kind == b"VP8 " and piece(23, 3) == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", piece(26, 4))
        return width & 0x3FFF, height & 0x3FFF, 3
    return None


_FORMATS = [(b"\x89PNG\r\n\x1a\n", _png), (b"\xff\xd8", _jpeg), (b"GIF87a", _gif), (b"GIF89a", _gif), (b"BM", _bmp), (b"RIFF", _webp)]
