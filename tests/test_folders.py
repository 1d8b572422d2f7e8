"""Indexing folders: only changed files are opened; image sizes come from headers."""

import io
import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from checks.inputs import _png
from skimdex.functions.paths import content_hash
from skimdex.plans.folders import index_folders, list_files, listing, split_listing
from skimdex.plans.jobs import IndexOptions
from skimdex.sources import readers
from skimdex.sources.files import load_files, scan_images
from skimdex.sources.tables import IndexStore

LONG_AGO = 1_600_000_000


def put(root, name, data, at=LONG_AGO):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(data if isinstance(data, bytes) else data.encode())
    os.utime(path, (at, at))
    return path


def state(store):
    return {os.path.basename(r.file_path): r.file_hash for r in store.meta.read().collect()}


def opened(store):
    """Files that the last build opened."""
    runs = sorted(os.scandir(f"{store.root}/opened"), key=lambda e: os.stat(e.path).st_mtime_ns)
    return sorted(os.path.basename(r.file_path) for r in store.spark.read.parquet(f"{runs[-1].path}/bodies").collect())


def hashes(spark, root):
    files = load_files(spark, [root]).withColumn("file_hash", content_hash(F.col("content")))
    return {os.path.basename(r.file_path): r.file_hash for r in files.select("file_path", "file_hash").collect()}


def test_only_changed_files_are_opened(spark, folder):
    root, store = f"{folder}/files", IndexStore(spark, f"{folder}/index")
    for name in ("a.txt", "b.md", "sub dir/c.txt", "Ü%20d.txt"):
        put(root, name, f"words of {name}")
    put(root, "p.png", _png(3, 4))
    put(root, "x.pdf", "not indexed")
    assert index_folders(store, [root]).summary().head().new_count == 5
    assert state(store) == hashes(spark, root) and len(opened(store)) == 5

    run = index_folders(store, [root])
    assert opened(store) == [] and run.summary().head().total == 5 and state(store) == hashes(spark, root)

    put(root, "a.txt", "another text of a", LONG_AGO + 50)
    put(root, "b.md", "words of b.md", LONG_AGO + 50)  # touched, same bytes
    os.remove(f"{root}/sub dir/c.txt")
    put(root, "e.txt", "a new file")
    found = index_folders(store, [root]).summary().head()
    assert (found.new_count, found.modified_count, found.deleted_count) == (1, 1, 1)
    assert opened(store) == ["a.txt", "b.md", "e.txt"] and state(store) == hashes(spark, root)
    assert {os.path.basename(r.file_path) for r in listing(store).read().collect()} == set(state(store))
    index_folders(store, [root])
    assert opened(store) == [] and state(store) == hashes(spark, root)


def test_same_size_and_time_is_not_opened(spark, folder):
    """The proof that a file stays closed: an edit that hides behind size and time is not noticed."""
    root, store = f"{folder}/files", IndexStore(spark, f"{folder}/index")
    put(root, "a.txt", "first words")
    index_folders(store, [root])
    before = state(store)
    put(root, "a.txt", "other words")
    index_folders(store, [root])
    assert state(store) == before


def test_fresh_times_prove_nothing(spark, folder):
    import time

    root, store = f"{folder}/files", IndexStore(spark, f"{folder}/index")
    now = time.time() + 5
    put(root, "a.txt", "first words", now)
    index_folders(store, [root])
    put(root, "a.txt", "other words", now)  # in the same second as the first listing
    index_folders(store, [root])
    assert state(store) == hashes(spark, root)


def test_failed_files_are_opened_again(spark, folder):
    root, store = f"{folder}/files", IndexStore(spark, f"{folder}/index")
    put(root, "good.txt", "fine")
    put(root, "bad.txt", b"\xff\xfe\xff")
    assert index_folders(store, [root]).summary().head().error_count == 1
    index_folders(store, [root])
    assert opened(store) == ["bad.txt"] and set(state(store)) == {"good.txt"}


def test_scope_and_missing_folders(spark, folder):
    a, b, store = f"{folder}/a", f"{folder}/b", IndexStore(spark, f"{folder}/index")
    put(a, "1.txt", "one")
    put(b, "2.txt", "two")
    index_folders(store, [a, b])
    os.remove(f"{a}/1.txt")
    index_folders(store, [a], IndexOptions(scope=a))
    assert set(state(store)) == {"2.txt"}
    index_folders(store, [b])
    assert opened(store) == []  # the scoped build left the other folder's listing alone
    index_folders(store, [f"{folder}/none"])
    assert state(store) == {}
    assert list_files(spark, [f"{folder}/none"]).collect() == []


def test_split_needs_listing_and_index_to_agree(spark):
    now = spark.createDataFrame([("a", 1, 10), ("b", 1, 10), ("c", 1, 10), ("d", 1, 99), ("e", 1, 10)], "file_path string, file_size long, modified_at long")
    seen = spark.createDataFrame(
        [("a", 1, 10, "ha", 90), ("b", 2, 10, "hb", 90), ("c", 1, 10, "hc", 90), ("d", 1, 99, "hd", 100), ("z", 1, 1, "hz", 90)],
        "file_path string, file_size long, modified_at long, file_hash string, listed_at long",
    )
    indexed = spark.createDataFrame([("a", "ha"), ("b", "hb"), ("c", "older"), ("d", "hd")], "file_path string, file_hash string")
    same, due = split_listing(now, seen, indexed)
    assert [tuple(r) for r in same.collect()] == [("a", 1, 10, "ha")]
    assert sorted(r.file_path for r in due.collect()) == ["b", "c", "d", "e"]


def test_bodies_are_dealt_by_bytes_and_vanished_files_left_out(spark, folder):
    rows = [(put(folder, f"f{i}.txt", b"x" * 1000), 1000, 0) for i in range(40)] + [(f"{folder}/gone.txt", 1000, 0)]
    paths = spark.createDataFrame(rows, "file_path string, file_size long, modified_at long")
    assert readers.dealt(paths, 2000).rdd.getNumPartitions() == 21
    got = readers.read_bodies(paths, 2000).collect()
    assert len(got) == 40 and all(bytes(r.content) == b"x" * 1000 for r in got)
    assert readers.read_bodies(paths.limit(0)).collect() == []


# -- headers


def jpeg(width, height, parts=3, extra=b""):
    frame = struct.pack(">BHHB", 8, height, width, parts) + b"\1\x11\0" * parts
    thumb = b"\xff\xe0" + struct.pack(">H", 2 + len(extra)) + extra
    return b"\xff\xd8" + thumb + b"\xff\xff\xc2" + struct.pack(">H", 2 + len(frame)) + frame + b"\xff\xda" + b"\0" * 50_000


def gif(width, height, alpha=False):
    control = b"\x21\xf9\x04" + bytes([int(alpha)]) + b"\0\0\0\0" + b"\x21\xfe\x03abc\0"
    return b"GIF89a" + struct.pack("<HHBBB", 999, 999, 0x81, 0, 0) + b"\0" * 12 + control + b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\0" * 5000


def bmp(width, height, depth=24):
    return b"BM" + b"\0" * 12 + struct.pack("<IiiHH", 40, width, height, 1, depth) + b"\0" * 4000


def webp(kind, width, height):
    if kind == b"VP8X":
        body = b"\x10\0\0\0" + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
    elif kind == b"VP8L":
        body = b"\x2f" + struct.pack("<I", (width - 1) | (height - 1) << 14)
    else:
        body = b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", width, height)
    return b"RIFF" + struct.pack("<I", 4000) + b"WEBP" + kind + struct.pack("<I", len(body)) + body + b"\0" * 4000


def with_transparency(data):
    chunk = struct.pack(">I4s", 3, b"tRNS") + b"\0\0\0" + struct.pack(">I", zlib.crc32(b"tRNS\0\0\0"))
    return data[:33] + chunk + data[33:]


def palette(data):
    return data[:25] + b"\3" + data[26:]


IMAGES = {
    "grey.png": (_png(7, 9), (7, 9, 1)), "rgb.png": (_png(7, 9)[:25] + b"\2" + _png(7, 9)[26:], (7, 9, 3)),
    "rgba.png": (_png(7, 9)[:25] + b"\6" + _png(7, 9)[26:], (7, 9, 4)), "palette.png": (palette(_png(7, 9)), (7, 9, 3)),
    "clear.png": (with_transparency(palette(_png(7, 9))), (7, 9, 4)),
    "a.jpg": (jpeg(640, 480), (640, 480, 3)), "b.jpeg": (jpeg(5, 6, 1, b"\xff\xc0" * 15_000), (5, 6, 1)),
    "a.gif": (gif(30, 20), (30, 20, 3)), "b.gif": (gif(30, 20, True), (30, 20, 4)),
    "a.bmp": (bmp(12, -34), (12, 34, 3)), "a.webp": (webp(b"VP8X", 70_000, 3), (70_000, 3, 4)),
    "b.webp": (webp(b"VP8L", 16_000, 9), (16_000, 9, 3)), "c.webp": (webp(b"VP8 ", 320, 200), (320, 200, 3)),
    "damaged.png": (b"damaged", None), "short.png": (_png(7, 9)[:20], None), "cut.jpg": (jpeg(5, 5)[:10], None),
    "none.jpg": (b"\xff\xd8\xff\xda" + b"\0" * 90, None), "zero.bmp": (bmp(0, 5), None), "other.heic": (b"\0\0\0\x18ftypheic", None),
    "loop.gif": (b"GIF89a" + b"\0" * 7 + b"\x21\xfe", None),
}


@pytest.mark.parametrize("name", sorted(IMAGES))
def test_image_size_reads_little(name):
    data, want = IMAGES[name]
    read = []

    class Counting(io.BytesIO):
        def read(self, n=-1):
            read.append(n)
            return super().read(n)

    assert readers.image_size(readers._pieces(Counting(data))) == want
    assert sum(read) <= 512 and -1 not in read


def test_random_bytes_never_crash():
    rng = random.Random(1)
    magics = [m for m, _ in readers._FORMATS]
    for _ in range(3000):
        data = rng.choice(magics) + rng.randbytes(rng.randrange(80))
        got = readers.image_size(readers._pieces(io.BytesIO(data)))
        assert got is None or all(isinstance(x, int) for x in got)


def test_headers_equal_decoded_images(spark, folder):
    for i in range(6):
        put(folder, f"{i}.png", _png(i + 1, 2 * i + 1) if i else b"damaged")
    listed = load_files(spark, [folder]).select("file_path", "file_size")
    got = readers.image_headers(listed.unionByName(spark.createDataFrame([(f"{folder}/gone.png", 1)], listed.schema)))
    want = scan_images(spark, folder)
    assert sorted(map(tuple, got.where("file_path NOT LIKE '%gone%'").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert [r.ok for r in got.where("file_path LIKE '%gone%'").collect()] == [False]


def test_a_text_without_direction_is_listed_and_indexed(spark, folder):
    root, store = f"{folder}/files", IndexStore(spark, f"{folder}/index")
    put(root, "a.txt", "Un.\n")  # its trigrams cancel
    put(root, "b.txt", "plain words\n")
    index_folders(store, [root])
    assert state(store) == hashes(spark, root) and set(state(store)) == {"a.txt", "b.txt"}
    assert tuple(index_folders(store, [root]).summary().head()) == (2, 0, 0, 0, 0)
