import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from checks.inputs import _png
from skimdex.functions import paths as P
from skimdex.operators import media
from skimdex.sources.files import list_files, load_files, read_text_docs, scan_files, scan_images


def write(root, name, data):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(data)
    return path


@pytest.fixture
def tree(folder):
    for name in ("a.TXT", "deep/er/b.md", "deep/c.JPG", "d.pdf", "noext", "e.txt.bak", "deep/f.Heic"):
        write(folder, name, name.encode())
    return folder


def test_scan_takes_indexable_files_once(spark, tree):
    rows = scan_files(spark, [tree, f"{tree}/deep", f"{tree}/missing"]).collect()
    names = sorted(os.path.relpath(r.file_path, tree) for r in rows)
    assert names == ["a.TXT", "deep/c.JPG", "deep/er/b.md", "deep/f.Heic"]
    sizes = {os.path.relpath(r.file_path, tree): r.file_size for r in rows}
    assert sizes["deep/c.JPG"] == len("deep/c.JPG")
    assert len({r.file_hash for r in rows}) == 4
    assert all(r.modified_at == int(os.path.getmtime(r.file_path)) for r in rows)


def test_scan_of_nothing(spark, tree):
    assert scan_files(spark, [f"{tree}/missing"]).collect() == []


def test_equal_bytes_have_equal_hashes(spark, folder):
    write(folder, "x.txt", b"same")
    write(folder, "y.md", b"same")
    assert len({r.file_hash for r in scan_files(spark, [folder]).collect()}) == 1


def test_listing_does_not_read_content(spark, tree):
    plan = load_files(spark, [tree]).select("file_path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_invalid_text_is_an_error_row(spark, folder):
    write(folder, "good.txt", "né 你".encode())
    write(folder, "bad.txt", b"\xff\xfeabc")
    got = {os.path.basename(r.file_path): r for r in read_text_docs(load_files(spark, [folder])).collect()}
    assert (got["good.txt"].text, got["good.txt"].error) == ("né 你", None)
    assert (got["bad.txt"].text, got["bad.txt"].error) == (None, "invalid UTF-8")


def test_spark_lists_no_empty_or_hidden_files(spark, folder):
    """A limit of Spark's file sources, stated in the README."""
    for name, data in (("empty.txt", b""), ("_private.txt", b"x"), (".dot.txt", b"x"), ("kept.txt", b"x")):
        write(folder, name, data)
    assert [os.path.basename(r.file_path) for r in scan_files(spark, [folder]).collect()] == ["kept.txt"]


def test_image_sizes_and_fit(spark, folder):
    sizes = {"wide": (400, 100), "tall": (100, 400), "small": (10, 10), "thin": (5000, 1)}
    for name, (w, h) in sizes.items():
        write(folder, f"{name}.png", _png(w, h))
    write(folder, "broken.png", b"not an image")
    images = scan_images(spark, folder)
    got = {os.path.basename(r.origin)[:-4]: r for r in images.collect()}
    assert {n: (got[n].width, got[n].height) for n in sizes} == sizes
    assert not got["broken"].ok and got["broken"].width is None
    files = load_files(spark, [folder]).select("file_path", "file_size", "modified_at")
    plan = {r.file_name[:-4]: (r.fit_width, r.fit_height) for r in media.file_catalog(files, images, max_edge=100).collect()}
    assert plan == {"wide": (100, 25), "tall": (25, 100), "small": (10, 10), "thin": (100, 1), "broken": (None, None)}


def column(spark, values, kind, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_extension_rules(spark):
    names = ["a/b.TXT", "a.b/c", ".txt", "x.tar.Md", "dir.md/", "a\\b.JPEG", "", "a.", "..webp"]
    assert column(spark, names, "string", P.extension) == ["txt", "", "", "md", "", "jpeg", "", "", "webp"]
    assert column(spark, names, "string", P.file_type) == ["text", None, None, "text", None, "image", None, None, "image"]
    assert column(spark, ["a/b.TXT", "c:\\d\\e.md", "f"], "string", P.base_name) == ["b.TXT", "e.md", "f"]
    assert column(spark, ["x/abc.webp", "abc", ".webp", "a.b.webp"], "string", P.file_stem) == ["abc", "abc", ".webp", "a.b"]


def test_mime_types(spark):
    names = ["a.JPG", "a.png", "a.tif", "a.dib", "a.ico", "a.heif", "a.svg", "noext"]
    want = ["image/jpeg", "image/png", "image/tiff", "image/bmp", "image/x-icon", "image/heic", "image/svg", "image/jpeg"]
    assert column(spark, names, "string", P.mime_type) == want


def test_data_url_has_no_line_breaks(spark):
    data = bytes(range(256)) * 3
    row = spark.createDataFrame([("x.webp", bytearray(data))], "p string, c binary")
    url = row.select(P.data_url(F.col("p"), F.col("c")).alias("u")).head().u
    import base64

    assert url == "data:image/webp;base64," + base64.b64encode(data).decode()


def test_transcode_rule(spark):
    rows = [("a.JPG", 4 * 1024**2), ("a.jpg", 4 * 1024**2 + 1), ("a.gif", 1), ("a.TIFF", 1), ("a", 1)]
    df = spark.createDataFrame(rows, "p string, s long")
    got = [r.x for r in df.select(P.needs_transcode(F.col("p"), F.col("s")).alias("x")).collect()]
    assert got == [False, True, True, False, True]


def test_size_labels(spark):
    sizes = [0, 1023, 1024, 1280, 1024**2 - 1, 1024**2, 1024**3 - 1, 1024**3, 5 * 1024**4]
    want = ["0 B", "1023 B", "1.0 KB", "1.3 KB", "1024.0 KB", "1.0 MB", "1024.0 MB", "1.00 GB", "5120.00 GB"]
    assert column(spark, sizes, "long", P.size_label) == want


def test_labels_of_large_sizes_round_as_doubles_do(spark):
    sizes = [280242448222367232, 1342301072752524625, 2402145669022010240]
    want = ["260996118.40 GB", "1250115290.98 GB", "2237172489.07 GB"]
    assert column(spark, sizes, "long", P.size_label) == want


def test_exif_defaults_and_hemispheres(spark):
    tags = [
        '{"Make":"M","FNumber":"2.8","ApertureValue":"9","GPSLatitude":-33.5,"GPSLongitude":0}',
        '{"ApertureValue":"4","GPSLatitude":0.00001,"GPSLongitude":-151.25}',
        "broken",
    ]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(tags)], "file_path string, tags string")
    got = {r.file_path: r for r in media.exif_fields(df).collect()}
    assert (got["0"].camera_make, got["0"].aperture) == ("M", "2.8")
    assert (got["0"].gps_latitude, got["0"].gps_longitude) == ("33.5 S", "0 E")
    assert (got["1"].aperture, got["1"].gps_latitude, got["1"].gps_longitude) == ("4", "0.00001 N", "151.25 W")
    assert set(got["2"]) == {"2", None}


def test_expired_artifacts(spark):
    art = spark.createDataFrame([("t/h1.webp",), ("t/h2.webp",), ("t/h3.png",)], "artifact_path string")
    meta = spark.createDataFrame([("h1",), ("h1",)], "file_hash string")
    assert [r["hash"] for r in media.expired_artifacts(art, meta).collect()] == ["h2"]
    assert tuple(media.expired_summary(art, meta).head()) == (2, 1)
    assert tuple(media.expired_summary(art, meta.where("false")).head()) == (2, 2)
    assert media.clear_artifacts_summary(art).head().deleted == 3


def test_png_helper_is_a_png():
    data = _png(3, 2)
    assert struct.unpack(">II", data[16:24]) == (3, 2) and zlib.crc32(data[12:29]) == struct.unpack(">I", data[29:33])[0]


def test_odd_coordinates_do_not_stop_the_job(spark):
    rows = [("a", '{"GPSLatitude": 12345.6, "GPSLongitude": -7.5}'), ("b", '{"GPSLatitude": 1e300}')]
    got = media.exif_fields(spark.createDataFrame(rows, "file_path string, tags string")).orderBy("file_path").collect()
    assert [(r.gps_latitude, r.gps_longitude) for r in got] == [(None, "7.5 W"), (None, None)]


def test_a_text_tree_holds_one_file_per_document_and_nothing_else(spark, folder):
    import os

    from checks.inputs import write_text_tree

    rows = [(1, "a"), (2, "ü\nb"), (2, "copied number"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    root = write_text_tree(spark, folder, f"{folder}/tree")
    found = [(d, f) for d, _, names in os.walk(root) for f in names]
    texts = sorted((os.path.basename(d), open(f"{d}/{f}", encoding="utf-8").read()) for d, f in found)
    assert texts == [("doc_id=1", "a\n"), ("doc_id=2", "copied number\n"), ("doc_id=2", "ü\nb\n"), ("doc_id=3", "\n")]


def test_a_repeated_task_leaves_the_same_files(spark, folder, monkeypatch):
    """A task that is run again may read its rows in another order."""
    from checks import inputs

    monkeypatch.setattr(inputs, "spread", lambda df: df)
    rows = [(1, "a"), (2, "b"), (2, "b"), (3, "c")]
    for name, part in (("one", rows), ("two", rows[::-1])):
        frame = spark.createDataFrame(part, "doc_id long, text string").coalesce(1)
        frame.write.parquet(f"{folder}/{name}/documents.parquet")
        inputs.write_text_tree(spark, f"{folder}/{name}", f"{folder}/tree")
    found = sorted(os.path.basename(d) for d, _, names in os.walk(f"{folder}/tree") for _ in names)
    assert found == ["doc_id=1", "doc_id=2", "doc_id=2", "doc_id=3"]


def test_tasks_list_the_same_files_as_spark(spark, folder):
    names = ("a.txt", "sub dir/b.MD", "Ü%20d/c[1].jpg", "_x=1/d.txt", "deep/er/still/e.txt", "_hidden/f.txt", ".dot/g.txt")
    for name in (*names, "_metadata/h.txt", "empty.txt", "x.pdf", "deep/.i.txt", "deep/_j.txt", "k.txt._COPYING_"):
        write(f"{folder}/t", name, b"" if name == "empty.txt" else name.encode())
    os.makedirs(f"{folder}/t/nothing")
    write(folder, "aside/l.txt", b"linked")
    os.symlink(f"{folder}/aside", f"{folder}/t/link")
    os.symlink(f"{folder}/aside/l.txt", f"{folder}/t/m.txt")
    os.symlink(f"{folder}/none", f"{folder}/t/dead.txt")
    columns = ["file_path", "file_size", "modified_at"]
    for roots in ([f"{folder}/t"], [f"file:{folder}/t/", f"{folder}/t/deep", f"{folder}/no"], [f"{folder}/t/de*"], [f"{folder}/t/a.txt"]):
        want = sorted(set(map(tuple, load_files(spark, roots).select(*columns).collect())))
        assert sorted(map(tuple, list_files(spark, roots).collect())) == want and want
        assert sorted(map(tuple, scan_files(spark, roots).select(*columns).collect())) == want
    before = list_files(spark, [f"{folder}/t"]).count()
    open(os.path.join(os.fsencode(f"{folder}/t"), b"no-utf8-\xff.txt"), "wb").write(b"x")
    assert before > 6 and list_files(spark, [f"{folder}/t"]).count() == before


def test_the_driver_holds_no_list_of_files(spark, folder):
    for i in range(300):
        write(folder, f"t/{i % 30}/{i}.txt", b"x")
    for found in (list_files(spark, [f"{folder}/t"]), scan_files(spark, [f"{folder}/t"])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "binaryFile" not in plan and len(found.inputFiles()) < 100 and found.count() == 300


def test_a_folder_that_cannot_be_read_fails_the_scan(spark, folder, monkeypatch):
    from skimdex.sources import readers

    def refused(path):
        raise PermissionError(path)

    with pytest.raises(PermissionError):
        monkeypatch.setattr(readers.os, "scandir", refused)
        list(readers._entries(folder))
    monkeypatch.undo()
    assert list(readers._entries(f"{folder}/gone")) == []
