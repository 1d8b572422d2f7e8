"""Trigram postings and seek pages against the plain filter and the plain listing."""

import collections
import datetime as dt
import random

import pytest

from skimdex.operators import listing, maintain

META = "file_path string, file_hash string, indexed_at timestamp"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def rows(n, seed=3):
    """A third of the rows share one time; paths share long beginnings; nulls and repeats occur."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        when = START if i % 3 == 0 else None if i % 41 == 0 else START + dt.timedelta(microseconds=rng.randrange(5000))
        name = "".join(rng.choice("abÉé_%\U0001f600\0") for _ in range(rng.randrange(6)))
        out.append((f"library/with/a/long/beginning/{name}/{i % 97}", f"h{i % 5}", when))
    out += [(None, "x", START), ("", "x", START), (None, None, None), ("Ab", "x", START)] + out[:40]
    return out


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame(rows(3000), META).repartition(6).cache()


def test_pages_equal_the_sorted_listing(spark, meta):
    key = lambda r: (r.indexed_at is None, -(r.indexed_at.timestamp() if r.indexed_at else 0), r.file_path is not None, (r.file_path or "").encode())
    every = [(r.file_path, r.indexed_at) for r in sorted(meta.collect(), key=key)]
    for page, size, most in ((1, 50, 60), (7, 50, 60), (12, 130, 50), (2, 3000, 200), (61, 50, 60), (40, 77, 100), (9999, 50, 60)):
        got = [(r.file_path, r.indexed_at) for r in listing.seek_page(meta, page=page, page_size=size, most=most).collect()]
        assert got == every[(page - 1) * size : page * size], (page, size, most)
    some = dict(path="LONG/beg", after=START + dt.timedelta(microseconds=100), before="2024-01-01T00:00:00.004Z")
    want = maintain.list_index(meta, **some, page=3, page_size=40).collect()
    got = listing.seek_page(meta, **some, page=3, page_size=40, most=50).collect()
    assert [(r.file_path, r.indexed_at) for r in got] == [(r.file_path, r.indexed_at) for r in want] and want
    assert listing.seek_page(meta.limit(0)).count() == 0


def test_only_the_page_is_sorted(spark, meta, folder):
    for skip in (0, 900, 1500, 2900):
        pieces = listing._pieces(meta, 0, skip, 50, 60)
        for part, _, _ in pieces:
            assert part.count() <= 60 or part.select("file_path", "indexed_at").distinct().count() == 1
    meta.write.mode("overwrite").parquet(folder)
    page = listing.seek_page(spark.read.parquet(folder), page=50, page_size=20, most=100)
    assert "GreaterThanOrEqual(indexed_at" in page._jdf.queryExecution().executedPlan().toString()


def counted(df):
    return collections.Counter((r.file_path, r.file_hash, r.indexed_at) for r in df.collect())


def test_postings_equal_the_filter(spark, meta, folder, monkeypatch):
    index = listing.build_path_index(meta.withColumnRenamed("file_hash", "gram").withColumnRenamed("gram", "file_hash"), f"{folder}/paths")
    assert counted(index.rows()) == counted(meta)
    for most in (listing.KEYS, 5):
        monkeypatch.setattr(listing, "KEYS", most)
        for text in ("É_%", "g/ab", "/9", "\U0001f600A", "LONG", "nothing here", "ab", "Ab", "%_b", "\0a", "ning//17", None, ""):
            assert counted(index.filter(text)) == counted(maintain.filter_index(meta, text)), (most, text)
        assert counted(index.filter("/17", after=START, before=START)) == counted(maintain.filter_index(meta, "/17", START, START))
    nothing = listing.build_path_index(meta.limit(0), f"{folder}/none")
    assert nothing.filter("abc").count() == 0 and nothing.filter().count() == 0


def test_postings_prune_the_scan(spark, folder):
    table = spark.range(20_000).selectExpr("concat('all/', sha2(cast(id as string), 256)) AS file_path", "'h' AS file_hash", "now() AS indexed_at")
    index = listing.build_path_index(table, f"{folder}/paths")
    text = table.where("file_path LIKE '%abc%'").head().file_path[10:30]
    gram, n = index.rarest(text)
    assert gram in text and 0 < n < 500 and index.rarest("all/")[1] == 20_000 and index.rarest("xyz") == ("xyz", 0)
    found = index.filter(text)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_folder" in plan and "In(_key" in plan and found.count() == 1
