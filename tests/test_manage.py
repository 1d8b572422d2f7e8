import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skimdex.functions.embed import HashingEmbedder
from skimdex.operators import diff, maintain, model_io

UTC = dt.timezone.utc


@pytest.fixture(scope="module")
def meta(spark):
    names = ["a_b.txt", "axb.txt", "100%.txt", "UPPER/É.txt", "it's.txt"]
    rows = [(n, "h", dt.datetime(2024, 1, 1 + i, 12, 0, 0, 123000, tzinfo=UTC)) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "file_path string, file_hash string, indexed_at timestamp")


def names(df):
    return sorted(r.file_path for r in df.collect())


def test_filter_is_literal_and_ignores_case(spark, meta):
    assert names(maintain.filter_index(meta, "a_b")) == ["a_b.txt"]
    assert names(maintain.filter_index(meta, "0%")) == ["100%.txt"]
    assert names(maintain.filter_index(meta, "upper/é")) == ["UPPER/É.txt"]
    assert names(maintain.filter_index(meta, "t's")) == ["it's.txt"]
    assert maintain.filter_index(meta, "", "", "").count() == 5


def test_time_bounds_are_inclusive_instants(spark, meta):
    exact = dt.datetime(2024, 1, 2, 12, 0, 0, 123000, tzinfo=UTC)
    assert names(maintain.filter_index(meta, after=exact, before=exact)) == ["axb.txt"]
    # a bound without milliseconds lies before the stored instant
    assert names(maintain.filter_index(meta, after="2024-01-05T12:00:00Z")) == ["it's.txt"]
    assert names(maintain.filter_index(meta, before="2024-01-01T12:00:00Z")) == []


def test_paging(spark, meta):
    page = maintain.list_index(meta, page=2, page_size=2).collect()
    assert [r.file_path for r in page] == ["100%.txt", "axb.txt"]
    assert maintain.list_index(meta, page=0, page_size=0).count() == 1
    assert maintain.count_index(meta, "txt").head().total == 5


def test_filters_reach_the_scan(spark, meta, folder):
    meta.write.mode("overwrite").parquet(folder)
    plan = maintain.filter_index(spark.read.parquet(folder), after="2024-01-03T00:00:00Z")
    assert "GreaterThanOrEqual(indexed_at" in plan._jdf.queryExecution().executedPlan().toString()


def test_delete_summary_counts_requests(spark, meta):
    ask = spark.createDataFrame([("a_b.txt",), ("nope",), ("a_b.txt",)], "file_path string")
    assert tuple(maintain.delete_summary(meta, ask).head()) == (3, 1)
    assert tuple(maintain.delete_summary(meta, ask.where("false")).head()) == (0, 0)


def snapshot(spark, **files):
    return spark.createDataFrame([(k, 1, v) for k, v in files.items()], "file_path string, modified_at long, file_hash string")


def test_diff_kinds(spark):
    old = spark.createDataFrame([("same", "1"), ("edit", "1"), ("gone", "1")], "file_path string, file_hash string")
    now = snapshot(spark, same="1", edit="2", fresh="1")
    # a path listed twice counts once
    got = {r.file_path: r.change_type for r in diff.snapshot_diff(now.union(now), old).collect()}
    assert got == {"same": "unchanged", "edit": "modified", "gone": "deleted", "fresh": "new"}
    same = diff.snapshot_diff(snapshot(spark, same="1", edit="1", gone="1"), old)
    assert diff.incremental_files(same).count() == 0
    scoped = diff.snapshot_diff(now, old, scope="other/")
    assert "deleted" not in {r.change_type for r in scoped.collect()}


def test_progress_percentage(spark):
    ev = [("j", "scan", 3, 9), ("j", "scan", 7, 9), ("j", "index", 0, 0)]
    df = spark.createDataFrame(ev, "job_id string, phase string, current int, total int")
    got = {r.phase: (r.current, r.total, r.percentage) for r in diff.progress_by_phase(df).collect()}
    assert got == {"scan": (7, 9, 77), "index": (0, 0, 0)}


def test_report_kinds(spark):
    with pytest.raises(ValueError):
        diff.indexed_files_report(None, snapshot(spark, a="1").withColumn("file_size", F.lit(1)), per="page")


SHAPES = {
    '{"data":[{"embedding":[1,2.5]}]}': [1.0, 2.5],
    '{"data":[{"embedding":[[1,2.5]]}]}': [1.0, 2.5],
    '{"data":[{"embedding":[1]},{"embedding":[2]}]}': [1.0],
    '[{"embedding":[1,-2]}]': [1.0, -2.0],
    '[{"embedding":[[1,2]]}]': [1.0, 2.0],
    "[[1,2],[3,4]]": [1.0, 2.0],
    "[1,2,3e2]": [1.0, 2.0, 300.0],
    '{"output":{"embeddings":[{"embedding":[0.5]}]}}': [0.5],
    '{"output":{"embeddings":[{"embedding":[[1]]}]}}': None,
    "[]": None,
    '{"data":[]}': None,
    '{"data":[{"embedding":[]}]}': None,
    '{"data":[{"embedding":[1,"x"]}]}': None,
    '{"data":[{"embedding":[1,true]}]}': None,
    '["a"]': None,
    "[null]": None,
    "3": None,
    "{}": None,
    "oops": None,
}


def test_response_shapes(spark):
    df = spark.createDataFrame([(s,) for s in SHAPES], "response string")
    for r in model_io.parse_embedding_responses(df).collect():
        assert r.vector == SHAPES[r.response], r.response
        assert (r.error is None) == (r.vector is not None)


def test_chat_request(spark):
    df = spark.createDataFrame([('say "hi"\n你',)], "text string")
    body = json.loads(model_io.build_embedding_requests(df, "chat", "m", '{"dimensions": 8}').head().request)
    assert body["messages"][1]["content"] == [{"type": "text", "text": 'say "hi"\n你'}]
    assert [m["role"] for m in body["messages"]] == ["system", "user", "assistant"]
    assert body["parameters"] == {"dimensions": 8} and body["encoding_format"] == "float"
    assert body["continue_final_message"] is True and body["add_special_tokens"] is True
    for params in (None, "", "[1]", "3", "broken"):
        body = json.loads(model_io.build_embedding_requests(df, "unknown", "m", params).head().request)
        assert "parameters" not in body and "messages" in body


def test_image_requests(spark):
    df = spark.createDataFrame([("a.png", bytearray(b"abc"))], "file_path string, content binary")
    chat = json.loads(model_io.build_embedding_requests(df, "chat", "m").head().request)
    assert chat["messages"][1]["content"] == [{"type": "image_url", "image_url": {"url": "data:image/png;base64,YWJj"}}]
    plain = json.loads(model_io.build_embedding_requests(df, "contents", "m").head().request)
    assert plain == {"model": "m", "input": {"contents": [{"image": "data:image/png;base64,YWJj"}]}}


def test_default_embedder():
    import pandas as pd

    e = HashingEmbedder(16)
    a, b, c, d = e.embed_batch(pd.Series(["hello world", "hello world", "hello word", None]))
    assert a == b and a != c and d is None
    assert sum(x * x for x in a) == pytest.approx(1.0, abs=1e-6)
    assert sum(x * y for x, y in zip(a, c)) > 0.5
    assert e.embed_batch(pd.Series([b"\x00\x01"]))[0] is not None
    joined, spaced, blank = e.embed_batch(pd.Series(["helloworld", "hello, world!", " .. "]))
    assert joined == spaced == a and blank is None


def test_a_text_whose_signs_cancel_is_embedded_all_the_same():
    import pandas as pd

    e = HashingEmbedder()
    assert not e.counts("Un").any()  # its two trigrams meet in a bucket with opposite signs
    short, blank, empty, plain = e.embed_batch(pd.Series(["Un.", " .. ", "", "Una"]))
    assert short == [0.0] * 64 and blank is None and empty is None and any(plain)
