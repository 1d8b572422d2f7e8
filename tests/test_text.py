import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skimdex.functions.text import WORD_PATTERN, estimate_tokens, tokenize_words
from skimdex.operators.chunk import chunk_documents, chunk_spans, word_tokens


def plain_spans(tokens, size, overlap):
    """Straightforward word-by-word statement of the chunk rule."""
    spans, start = [], 0
    while start < len(tokens):
        total, end = 0.0, start
        while end < len(tokens) and (end == start or total + tokens[end] <= size):
            total += tokens[end]
            end += 1
        spans.append((start, end))
        if end == len(tokens):
            break
        covered, back = 0.0, end
        while back > start and covered < overlap:
            back -= 1
            covered += tokens[back]
        start = end if back == start else back
    return spans


words = st.lists(st.sampled_from(["a", "bb", "ccc", "好", "界", "é" * 9, "x" * 40]), max_size=120)


@settings(max_examples=300, deadline=None)
@given(words, st.sampled_from([1, 2, 5, 10, 14, 512]), st.sampled_from([0, 1, 2, 3, 8, 50]))
def test_spans_equal_plain_rule(ws, size, overlap):
    tokens = word_tokens(ws)
    assert list(chunk_spans(tokens, size, overlap)) == plain_spans(tokens.tolist(), size, overlap)


@settings(max_examples=100, deadline=None)
@given(words, st.sampled_from([2, 5, 10]), st.sampled_from([0, 1, 3]))
def test_spans_cover_words_and_respect_size(ws, size, overlap):
    tokens = word_tokens(ws)
    spans = list(chunk_spans(tokens, size, overlap))
    covered = [i for lo, hi in spans for i in range(lo, hi)]
    assert sorted(set(covered)) == list(range(len(ws)))
    assert all(b[0] > a[0] and b[0] <= a[1] for a, b in zip(spans, spans[1:]))
    assert all(tokens[lo:hi].sum() <= size + 1e-9 or hi - lo == 1 for lo, hi in spans)


def test_long_ideograph_text_ends_where_double_sums_end():
    tokens = word_tokens(["好"] * 2000)
    assert list(chunk_spans(tokens, 512, 50)) == plain_spans(tokens.tolist(), 512, 50)


def test_words_of_mixed_text(spark):
    text = "Hello, wörld!好的ok　end x\u0085y z…done [q]{r}"
    row = spark.createDataFrame([(text,)], "text string").select(
        tokenize_words(F.col("text")).alias("w"), estimate_tokens(tokenize_words(F.col("text"))).alias("t")
    ).head()
    expected = ["Hello", "wörld", "好", "的", "ok", "end", "x", "y", "z", "done", "q", "r"]
    assert row.w == expected == re.findall(WORD_PATTERN, text)
    assert abs(row.t - word_tokens(expected).sum()) < 1e-9
    assert np.isclose(row.t, 2 / 1.5 + 0.3 * (5 + 6 + 2 + 3 + 3 + 4 + 2))


def chunks_of(spark, text, size, overlap, sep=""):
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    rows = chunk_documents(docs, size, overlap, sep).orderBy("chunk_index").collect()
    assert all(r.total_chunks == len(rows) for r in rows)
    return [r.chunk_text for r in rows]


def test_texts_without_words_have_no_chunks(spark):
    for text in ("", " \n\t", "...!?", None):
        assert chunks_of(spark, text, 100, 20) == []


def test_english_chunks(spark):
    text = "one two three four five six seven eight"
    # tokens .9 .9 1.5 1.2 1.2 .9 1.5 1.5; five tokens per chunk, at least one of overlap
    assert chunks_of(spark, text, 5, 1) == ["onetwothreefour", "fourfivesixseven", "seveneight"]
    assert chunks_of(spark, text, 5, 0, " ") == ["one two three four", "five six seven", "eight"]


def test_chinese_chunks(spark):
    # fifteen ideographs are ten tokens, three are the overlap
    text = "一二三四五六七八九十甲乙丙丁戊己庚辛壬癸"
    assert chunks_of(spark, text, 10, 2) == ["一二三四五六七八九十甲乙丙丁戊", "丙丁戊己庚辛壬癸"]


def test_long_word_stays_whole(spark):
    assert chunks_of(spark, "a " + "x" * 100 + " b", 3, 1) == ["a", "x" * 100, "b"]


def test_input_columns_are_kept(spark):
    docs = spark.createDataFrame([("p", 7, "hi there")], "file_path string, size long, text string")
    assert chunk_documents(docs).columns == ["file_path", "size", "chunk_index", "total_chunks", "chunk_text"]


def test_chunks_leave_a_task_in_small_batches():
    import pyarrow as pa
    from pyspark.sql import types as T

    class Docs:
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

        def mapInArrow(self, run, schema):
            return run

    texts = [None, "", *["some words of a text " * 400] * 3000, "word " * 300_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    found = list(chunk_documents(Docs())(iter([batch])))
    assert max(b.nbytes for b in found) < 4_000_000
    rows = pa.Table.from_batches(found).to_pylist()
    assert sorted({r["doc_id"] for r in rows}) == list(range(2, len(texts)))
    last = [r for r in rows if r["doc_id"] == len(texts) - 1]
    assert [r["chunk_index"] for r in last] == list(range(last[0]["total_chunks"])) and len(last) > 700
