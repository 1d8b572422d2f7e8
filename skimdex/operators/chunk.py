"""Splitting documents into overlapping, token-bounded chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skimdex.functions.text import BYTE_UNITS, CHUNK_OVERLAP, CHUNK_SIZE, CJK, UNITS_PER_TOKEN, WORD_PATTERN

#: chunks handed back to Spark at a time, which bounds the output batch of a very long document
FLUSH_CHUNKS = 1024
#: texts that are Python strings at a time
TEXTS = 64


def word_tokens(words: list[str], plain: bool = False) -> np.ndarray:
    """Token estimate of every word, in double precision; ``plain`` promises no ideographs."""
    sizes = np.fromiter(map(len, map(str.encode, words)), dtype=np.float64, count=len(words))
    tokens = sizes * (BYTE_UNITS / UNITS_PER_TOKEN)
    if not plain:
        ideograph = re.compile(f"[{CJK}]").match
        tokens[[i for i, w in enumerate(words) if ideograph(w)]] = 1.0 / 1.5
    return tokens


def chunk_spans(tokens: np.ndarray, size: float, overlap: float) -> Iterator[tuple[int, int]]:
    """Word ranges [start, end) of the chunks.

    A chunk takes words while their running sum stays within ``size`` (one word always fits). The
    next one starts at the nearest earlier word from which the tail covers ``overlap``; if only the
    chunk's own start would do, it starts where the chunk ended. Sums are accumulated in word order
    from the chunk's edge, so the ends fall where a sequential double sum puts them.
    """
    n, start, reach = len(tokens), 0, 64
    while start < n:
        while True:
            sums = np.cumsum(tokens[start : start + reach])
            fitting = int(np.searchsorted(sums, size, side="right"))
            if fitting < len(sums) or start + reach >= n:
                break
            reach *= 2
        end = start + max(fitting, 1)
        yield start, end
        if end >= n:
            return
        start = _restart(tokens, start, end, overlap)


def _restart(tokens: np.ndarray, start: int, end: int, overlap: float) -> int:
    if overlap <= 0:
        return end
    tail = np.cumsum(tokens[start:end][::-1])
    steps = int(np.searchsorted(tail, overlap, side="left")) + 1
    return end - steps if end - steps > start else end


def chunk_documents(
    docs: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    sep: str = "",
    text: str = "text",
    keep_unread: bool = False,
) -> DataFrame:
    """One row per chunk: the input columns without the text, chunk_index, total_chunks, chunk_text.

    Words of a chunk are joined with ``sep``. Documents are independent, so this needs no shuffle;
    a document without words yields no row. With ``keep_unread`` a null text yields one row with
    null chunk columns, so that its error is not lost.
    """
    keep = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in keep]
    last = [pa.int32(), pa.int32(), pa.string()]
    schema = T.StructType(
        [
            *keep,
            T.StructField("chunk_index", T.IntegerType()),
            T.StructField("total_chunks", T.IntegerType()),
            T.StructField("chunk_text", T.StringType()),
        ]
    )
    columns = [f.name for f in schema.fields]

    def table(part: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        """Chunks as (row of ``part``, chunk_index, total_chunks, chunk_text)."""
        at, *made = zip(*out)
        kept = part.select(names).take(pa.array(at, pa.int32()))
        return pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, made, last)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, ideograph = re.compile(WORD_PATTERN), re.compile(f"[{CJK}]")
        for part in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            out: list[tuple] = []
            for row, body in enumerate(part.column(text)):
                body = body.as_py()
                if body is None and keep_unread:
                    out.append((row, None, None, None))
                    continue
                words = pattern.findall(body) if body else []
                if not words:
                    continue
                tokens = word_tokens(words, plain=ideograph.search(body) is None)
                spans = list(chunk_spans(tokens, size, overlap))
                for i, (lo, hi) in enumerate(spans):
                    out.append((row, i, len(spans), sep.join(words[lo:hi])))
                    if len(out) >= FLUSH_CHUNKS:
                        yield table(part, out)
                        out = []
            if out:
                yield table(part, out)

    return docs.mapInArrow(run, schema)
