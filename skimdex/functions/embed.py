"""Pluggable embedders.

An embedder has a ``dim`` and ``embed_batch(values) -> list of vectors``; it is pickled into the
tasks, so a model client belongs into a lazily created attribute. ``None`` marks a failed item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimdex.functions.text import DELIMITER_PATTERN

EMBEDDING = T.StructType(
    [
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("error", T.StringType()),
    ]
)


class Embedder(Protocol):
    dim: int

    def embed_batch(self, values: pd.Series) -> Sequence[Sequence[float] | None]: ...


class HashingEmbedder:
    """Offline default: signed hashing of trigrams over characters (text) or bytes (images).

    Texts are hashed without white space and punctuation, so a chunk of joined words and the same
    words in a query agree, in any script. Equal input gives equal vectors; inputs sharing many
    trigrams are close. Where the signs of a short text cancel, its vector is zero: it is embedded, and
    never matches. Only a value without any trigram has none.
    """

    MULTIPLIER = 2654435761  # odd constant near 2**32 / golden ratio
    BASE = 31
    SLICE = 1 << 20  # characters hashed at once

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _codes(self, value: str | bytes) -> np.ndarray:
        if isinstance(value, str):
            packed = re.sub(DELIMITER_PATTERN, "", value)
            return np.frombuffer(f" {packed} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return np.frombuffer(b" " + bytes(value) + b" ", dtype=np.uint8)

    def _counts(self, parts: list[np.ndarray]) -> np.ndarray:
        """Signed trigram counts, one row per code array; trigrams across two arrays do not count."""
        codes = np.concatenate(parts).astype(np.int64)
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        gram = (codes[:-2] * self.BASE + codes[1:-1]) * self.BASE + codes[2:]
        whole = row[:-2] == row[2:]
        mixed = (gram[whole] * self.MULTIPLIER) % (1 << 32)
        bucket = row[:-2][whole] * self.dim + (mixed >> 16) % self.dim
        sign = np.where((mixed >> 8) & 1, 1.0, -1.0)
        return np.bincount(bucket, weights=sign, minlength=len(parts) * self.dim).reshape(-1, self.dim)

    def counts(self, value: str | bytes) -> np.ndarray:
        """Signed trigram counts per bucket."""
        return self._counts([self._codes(value)])[0]

    def embed_batch(self, values: pd.Series) -> list[list[float] | None]:
        out: list[list[float] | None] = [None] * len(values)
        parts: list[np.ndarray] = []
        at: list[int] = []

        def flush() -> None:
            if parts:
                counts = self._counts(parts)
                norms = np.sqrt(np.einsum("ij,ij->i", counts, counts))
                units = (counts / np.where(norms > 0.0, norms, 1.0)[:, None]).astype(np.float32).tolist()
                for i, unit, part in zip(at, units, parts):
                    out[i] = unit if len(part) > 2 else None
            parts.clear()
            at.clear()

        held = 0
        for i, value in enumerate(values):
            if value is None:
                continue
            parts.append(self._codes(value))
            at.append(i)
            held += len(parts[-1])
            if held >= self.SLICE:
                flush()
                held = 0
        flush()
        return out


def embed_column(embedder: Embedder, value: Column) -> Column:
    """Struct ``vector, error`` of a text or binary column.

    A batch that raises is repeated item by item, so one bad item fails alone.
    """

    def one_by_one(values: pd.Series) -> Iterator[tuple]:
        for i in range(len(values)):
            try:
                yield embedder.embed_batch(values.iloc[i : i + 1])[0], None
            except Exception as problem:  # the model's failure becomes this row's error
                yield None, str(problem) or type(problem).__name__

    def run(column: pa.Array) -> pa.Array:
        values = column.to_pandas()
        try:
            pairs = [(v, None) for v in embedder.embed_batch(values)]
        except Exception:
            pairs = list(one_by_one(values))
        blank = np.zeros(0, np.float32)
        rows = [blank if v is None else np.asarray(v, dtype=np.float32) for v, _ in pairs]
        missing = pa.array([v is None for v, _ in pairs], pa.bool_())
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        flat = pa.array(np.concatenate([blank, *rows]), pa.float32())
        vectors = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=missing)
        errors = pa.array([e or ("no embedding" if v is None else None) for v, e in pairs], pa.string())
        return pa.StructArray.from_arrays([vectors, errors], ["vector", "error"])

    return F.arrow_udf(run, EMBEDDING)(value)
