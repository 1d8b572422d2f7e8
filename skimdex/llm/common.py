"""Helpers shared by the operators: written intermediate tables and text patterns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skimdex.session import configure, work_dir

#: white space of the text contracts, as a Java class
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: small tables up to this many rows are broadcast; larger ones are shuffled
BROADCAST_ROWS = 200_000
#: tables whose bytes were added up are broadcast up to this size
BROADCAST_BYTES = 32 * 1024 * 1024


def session(df: DataFrame) -> SparkSession:
    return configure(df.sparkSession)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: its lineage ends there."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count finds at most ``rows`` rows, else without."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shippable(df: DataFrame, room: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, written as text, take at most ``room`` bytes; else without.

    A cheap table for which this is asked twice should be stored first.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).head()[0] or 0
    return F.broadcast(df) if size <= room else df


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no group of ``keys`` is cut between two tables.

    A table holds one batch and the rest of a group that began in the one before, so memory is
    bounded by a batch and the largest group.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        last = table.num_rows - 1
        cut = last
        final = [table[k][last].as_py() for k in keys]
        while cut > 0 and [table[k][cut - 1].as_py() for k in keys] == final:
            cut -= 1
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if rest is not None:
        yield rest
