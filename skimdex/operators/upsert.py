"""Row-level merge rules for vectors and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(updates: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the one with the greatest ``order``.

    A plain aggregate: rows of a key are combined before the shuffle, so a key that owns a large
    share of the updates does not end up in one task.
    """
    rest = [c for c in updates.columns if c not in keys]
    best = F.max_by(F.struct(*rest), order).alias("b")
    return updates.groupBy(*keys).agg(best).select(
        *[F.col(c) if c in keys else F.col(f"b.{c}") for c in updates.columns]
    )


def upsert_vectors(target: DataFrame, updates: DataFrame, mode: str = "by_path") -> DataFrame:
    """Target after merging: ``by_path`` replaces whole files, ``by_id`` single rows."""
    if mode not in ("by_path", "by_id"):
        raise ValueError(f"unknown mode {mode!r}")
    key = "file_path" if mode == "by_path" else "id"
    if mode == "by_id":  # a row that is updated twice is written once
        updates = latest(updates, ["id"], F.struct(*[c for c in updates.columns if c != "id"]))
    kept = target.join(updates.select(key).distinct(), key, "left_anti")
    return kept.select(*target.columns).unionByName(updates.select(*target.columns))


def written_gate(updates: DataFrame, written: DataFrame) -> DataFrame:
    """Files that may be marked as indexed: those whose vectors were written."""
    return updates.join(written.select("file_path").distinct(), "file_path", "left_semi")


def upsert_meta(meta: DataFrame, updates: DataFrame, written: DataFrame) -> DataFrame:
    """Metadata after insert-or-replace of the files that were written; one shuffle by path."""
    accepted = written_gate(updates, written).select(*meta.columns)
    both = meta.withColumn("_fresh", F.lit(0)).unionByName(accepted.withColumn("_fresh", F.lit(1)))
    return latest(both, ["file_path"], F.col("_fresh")).select(*meta.columns)
