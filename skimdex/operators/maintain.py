"""Listing, filtering, deleting and retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: paging and retention defaults ---
DEFAULT_PAGE_SIZE = 50
RETENTION_HOURS = 24
# --- end of fixed values ---

When = str | dt.datetime | None


def _instant(value: str | dt.datetime) -> Column:
    return F.to_timestamp(F.lit(value)) if isinstance(value, str) else F.lit(value)


def filter_index(
    meta: DataFrame, path: str | None = None, after: When = None, before: When = None
) -> DataFrame:
    """Rows whose path contains ``path`` in any case and whose time lies in [after, before].

    Empty filters do nothing. The text is matched literally, and the time bounds reach the scan.
    """
    out = meta
    if path:
        out = out.where(F.contains(F.lower("file_path"), F.lit(path.lower())))
    if after:
        out = out.where(F.col("indexed_at") >= _instant(after))
    if before:
        out = out.where(F.col("indexed_at") <= _instant(before))
    return out


def list_index(
    meta: DataFrame,
    path: str | None = None,
    after: When = None,
    before: When = None,
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
) -> DataFrame:
    """One page of the filtered listing, newest first, ties by path."""
    size = max(page_size, 1)
    skip = (max(page, 1) - 1) * size
    rows = filter_index(meta, path, after, before)
    return rows.orderBy(F.desc("indexed_at"), "file_path").offset(skip).limit(size)


def count_index(
    meta: DataFrame, path: str | None = None, after: When = None, before: When = None
) -> DataFrame:
    """Number of rows the listing has over all pages."""
    return filter_index(meta, path, after, before).agg(F.count(F.lit(1)).alias("total"))


def count_vectors(vectors: DataFrame) -> DataFrame:
    """Number of rows in the vector table."""
    return vectors.agg(F.count(F.lit(1)).alias("n_vectors"))


def iso_millis(ts: Column) -> Column:
    """Index time as ISO-8601 text with milliseconds, UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def delete_by_paths(table: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows that stay after deleting the paths; no literal lists, so any number and any character.

    The path side is reduced to distinct values first; Spark ships it when it is small and otherwise
    shuffles, where adaptive execution splits a path that owns very many rows.
    """
    return table.join(paths.select("file_path").distinct(), "file_path", "left_anti")


def delete_summary(table: DataFrame, paths: DataFrame) -> DataFrame:
    """``deleted`` counts the requested paths, ``matched`` the rows they remove."""
    hit = table.join(paths.select("file_path").distinct(), "file_path", "left_semi")
    asked = paths.select(F.lit(1).alias("deleted"), F.lit(0).alias("matched"))
    found = hit.select(F.lit(0).alias("deleted"), F.lit(1).alias("matched"))
    counts = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("deleted", "matched")]
    return asked.unionByName(found).agg(*counts)


def prune_versions(
    versions: DataFrame, retention_hours: int = RETENTION_HOURS, now: Column | None = None
) -> DataFrame:
    """Versions to drop: older than the retention and not current."""
    now = F.current_timestamp() if now is None else now
    cut = now - F.make_dt_interval(hours=F.lit(retention_hours))
    return versions.where((F.col("created_at") < cut) & ~F.col("is_current"))
