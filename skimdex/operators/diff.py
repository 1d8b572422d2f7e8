"""What changed between a scan and the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(current: DataFrame, meta: DataFrame, scope: str | None = None) -> DataFrame:
    """file_path, change_type (new, modified, deleted, unchanged), old_hash, new_hash.

    A path scanned twice counts once, with its latest content. With ``scope`` only indexed paths
    under that prefix can turn out deleted, so a scan of one folder leaves the others alone.
    """
    newest = F.max(F.struct("modified_at", "file_hash")).alias("f")
    now = current.groupBy("file_path").agg(newest).select(
        "file_path", F.col("f.file_hash").alias("new_hash"), F.lit(True).alias("_here")
    )
    then = meta.select("file_path", F.col("file_hash").alias("old_hash"), F.lit(True).alias("_known"))
    # presence decides, not the hash: a file that is there without a hash is not deleted
    change = (
        F.when(F.col("_known").isNull(), "new")
        .when(F.col("_here").isNull(), "deleted")
        .when(F.col("old_hash") != F.col("new_hash"), "modified")
        .otherwise("unchanged")
    )
    diff = now.join(then, "file_path", "full_outer").select(
        "file_path", change.alias("change_type"), "old_hash", "new_hash"
    )
    if scope:
        outside = (F.col("change_type") == "deleted") & ~F.startswith("file_path", F.lit(scope))
        diff = diff.where(~outside)
    return diff


def incremental_files(diff: DataFrame) -> DataFrame:
    """The work list: new and modified files."""
    return diff.where(F.col("change_type").isin("new", "modified"))


def index_summary(diff: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row: total scanned, new, modified, deleted and failed files."""
    kinds = diff.select("change_type")
    if errors is not None:
        kinds = kinds.unionByName(errors.select(F.lit("error").alias("change_type")))

    def n(*names: str) -> Column:
        return F.count_if(F.col("change_type").isin(*names))

    return kinds.agg(
        n("new", "modified", "unchanged").alias("total"),
        n("new").alias("new_count"),
        n("modified").alias("modified_count"),
        n("deleted").alias("deleted_count"),
        n("error").alias("error_count"),
    )


def progress_by_phase(job_events: DataFrame) -> DataFrame:
    """Furthest step of every job phase: job_id, phase, current, total, percentage."""
    reached = job_events.groupBy("job_id", "phase").agg(
        F.max("current").alias("current"), F.max("total").alias("total")
    )
    share = F.floor(F.col("current") * 100 / F.nullif(F.col("total"), F.lit(0)))
    return reached.withColumn("percentage", F.coalesce(share, F.lit(0)).cast("int"))


def indexed_files_report(chunks: DataFrame, files: DataFrame, per: str = "chunk") -> DataFrame:
    """Processed files with size, time and hash; one row per chunk, or per file with its count."""
    listed = files.select("file_path", "file_size", "modified_at", "file_hash")
    if per == "chunk":
        return chunks.select("file_path", "chunk_index").join(listed, "file_path")
    if per != "file":
        raise ValueError(f"per must be 'chunk' or 'file', not {per!r}")
    counted = chunks.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_chunks"))
    return counted.join(listed, "file_path")
