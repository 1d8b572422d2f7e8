"""Indexing folders without opening files that did not change.

A store keeps the listing of its last build: size, time and hash of every file. A file that is listed
with the same size and time again, and whose hash is the one indexed, is not opened. All others are
opened once; hash and body come from the same read and are written next to each other, and the build
reads that table instead of the files.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimdex.functions.paths import content_hash
from skimdex.plans.jobs import IndexOptions, IndexRun, incremental_index_job
from skimdex.sources.files import list_files
from skimdex.sources.readers import TASK_BYTES, read_bodies
from skimdex.sources.tables import IndexStore, IndexTable

LISTING = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("modified_at", T.LongType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("listed_at", T.LongType()),
    ]
)
#: a file written this many seconds before it was listed, or later, may have been written again
#: within the same second, so its time proves nothing
SETTLED_SECONDS = 2


def listing(store: IndexStore) -> IndexTable:
    """The files a store has seen, by path."""
    return IndexTable(store.spark, f"{store.root}/listing", LISTING, "file_path")


def split_listing(now: DataFrame, seen: DataFrame, indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unchanged files with their hash, files to open) of a listing.

    ``seen`` is the earlier listing and ``indexed`` the metadata of the index: a file that was seen but
    not indexed, such as one whose embedding failed, is opened again.
    """
    settled = seen.where(F.col("modified_at") < F.col("listed_at") - SETTLED_SECONDS)
    known = settled.join(indexed.select("file_path", "file_hash"), ["file_path", "file_hash"], "left_semi")
    same = now.join(known.drop("listed_at"), ["file_path", "file_size", "modified_at"], "left")
    return same.where("file_hash IS NOT NULL"), same.where("file_hash IS NULL").drop("file_hash")


def index_folders(
    store: IndexStore, folders: list[str], options: IndexOptions | None = None, tag: str = "", task_bytes: int = TASK_BYTES
) -> IndexRun:
    """``incremental_index_job`` over the files under ``folders``, opening only what changed.

    The listing is written last: a build that dies opens its files again and finds them unchanged by
    their hashes.
    """
    spark, seen = store.spark, listing(store)
    base = f"{store.root}/opened/{uuid.uuid4().hex}"
    started = int(time.time())
    list_files(spark, folders).write.parquet(f"{base}/list")
    now = spark.read.parquet(f"{base}/list")
    same, due = split_listing(now, seen.read(), store.meta.read())
    bodies = read_bodies(due, task_bytes)
    bodies.withColumn("file_hash", content_hash(F.col("content"))).write.parquet(f"{base}/bodies")
    opened = spark.read.parquet(f"{base}/bodies")
    columns = ["file_path", "file_size", "modified_at", "file_hash"]
    files = opened.select(*columns, "content").unionByName(same.select(*columns, F.lit(None).cast("binary").alias("content")))
    run = incremental_index_job(store, files, options, tag)
    fresh = opened.select(*columns, F.lit(started).cast("long").alias("listed_at"))
    gone = seen.read().join(now, "file_path", "left_anti").select("file_path")
    if options is not None and options.scope:
        gone = gone.where(F.col("file_path").startswith(options.scope))
    if not (fresh.isEmpty() and gone.isEmpty()):
        seen.upsert(fresh, fresh.select("file_path").unionByName(gone))
    return run
