"""The index build: scan result in, both tables updated."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimdex.functions.embed import Embedder, HashingEmbedder
from skimdex.functions.paths import file_type
from skimdex.functions.text import CHUNK_OVERLAP, CHUNK_SIZE
from skimdex.operators.chunk import chunk_documents
from skimdex.operators.diff import incremental_files, index_summary, indexed_files_report, snapshot_diff
from skimdex.operators.index_rows import (
    embed_images,
    embed_texts,
    failed_files,
    image_index_rows,
    text_index_rows,
)
from skimdex.operators.media import exif_fields
from skimdex.operators.upsert import latest
from skimdex.plans.coarse import CoarseIndex
from skimdex.schemas import EXIF
from skimdex.session import spread
from skimdex.sources.files import read_text_docs
from skimdex.sources.tables import IndexStore

PHASES = ("scanning", "comparing", "processing", "cleanup", "indexing", "optimizing")


@dataclass
class IndexOptions:
    """Knobs of a build. ``cells`` also extends the store's coarse index, ``compact`` folds generations.

    ``tags`` (file_path, tags as JSON) gives image rows their EXIF fields; ``thumbnails`` is the folder
    in which a thumbnail is named after its file's hash.
    """

    embedder: Embedder = field(default_factory=HashingEmbedder)
    image_embedder: Embedder = field(default_factory=HashingEmbedder)
    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    sep: str = ""
    scope: str | None = None
    cells: int | None = None
    compact: bool = False
    target_files: int | None = None
    now: dt.datetime | None = None
    tags: DataFrame | None = None
    thumbnails: str | None = None


@dataclass
class IndexRun:
    """Tables a build leaves behind for reports; all are read lazily."""

    spark: SparkSession
    path: str

    @property
    def diff(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/diff")

    @property
    def errors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/errors")

    @property
    def text_chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/text")

    @property
    def images(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/images")

    def summary(self) -> DataFrame:
        return index_summary(self.diff, self.errors)

    def report(self, files: DataFrame, per: str = "file") -> DataFrame:
        """Processed text files with size, time and hash and their chunks; failed files are left out."""
        chunks = self.text_chunks.join(self.errors.select("file_path"), "file_path", "left_anti")
        return indexed_files_report(chunks, files, per)

    def progress(self) -> DataFrame:
        """Job events of the finished run, one row per phase."""
        counts = self.summary()
        todo = F.col("new_count") + F.col("modified_count")
        steps = {
            "scanning": F.col("total"),
            "comparing": F.lit(1),
            "processing": todo,
            "cleanup": F.col("deleted_count"),
            "indexing": todo + F.col("deleted_count"),
            "optimizing": F.lit(1),
        }
        events = [
            F.struct(F.lit(p).alias("phase"), steps[p].cast("int").alias("current")) for p in PHASES
        ]
        return counts.select(F.inline(F.array(*events))).select(
            F.lit(self.path).alias("job_id"), "phase", "current", F.col("current").alias("total")
        )


def _process(run: IndexRun, todo: DataFrame, options: IndexOptions) -> None:
    """Embed the changed files; vectors and errors are written down before anything is merged."""
    kind = file_type(F.col("file_path"))
    plain = "text" in todo.columns
    texts = todo.where(kind == "text")
    docs = texts.withColumn("error", F.lit(None).cast("string")) if plain else read_text_docs(texts)
    chunks = chunk_documents(
        spread(docs.withColumnRenamed("error", "read_error")),
        options.chunk_size,
        options.chunk_overlap,
        options.sep,
        keep_unread=True,
    )
    embedded = embed_texts(chunks, options.embedder)
    embedded = embedded.withColumn("error", F.coalesce("read_error", "error")).drop("read_error")
    embedded.write.mode("overwrite").parquet(f"{run.path}/text")
    errors = failed_files(run.text_chunks)
    if plain:  # a text table has nothing to read for other types; they are not indexed
        others = todo.where(kind != "text").select("file_path", F.lit("no content for this file type").alias("error"))
        errors = errors.unionByName(others)
    else:
        pictures = _described(embed_images(todo.where(kind == "image"), options.image_embedder), options)
        pictures.write.mode("overwrite").parquet(f"{run.path}/images")
        errors = errors.unionByName(failed_files(run.images))
    errors.write.mode("overwrite").parquet(f"{run.path}/errors")


def _described(pictures: DataFrame, options: IndexOptions) -> DataFrame:
    """Add ``thumbnail_path`` and ``exif`` as far as the options give them; of repeated tags the smallest count."""
    if options.thumbnails:
        name = F.concat(F.lit(options.thumbnails.rstrip("/") + "/"), "file_hash", F.lit(".webp"))
        pictures = pictures.withColumn("thumbnail_path", name)
    if options.tags is not None:
        once = options.tags.groupBy("file_path").agg(F.min("tags").alias("tags"))
        exif = exif_fields(once).select("file_path", F.struct(*EXIF.names).alias("exif"))
        pictures = pictures.join(exif, "file_path", "left")
    return pictures


def _mark(store: IndexStore, run: IndexRun) -> str:
    """Name of what a run is about to merge: which changes, on top of which metadata.

    A run that died between the two tables finds the same metadata and the same changes again and
    goes on with the second table. Any other run has another mark, whatever its tag is.
    """
    changes = run.diff.where("change_type <> 'unchanged'").join(run.errors.select("file_path"), "file_path", "left_anti")
    total = F.sum(F.xxhash64(*run.diff.columns).cast("decimal(38,0)"))
    row = changes.agg(F.count("*").alias("n"), total.alias("x")).head()
    return f"{store.meta.state().gen}:{row.n}:{row.x}"


def _merge(store: IndexStore, run: IndexRun, options: IndexOptions, plain: bool) -> None:
    """Replace the rows of changed files and drop deleted ones; vectors first, metadata second."""
    mark = _mark(store, run)
    bad = run.errors.select("file_path")
    changed = incremental_files(run.diff).select("file_path", "new_hash", "change_type")
    done = changed.join(bad, "file_path", "left_anti")
    deleted = run.diff.where(F.col("change_type") == "deleted").select("file_path")

    rows = text_index_rows(run.text_chunks.join(bad, "file_path", "left_anti"))
    if not plain:
        rows = rows.unionByName(image_index_rows(run.images.join(bad, "file_path", "left_anti")))
    live = store.vectors.read()
    if store.vectors.key == "file_path":
        replaced = done.where("change_type = 'modified'").select("file_path").unionByName(deleted)
        if store.vectors.last_tag() != store.meta.last_tag():
            # the last write reached one table only: new files may have rows already
            fresh = done.where("change_type = 'new'").select("file_path")
            replaced = replaced.unionByName(fresh.join(live.select("file_path").distinct(), "file_path", "left_semi"))
    else:
        rows = latest(rows, ["id"], F.col("file_path"))
        gone = live.join(deleted, "file_path", "left_semi").select("id")
        replaced = rows.select("id").unionByName(gone)
    if not store.vectors.committed(mark):
        store.vectors.upsert(rows, replaced, mark, one_width=True)

    stamp = F.lit(options.now) if options.now else F.current_timestamp()
    entries = done.select(
        "file_path", F.col("new_hash").alias("file_hash"), stamp.alias("indexed_at")
    )
    old = done.where("change_type = 'modified'").select("file_path")
    store.meta.upsert(entries, old.unionByName(deleted), mark)


def incremental_index_job(
    store: IndexStore, files: DataFrame, options: IndexOptions | None = None, tag: str = ""
) -> IndexRun:
    """Bring the index in line with ``files``.

    ``files`` holds each path once: file_path, file_size, modified_at, file_hash and either
    ``content`` (bytes) or ``text``. Only changed files are chunked and embedded. A file
    with any error keeps its old rows and stays on the work list of the next run. Every step writes
    its result before the next one starts, so a repeated run after a crash only repeats work. ``tag``
    only names the run's folder; it may be used again.
    """
    options = options or IndexOptions()
    run = _new_run(store, tag)
    plain = "text" in files.columns
    seen = files.select("file_path", "modified_at", "file_hash").where(
        file_type(F.col("file_path")).isNotNull()
    )
    diff = snapshot_diff(seen, store.meta.read(), options.scope)
    return _run(store, run, files, diff, options, plain)


def _new_run(store: IndexStore, tag: str) -> IndexRun:
    name = uuid.uuid4().hex
    return IndexRun(store.spark, f"{store.root}/runs/{tag}-{name}" if tag else f"{store.root}/runs/{name}")


def _work_list(files: DataFrame, diff: DataFrame, same: int, changed: int) -> DataFrame:
    """Rows of ``files`` to process, bodies included.

    A first build takes all rows without a join; otherwise the shorter list of paths, changed or
    unchanged, meets the files, so that it rather than the bodies travels wherever one of them is short.
    """
    files = files.where(file_type(F.col("file_path")).isNotNull())
    if not changed:
        return files.limit(0)
    if not same:
        return files
    if same < changed:
        return files.join(diff.where("change_type = 'unchanged'").select("file_path"), "file_path", "left_anti")
    return files.join(incremental_files(diff).select("file_path"), "file_path", "left_semi")


def _run(store, run, files, diff, options, plain) -> IndexRun:
    diff.write.mode("overwrite").parquet(f"{run.path}/diff")
    kind = F.col("change_type")
    n = run.diff.agg(
        F.count_if(kind == "unchanged").alias("same"), F.count_if(kind.isin("new", "modified")).alias("changed"),
        F.count_if(kind == "deleted").alias("gone"),
    ).head()
    busy = n.changed + n.gone > 0
    _process(run, _work_list(files, run.diff, n.same, n.changed), options)
    if busy:
        _merge(store, run, options, plain)
    if options.compact:
        store.optimize(options.target_files)
    if options.cells:
        CoarseIndex(store).refresh(options.cells)
    return run


def index_arrivals(
    store: IndexStore, files: DataFrame, options: IndexOptions | None = None, tag: str = ""
) -> IndexRun:
    """Like ``incremental_index_job`` for a batch of arrived files: nothing counts as deleted.

    A batch that is in the index already is unchanged against it, so a replay writes nothing.
    """
    options = options or IndexOptions()
    run = _new_run(store, tag)
    newest = files
    if not files.groupBy("file_path").count().where("count > 1").isEmpty():  # bodies are only merged where paths repeat
        newest = latest(files, ["file_path"], F.struct("modified_at", "file_hash"))
    seen = newest.select("file_path", "modified_at", "file_hash").where(
        file_type(F.col("file_path")).isNotNull()
    )
    known = store.meta.read().join(seen.select("file_path"), "file_path", "left_semi")
    diff = snapshot_diff(seen, known)
    return _run(store, run, newest, diff, options, "text" in files.columns)
