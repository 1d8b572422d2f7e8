"""File scans: folders to tables of paths, hashes, texts and image sizes."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimdex.functions.paths import IMAGE_EXTENSIONS, TEXT_EXTENSIONS, content_hash, file_type
from skimdex.session import empty, path_is_missing
from skimdex.sources import readers

#: columns of Spark's ``binaryFile`` source
BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def _any_case(ext: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def _glob(extensions: tuple[str, ...]) -> str:
    return "{" + ",".join(f"*.{_any_case(e)}" for e in extensions) + "}"


def _outer_roots(folders: list[str]) -> list[str]:
    """Drop folders that lie inside another one, so overlapping roots list a file once."""
    roots = sorted({f.rstrip("/") for f in folders})
    return [r for r in roots if not any(r != o and r.startswith(o + "/") for o in roots)]


def load_files(
    spark: SparkSession,
    folders: list[str],
    extensions: tuple[str, ...] = IMAGE_EXTENSIONS + TEXT_EXTENSIONS,
) -> DataFrame:
    """Files under the folders: file_path, file_size, modified_at, content.

    The extension test runs while listing, so other files are never opened; ``content`` is only
    read by queries that use it. Missing folders and files that vanish are skipped; a file that cannot
    be read fails the scan, so it never looks deleted. Spark's file sources never list empty files and
    names starting with ``_`` or ``.``.
    """
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _glob(extensions))
        .option("ignoreMissingFiles", "true")
    )
    found = None
    for root in _outer_roots(folders):
        try:
            part = reader.load(root)
        except AnalysisException as problem:
            if not path_is_missing(problem):
                raise
            continue
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = empty(spark, BINARY_FILE)
    return _named(found)


def _named(found: DataFrame) -> DataFrame:
    return found.select(
        F.regexp_replace("path", "^file:/*", "/").alias("file_path"),
        F.col("length").alias("file_size"),
        F.coalesce(F.unix_seconds("modificationTime"), F.lit(0)).alias("modified_at"),
        "content",
    )


def stream_files(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Stream of indexable files arriving in a folder, with ``file_hash``.

    A stream reports a path once; later edits of the same path are found by the batch job.
    """
    reader = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _glob(IMAGE_EXTENSIONS + TEXT_EXTENSIONS))
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _named(reader.load(folder)).withColumn("file_hash", content_hash(F.col("content")))


def _roots(spark: SparkSession, folders: list[str]) -> tuple[list[str], list[str]]:
    """The folders that tasks can list, globs resolved, and the other roots: single files and other schemes."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    ours, others = [], []
    for root in _outer_roots(folders):
        if not root:  # the root of a file system
            others.append("/")
            continue
        files = path_of(root).getFileSystem(conf)
        found = files.globStatus(files.makeQualified(path_of(root))) or []
        if files.getUri().getScheme() in readers.SCHEMES and all(f.isDirectory() for f in found):
            ours += [re.sub("^file:/*", "/", f.getPath().toString()) for f in found]
        else:
            others.append(root)
    return _outer_roots(ours), others


def list_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(file_path, file_size, modified_at) of the indexable files, listed by tasks; none is opened.

    Stores that only Spark reaches are listed by its driver.
    """
    ours, others = _roots(spark, folders)
    extensions = IMAGE_EXTENSIONS + TEXT_EXTENSIONS
    files = load_files(spark, others, extensions).select("file_path", "file_size", "modified_at")
    if ours:
        files = files.unionByName(readers.list_tree(spark.createDataFrame([(r,) for r in ours], "path string"), extensions))
    return files.where(file_type(F.col("file_path")).isNotNull())


def scan_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Snapshot of the indexable files: path, size, modification second, content hash.

    Files are listed and read by tasks; stores that only Spark reaches are listed by its driver.
    """
    ours, others = _roots(spark, folders)
    files = load_files(spark, others).where(file_type(F.col("file_path")).isNotNull())
    files = files.select("file_path", "file_size", "modified_at", content_hash(F.col("content")).alias("file_hash"))
    return files.unionByName(readers.hash_files(list_files(spark, ours))) if ours else files


def read_text_docs(files: DataFrame) -> DataFrame:
    """Decode ``content`` as strict UTF-8; a bad file keeps a null text and an error."""
    raw = F.col("content")
    ok = F.is_valid_utf8(raw.cast("string"))
    return files.select(
        *[c for c in files.columns if c != "content"],
        F.when(ok, raw.cast("string")).alias("text"),
        F.when(~ok, "invalid UTF-8").alias("error"),
    )


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """Width, height and channels of standard image formats; undecodable files have ``ok`` false."""
    images = (
        spark.read.format("image")
        .option("dropInvalid", False)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _glob(IMAGE_EXTENSIONS))
        .load(path)
    )
    valid = F.col("image.width") > 0
    return images.select(
        F.regexp_replace("image.origin", "^file:/*", "/").alias("origin"),
        F.when(valid, F.col("image.width")).alias("width"),
        F.when(valid, F.col("image.height")).alias("height"),
        F.when(valid, F.col("image.nChannels")).alias("channels"),
        valid.alias("ok"),
    )
