"""Inputs of the registered queries, derived from whole tables."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimdex.session import spread

#: query vector of the single-query searches, a fixed parameter
QUERY = [((37 * i + 11) % 64 - 31.5) / 32 for i in range(64)]
QUERY_TEXT = "the retention of entire heard than other thing"
#: extensions handed out to documents in turn; the last is "no extension"
EXTENSIONS = ["jpg", "JPEG", "png", "gif", "bmp", "webp", "HEIC", "heif", "txt", "MD", "tiff", "pdf", ""]
INDEXED_AT = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vector table: five chunks per file."""
    return table(spark, sf, "embeddings").selectExpr(
        "concat('v', vec_id) AS id",
        "concat('f', vec_id div 5) AS file_path",
        "cast(vec_id % 5 AS int) AS chunk_index",
        "embedding AS vector",
        "label",
        "vec_id",
    )


def vector_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Vector table with metadata; a row's chunk text is the document of the same number."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    meta = """to_json(named_struct(
        'file_path', file_path, 'file_name', concat(file_path, '.txt'), 'file_type', 'text',
        'file_size', cast(label * 1000 AS bigint), 'chunk_index', chunk_index, 'chunk_text', text))"""
    return (
        vectors(spark, sf)
        .join(docs, "vec_id", "left")
        .selectExpr("id", "file_path", "chunk_index", "'text' AS file_type", "vector", f"{meta} AS metadata")
    )


def current_files(spark: SparkSession, sf: str) -> DataFrame:
    """The scan: every document is a text file."""
    return table(spark, sf, "documents").selectExpr(
        "concat(source, '/', doc_id, '.txt') AS file_path",
        "n_chars AS file_size",
        "doc_id AS modified_at",
        "sha2(text, 256) AS file_hash",
        "text",
    )


def earlier_files(spark: SparkSession, sf: str) -> DataFrame:
    """What was indexed before: labelled documents, some in an older wording, and all pages."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    docs = docs.selectExpr(
        "concat(source, '/', doc_id, '.txt') AS file_path",
        "n_chars AS file_size",
        "doc_id AS modified_at",
        "if(quality = 0 OR toxic = 1, concat(text, ' old'), text) AS text",
    )
    pages = table(spark, sf, "pages").selectExpr(
        "concat('web/', page_id, '.txt') AS file_path",
        "cast(length(html) AS bigint) AS file_size",
        "page_id AS modified_at",
        "html AS text",
    )
    return docs.unionByName(pages).withColumn("file_hash", F.sha2("text", 256))


def meta(spark: SparkSession, sf: str) -> DataFrame:
    return earlier_files(spark, sf).select(
        "file_path",
        "file_hash",
        F.timestamp_seconds(F.lit(1704067200) + F.col("modified_at")).alias("indexed_at"),
    )


def labelled_paths(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return docs.selectExpr("concat(source, '/', doc_id, '.txt') AS file_path")


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """A large index listing: every event is an indexed file."""
    return table(spark, sf, "events").selectExpr(
        "concat(event_type, '/', user_id, '/', event_id, '.md') AS file_path",
        "sha2(props, 256) AS file_hash",
        "cast(ts AS timestamp) AS indexed_at",
    )


def unwanted_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Deletion request: all error events, and the pages, which the listing does not hold."""
    errors = table(spark, sf, "events").where("event_type = 'error'")
    errors = errors.selectExpr("concat(event_type, '/', user_id, '/', event_id, '.md') AS file_path")
    return errors.unionByName(table(spark, sf, "pages").selectExpr("url AS file_path"))


def mixed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of many types and sizes, with image dimensions."""
    names = F.array(*[F.lit(f".{e}" if e else "") for e in EXTENSIONS])
    ext = F.element_at(names, (F.col("doc_id") % len(EXTENSIONS)).cast("int") + 1)
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("file_path"),
        (F.col("n_chars") * F.col("n_chars") * 61).alias("file_size"),
        F.col("doc_id").alias("modified_at"),
        (F.col("n_chars") % 4000 + 1).cast("int").alias("width"),
        (F.col("n_chars") * 7 % 3000 + 1).cast("int").alias("height"),
        "text",
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as chunked text files, one turn per chunk."""
    return table(spark, sf, "conversations").selectExpr(
        "concat('f', conv_id + 50) AS file_path",
        "cast(turn AS int) AS chunk_index",
        "concat('f', conv_id + 50, '__chunk_', turn) AS id",
        "text AS chunk_text",
        "array(cast(length(text) AS float), cast(turn AS float)) AS vector",
        "role",
    )


def artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Cached previews of documents and pages, and files of another type."""
    docs = table(spark, sf, "documents").selectExpr("concat('cache/', sha2(text, 256), '.webp') AS artifact_path")
    pages = table(spark, sf, "pages").selectExpr("concat('cache/', sha2(html, 256), '.webp') AS artifact_path")
    other = table(spark, sf, "conversations").selectExpr("concat('cache/', sha2(text, 256), '.png') AS artifact_path")
    return docs.unionByName(pages).unionByName(other).distinct()


def label_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Given centroids: the mean vector of every label."""
    per_dim = (
        table(spark, sf, "embeddings")
        .select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
    )
    parts = F.sort_array(F.collect_list(F.struct("pos", "m")))
    return per_dim.groupBy(F.col("label").alias("cell")).agg(
        F.transform(parts, lambda p: p["m"]).alias("centroid")
    )


def write_text_tree(spark: SparkSession, sf: str, root: str) -> str:
    """One folder and ``.txt`` file per document, its text followed by a line break.

    Tasks write the files themselves: Spark's writer would open and commit them one by one, the latter in
    the driver. A file is renamed when it is whole and named after its task and text, whatever the order
    of the rows, so a repeated task leaves the same files.
    """

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        task, written = TaskContext.get().partitionId(), Counter()
        target, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                folder = f"{base}/doc_id={'__HIVE_DEFAULT_PARTITION__' if doc_id is None else doc_id}"
                target.create_dir(folder, recursive=True)
                part = f"{folder}/_{uuid.uuid4().hex}"
                body = f"{text or ''}\n".encode()
                with target.open_output_stream(part) as out:
                    out.write(body)
                name = f"{folder}/{task}-{hashlib.md5(body).hexdigest()}"
                target.move(part, f"{name}-{written[name]}.txt")
                written[name] += 1
            yield batch[["doc_id"]]

    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string"), "text")
    spread(docs).mapInPandas(save, "doc_id string").write.format("noop").mode("overwrite").save()
    return root


def _png(width: int, height: int) -> bytes:
    def block(kind: bytes, data: bytes) -> bytes:
        crc = struct.pack(">I", zlib.crc32(kind + data))
        return struct.pack(">I", len(data)) + kind + data + crc

    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    rows = (b"\0" + b"\x7f" * width) * height
    return b"\x89PNG\r\n\x1a\n" + block(b"IHDR", head) + block(b"IDAT", zlib.compress(rows)) + block(b"IEND", b"")


def write_image_tree(spark: SparkSession, sf: str, root: str) -> str:
    """A PNG per embedding, label+1 wide and 8 high; images of label 0 are damaged."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for vec_id, label in zip(batch["vec_id"], batch["label"]):
                name = f"{base}/{vec_id}.png"
                part = f"{name}.{uuid.uuid4().hex}"
                data = _png(int(label) + 1, 8) if label else b"damaged"
                target.create_dir(base, recursive=True)
                with target.open_output_stream(part) as out:
                    out.write(data)
                target.move(part, name)
            yield batch[["vec_id"]]

    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    rows.mapInPandas(save, "vec_id long").write.format("noop").mode("overwrite").save()
    return root
