"""From file contents to rows of the vector table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skimdex.functions.embed import Embedder, HashingEmbedder, embed_column
from skimdex.functions.paths import base_name
from skimdex.schemas import VECTORS


def embed_texts(df: DataFrame, embedder: Embedder | None = None, text: str = "chunk_text") -> DataFrame:
    """Add ``vector`` and ``error`` for a text column."""
    out = embed_column(embedder or HashingEmbedder(), F.col(text))
    return df.withColumn("_e", out).select(*df.columns, "_e.vector", "_e.error")


def embed_images(files: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Replace ``content`` by ``vector`` and ``error``."""
    out = embed_column(embedder or HashingEmbedder(), F.col("content"))
    rest = [c for c in files.columns if c != "content"]
    return files.withColumn("_e", out).select(*rest, "_e.vector", "_e.error")


def failed_files(embedded: DataFrame) -> DataFrame:
    """Files with at least one failed chunk, with one of the messages."""
    bad = embedded.where(F.col("error").isNotNull())
    return bad.groupBy("file_path").agg(F.min("error").alias("error"))


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def text_index_rows(chunks: DataFrame) -> DataFrame:
    """Index rows of embedded text chunks: file columns, chunk columns and ``vector``."""
    meta = _json(
        F.col("file_path"),
        base_name(F.col("file_path")).alias("file_name"),
        F.lit("text").alias("file_type"),
        F.col("file_size"),
        F.col("modified_at"),
        F.col("chunk_index"),
        F.col("total_chunks"),
        F.col("chunk_text"),
    )
    return chunks.select(
        F.concat("file_path", F.lit("__chunk_"), F.col("chunk_index").cast("string")).alias("id"),
        "file_path",
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.lit("text").alias("file_type"),
        "vector",
        meta.alias("metadata"),
    )


def image_index_rows(images: DataFrame) -> DataFrame:
    """Index rows of embedded images; ``exif`` (struct) and ``thumbnail_path`` are optional."""
    extra = [F.col(c) for c in ("thumbnail_path", "exif") if c in images.columns]
    meta = _json(
        F.col("file_path"),
        base_name(F.col("file_path")).alias("file_name"),
        F.lit("image").alias("file_type"),
        F.col("file_size"),
        F.col("modified_at"),
        F.col("file_hash"),
        F.lit(0).alias("chunk_index"),
        F.lit(1).alias("total_chunks"),
        *extra,
    )
    return images.select(
        F.col("file_hash").alias("id"),
        "file_path",
        F.lit(0).alias("chunk_index"),
        F.lit("image").alias("file_type"),
        "vector",
        meta.alias("metadata"),
    )


def index_rows_from_json(entries: DataFrame) -> DataFrame:
    """Rows (id, vector, metadata JSON) completed from the JSON: path falls back to the id, type to
    ``unknown``."""
    meta = F.from_json("metadata", "file_path string, file_type string, chunk_index int")
    return entries.withColumn("_m", meta).select(
        "id",
        F.coalesce("_m.file_path", "id").alias("file_path"),
        F.coalesce("_m.chunk_index", F.lit(0)).alias("chunk_index"),
        F.coalesce("_m.file_type", F.lit("unknown")).alias("file_type"),
        "vector",
        F.when(F.col("_m").isNull(), "{}").otherwise(F.col("metadata")).alias("metadata"),
    ).select(*VECTORS.names)
