"""Similarity search over a vector table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimdex.functions.vectors import distance_to_score, similarity_band, similarity_percent
from skimdex.operators.scoring import COSINE_DECIMALS, partition_topk, payload_schema, score_rows
from skimdex.schemas import METADATA

# --- fixed values: page size and preview length ---
DEFAULT_LIMIT = 50
PREVIEW_CHARS = 200
# --- end of fixed values ---

#: hits of a page that may pass through the driver
PAGE_ROWS = 1000
#: columns a hit carries next to its score; everything else is fetched for the winners only
HIT_COLUMNS = ("id", "file_path", "chunk_index")


def nearest_first() -> list[Column]:
    """Sort keys of hits: distance at ranking precision, then id; equal images share an id, so path."""
    return [F.round("distance", COSINE_DECIMALS), F.col("id"), F.col("file_path")]


def _narrow(vectors: DataFrame) -> DataFrame:
    return vectors.select(*[c for c in HIT_COLUMNS if c in vectors.columns], "vector")


def _with_score(hits: DataFrame, cosine: str) -> DataFrame:
    return hits.withColumn("distance", 1.0 - F.col(cosine)).withColumn(
        "score", distance_to_score(F.col("distance"))
    )


def search_topk(vectors: DataFrame, query: list[float], k: int = DEFAULT_LIMIT) -> DataFrame:
    """The ``k`` nearest rows by cosine: id, file_path, chunk_index, distance, score.

    Each task returns at most ``k`` rows, and the final order is a TakeOrderedAndProject. Rows
    without a usable vector (null, other width, zero, NaN) never match.
    """
    rows = np.asarray(query, dtype=np.float64)[None, :]
    source = _narrow(vectors)
    found = source.mapInArrow(lambda it: partition_topk(it, rows, k), payload_schema(source))
    hits = _with_score(found, "_cos").drop("_q", "_cos")
    return hits.orderBy(*nearest_first()).limit(k)


def best_per_file(hits: DataFrame) -> DataFrame:
    """Best hit of every file, best file first; hits without a path are dropped.

    One aggregate that combines before the shuffle: a file holding most of the hits still sends one
    row per task.
    """
    rest = [c for c in hits.columns if c not in ("file_path", "id")]
    away = F.col("distance") if "distance" in hits.columns else 1.0 - F.col("score")
    rank = F.round(away, COSINE_DECIMALS).alias("_rank")
    return (
        hits.where(F.coalesce(F.col("file_path"), F.lit("")) != "")
        .groupBy("file_path")
        .agg(F.min(F.struct(rank, "id", *rest)).alias("b"))
        .orderBy("b._rank", "b.id", "file_path")
        .select(*[F.col(c if c == "file_path" else f"b.{c}") for c in hits.columns])
    )


def search_page(
    vectors: DataFrame, query: list[float], offset: int = 0, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """One page of raw hits, de-duplicated per file inside the page.

    ``has_more`` is true when the raw page came back full; ``total`` counts rows after
    de-duplication. Both windows below see at most one page.
    """
    page = search_topk(vectors, query, offset + limit).orderBy(*nearest_first()).offset(offset)
    whole_page = Window.partitionBy(F.lit(1))
    page = page.withColumn("has_more", F.count(F.lit(1)).over(whole_page) >= limit)
    return (
        best_per_file(page)
        .withColumn("total", F.count(F.lit(1)).over(whole_page).cast("int"))
        .withColumn("offset", F.lit(offset))
        .orderBy(*nearest_first())
    )


def search_files(
    vectors: DataFrame, query: list[float], offset: int = 0, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Best hit per file first, then paging: no file shows up on two pages."""
    scored = score_rows(_narrow(vectors), query, best_by="file_path")
    scored = _with_score(scored, "cosine").drop("cosine")
    return best_per_file(scored).orderBy(*nearest_first()).offset(offset).limit(limit)


def with_payload(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """Add each hit's metadata, keeping the order.

    An ordinary page is brought back first, which runs the search once, and its paths become a filter
    of the payload scan; more than ``PAGE_ROWS`` hits are joined without one. The rows are the same.
    """
    rest = vectors.select("id", "file_path", "metadata")
    page = hits.limit(PAGE_ROWS + 1).collect()
    if len(page) <= PAGE_ROWS:
        hits = hits.sparkSession.createDataFrame(page, hits.schema)
        rest = rest.where(F.col("file_path").isin(sorted({r.file_path for r in page if r.file_path is not None})))
    return hits.join(rest, ["id", "file_path"]).orderBy(*nearest_first())


def format_results(hits: DataFrame) -> DataFrame:
    """Result items: file fields from the metadata JSON with defaults, percentage and preview."""
    meta = F.from_json("metadata", METADATA)
    text = F.coalesce(F.col("_m.chunk_text"), F.lit(""))
    exif = F.to_json("_m.exif")
    lead = [c for c in ("id", "chunk_index", "score", "has_more", "total", "offset") if c in hits.columns]
    return hits.withColumn("_m", meta).select(
        *lead,
        F.coalesce("_m.file_path", F.lit("")).alias("file_path"),
        F.coalesce("_m.file_name", F.lit("")).alias("file_name"),
        F.coalesce("_m.file_type", F.lit("")).alias("file_type"),
        F.coalesce("_m.file_size", F.lit(0)).cast("long").alias("file_size"),
        F.coalesce("_m.thumbnail_path", F.lit("")).alias("thumbnail_path"),
        similarity_percent(F.col("score")).alias("similarity"),
        similarity_band(F.col("score")).alias("band"),
        F.when(text != "", F.left(text, F.lit(PREVIEW_CHARS))).alias("text_preview"),
        F.when(exif != "{}", exif).alias("exif"),
    )
