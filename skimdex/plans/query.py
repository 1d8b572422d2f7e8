"""Search requests end to end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from skimdex.functions.embed import Embedder, HashingEmbedder
from skimdex.operators.ann import probed, probed_exactly
from skimdex.operators.search import DEFAULT_LIMIT, format_results, search_page, with_payload
from skimdex.plans.coarse import CoarseIndex
from skimdex.sources.tables import IndexStore


def query_vector(
    spark: SparkSession,
    kind: str,
    text: str | None = None,
    image_path: str | None = None,
    embedder: Embedder | None = None,
) -> list[float]:
    """Embed a text or an image file for searching; empty input and other kinds are errors."""
    if kind == "text":
        if not text:
            raise ValueError("search text must not be empty")
        value: str | bytes = text
    elif kind == "image":
        if not image_path:
            raise ValueError("image path must not be empty")
        value = bytes(spark.read.format("binaryFile").load(image_path).select("content").head()[0])
    else:
        raise ValueError(f"unsupported search type: {kind}")
    vector = (embedder or HashingEmbedder()).embed_batch(pd.Series([value]))[0]
    if vector is None or not any(vector):
        raise ValueError("the query could not be embedded")
    return [float(x) for x in vector]


def search(
    vectors: DataFrame | IndexStore,
    kind: str,
    text: str | None = None,
    image_path: str | None = None,
    offset: int = 0,
    limit: int = DEFAULT_LIMIT,
    embedder: Embedder | None = None,
    centroids: DataFrame | None = None,
    nprobe: int | None = None,
) -> DataFrame:
    """Validate, embed, fetch one page, de-duplicate and format. An empty table gives no rows.

    The answer is exact unless ``nprobe`` says how many cells to read. A store with a coarse index
    leaves out the cells that can hold no hit of the page. With ``centroids``, ``vectors`` are the cells
    of a coarse index.
    """
    rows = cells = vectors
    radii = None
    if isinstance(vectors, IndexStore):
        rows = cells = vectors.vectors.read()
        index = CoarseIndex(vectors)
        cells, centroids = index.tables() or (rows, None)
        radii = index.radii() if nprobe is None else None
    query = query_vector(rows.sparkSession, kind, text, image_path, embedder)
    if centroids is not None and radii is not None:
        cells = probed_exactly(cells, centroids, radii, query, offset + limit)
    elif centroids is not None and nprobe is not None:
        cells = probed(cells, centroids, query, nprobe)
    page = search_page(cells, query, offset, limit)
    return format_results(with_payload(page, rows))
