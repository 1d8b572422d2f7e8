"""Product codes of what a coarse cell leaves of a vector: a few bytes a row, scanned by lookup tables.

A unit vector is its cell's centroid plus a residual; the residual is cut into ``parts`` pieces, and
each piece is replaced by the nearest of 256 centers of its own codebook. A query makes one table of
256 inner products a part, so the cosine of a row is estimated by as many lookups as it has bytes, plus
one for its cell. A row also keeps the length ``off`` of what its code leaves out. Errors in the
direction of a query are spread like ``off`` over the root of the dimensions; rows whose estimate
comes within ``z`` times that of the last hit are looked at in full. ``z`` of the root of the
dimensions or more makes the search exact.

Codebooks are trained on a bounded, documented sample; every row is coded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimdex.operators.ann import assign_cells
from skimdex.operators.bounded import knn_intervals
from skimdex.operators.intervals import COSINE_SLACK, Ends
from skimdex.operators.scoring import BLOCK_CELLS, unit_rows, usable_slices

CODES = 256
#: rows, chosen by hash, that the codebooks are trained on
SAMPLE_ROWS = 20_000
CODEBOOK = T.StructType(
    [T.StructField("part", T.IntegerType()), T.StructField("code", T.IntegerType()), T.StructField("center", T.ArrayType(T.DoubleType()))]
)


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Number of the center nearest to each row, the smallest on ties."""
    out = np.empty(len(rows), dtype=np.int64)
    half = (centers**2).sum(1) / 2
    step = max(1, BLOCK_CELLS // len(centers))
    for at in range(0, len(rows), step):
        out[at : at + step] = np.argmin(half - rows[at : at + step] @ centers.T, axis=1)
    return out


def _means(rows: np.ndarray, codes: int, iterations: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's iterations from distinct rows; a center that loses its rows stays where it is."""
    distinct = np.unique(rows, axis=0)
    centers = distinct[np.sort(rng.choice(len(distinct), min(codes, len(distinct)), replace=False))].copy()
    for _ in range(iterations):
        own = _nearest(rows, centers)
        counts = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, rows)
        held = counts > 0
        centers[held] = sums[held] / counts[held, None]
    return centers


def _units(batch: pa.RecordBatch, cells: dict[int, int], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions, unit vectors and centroid numbers of the rows that lie in a known cell."""
    number = np.array([cells.get(c, -1) for c in batch.column("cell").to_pylist()], dtype=np.int64)
    for rows, values in usable_slices(batch.column("vector"), dim):
        unit = unit_rows(values)
        good = np.isfinite(unit).all(axis=1) & (number[rows] >= 0)
        yield rows[good], unit[good], number[rows][good]


def _centroid_table(centroids: DataFrame) -> tuple[dict[int, int], np.ndarray]:
    rows = centroids.orderBy("cell").collect()
    matrix = unit_rows(np.array([r.centroid for r in rows], dtype=np.float64).reshape(len(rows), -1))
    return {r.cell: i for i, r in enumerate(rows)}, np.nan_to_num(matrix)


def build_product_index(
    vectors: DataFrame, path: str, centroids: DataFrame, parts: int = 16, iterations: int = 12, sample: int = SAMPLE_ROWS, seed: int = 7
) -> "ProductIndex":
    """Write ``path/centroids``, ``path/codebooks`` and ``path/codes``, the latter partitioned by cell.

    ``parts`` bytes a row. Rows without a direction or of another width than the centroids have no
    code; they match no query of that width.
    """
    spark = vectors.sparkSession
    centroids.select("cell", "centroid").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    kept = spark.read.parquet(f"{path}/centroids")
    cells, matrix = _centroid_table(kept)
    dim = matrix.shape[1]
    edges = np.linspace(0, dim, parts + 1).round().astype(int)
    placed = assign_cells(vectors, kept)
    names = [c for c in ("id", "file_path", "chunk_index") if c in vectors.columns]
    some = placed.where("cell >= 0").orderBy(F.xxhash64(F.lit(seed), *names), *names).limit(sample).select("vector", "cell")
    table = some.toArrow().combine_chunks()
    left = [unit - matrix[number] for batch in table.to_batches() for _, unit, number in _units(batch, cells, dim)]
    residuals = np.concatenate([*left, np.zeros((0, dim))])
    if not len(residuals):
        residuals = np.zeros((1, dim))
    rng = np.random.default_rng(seed)
    books = [_means(residuals[:, a:b], CODES, iterations, rng) for a, b in zip(edges, edges[1:])]
    rows = [(p, c, [float(x) for x in center]) for p, book in enumerate(books) for c, center in enumerate(book)]
    spark.createDataFrame(rows, CODEBOOK).coalesce(1).write.mode("overwrite").parquet(f"{path}/codebooks")
    shipped = spark.sparkContext.broadcast((cells, matrix, books))
    fields = [vectors.schema[c] for c in names]
    schema = T.StructType([*fields, T.StructField("pq", T.BinaryType()), T.StructField("off", T.DoubleType()), T.StructField("cell", T.IntegerType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, matrix, books = shipped.value
        for batch in batches:
            for at, unit, number in _units(batch, cells, dim):
                residual = unit - matrix[number]
                codes = np.empty((len(at), parts), dtype=np.uint8)
                rest = np.zeros(len(at))
                for p, book in enumerate(books):
                    piece = residual[:, edges[p] : edges[p + 1]]
                    own = _nearest(piece, book)
                    codes[:, p] = own
                    rest += ((piece - book[own]) ** 2).sum(1)
                part = batch.take(pa.array(at))
                columns = [part.column(c) for c in names]
                columns += [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.sqrt(rest)), part.column("cell").cast(pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    coded = placed.select(*names, "vector", "cell").mapInArrow(encode, schema)
    coded.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes")
    return ProductIndex(spark, path, schema)


class ProductIndex:
    """A stored index of product codes, opened for searches."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None):
        self.spark = spark
        reader = spark.read.schema(schema) if schema else spark.read
        self.codes = reader.parquet(f"{path}/codes")
        self.cells, self.matrix = _centroid_table(spark.read.parquet(f"{path}/centroids"))
        held: dict[int, list] = {}
        for r in spark.read.parquet(f"{path}/codebooks").orderBy("part", "code").collect():
            held.setdefault(r.part, []).append(r.center)
        self.books = [np.array(held[p], dtype=np.float64) for p in sorted(held)]
        self.dim = self.matrix.shape[1]

    def ends(self, z: float) -> Ends:
        """Interval ends of cosines: the estimate by tables, and ``z`` spreads of its error around it."""
        cells, matrix, books, share = self.cells, self.matrix, self.books, min(1.0, z / math.sqrt(self.dim))
        edges = np.cumsum([0, *[b.shape[1] for b in books]])
        known = np.array(sorted(cells))
        number = np.array([cells[c] for c in known])

        def ends(part: pa.RecordBatch, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            codes = np.frombuffer(b"".join(part.column("pq").to_pylist()), np.uint8).reshape(-1, len(books))
            at = number[np.searchsorted(known, part.column("cell").to_numpy())]
            estimate = (matrix @ unit.T)[at]
            for p, book in enumerate(books):
                estimate += (book @ unit[:, edges[p] : edges[p + 1]].T)[codes[:, p]]
            off = part.column("off").to_numpy()[:, None] * share + COSINE_SLACK
            return estimate - off, estimate + off

        return ends

    def neighbors(
        self, queries: DataFrame, vectors: DataFrame, k: int, z: float = 2.0, exclude_same_id: bool = False
    ) -> DataFrame:
        """Top-``k`` of every query (query_id, vector): undecided rows are scored by ``vectors``, as in ``knn_join``."""
        return knn_intervals(queries, self.codes, ["pq", "off", "cell"], self.ends(z), self.dim, len(self.books), vectors, k, exclude_same_id)
