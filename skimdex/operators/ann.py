"""Approximate search: a coarse cell layout, probing, scalar quantization, hashing, recall."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimdex.functions.vectors import cosine_similarity, dot
from skimdex.operators.intervals import COSINE_SLACK, scan_intervals
from skimdex.operators.knn import BROADCAST_BYTES, GRID_BYTES, _ranked, blocked_topk, knn_join
from skimdex.operators.scoring import BLOCK_CELLS, COSINE_DECIMALS, unit_rows, usable_slices
from skimdex.operators.search import search_topk
from skimdex.session import work_dir

#: cell of rows that were not assigned yet: every search looks there
UNPLACED = -2
#: names of rows that may be broadcast
SHIPPED_ROWS = 10_000
#: cells searched first for a bound on the last hit, and what rounding may add to an angle
LEAD_CELLS, ANGLE_SLACK = 8, 1e-5
CENTROIDS = T.StructType(
    [T.StructField("cell", T.IntegerType()), T.StructField("centroid", T.ArrayType(T.DoubleType()))]
)


def _usable(vector: Column) -> Column:
    square = dot(vector, vector)
    return (square > 0.0) & (square < float("inf"))  # NaN sorts above infinity


def _as_rows(centroids: DataFrame) -> DataFrame:
    """Centroids in the shape of a vector table; ids sort like cell numbers."""
    return centroids.select(F.lpad(F.col("cell").cast("string"), 10, "0").alias("id"), F.col("centroid").alias("vector"))


def _centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Cell numbers and unit centroids, in cell order; None if they exceed what may be shipped."""
    room = centroids.agg(F.sum(F.size("centroid").cast("long") * 8)).head()[0] or 0
    if room > BROADCAST_BYTES:
        return None
    table = centroids.select("cell", "centroid").orderBy("cell").toPandas()
    rows = np.array([np.asarray(v, dtype=np.float64) for v in table["centroid"]])
    return table["cell"].to_numpy(dtype=np.int64), unit_rows(rows)


def train_centroids(
    vectors: DataFrame, cells: int, seed: int = 7, train_fraction: float = 1.0, iterations: int = 20
) -> DataFrame:
    """Cosine k-means centroids: cell, centroid. Only training may use a sample; assignment, and so
    every search, always covers all rows."""
    rows = vectors.where(_usable(F.col("vector"))).select(array_to_vector("vector").alias("features"))
    if train_fraction < 1.0:
        rows = rows.sample(train_fraction, seed=seed)
    model = KMeans(k=cells, seed=seed, maxIter=iterations, distanceMeasure="cosine").fit(rows)
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(centers, CENTROIDS)


def assign_cells(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Add ``cell``, the centroid with the highest cosine (lowest number on ties).

    Rows without a usable vector get cell -1: they are kept, and no search probes them. Centroids
    too large to be shipped meet the rows block by block; rows are then told apart by id and path.
    """
    found = _centroid_matrix(centroids)
    if found is None:
        return _assign_by_blocks(vectors, centroids)
    cells, unit = found
    dim = unit.shape[1]

    def nearest(vectors: pa.Array) -> pa.Array:
        out = np.full(len(vectors), -1, dtype=np.int32)
        step = max(1, BLOCK_CELLS // len(cells))
        for rows, values in usable_slices(vectors, dim):
            for lo in range(0, len(rows), step):
                block = unit_rows(values[lo : lo + step])
                usable = ~np.isnan(block).any(axis=1)
                cosines = np.round(block[usable] @ unit.T, COSINE_DECIMALS)
                out[rows[lo : lo + step][usable]] = cells[np.argmax(cosines, axis=1)]
        return pa.array(out)

    return vectors.withColumn("cell", F.arrow_udf(nearest, T.IntegerType())(F.col("vector")))


def _assign_by_blocks(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    name = F.concat_ws("\0", *[c for c in ("id", "file_path") if c in vectors.columns])
    asked = vectors.select(name.alias("query_id"), "vector")
    near = _ranked(blocked_topk(asked, _as_rows(centroids), 1, [], False), 1)
    near = near.select(F.col("query_id").alias("_name"), F.col("id").cast("int").alias("cell"))
    rows = vectors.withColumn("_name", name).join(near, "_name", "left").drop("_name")
    return rows.withColumn("cell", F.coalesce("cell", F.lit(-1)))


def build_coarse_index(
    vectors: DataFrame, path: str, cells: int | None = None, centroids: DataFrame | None = None, **train
) -> None:
    """Write ``path/centroids`` and ``path/cells``, the latter partitioned by cell.

    The rebalance hint gathers a cell's rows for writing and lets adaptive execution split a cell
    that holds much of the table over several tasks and files.
    """
    if centroids is None:
        centroids = train_centroids(vectors, cells, **train)
    centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    kept = centroids.sparkSession.read.parquet(f"{path}/centroids")
    laid_out = assign_cells(vectors, kept).hint("rebalance", "cell")
    laid_out.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")


def load_coarse_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, centroids) of an index written by ``build_coarse_index``."""
    return spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/centroids")


def probe_cells(centroids: DataFrame, query: list[float], nprobe: int) -> list[int]:
    """The ``nprobe`` cells nearest to a query; only those reach the driver."""
    near = search_topk(_as_rows(centroids).withColumn("file_path", F.lit("")), query, nprobe)
    return [int(r.id) for r in near.select("id").collect()]


def probed(
    indexed: DataFrame, centroids: DataFrame, query: list[float], nprobe: int
) -> DataFrame:
    """The rows of the ``nprobe`` nearest cells and unplaced ones; other cells are pruned from the scan."""
    return indexed.where(F.col("cell").isin([*probe_cells(centroids, query, nprobe), UNPLACED]))


def cell_radii(indexed: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cell, radius): the largest angle between a row of a cell and its centroid."""
    away = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine_similarity(F.col("vector"), F.col("centroid")))))
    return indexed.join(centroids, "cell").groupBy("cell").agg(F.max(away).alias("radius"))


def probed_exactly(
    indexed: DataFrame, centroids: DataFrame, radii: DataFrame, query: list[float], k: int
) -> DataFrame:
    """The rows of every cell that may hold one of the ``k`` nearest, and unplaced ones.

    No row of a cell is nearer in angle than the centroid less the cell's radius. The cells with the
    least such bounds are searched for ``k`` hits, and cells whose bound exceeds the last hit are pruned.
    """
    target = F.array(*[F.lit(float(x)) for x in query])
    away = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine_similarity(F.col("centroid"), target))))
    bounds = centroids.where(F.size("centroid") == len(query)).join(radii, "cell")
    bounds = bounds.select("cell", away.alias("away"), F.greatest(F.lit(0.0), away - F.col("radius")).alias("bound"))
    bounds = bounds.where("away IS NOT NULL")
    lead = [r.cell for r in bounds.orderBy("bound", "away", "cell").limit(LEAD_CELLS).collect()]
    if not lead:  # a query of another width, or nothing laid out
        return indexed
    hits = search_topk(indexed.where(F.col("cell").isin([*lead, UNPLACED])), query, k)
    last = hits.agg(F.count("*").alias("n"), F.acos(F.greatest(F.lit(-1.0), 1.0 - F.max("distance"))).alias("away")).head()
    if last.n < k:
        return indexed
    # rounding may lift a cosine above one, whose angle is zero
    reach = (0.0 if last.away is None or last.away != last.away else last.away) + ANGLE_SLACK
    return indexed.where(F.col("cell").isin([*[r.cell for r in bounds.where(F.col("bound") <= reach).collect()], UNPLACED]))


def search_ann(
    indexed: DataFrame, centroids: DataFrame, query: list[float], k: int, nprobe: int
) -> DataFrame:
    """Exact top-k inside the ``nprobe`` nearest cells."""
    return search_topk(probed(indexed, centroids, query, nprobe), query, k)


def knn_ann(
    queries: DataFrame,
    indexed: DataFrame,
    centroids: DataFrame,
    k: int,
    nprobe: int,
    exclude_same_id: bool = False,
    block_bytes: int = GRID_BYTES,
) -> DataFrame:
    """Approximate top-k for a table of queries with distinct ids: a row is scored only by queries
    probing its cell.

    Queries find their cells by a join with the centroids and then meet the rows of each cell block
    by block; neither queries nor centroids pass through the driver whole, and a hot cell is cut up.
    """
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector").where(F.size("vector") > 0)
    probes = knn_join(asked, _as_rows(centroids), nprobe).select("query_id", F.col("id").cast("int").alias("cell"))
    source = indexed.select(*[c for c in ("id", "file_path") if c in indexed.columns], "vector", F.col("cell").cast("int").alias("cell"))
    return _ranked(blocked_topk(asked.join(probes, "query_id"), source, k, ["cell"], exclude_same_id, block_bytes), k)


def dimension_ranges(vectors: DataFrame) -> DataFrame:
    """One row with the smallest and largest value per dimension: ``low``, ``high``.

    A table of several widths is described by its commonest one (the smallest of equally common).
    """
    stats = Summarizer.metrics("min", "max").summary(array_to_vector("vector")).alias("s")
    widths = vectors.where(F.size("vector") > 0).groupBy(F.size("vector").alias("width"))
    common = widths.agg(F.count("*").alias("n"), stats).orderBy(F.desc("n"), "width").limit(1)
    return common.select(vector_to_array("s.min").alias("low"), vector_to_array("s.max").alias("high"))


def quantize_sq8(vectors: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Replace ``vector`` by ``code``: one byte per dimension, scaled to that dimension's range.

    Rows of another width than the ranges, or with entries that are no numbers, have no code.
    """
    bounds = (dimension_ranges(vectors) if ranges is None else ranges).head()
    if bounds is None or bounds.low is None:
        return vectors.select(
            *[c for c in vectors.columns if c != "vector"], F.lit(None).cast("binary").alias("code")
        )
    low, high = np.asarray(bounds.low), np.asarray(bounds.high)
    scale = np.where(high > low, high - low, 1.0)

    def encode(vectors: pa.Array) -> pa.Array:
        out = np.full(len(vectors), None, dtype=object)
        for rows, values in usable_slices(vectors, len(low)):
            whole = np.isfinite(values).all(axis=1)
            steps = np.floor((values[whole] - low) * 255.0 / scale + 0.5)
            codes = np.clip(steps, 0, 255).astype(np.uint8)
            out[rows[whole]] = [code.tobytes() for code in codes]
        return pa.array(out, pa.binary())

    code = F.arrow_udf(encode, T.BinaryType())(F.col("vector"))
    return vectors.withColumn("code", code).drop("vector")


def search_sq8(coded: DataFrame, vectors: DataFrame, ranges: DataFrame, query: list[float], k: int) -> DataFrame:
    """Exact top-k by a scan of codes, a byte per dimension, and a second look at every undecided row.

    ``coded`` comes from ``quantize_sq8(vectors, ranges)``, and the ranges cover the vectors: a row then
    lies within half a step of its decoded code in each dimension, so the angle between the two is
    bounded, and its cosine with the query lies in an interval. Rows whose interval reaches the k-th best
    lower end are joined with their vectors, by the plan that their number allows.
    """
    bounds = ranges.head()
    if bounds is None or bounds.low is None or len(bounds.low) != len(query):
        return search_topk(vectors, query, k)
    low, high = np.asarray(bounds.low), np.asarray(bounds.high)
    step = np.where(high > low, high - low, 0.0) / 255.0
    half = float(np.linalg.norm(step)) / 2

    def ends(part: pa.RecordBatch, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(-1, len(low))
        rows = low + codes * step
        length = np.linalg.norm(rows, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            off = np.where(length > half * (1 + 1e-9), np.arcsin(np.minimum(1.0, half / length)), np.pi)[:, None] + ANGLE_SLACK
            angle = np.arccos(np.clip(np.nan_to_num(rows @ unit.T / length[:, None]), -1.0, 1.0))
        return np.cos(np.minimum(angle + off, np.pi)), np.cos(np.maximum(angle - off, 0.0))

    found = scan_intervals(coded, ["code"], ends, [""], np.asarray(query, dtype=np.float64)[None, :], k, False)
    path = work_dir(vectors.sparkSession, "candidates")
    found.write.parquet(path)
    found = vectors.sparkSession.read.schema(found.schema).parquet(path)
    last = found.orderBy(F.desc("lower")).limit(k).agg(F.count("*").alias("n"), F.min("lower").alias("floor")).head()
    able = found.where(F.col("upper") >= last.floor - COSINE_SLACK) if last.n == k else found
    names = able.select(F.col("id").alias("_id"), F.col("file_path").alias("_path"))
    if able.limit(SHIPPED_ROWS + 1).count() <= SHIPPED_ROWS:
        names = F.broadcast(names)
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("file_path").eqNullSafe(F.col("_path"))
    return search_topk(vectors.join(names, same, "left_semi"), query, k)


def lsh_neighbors(
    vectors: DataFrame, query: list[float], k: int, bucket: float = 0.5, tables: int = 4, seed: int = 7
) -> DataFrame:
    """Approximate neighbours by random projections of unit vectors, reranked by exact cosine."""
    length = F.sqrt(dot(F.col("vector"), F.col("vector")))
    unit = F.transform("vector", lambda x: x.cast("double") / length)
    rows = vectors.where(F.size("vector") == len(query)).where(_usable(F.col("vector")))
    # the optimizer may hash rows ahead of these filters, so every row has features of the right width
    blank = F.array_repeat(F.lit(0.0), len(query))
    fits = (F.size("vector") == len(query)) & _usable(F.col("vector"))
    rows = rows.withColumn("features", array_to_vector(F.when(fits, unit).otherwise(blank)))
    lsh = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed
    )
    key = Vectors.dense(unit_rows(np.asarray(query, dtype=np.float64)[None, :])[0])
    found = lsh.fit(rows).approxNearestNeighbors(rows, key, k)
    target = F.array(*[F.lit(float(x)) for x in query])
    score = F.greatest(cosine_similarity(F.col("vector"), target), F.lit(0.0))
    return found.select("id", "file_path", score.alias("score")).orderBy(F.desc("score"), "id")


def ann_recall(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Share of the exact top-k that the approximate answer contains, per query."""
    truth = exact.where(F.col("rank") <= k).select("query_id", "id")
    found = approx.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit"))
    return (
        truth.join(found, ["query_id", "id"], "left")
        .groupBy("query_id")
        .agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    )
