"""A stored hash index for cosine neighbours: sign hashes in several tables, probed by query margins.

A row's code in a table says on which side of each random plane it lies. The index keeps a copy of
the rows per table, in folders of the code's first bits, with the codes in every row. A bucket whose
code differs from the query's in planes the query lies far from is unlikely to hold its neighbours: its
score is the sum of the squared margins of these planes, and a query reads the buckets whose score is
within its reach. Membership is an inequality, so no list of probes exists however many there are.

The reach follows from the recall asked for: a first look at the nearest buckets finds the angle of
the last hit, and at that angle the chance of each plane to separate a neighbour from the query is
known, hence the chance that a neighbour lies within a reach. A row that several tables offer is
scored in the first of them, which its codes tell.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimdex.operators.knn import BROADCAST_BYTES, RESULT_ROWS, _named, _ranked
from skimdex.operators.scoring import partition_topk, unit_rows, usable_slices
from skimdex.session import work_dir

#: copies of the rows, planes of a table (at most 16), planes that name a folder
TABLES, BITS, FOLDER_BITS = 4, 16, 5
#: the first look takes so many rows per hit asked for
LEAD = 16
#: steps of the scale on which chances are added up
SCALE = 512
KEPT = ("id", "file_path", "chunk_index")


def planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """Normals of the planes, tables x bits x dim, each entry 1 or -1 by a digest of its place."""
    sign = lambda *at: 1.0 if md5(":".join(map(str, (seed, *at))).encode()).hexdigest() >= "8" else -1.0
    return np.array([[[sign(t, b, d) for d in range(dim)] for b in range(bits)] for t in range(tables)])


def _margins(rows: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Rows x tables x bits: the side of each plane a row lies on, and how far for unit rows."""
    tables, bits, dim = normals.shape
    return (rows @ normals.reshape(-1, dim).T).reshape(-1, tables, bits)


def _weights(bits: int) -> np.ndarray:
    return 1 << np.arange(bits - 1, -1, -1)


def build_hash_index(
    vectors: DataFrame, path: str, tables: int = TABLES, bits: int = BITS, folder_bits: int = FOLDER_BITS, seed: int = 7
) -> "HashIndex":
    """Write ``path/rows``, partitioned by table and folder, and then ``path/about``.

    The index has the commonest width; other rows and rows without a direction are left out, as they
    match no query. A folder that holds much of the table is split over tasks and files.
    """
    if not 1 <= folder_bits <= bits <= 16:
        raise ValueError("one to 16 bits, and no more of them for folders")
    spark = vectors.sparkSession
    widths = vectors.where(F.size("vector") > 0).groupBy(F.size("vector").alias("width")).count()
    common = widths.orderBy(F.desc("count"), "width").head()
    dim = common["width"] if common else 1
    normals = planes(dim, tables, bits, seed)
    weights = _weights(bits)

    def encode(column: pa.Array) -> pa.Array:
        out = np.full(len(column), None, dtype=object)
        for rows, values in usable_slices(column, dim):
            usable = ~np.isnan(unit_rows(values)).any(axis=1)
            out[rows[usable]] = list(((_margins(values[usable], normals) > 0) @ weights).astype(np.int32))
        return pa.array(out.tolist(), pa.list_(pa.int32()))

    codes = F.arrow_udf(encode, T.ArrayType(T.IntegerType()))(F.col("vector"))
    coded = vectors.select(*[c for c in KEPT if c in vectors.columns], "vector", codes.alias("codes")).where("codes IS NOT NULL")
    copies = coded.select("*", F.posexplode("codes").alias("tbl", "code"))
    copies = copies.withColumn("folder", F.shiftright("code", bits - folder_bits)).drop("code")
    copies.hint("rebalance", "tbl", "folder").write.mode("overwrite").partitionBy("tbl", "folder").parquet(f"{path}/rows")
    n = spark.read.schema(copies.schema).parquet(f"{path}/rows").where("tbl = 0").count()
    about = [(dim, tables, bits, folder_bits, seed, n, copies.schema.json())]
    shape = "dim int, tables int, bits int, folder_bits int, seed long, n long, columns string"
    spark.createDataFrame(about, shape).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return HashIndex(spark, path)


class HashIndex:
    """A stored hash index, opened for searches."""

    def __init__(self, spark: SparkSession, path: str):
        about = spark.read.parquet(f"{path}/about").head()
        self.spark, self.path = spark, path
        self.dim, self.tables, self.bits, self.folder_bits, self.seed, self.n, columns = about
        self.schema = T.StructType.fromJson(json.loads(columns))
        self.normals = planes(self.dim, self.tables, self.bits, self.seed)

    @property
    def rows(self) -> DataFrame:
        """All copies: KEPT columns, vector, codes, tbl, folder."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def search(self, query: list[float], k: int, recall: float = 0.9, reach: float | None = None) -> DataFrame:
        """The ``k`` nearest rows that the probed buckets hold: id, file_path, ..., rank, distance, score."""
        asked = self.spark.createDataFrame([("", [float(x) for x in query])], "query_id string, vector array<double>")
        return self.neighbors(asked, k, recall, reach).drop("query_id")

    def neighbors(
        self, queries: DataFrame, k: int, recall: float = 0.9, reach: float | None = None,
        exclude_same_id: bool = False, block_bytes: int = BROADCAST_BYTES,
    ) -> DataFrame:
        """Near rows for a table of queries (query_id, vector) with distinct ids, ranked by exact cosine.

        ``recall`` is what the reach is chosen for; ``reach`` fixes it instead, as a share of the
        highest score, one reading everything. Queries are answered in blocks of at most
        ``block_bytes``, each in one pass over the folders it can reach.
        """
        queries = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector").where(F.size("vector") == self.dim)
        n = queries.count()
        blocks = max(math.ceil(n * self.dim * 8 / block_bytes), math.ceil(n * k / RESULT_ROWS), 1)
        if blocks == 1:
            return _ranked(self._block(queries, k, recall, reach, exclude_same_id), k)
        out = work_dir(self.spark, "hashed")
        for b in range(blocks):
            part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            self._block(part, k, recall, reach, exclude_same_id).write.mode("append").parquet(out)
        return _ranked(self.spark.read.parquet(out), k)

    def _block(self, queries: DataFrame, k: int, recall: float, reach: float | None, exclude: bool) -> DataFrame:
        table = queries.toPandas()
        ids = table["query_id"].tolist()
        given = np.array([np.asarray(v, dtype=np.float64) for v in table["vector"]]).reshape(-1, self.dim)
        margins = _margins(np.nan_to_num(unit_rows(given)), self.normals)
        if reach is not None:
            return self._scan(ids, given, margins, reach * (margins**2).sum(2), k, exclude)
        share = min(1.0, LEAD * (k + 1) / max(1, self.n * self.tables))
        first = _ranked(self._scan(ids, given, margins, reaches(margins, None, share), k, exclude), k)
        last = first.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("away")).collect()
        cosines = {r.query_id: 1.0 - r.away for r in last if r.n == k}
        known = np.array([cosines.get(i, np.nan) for i in ids])
        wide = reaches(margins, np.nan_to_num(known), 1.0 - (1.0 - min(recall, 1.0)) ** (1.0 / self.tables))
        wide[np.isnan(known)] = np.inf  # too few hits to judge by: read everything
        return self._scan(ids, given, margins, wide, k, exclude)

    def folders(self, margins: np.ndarray, reach: np.ndarray) -> list[list[int]]:
        """Per table, the folders in which some query's reach begins."""
        scores = (margins**2)[:, :, : self.folder_bits]
        codes = np.arange(1 << self.folder_bits)
        bits = (codes[:, None] & _weights(self.folder_bits)) > 0
        out = []
        for t in range(self.tables):
            apart = bits[None, :, :] != (margins[:, t, None, : self.folder_bits] > 0)
            least = (apart * scores[:, t, None, :]).sum(2)
            out.append(np.flatnonzero((np.round(least, 9) <= reach[:, t, None]).any(0)).tolist())
        return out

    def _scan(self, ids: list[str], given: np.ndarray, margins: np.ndarray, reach: np.ndarray, k: int, exclude: bool) -> DataFrame:
        reached = [self._in_folders(t, found) for t, found in enumerate(self.folders(margins, reach)) if found]
        source = self.rows.where(reduce(lambda a, b: a | b, reached, F.lit(False)))
        kept = [c for c in KEPT if c in source.columns]
        source = source.select(*kept, "vector", F.col("codes").alias("_codes"), F.col("tbl").alias("_tbl"))
        shipped = self.spark.sparkContext.broadcast((ids, given, *member_of(margins, reach)))
        bits = self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, rows, slopes, offsets, reach = shipped.value
            name = pa.array(ids, pa.string())
            allowed = lambda part: _meet(part, slopes, offsets, reach, bits)
            for out in partition_topk(batches, rows, k, ids if exclude else None, allowed=allowed):
                yield pa.RecordBatch.from_arrays([name.take(out.column("_q")), *out.columns[1:]], ["query_id", *out.schema.names[1:]])

        return source.mapInArrow(run, _named(source))

    @staticmethod
    def _in_folders(table: int, found: list[int]) -> Column:
        return (F.col("tbl") == table) & F.col("folder").isin(found)


def member_of(margins: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's score as a linear function of its bits: slopes, offsets, and the reach beside them."""
    scores, side = margins**2, margins > 0
    return np.where(side, -scores, scores), (scores * side).sum(2), reach


def _meet(part: pa.RecordBatch, slopes: np.ndarray, offsets: np.ndarray, reach: np.ndarray, bits: int) -> np.ndarray:
    """Rows x queries: whether this copy of a row is the first that the query reaches."""
    tables = slopes.shape[1]
    codes = part.column("_codes").flatten().to_numpy(zero_copy_only=False).reshape(-1, tables)
    own = part.column("_tbl").to_numpy(zero_copy_only=False)
    before = np.zeros((len(codes), len(slopes)), dtype=bool)
    out = np.zeros_like(before)
    for t in range(tables):
        sides = ((codes[:, t, None] & _weights(bits)) > 0).astype(np.float64)
        hit = np.round(sides @ slopes[:, t].T + offsets[:, t], 9) <= reach[:, t]  # the same in every task
        mine = own == t
        out[mine] = hit[mine] & ~before[mine]
        before |= hit
    return out


def reaches(margins: np.ndarray, cosine: np.ndarray | None, chance: float) -> np.ndarray:
    """Queries x tables: the least reach that holds a row with at least this chance.

    The row lies at ``cosine`` from the query, where a plane at margin m separates them with the chance
    that a normal variable exceeds m cos / sin; without ``cosine`` it is any row, on either side of a
    plane alike. Scores are rounded up to a scale of ``SCALE`` steps, so the chance is never overrated.
    """
    scores = margins**2
    n, tables, bits = scores.shape
    if cosine is None:
        apart = np.full(scores.shape, 0.5)
    else:
        cosine = np.clip(cosine, 0.0, 1.0 - 1e-9)
        z = np.abs(margins) * (cosine / np.sqrt(1.0 - cosine**2))[:, None, None]
        apart = 0.5 * np.frompyfunc(math.erfc, 1, 1)(z / math.sqrt(2.0)).astype(np.float64)
    total = scores.sum(2)
    steps = np.ceil(scores / np.maximum(total, 1e-300)[:, :, None] * SCALE).astype(np.int64)
    flat, chances = steps.reshape(-1, bits), apart.reshape(-1, bits)
    width = SCALE + bits + 1
    mass = np.zeros((len(flat), width))
    mass[:, 0] = 1.0
    at = np.arange(width)
    for j in range(bits):
        moved = at[None, :] - flat[:, j, None]
        shifted = np.where(moved >= 0, np.take_along_axis(mass, np.maximum(moved, 0), 1), 0.0)
        mass = mass * (1.0 - chances[:, j, None]) + shifted * chances[:, j, None]
    enough = (np.cumsum(mass, 1) >= chance - 1e-12).argmax(1).reshape(n, tables)
    return np.where(chance >= 1.0, np.inf, enough / SCALE * total)
