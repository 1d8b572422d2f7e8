"""Nearest neighbours for a table of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skimdex.functions.vectors import distance_to_score
from skimdex.operators.scoring import COSINE_DECIMALS, matrix, partition_topk, payload_schema

#: query matrices up to this size travel to every executor; larger ones take the grid
BROADCAST_BYTES = 64 * 1024 * 1024
#: partial results of a query are merged in so many branches first
MERGE_BRANCHES = 64
#: result rows (queries x k) that one task may hold
RESULT_ROWS = 250_000
#: bytes of the vectors on each side of a block pair, which bounds what one task holds and how long it runs
GRID_BYTES = 32 * 1024 * 1024


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of what the tasks found, merged in two steps so that no task sees all of a query."""
    nearness = F.round("_cos", COSINE_DECIMALS)
    ties = [c for c in ("id", "file_path") if c in found.columns]
    found = found.withColumn("_branch", F.spark_partition_id() % MERGE_BRANCHES)
    branch = Window.partitionBy("query_id", "_branch").orderBy(nearness.desc(), *ties)
    found = found.withColumn("_at", F.row_number().over(branch)).where(F.col("_at") <= k).drop("_at", "_branch")
    best_first = Window.partitionBy("query_id").orderBy(nearness.desc(), *ties)
    return (
        found.withColumn("rank", F.row_number().over(best_first))
        .where(F.col("rank") <= k)
        .withColumn("distance", 1.0 - F.col("_cos"))
        .withColumn("score", distance_to_score(F.col("distance")))
        .drop("_cos")
    )


def knn_join(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    exclude_same_id: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = GRID_BYTES,
) -> DataFrame:
    """Exact top-``k`` rows of ``vectors`` for every row of ``queries`` (query_id, vector).

    While queries and results are small, one pass over ``vectors`` answers all queries and only
    ``k`` rows per query and task are shuffled. Otherwise both sides are cut into blocks and every
    block pair keeps its own top-k, so memory stays bounded for any number of queries. In both plans a
    query meets the vectors of its own width; queries without a usable vector have no neighbours.
    """
    queries = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector").where(F.size("vector") > 0)
    source = vectors.select(*[c for c in ("id", "file_path") if c in vectors.columns], "vector")
    widths = {r.width: r.n for r in queries.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).collect()}
    too_wide = sum(w * n * 8 for w, n in widths.items()) > broadcast_bytes
    if too_wide or sum(widths.values()) * k > RESULT_ROWS:
        return _ranked(blocked_topk(queries, source, k, [], exclude_same_id, block_bytes), k)
    found = None
    for width in sorted(widths) or [1]:
        part = _broadcast_pass(queries.where(F.size("vector") == width), source, k, exclude_same_id)
        found = part if found is None else found.unionByName(part)
    return _ranked(found, k)


def _broadcast_pass(queries: DataFrame, source: DataFrame, k: int, exclude_same_id: bool) -> DataFrame:
    """Top-k per query and task for queries of one width, whose size was checked."""
    table = queries.toPandas()
    query_ids = table["query_id"].tolist()
    width = len(table["vector"][0]) if query_ids else 1
    rows = np.array([np.asarray(v, dtype=np.float64) for v in table["vector"]]).reshape(-1, width)
    shipped = queries.sparkSession.sparkContext.broadcast((query_ids, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shipped.value
        name = pa.array(ids, pa.string())
        for out in partition_topk(batches, asked, k, ids if exclude_same_id else None):
            yield pa.RecordBatch.from_arrays(
                [name.take(out.column("_q")), *out.columns[1:]],
                ["query_id", *out.schema.names[1:]],
            )

    return source.mapInArrow(run, _named(source))


def _named(source: DataFrame) -> T.StructType:
    fields = payload_schema(source).fields[1:]
    return T.StructType([T.StructField("query_id", T.StringType()), *fields])


def blocked_topk(
    queries: DataFrame, source: DataFrame, k: int, on: list[str], exclude_same_id: bool, block_bytes: int = GRID_BYTES
) -> DataFrame:
    """Top-k per pair of blocks, of the queries and rows that agree in width and the columns ``on``.

    Every group of equal width and ``on`` is cut by its own size, so a group that owns much of the
    table is spread over many tasks. Blocks are drawn by hashing unique keys (equal images share an
    id, but not a path), so copies spread evenly. ``source`` is copied once per query block.
    """
    keys = ["width", *on]
    unique = [c for c in source.columns if c not in ("vector", *on)]
    left = queries.select("query_id", F.col("vector").alias("query_vector"), F.size("vector").alias("width"), *on)
    right = source.withColumn("width", F.size("vector")).where("width > 0")
    room = F.greatest(F.lit(1), F.lit(block_bytes) / (F.col("width") * 8))
    most = F.greatest(F.lit(1), F.least(room, F.lit(RESULT_ROWS / k)))  # queries of a block, each with k rows
    asked = left.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.ceil(F.col("n") / most).alias("q_blocks"))
    held = right.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.ceil(F.col("n") / room).alias("v_blocks"))
    sizes = asked.join(held, keys)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = left.join(sizes, keys).select(
        "query_id", "query_vector", *keys, F.pmod(F.xxhash64("query_id"), "q_blocks").alias("qb"), each("v_blocks").alias("vb")
    )
    right = right.join(sizes, keys).select(
        *unique, "vector", *keys, F.pmod(F.xxhash64(*unique), "v_blocks").alias("vb"), each("q_blocks").alias("qb")
    )
    source = source.drop(*on)
    out = _named(source)
    empty = to_arrow_schema(out).empty_table()
    columns = list(source.columns)

    def run(block: pa.Table, rows: pa.Table) -> pa.Table:
        if not block.num_rows or not rows.num_rows:
            return empty
        asked = matrix(block["query_vector"].combine_chunks(), block["width"][0].as_py())
        ids = block["query_id"].to_pylist()
        batches = rows.select(columns).combine_chunks().to_batches()
        found = list(partition_topk(iter(batches), asked, k, ids if exclude_same_id else None))
        if not found:
            return empty
        table = pa.Table.from_batches(found)
        return table.set_column(0, "query_id", pa.array(ids, pa.string()).take(table["_q"].combine_chunks()))

    pair = [*keys, "qb", "vb"]
    return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(run, out)
