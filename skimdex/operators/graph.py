"""A graph of near neighbours, refined by its own neighbours' neighbours until it changes no more.

Every row starts with neighbours from groups of equal hash codes. A table of some size takes larger groups
and goes on with further hash tables until the lists hold what was asked for, as some rows that are
compared with all show, or until a row would have met as many rows as there are. Lists that hold less are
refined: in a round each row is a pivot; the rows on its list and some that list it meet in one task and
are scored against each other, unless both were met in an earlier round, and a pair is reported only where
it improves a list; pivots without a new member rest. The rounds end when few entries are new, or when the
lists hold what was asked for. Nothing compares all rows; a round scores some ``(2 width)^2`` pairs a row.
Lists of one width find less in a larger table, so lists that have settled below what was asked for are
widened by half and refined again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimdex.functions.vectors import distance_to_score
from skimdex.operators import knn
from skimdex.operators.hash_index import _margins, _weights, planes
from skimdex.operators.scoring import COSINE_DECIMALS, unit_rows, usable_slices
from skimdex.session import work_dir

#: rows that meet in a starting group, and hash tables the groups come from
GROUP_ROWS, TABLES = 64, 2
#: rows from which on groups hold a part ``GROUP_PART`` of the table, ``MOST_ROWS`` at most, and tables go on by ``MORE``
LARGE, GROUP_PART, MOST_ROWS, MORE = 4096, 16, 4096, 8
#: cosines that a task holds at a time in such a group
CELLS = 1 << 22
#: share of new entries from which on a round is followed by a look at the recall
NEARLY = 0.2
#: branches in which a long list of callers is cut before it is cut as a whole
BRANCHES = 64
#: rows, about, that are compared with all to measure the recall, and what it must lie above the one asked for
CHECKED, MARGIN = 500, 0.02
EDGES = "node long, other long, cos double"
_ARROW_EDGES = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("cos", pa.float64())])


def _written(df: DataFrame, name: str) -> DataFrame:
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _matrix(table: pa.Table) -> np.ndarray:
    """Rows of the packed ``unit``, all of one width."""
    units = table["unit"].combine_chunks()
    units = units.chunk(0) if isinstance(units, pa.ChunkedArray) else units
    return np.frombuffer(b"".join(units.to_pylist()), np.float64).reshape(table.num_rows, -1)


def _nodes(vectors: DataFrame) -> DataFrame:
    """(node, id, file_path, unit) of the rows with a direction, of the commonest width; ``unit`` is packed."""
    width = vectors.where(F.size("vector") > 0).groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").head()
    dim = width["w"] if width else 1

    def packed(column: pa.Array) -> pa.Array:
        out = np.full(len(column), None, dtype=object)
        for rows, values in usable_slices(column, dim):
            unit = unit_rows(values)
            good = np.isfinite(unit).all(axis=1)
            for i, u in zip(rows[good], unit[good]):
                out[i] = u.astype(np.float64).tobytes()
        return pa.array(out.tolist(), pa.binary())

    names = [c for c in ("id", "file_path") if c in vectors.columns]
    held = vectors.select(*names, F.arrow_udf(packed, T.BinaryType())(F.col("vector")).alias("unit")).where("unit IS NOT NULL")
    return _written(held.select(F.monotonically_increasing_id().alias("node"), *names, "unit"), "nodes")


def _coded(nodes: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """(node, unit, codes) with a hash code of each table."""
    weights = _weights(bits)

    def coded(units: pa.Array) -> pa.Array:
        values = np.frombuffer(b"".join(units.to_pylist()), np.float64).reshape(len(units), -1)
        normals = planes(values.shape[1], tables, bits, seed)
        codes = (_margins(values, normals) > 0) @ weights
        return pa.array(list(codes), pa.list_(pa.int64()))

    return nodes.select("node", "unit", F.arrow_udf(coded, T.ArrayType(T.LongType()))(F.col("unit")).alias("codes"))


def _best(edges: DataFrame, width: int) -> DataFrame:
    """The ``width`` nearest others of each node, every other once; an old entry stays old."""
    once = edges.groupBy("node", "other").agg(F.max("cos").alias("cos"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("node").orderBy(F.round("cos", COSINE_DECIMALS).desc(), "other")
    return once.withColumn("at", F.row_number().over(order)).where(F.col("at") <= width).drop("at")


def _met(nodes: DataFrame, n: int, size: int, tables: int, reported: int, seed: int) -> DataFrame:
    """Edges from groups of equal codes and of equal hashes of about ``size`` rows; a large group is cut at random.

    In a large table a group may have twice as many rows, so that most are whole.
    """
    bits = max(1, min(24, round(math.log2(max(2.0, n / size)))))
    anyhow = F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(max(1, n // size)))
    coded = _coded(nodes, tables, bits, seed)
    posted = coded.select("node", "unit", F.posexplode(F.concat("codes", F.array(anyhow))).alias("tbl", "code"))
    sizes = posted.groupBy("tbl", "code").agg(F.ceil(F.count("*") / (size if n < LARGE else 2 * size)).alias("cuts"))
    cut = posted.join(sizes, ["tbl", "code"]).withColumn("cut", F.pmod(F.xxhash64(F.lit(seed + 1), "node"), "cuts"))

    def meet(table: pa.Table) -> pa.Table:
        unit, node = _matrix(table), table["node"].to_numpy()
        most = min(reported, len(node) - 1)
        if most < 1:
            return _ARROW_EDGES.empty_table()
        out, step = [], max(1, CELLS // len(node))
        for lo in range(0, len(node), step):
            cosines = unit[lo : lo + step] @ unit.T
            rows = np.arange(len(cosines))
            cosines[rows, lo + rows] = -np.inf
            at = np.argpartition(-cosines, most - 1, axis=1)[:, :most]
            out.append((node[lo + np.repeat(rows, most)], node[at.ravel()], np.take_along_axis(cosines, at, 1).ravel()))
        return pa.table([np.concatenate(x) for x in zip(*out)], schema=_ARROW_EDGES)

    found = cut.select("tbl", "code", "cut", "node", "unit").groupBy("tbl", "code", "cut").applyInArrow(meet, EDGES)
    return found.withColumn("fresh", F.lit(True))


def _start(nodes: DataFrame, n: int, k: int, width: int, seed: int, checked: DataFrame, want: float) -> tuple[DataFrame, bool]:
    """First lists, and whether they hold the share ``want`` of the nearest rows.

    A row that is among the ``k`` nearest of all is so in every group, so large groups report no more.
    """
    if n < LARGE:
        return _written(_best(_met(nodes, n, GROUP_ROWS, TABLES, width, seed), width), "graph"), False
    size, edges, tables = min(MOST_ROWS, n // GROUP_PART), None, 0
    while tables * size < n:
        found = _met(nodes, n, size, MORE, k, seed + tables)
        edges = _written(_best(found if edges is None else edges.unionByName(found), width), "graph")
        if _recall(checked, edges) >= want:
            return edges, True
        tables += MORE + 1
    return edges.withColumn("fresh", F.lit(True)), False


def _round(nodes: DataFrame, edges: DataFrame, width: int, seed: int) -> DataFrame:
    """Lists after every pivot's members have met."""
    listed = edges.select(F.col("node").alias("pivot"), F.col("other").alias("member"), "fresh")
    calls = edges.select(F.col("other").alias("pivot"), F.col("node").alias("member"), "fresh")
    # a row that half the table lists hears only some of its callers, others in other rounds
    draw = F.xxhash64(F.lit(seed), "pivot", "member")
    calls = calls.withColumn("draw", draw).withColumn("branch", F.pmod("draw", F.lit(BRANCHES)))
    for keys in (["pivot", "branch"], ["pivot"]):
        order = Window.partitionBy(*keys).orderBy("draw")
        calls = calls.withColumn("at", F.row_number().over(order)).where(F.col("at") <= width).drop("at")
    members = listed.unionByName(calls.select("pivot", "member", "fresh")).groupBy("pivot", "member").agg(F.max("fresh").alias("fresh"))
    # where nobody is new, all have met
    members = members.withColumn("awake", F.max("fresh").over(Window.partitionBy("pivot"))).where("awake").drop("awake")
    floors = edges.groupBy("node").agg(F.count("*").alias("n"), F.min("cos").alias("floor"))
    floors = floors.select("node", F.when(F.col("n") >= width, F.col("floor")).otherwise(F.lit(-2.0)).alias("floor"))
    rows = nodes.select("node", "unit").join(floors, "node", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    met = members.join(rows.withColumnRenamed("node", "member"), "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _pivots(batches):
            pivot, node = table["pivot"].to_numpy(), table["member"].to_numpy()
            unit, floor = _matrix(table), table["floor"].to_numpy()
            fresh = table["fresh"].to_numpy(zero_copy_only=False)
            bounds = np.r_[0, np.flatnonzero(pivot[1:] != pivot[:-1]) + 1, len(pivot)]
            out = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                new, part = fresh[lo:hi], unit[lo:hi]
                cosines = part @ part.T
                good = (cosines > floor[lo:hi, None]) & (new[:, None] | new[None, :])
                np.fill_diagonal(good, False)
                i, j = np.nonzero(good)
                out.append((node[lo + i], node[lo + j], cosines[i, j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=_ARROW_EDGES)

    met = met.select("pivot", "member", "fresh", "unit", "floor").repartition("pivot").sortWithinPartitions("pivot")
    found = met.mapInArrow(run, EDGES).groupBy("node", "other").agg(F.max("cos").alias("cos"))
    old = edges.withColumn("fresh", F.lit(False))
    return _best(old.unionByName(found.withColumn("fresh", F.lit(True))), width)


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup batches that are sorted by ``pivot`` so that no pivot is cut between two tables."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        pivot = table["pivot"].to_numpy()
        cut = int(np.flatnonzero(pivot == pivot[-1])[0])
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if rest is not None:
        yield rest


def _checked(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """(node, n, last): of rows chosen by hash, how many nearest others there are and the distance of the last."""
    part = max(1, nodes.count() // CHECKED)
    unpacked = F.arrow_udf(
        lambda units: pa.array([np.frombuffer(u.as_py(), np.float64) for u in units], pa.list_(pa.float64())), T.ArrayType(T.DoubleType())
    )
    some = nodes.where(F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(part)) == 0)
    asked = some.select(F.col("node").cast("string").alias("query_id"), unpacked("unit").alias("vector"))
    rows = nodes.select(F.col("node").cast("string").alias("id"), unpacked("unit").alias("vector"))
    exact = knn.knn_join(asked, rows, k, exclude_same_id=True).groupBy(F.col("query_id").cast("long").alias("node"))
    return _written(exact.agg(F.count("*").alias("n"), F.max("distance").alias("last")), "checked")


def _recall(checked: DataFrame, edges: DataFrame) -> float:
    """Share of the nearest others that the lists of the ``checked`` rows hold; others as near count as well."""
    held = edges.join(F.broadcast(checked), "node").where(F.round(1.0 - F.col("cos"), 9) <= F.round("last", 9))
    held = held.groupBy("node").agg(F.count("*").alias("held"))
    row = checked.join(held, "node", "left").agg(F.sum(F.least("held", "n")).alias("held"), F.sum("n").alias("n")).head()
    return (row.held or 0) / row.n if row.n else 1.0


def _refined(
    nodes: DataFrame, edges: DataFrame, width: int, rounds: int, settled: float, seed: int, checked: DataFrame, want: float
) -> tuple[DataFrame, bool, bool]:
    """The lists after their rounds, whether they have settled, and whether they hold the share ``want``."""
    for at in range(rounds):
        edges = _written(_round(nodes, edges, width, seed + at), "graph")
        row = edges.agg(F.count_if("fresh").alias("fresh"), F.count("*").alias("n")).head()
        if row.fresh <= NEARLY * row.n and _recall(checked, edges) >= want:
            return edges, True, True
        if row.fresh <= settled * row.n:
            return edges, True, False
    return edges, False, False


def neighbor_graph(
    vectors: DataFrame, k: int, width: int | None = None, rounds: int = 12, settled: float = 0.005, seed: int = 7,
    recall: float = 0.9,
) -> DataFrame:
    """Approximate ``k`` nearest other rows of every row: query_id, id, file_path, rank, distance, score.

    Lists hold ``width`` entries (default ``3 k``) while they are refined; tables and rounds end when they hold
    the share ``recall`` of the nearest rows, and ``MARGIN`` more, as about ``CHECKED`` rows show, or when no
    more than the share ``settled`` of all entries is new. Lists that have settled and hold less are widened;
    where ``rounds`` do not suffice, they stay as they are. Rows without a direction have no neighbours.
    """
    width = max(k, width or 3 * k)
    nodes = _nodes(vectors)
    n = nodes.count()
    checked, want = _checked(nodes, k, seed), min(1.0, recall + MARGIN)
    edges, enough = _start(nodes, n, k, width, seed, checked, want)
    while not enough:
        edges, done, enough = _refined(nodes, edges, width, rounds, settled, seed, checked, want)
        if not done or enough or width >= n - 1:
            break
        width += width // 2 + 1
        edges = edges.withColumn("fresh", F.lit(True))  # what narrower lists refused must be met again
    names = [c for c in ("id", "file_path") if c in nodes.columns]
    asked = nodes.select("node", F.col("id").cast("string").alias("query_id"))
    found = edges.join(asked, "node").join(nodes.select(F.col("node").alias("other"), *names), "other")
    order = Window.partitionBy("node").orderBy(F.round("cos", COSINE_DECIMALS).desc(), *names)
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    distance = 1.0 - F.col("cos")
    return found.select("query_id", *names, "rank", distance.alias("distance"), distance_to_score(distance).alias("score"))
