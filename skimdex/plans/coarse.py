"""The coarse index of a store: a slim copy of its vectors laid out by cell, extended by every build.

Centroids are trained once per base of the vector table, on a bounded share of its rows, and kept.
A refresh assigns only the rows of generations that have no cells yet. Rows that were written after
the last refresh are unplaced and part of every search, so an index that lags behind costs time
and never answers.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimdex.functions.vectors import dot
from skimdex.operators.ann import UNPLACED, assign_cells, cell_radii, train_centroids
from skimdex.session import path_is_missing
from skimdex.sources.tables import IndexStore

#: k-means sees at least all rows of a small table and about so many rows per cell of a large one
TRAIN_ROWS_PER_CELL = 1000
SLIM = ("id", "file_path", "chunk_index", "vector", "gen")
RADII = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())])
DONE = T.StructType([T.StructField("upto", T.LongType())])


class CoarseIndex:
    """Cells and centroids under ``<store>/coarse/base=<base>``."""

    def __init__(self, store: IndexStore):
        self.spark, self.vectors = store.spark, store.vectors
        self.root = f"{store.root}/coarse"

    def _home(self, base: int) -> str:
        return f"{self.root}/base={base}"

    def _done(self, base: int) -> list[int]:
        """Last generation of every finished refresh, one number per refresh since the base."""
        try:
            log = self.spark.read.schema(DONE).parquet(f"{self._home(base)}/done")
        except AnalysisException as problem:
            if not path_is_missing(problem):
                raise
            return []
        return sorted(r.upto for r in log.distinct().collect())

    def refresh(self, cells: int, seed: int = 7, iterations: int = 20) -> bool:
        """Lay out the generations that have no cells yet; whether there were any.

        A refresh is finished by its row in ``done``; what a dead one left behind is overwritten.
        """
        now = self.vectors.state()
        done = self._done(now.base)
        if not now.gen or (done and done[-1] == now.gen):
            return False
        home = self._home(now.base)
        if not done:
            rows = self.vectors.read().select("vector").where(dot(F.col("vector"), F.col("vector")) > 0)
            n = rows.count()
            if not n:
                return False
            share = min(1.0, TRAIN_ROWS_PER_CELL * cells / n)
            fitted = train_centroids(rows, cells, seed, share, iterations)
            fitted.coalesce(1).write.mode("overwrite").parquet(f"{home}/centroids")
        centroids = self.spark.read.parquet(f"{home}/centroids")
        fresh = self.vectors.written(done[-1] + 1 if done else now.base, now.gen).select(*SLIM)
        # the hint gathers a cell's rows and lets adaptive execution split a cell that holds many
        laid_out = assign_cells(fresh, centroids).hint("rebalance", "cell")
        laid_out.write.mode("overwrite").partitionBy("cell").parquet(f"{home}/cells/upto={now.gen}")
        fields = T.StructType([*(f for f in fresh.schema if f.name == "vector"), RADII["cell"]])
        written = self.spark.read.schema(fields).parquet(f"{home}/cells/upto={now.gen}")
        radii = cell_radii(written, centroids)
        radii.coalesce(1).write.mode("overwrite").parquet(f"{home}/radii/upto={now.gen}")
        self.spark.createDataFrame([(now.gen,)], DONE).coalesce(1).write.mode("append").parquet(f"{home}/done")
        return True

    def radii(self) -> DataFrame | None:
        """(cell, radius) over all finished refreshes; None without an index or if one stored none."""
        base = self.vectors.state().base
        done = self._done(base)
        try:
            kept = self.spark.read.schema(RADII).parquet(*[f"{self._home(base)}/radii/upto={n}" for n in done]) if done else None
        except AnalysisException as problem:
            if not path_is_missing(problem):
                raise
            return None
        return kept.groupBy("cell").agg(F.max("radius").alias("radius")) if done else None

    def tables(self) -> tuple[DataFrame, DataFrame] | None:
        """(cells, centroids): every live row with its cell, ``UNPLACED`` where it has none yet; None without an index."""
        now = self.vectors.state()
        done = self._done(now.base)
        if not done:
            return None
        home = self._home(now.base)
        fields = [f for f in self.vectors.schema if f.name in SLIM]
        number = lambda name, kind: T.StructField(name, kind)
        schema = T.StructType([*fields, number("gen", T.LongType()), number("upto", T.LongType()), number("cell", T.IntegerType())])
        kept = self.spark.read.schema(schema).parquet(f"{home}/cells").where(F.col("upto").isin(done)).drop("upto")
        if done[-1] < now.gen:
            later = self.vectors.written(done[-1] + 1, now.gen).select(*SLIM)
            kept = kept.unionByName(later.withColumn("cell", F.lit(UNPLACED)))
        return self.vectors.live(kept, now), self.spark.read.parquet(f"{home}/centroids")
