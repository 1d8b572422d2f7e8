"""Append-only generations of a Parquet table, so that a write never rewrites the table.

Every write adds one numbered generation: new rows under ``rows/gen=N`` and the keys it replaces or
deletes under ``gone/gen=N``. One row in ``log`` makes the generation visible; a job that dies
earlier leaves nothing behind that readers would see, and the next attempt overwrites its folders.
Readers drop rows whose key was replaced by a later generation; compaction folds everything into a
new base. One writer at a time, as many readers as you like.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimdex.functions.vectors import fit_vector_dim
from skimdex.operators.upsert import latest
from skimdex.operators.maintain import RETENTION_HOURS, prune_versions
from skimdex.schemas import META, VECTORS
from skimdex.session import empty, path_is_missing

LOG = T.StructType(
    [
        T.StructField("gen", T.LongType()),
        T.StructField("base", T.LongType()),
        T.StructField("n_gone", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


class IndexTable:
    """A keyed table under ``root``; all rows of one ``key`` value are replaced together."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, fit_width: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema
        self.key = key
        self.fit_width = fit_width

    # -- state ---------------------------------------------------------------------------------

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.root}/log")
        except AnalysisException as problem:
            if not path_is_missing(problem):
                raise
            return empty(self.spark, LOG)

    def state(self) -> Row:
        """Current generation, its base (0 when nothing was written) and keys gone since the base."""
        newest = F.max(F.struct("gen", "base", "n_gone")).alias("s")
        found = self.log().agg(newest).select("s.*").head()
        return Row(gen=0, base=0, n_gone=0) if found.gen is None else found

    def last_tag(self) -> str:
        """Tag of the newest write, empty if nothing was written."""
        found = self.log().agg(F.max_by("tag", "gen")).head()[0]
        return found or ""

    def committed(self, tag: str) -> bool:
        return self.log().where(F.col("tag") == tag).limit(1).count() > 0

    def versions(self) -> DataFrame:
        """One row per generation: version, created_at, retired_at, is_current.

        A generation retires when a newer base no longer needs it. The window runs over the commit
        log, which has one row per write.
        """
        later = Window.orderBy("gen").rowsBetween(1, Window.unboundedFollowing)
        new_base = F.when(F.col("gen") == F.col("base"), F.col("created_at"))
        retired = F.min(new_base).over(later)
        return self.log().select(
            F.col("gen").alias("version"),
            "created_at",
            retired.alias("retired_at"),
            retired.isNull().alias("is_current"),
        )

    # -- read ----------------------------------------------------------------------------------

    def _generations(self, kind: str, schema: T.StructType, low: int, high: int) -> DataFrame:
        with_gen = T.StructType([*schema.fields, T.StructField("gen", T.LongType())])
        try:
            rows = self.spark.read.schema(with_gen).parquet(f"{self.root}/{kind}")
        except AnalysisException as problem:
            if not path_is_missing(problem):
                raise
            return empty(self.spark, with_gen)
        return rows.where(F.col("gen").between(low, high))

    def read(self) -> DataFrame:
        """Live rows; an index that was never written reads as empty.

        Keys replaced since the last compaction are anti-joined; statistics decide whether they travel
        to the scan.
        """
        now = self.state()
        return self.live(self.written(now.base, now.gen), now)

    def written(self, low: int, high: int) -> DataFrame:
        """Rows that the generations from ``low`` to ``high`` wrote, replaced ones included, with ``gen``."""
        return self._generations("rows", self.schema, low, high)

    def live(self, rows: DataFrame, now: Row) -> DataFrame:
        """``rows`` of a state, with ``gen``, without those that a later generation replaced."""
        if not now.n_gone:
            return rows.drop("gen")
        gone_key = T.StructType([self.schema[self.key]])
        gone = self._generations("gone", gone_key, now.base + 1, now.gen)
        last = gone.groupBy(self.key).agg(F.max("gen").alias("gone_gen"))
        later = (rows[self.key] == last[self.key]) & (rows["gen"] < last["gone_gen"])
        return rows.join(last, later, "left_anti").drop("gen")

    def count(self) -> DataFrame:
        return self.read().agg(F.count(F.lit(1)).alias("n_rows"))

    def _widths(self, rows: DataFrame) -> tuple[int, int] | None:
        size = F.size("vector")
        found = rows.where("vector IS NOT NULL").agg(F.min(size).alias("low"), F.max(size).alias("high")).head()
        return None if found.low is None else (found.low, found.high)

    def width(self) -> int | None:
        """Entries of the table's vectors; None while it holds none."""
        now = self.state()
        rows = self._generations("rows", self.schema, now.base, now.gen).where("vector IS NOT NULL")
        found = rows.select(F.size("vector").alias("n")).head()
        return found.n if found else None

    def _check_width(self, written: DataFrame) -> None:
        """A build keeps one width per table, so that no row silently drops out of every search."""
        new = self._widths(written)
        if new is None:
            return
        want = self.width() or new[0]
        if new != (want, want):
            raise ValueError(f"vectors have {new[0]} to {new[1]} entries, the table holds {want}; see fit_width")

    # -- write ---------------------------------------------------------------------------------

    def _write(self, kind: str, gen: int, rows: DataFrame | None, schema: T.StructType) -> str:
        """Fill a generation folder; an empty write clears what a dead job may have left there."""
        path = f"{self.root}/{kind}/gen={gen}"
        rows = empty(self.spark, schema) if rows is None else rows.select(*schema.names)
        rows.write.mode("overwrite").parquet(path)
        return path

    def _commit(
        self,
        now: Row,
        replaced: DataFrame | None,
        action: str,
        tag: str = "",
        new_base: bool = False,
    ) -> int:
        """Make generation ``now.gen + 1``, whose rows are already written, visible."""
        gen = now.gen + 1
        keys = replaced.select(self.key).distinct() if replaced is not None and now.gen else None
        gone = self._write("gone", gen, keys, T.StructType([self.schema[self.key]]))
        fresh = new_base or now.gen == 0
        # readers skip the gone keys when there are none, so the number comes from the files
        added = 0 if fresh or keys is None else self.spark.read.parquet(gone).count()
        n_gone = 0 if fresh else now.n_gone + added
        base = gen if fresh else now.base
        entry = self.spark.range(1).select(
            F.lit(gen).cast("long").alias("gen"),
            F.lit(base).cast("long").alias("base"),
            F.lit(n_gone).cast("long").alias("n_gone"),
            F.lit(action).alias("action"),
            F.lit(tag).alias("tag"),
            F.current_timestamp().alias("created_at"),
        )
        entry.coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return gen

    def upsert(
        self, updates: DataFrame, replaced: DataFrame | None = None, tag: str = "", one_width: bool = False
    ) -> int:
        """Insert rows and replace what their keys held before. Empty input changes nothing.

        With ``one_width`` vectors of another width than the table's are an error, and nothing becomes
        visible; a table with ``fit_width`` pads or cuts them instead.

        Where the key names single rows (``id``, or the path of a metadata row), of several updates
        with one key only the last in column order is written. Pass ``replaced`` when the caller already
        knows the keys, which also covers keys that have no rows any more.
        """
        now = self.state()
        if self.key == self.schema.names[0]:
            rest = [F.col(c) for c in self.schema.names if c != self.key]
            updates = latest(updates.select(*self.schema.names), [self.key], F.struct(*rest))
        if self.fit_width:
            updates = updates.withColumn("vector", fit_vector_dim(F.col("vector"), self.fit_width))
        staged = self._write("rows", now.gen + 1, updates, self.schema)
        written = self.spark.read.schema(self.schema).parquet(staged)
        if one_width:
            self._check_width(written)
        if (replaced is None or replaced.isEmpty()) and written.isEmpty():
            return now.gen
        if replaced is None:
            replaced = written.select(self.key)
        return self._commit(now, replaced, "upsert", tag)

    def delete(self, keys: DataFrame, tag: str = "") -> int:
        """Delete all rows of the keys."""
        now = self.state()
        self._write("rows", now.gen + 1, None, self.schema)
        return self._commit(now, keys, "delete", tag)

    def clear(self) -> int:
        """Start a new, empty base."""
        now = self.state()
        self._write("rows", now.gen + 1, None, self.schema)
        return self._commit(now, None, "clear", new_base=True)

    def compact(self, target_files: int | None = None) -> int:
        """Rewrite the live rows as a new base and check that no row was lost, added or renamed.

        Without ``target_files`` the rebalance hint lets adaptive execution choose file sizes.
        """
        now = self.state()
        live = self.read()
        total = F.sum(F.xxhash64(*self.schema.names).cast("decimal(38,0)"))
        checks = [F.count(F.lit(1)).alias("n"), total.alias("x")]
        before = live.agg(*checks).head()
        if target_files:
            live = live.repartitionByRange(target_files, self.key, self.schema.names[0])
            live = live.sortWithinPartitions(self.key)
        else:
            live = live.hint("rebalance")
        staged = self._write("rows", now.gen + 1, live, self.schema)
        after = self.spark.read.schema(self.schema).parquet(staged).agg(*checks).head()
        if before != after:
            raise RuntimeError(f"compaction changed the table: {before} became {after}")
        return self._commit(now, None, "compact", new_base=True)

    def vacuum(self, retention_hours: int) -> int:
        """Delete folders of generations that retired longer ago than the retention."""
        retired = self.versions().select(
            "version", F.col("retired_at").alias("created_at"), "is_current"
        )
        old = prune_versions(retired, retention_hours, F.current_timestamp())
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        dropped = 0
        for row in old.select("version").toLocalIterator():
            for kind in ("rows", "gone"):
                target = fs_path(f"{self.root}/{kind}/gen={row.version}")
                target.getFileSystem(conf).delete(target, True)
            dropped += 1
        return dropped


class IndexStore:
    """The two tables of an index: vectors and per-file metadata.

    ``vector_key`` decides what an upsert replaces: ``file_path`` swaps all rows of a file, ``id``
    swaps single rows, so files of equal content share one image row. ``fit_width`` pads or cuts every
    written vector to that many entries.
    """

    def __init__(self, spark: SparkSession, root: str, vector_key: str = "file_path", fit_width: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.vectors = IndexTable(spark, f"{self.root}/vectors", VECTORS, vector_key, fit_width)
        self.meta = IndexTable(spark, f"{self.root}/meta", META, "file_path")

    def delete_paths(self, paths: DataFrame) -> None:
        """Remove files from both tables."""
        self.meta.delete(paths)
        if self.vectors.key == "file_path":
            self.vectors.delete(paths)
        else:
            hit = self.vectors.read().join(paths.select("file_path").distinct(), "file_path", "left_semi")
            self.vectors.delete(hit.select(self.vectors.key))

    def optimize(self, target_files: int | None = None, retention_hours: int = RETENTION_HOURS) -> None:
        """Compact both tables, then delete generations nobody may need any more."""
        for table in (self.vectors, self.meta):
            table.compact(target_files)
            table.vacuum(retention_hours)

    def clear(self) -> None:
        self.meta.clear()
        self.vectors.clear()


def scan_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Live rows of the vector table under an index root."""
    return IndexStore(spark, path).vectors.read()


def scan_meta(spark: SparkSession, path: str) -> DataFrame:
    """All metadata rows under an index root."""
    return IndexStore(spark, path).meta.read()
