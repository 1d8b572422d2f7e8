"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runtime settings every job relies on. They can be set on a live session.
SETTINGS = {
    # index times are instants and are printed in UTC
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # deep pages sort across executors instead of collecting into one heap
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
}

#: inputs up to this size are spread over all cores
SPREAD_BYTES = 1024**3

_local_base: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply ``SETTINGS`` to a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "skimdex", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with ``SETTINGS``; cluster sizing stays with the submitter."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, under the cluster's shared checkpoint folder.

    Only a local master may fall back to a temporary folder of its own; on a cluster such a folder
    would be invisible to the other machines, so a missing setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        if app not in _local_base:
            _local_base[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        base = _local_base[app]
    return f"{base.rstrip('/')}/skimdex/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows of a small input ahead of a Python stage, so that all cores take part.

    A few files, or files of one row group, would otherwise land in few tasks. The optimizer's size
    estimate decides, which runs nothing; large inputs have many splits and pass without a shuffle.
    """
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(estimate)) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def path_is_missing(problem: AnalysisException) -> bool:
    """Whether a read failed because nothing is there; any other failure must not read as empty."""
    return problem.getCondition() == "PATH_NOT_FOUND"


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A frame of ``schema`` without rows."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
