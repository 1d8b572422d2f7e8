"""Exact deduplication with keyed streaming state.

A stream of slim rows (digest, doc_id, row) is folded into one state entry per digest: the smallest
identifier, the locator of its row and the number of rows. The state lives in RocksDB under the
checkpoint folder and never expires, so later arrivals meet everything seen before. Digests only
propose: where a digest was hit, the whole normalised texts are compared before a row is dropped.

Defined results: null texts count as empty; a null doc_id ranks behind all others; of rows that
repeat both doc_id and text one stays; an empty table gives an empty result; other columns pass
through untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skimdex.llm.common import SPACE, session, stored
from skimdex.session import work_dir

_STATE = "spark.sql.streaming.stateStore."
#: disk-backed state; one store per shuffle partition, so none may reserve space ahead
SETTINGS = {
    _STATE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    _STATE + "rocksdb.allowFAllocate": "false",
    _STATE + "rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


class DedupState:
    """Keyed state of everything seen, kept under ``folder``; feed it again to go on."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def feed(self, path: str, schema, files_per_batch: int | None = None) -> None:
        """Fold the slim rows below ``path`` that were not folded before into the state."""
        for key, value in SETTINGS.items():
            self.spark.conf.set(key, value)
        reader = self.spark.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
        seen = reader.parquet(path).groupBy("digest").agg(best.alias("keep"), F.count("*").alias("n"))
        query = (
            seen.writeStream.format("noop").outputMode("update")
            .option("checkpointLocation", self.folder).trigger(availableNow=True).start()
        )
        query.awaitTermination()

    def entries(self) -> DataFrame:
        """(digest, keep_id, keep_row, n) of every digest seen."""
        state = self.spark.read.format("statestore").load(self.folder)
        names = state.schema["value"].dataType.names
        keep, n = F.col("value").getField(names[0]), F.col("value").getField(names[1])
        return state.select(
            F.col("key.digest").alias("digest"), keep["doc_id"].alias("keep_id"), keep["row"].alias("keep_row"),
            n.alias("n"),
        )


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept.

    ``digest`` may be any string function of the normalised text; equal digests of different texts
    are told apart by their bytes.
    """
    spark = session(docs)
    path = work_dir(spark, "dedup-slim")
    slim = docs.select("doc_id", digest(normalised(F.col("text"))).alias("digest"))
    slim.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    state = DedupState(spark, work_dir(spark, "dedup-state"))
    state.feed(path, rows.schema)
    entries = stored(state.entries(), "dedup-entries")

    hits = entries.where("n > 1").select("digest")
    flagged = rows.join(hits, "digest", "left_semi").select("doc_id", "digest")
    flagged = flagged.repartition("doc_id", "digest").distinct()  # else a hot digest would stay in one task
    named = flagged.where("doc_id IS NOT NULL")
    texts = docs.select("doc_id", "text").join(named, "doc_id")
    if flagged.where("doc_id IS NULL").limit(1).count():
        unnamed = docs.where("doc_id IS NULL").select("doc_id", "text")
        key = digest(normalised(F.col("text")))
        texts = texts.unionByName(
            unnamed.withColumn("digest", key).join(flagged.where("doc_id IS NULL").select("digest"), "digest", "left_semi")
        )
    body = texts.select("doc_id", "digest", normalised(F.col("text")).alias("body"))
    body = body.where(digest(F.col("body")) == F.col("digest"))  # of repeated ids, the text that was meant
    # all texts behind a digest are equal exactly if the smallest equals the largest; a group of any
    # size shrinks to one row per task ahead of the shuffle
    spans = body.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    clashes = stored(spans.where("low <> high").select("digest"), "dedup-clashes")

    whole = rows.join(entries, "digest").select(
        "doc_id", "digest", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept")
    )
    if not clashes.limit(1).count():
        return whole
    return whole.join(clashes, "digest", "left_anti").unionByName(_by_bytes(docs, clashes, digest))


def _by_bytes(docs: DataFrame, clashes: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The same columns for rows whose digest stands for several texts: grouped by the text itself."""
    body = docs.select("doc_id", normalised(F.col("text")).alias("body"))
    body = body.withColumn("digest", digest(F.col("body"))).join(clashes, "digest", "left_semi")
    body = stored(body.withColumn("row", F.monotonically_increasing_id()), "dedup-bytes")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("keep")
    groups = body.groupBy("digest", "body").agg(best, F.count("*").alias("group_size"))
    return body.join(groups, ["digest", "body"]).select(
        "doc_id", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with one row of every group of equal texts, all columns."""
    kept = stored(exact_groups(docs).where("kept").select("doc_id", "digest"), "dedup-kept")
    same = docs["doc_id"].eqNullSafe(kept["doc_id"]) & (sha256(normalised(docs["text"])) == kept["digest"])
    stay = docs.join(kept, same, "left_semi")
    # only where an identifier repeats can a kept (doc_id, digest) stand for more than one row
    if not docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return stay
    rows = stay.select(F.struct(*stay.columns).alias("row"), "doc_id", sha256(normalised(F.col("text"))).alias("digest"))
    return rows.dropDuplicates(["doc_id", "digest"]).select("row.*")
