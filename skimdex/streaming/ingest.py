"""Indexing files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from skimdex.plans.jobs import IndexOptions, index_arrivals
from skimdex.sources.tables import IndexStore


def incremental_index_stream(
    store: IndexStore,
    files: DataFrame,
    checkpoint: str,
    options: IndexOptions | None = None,
    name: str = "ingest",
    available_now: bool = True,
) -> StreamingQuery:
    """Start a stream that upserts every micro-batch of ``files`` into the index.

    ``files`` is a streaming frame with the columns of ``incremental_index_job``. A batch is
    compared with the index before it is merged, so a replayed batch writes nothing and streams that
    number their batches alike do not get in each other's way.
    Deletions are invisible to a stream and stay with the batch job.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        index_arrivals(store, batch, options, tag=f"{name}-{batch_id}")

    writer = files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
