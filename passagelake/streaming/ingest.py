"""Continuous ingest of a growing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..sources.files import stream_uploads


def start_ingest(
    engine: Engine,
    source: str | DataFrame,
    checkpoint: str,
    name: str = "ingest",
    **trigger,
) -> StreamingQuery:
    """Feed new files (or a stream of uploads) to ``engine.ingest``, batch by batch.

    The segment of a batch is named after the stream and the batch number: a batch that
    is replayed after a failure overwrites what it left behind, and one that had been
    committed is skipped. Duplicates of earlier batches are found in the tables, which
    are the only state.
    """
    uploads = source
    if isinstance(source, str):
        uploads = stream_uploads(engine.spark, source, engine.settings.max_upload_bytes)

    def take(batch: DataFrame, batch_id: int) -> None:
        engine.ingest(batch, segment=f"{name}-{batch_id:010d}")

    return (
        uploads.writeStream.queryName(name)
        .foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
