"""Streams into stores: the same appends and merges, batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from causalframe.sources.dataset import Dataset, Metadata
from causalframe.time import TimeRange


def _declared(batch: DataFrame, metadata: Metadata) -> TimeRange | None:
    return TimeRange.of(batch, metadata.time_col) if batch.head(1) else None


def _into(stream: DataFrame, write: Callable[[DataFrame], None], checkpoint: str) -> DataStreamWriter:
    def each(batch: DataFrame, _id: int) -> None:
        # Range and write both read the batch.
        batch = batch.persist()
        try:
            write(batch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def append_stream(stream: DataFrame, metadata: Metadata, checkpoint: str) -> DataStreamWriter:
    """Rows later than what is stored are appended; late rows are dropped. A batch that is
    delivered again changes nothing."""

    def write(batch: DataFrame) -> None:
        declared = _declared(batch, metadata)
        if declared is not None:
            metadata.store.append(Dataset(metadata, batch, declared))

    return _into(stream, write, checkpoint)


def merge_stream(stream: DataFrame, metadata: Metadata, checkpoint: str, keys: list[str] = ()) -> DataStreamWriter:
    """Late and backfilled rows are merged; stored values win."""

    def write(batch: DataFrame) -> None:
        declared = _declared(batch, metadata)
        if declared is None:
            return
        known = metadata.declared_time_range() if metadata.exists() else None
        if known is not None:
            # Batches follow one another: the declared range covers the gap between them.
            declared = TimeRange(min(known.start, declared.start), max(known.end, declared.end))
        metadata.store.merge(Dataset(metadata, batch, declared), keys)

    return _into(stream, write, checkpoint)


def bucketed(stream: DataFrame, on: str, width: str, late: str, keys: list[str], **aggregates) -> DataFrame:
    """Sums by fixed windows of time with a watermark, for streams whose late rows may be
    dropped after `late`. on must be a timestamp (Structured Streaming has no watermark on
    timestamp_ntz)."""
    return stream.withWatermark(on, late).groupBy(F.window(on, width), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])


def ready(inputs: list[Metadata], checker, as_of: datetime, start: datetime) -> bool:
    """Whether all inputs have reached the expected point: the gate before a downstream run."""
    return all(checker.is_complete(m, TimeRange(start, as_of)) for m in inputs)
