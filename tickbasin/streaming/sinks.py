"""Streaming sinks: hour-partitioned Parquet, fan-out to several writers, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources import storage

FLUSH_SECONDS = 300
Writer = Callable[[DataFrame, int], None]


def dataset_writer(base: str, dataset: str) -> Writer:
    """A writer that appends a micro-batch to a dataset."""
    return lambda batch, batch_id: storage.write(batch, base, dataset)


def fan_out(stream: DataFrame, writers: list[Writer], checkpoint: str, seconds: int = FLUSH_SECONDS, available_now: bool = False):
    """Starts a query that gives every micro-batch to all writers; a writer that fails fails the batch.

    The batch is kept while they write, so the stream is read once.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for writer in writers:
                writer(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()


def observed(stream: DataFrame, name: str = "feed") -> DataFrame:
    """Counts rows and the largest feed latency of each micro-batch; MetricLog receives them."""
    recv, exchange = F.col("recv_timestamp_us"), F.col("exchange_timestamp_us")
    late = F.when((exchange > 0) & (recv > exchange), recv - exchange)
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), F.max(late).alias("most_latency_us"))


class MetricLog(StreamingQueryListener):
    """Keeps the latest observed metrics and row counts of every query."""

    def __init__(self) -> None:
        self.latest: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.latest[str(event.id)] = {"rows": 0}

    def onQueryProgress(self, event) -> None:
        own = self.latest.setdefault(str(event.progress.id), {"rows": 0})
        own["rows"] += event.progress.numInputRows
        own["observed"] = {k: v.asDict() for k, v in (event.progress.observedMetrics or {}).items()}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.latest.setdefault(str(event.id), {"rows": 0})["ended"] = True
