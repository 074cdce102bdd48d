"""Counters and histograms of the streams: observed by Spark where rows flow, counted where they don't.

Histograms have fixed bounds, so batches add up; a quantile sketch goes with
each batch's latencies and merges as well.
"""

from __future__ import annotations

import threading
import time
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..schemas import DELTA, SNAPSHOT

# The counters and the histograms.
COUNTERS = ["messages_received", "snapshots_applied", "deltas_applied", "trades_received", "gaps_detected", "reconnections", "snapshots_reconciled", "stale_snapshots_skipped", "storage_flushes", "rest_requests", "rotations", "discovery_failures"]
HISTOGRAMS = {
    "ws_latency_us": [1_000, 5_000, 10_000, 50_000, 100_000, 500_000, 1_000_000, 5_000_000, 10_000_000], "message_processing_us": [1, 2, 5, 10, 20, 50, 100, 500, 1_000, 10_000],
    "storage_flush_ms": [5, 10, 20, 50, 100, 500, 1_000, 5_000, 30_000],
}


def histogram(value: Column, bounds: list[int]) -> Column:
    """Rows by the first bound that is not below the value, and those above all: an aggregate of one array."""
    edges = [None, *bounds, None]

    def inside(low: int | None, high: int | None) -> Column:
        of = value.isNotNull()
        of = of if low is None else of & (value > low)
        return F.count_if(of if high is None else of & (value <= high))

    return F.array(*[inside(a, b) for a, b in zip(edges, edges[1:], strict=False)])


def of_tagged(tagged: DataFrame) -> list[Column]:
    """Aggregates of a tagged stream or table, by the names of the counters and of the latency histogram.

    A reconciled snapshot is counted by its first row, so one without rows is not.
    """
    def count(condition: Column, name: str) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)

    kind, note = F.col("book_events.event_kind"), F.col("ingest_events.event_kind")
    exchange = F.coalesce(F.col("book_events.exchange_timestamp_us"), F.col("trade_events.exchange_timestamp_us"))
    recv = F.coalesce(F.col("book_events.recv_timestamp_us"), F.col("trade_events.recv_timestamp_us"))
    late = F.when((exchange > 0) & (recv > exchange), recv - exchange)
    return [
        F.count(F.lit(1)).alias("messages_received"), count(kind == SNAPSHOT, "snapshots_applied"), count(kind == DELTA, "deltas_applied"), count(F.col("dataset") == "trade_events", "trades_received"),
        count(note == "sequence_gap", "gaps_detected"), count(note == "reconnect_success", "reconnections"), count((kind == SNAPSHOT) & (F.col("book_events.sequence") == 0), "snapshots_reconciled"),
        count(note == "stale_snapshot_skip", "stale_snapshots_skipped"), histogram(late, HISTOGRAMS["ws_latency_us"]).alias("ws_latency_us"), F.kll_sketch_agg_bigint(late).alias("ws_latency_sketch"),
    ]


def measured(tagged: DataFrame, name: str = "feed") -> DataFrame:
    """The tagged stream with its counters and latencies observed; Metrics receives them."""
    return tagged.observe(name, *of_tagged(tagged))


class Metrics(StreamingQueryListener):
    """Sums of all counters and histograms of the queries of a session, from its start or reset() on.

    Register it with spark.streams.addListener().  count() and add() are for
    what happens outside of queries: requests, rotations, failed discoveries.
    """

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.reset()

    def reset(self) -> None:
        """Starts anew."""
        self.counters: Counter = Counter(dict.fromkeys(COUNTERS, 0))
        self.histograms = {name: [0] * (len(bounds) + 1) for name, bounds in HISTOGRAMS.items()}
        self.sketches: list[bytes] = []

    def count(self, name: str, n: int = 1) -> None:
        """Adds to a counter."""
        if name not in COUNTERS:
            raise KeyError(name)
        with self.lock:
            self.counters[name] += n

    def add(self, name: str, value: float, n: int = 1) -> None:
        """Adds a value, or several equal ones, to a histogram."""
        with self.lock:
            self.histograms[name][bisect_left(HISTOGRAMS[name], value)] += n

    @contextmanager
    def flush(self) -> Iterator[None]:
        """Times one flush of a sink and counts it."""
        began = time.monotonic()
        yield
        self.add("storage_flush_ms", (time.monotonic() - began) * 1000)
        self.count("storage_flushes")

    def timed(self, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """A writer of micro-batches whose flushes are measured."""
        def each(batch: DataFrame, batch_id: int) -> None:
            with self.flush():
                write(batch, batch_id)

        return each

    def quantiles(self, spark: SparkSession, shares: list[float]) -> list[int]:
        """Quantiles of all observed latencies, by merged sketches; empty if there were none."""
        with self.lock:
            held = [(s,) for s in self.sketches]
        if not held:
            return []
        merged = spark.createDataFrame(held, "s binary").agg(F.kll_merge_agg_bigint("s").alias("s"))
        return list(merged.select(F.array(*[F.kll_sketch_get_quantile_bigint("s", F.lit(q)) for q in shares])).first()[0])

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        for row in (progress.observedMetrics or {}).values():
            got = row.asDict()
            for name in COUNTERS:
                self.count(name, got.get(name) or 0)
            with self.lock:
                for name in HISTOGRAMS:
                    self.histograms[name] = [a + b for a, b in zip(self.histograms[name], got.get(name) or [0] * len(self.histograms[name]), strict=True)]
                if got.get("ws_latency_sketch") and sum(got.get("ws_latency_us") or [0]):
                    self.sketches.append(bytes(got["ws_latency_sketch"]))
        took = progress.durationMs.get("addBatch", 0) if progress.durationMs else 0
        if progress.numInputRows:
            self.add("message_processing_us", took * 1000 / progress.numInputRows, progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
