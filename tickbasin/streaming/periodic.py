"""What a stream does by the clock: checkpoints, market rotation, and flushes by count or time.

Checkpoints and rotation follow the event clock of receipt: a timer fires when
the watermark passes it, so a rerun gives the same rows.  Rows must come in
order of arrival from batch to batch, and the watermark's delay must be above 0,
or rows that tie with the newest ones would count as late.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.codecs import levels_to_json, market_slug
from ..schemas import ASK, BID, SNAPSHOT
from .books import entries, numbered_table
from .packed import packed, put_out, unpacked

# executors need not have this package: its processors travel with the plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHECKPOINT_SECONDS = 60
#: Seconds of a market, and how long before its start its state begins.
MARKET_SECONDS, EARLY_SECONDS = 300, 10
#: Rows and milliseconds at which a buffer is flushed.
FLUSH_ROWS, FLUSH_MS = 10_000, 1000
CHECKPOINT_OUT = "asset_id string, at_us long, bids array<struct<price:int,size:long>>, asks array<struct<price:int,size:long>>"
ROTATED_OUT = "bucket long, asset_id string, recv_timestamp_us long, exchange_timestamp_us long, event_kind int, side int, price int, size long, sequence long, source_event_id string, stale_after_us long"
FLUSH_OUT = "key string, flush long, reason string, n long, row string"


def on_clock(rows: DataFrame, delay: str = "1 second") -> DataFrame:
    """The stream with the clock of receipt as its event time."""
    return rows.withColumn("event_time", F.timestamp_micros("recv_timestamp_us")).withWatermark("event_time", delay)


class Checkpointer(StatefulProcessor):
    """An asset's live book at the end of every interval since its first row, silent intervals too.

    A row beyond the interval's end closes it; where none comes, the timer does.
    """

    def __init__(self, interval_us: int):
        self.interval = interval_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", "side int, price int", "size long")
        self.head = handle.getValueState("head", "next_us long, last_key string")

    def _row(self, key, at: int, book: dict) -> tuple:
        bids = [(p, z) for (s, p), z in sorted(book.items(), reverse=True) if s == BID]
        asks = [(p, z) for (s, p), z in sorted(book.items()) if s == ASK]
        return key[0], at, [{"price": p, "size": z} for p, z in bids], [{"price": p, "size": z} for p, z in asks]

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["asset_id", "at_us", "bids", "asks"])

    def _book(self) -> dict:
        return {(int(k[0]), int(k[1])): int(v[0]) for k, v in self.levels.iterator()} if self.levels.exists() else {}

    def _timer(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        known = self.head.exists()
        following, last_key = self.head.get() if known else ((int(frame["recv_timestamp_us"].iloc[0]) // self.interval + 1) * self.interval, "")
        first = following if known else None
        book, out = self._book(), []
        before = dict(book)
        for row in frame.itertuples(index=False):
            while row.recv_timestamp_us > following:
                out.append(self._row(key, following, book))
                following += self.interval
            level, size = (int(row.side), int(row.price)), int(row.size)
            name = ""
            if row.event_kind == SNAPSHOT:
                name = f"{row.recv_timestamp_us}/{row.exchange_timestamp_us}/{'' if row.source_event_id is None else row.source_event_id}"
                if name != last_key:
                    book.clear()
            last_key = name
            if size > 0:
                book[level] = size
            elif row.event_kind != SNAPSHOT:
                book.pop(level, None)
        for level in before.keys() - book.keys():
            self.levels.removeKey(level)
        for level, size in book.items():
            if before.get(level) != size:
                self.levels.updateValue(level, (size,))
        self.head.update((following, last_key))
        if following != first:
            if first:
                self.handle.deleteTimer(first // 1000 + 1)
            self._timer(following)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        following, last_key = self.head.get()
        book, out = self._book(), []
        while following // 1000 + 1 <= timerValues.getCurrentWatermarkInMs():
            out.append(self._row(key, following, book))
            following += self.interval
        if out:
            self.head.update((following, last_key))
            self._timer(following)
        yield self._frame(out)

    def close(self) -> None:
        pass


def checkpoints(events: DataFrame, seconds: int = CHECKPOINT_SECONDS, delay: str = "1 second") -> DataFrame:
    """The stream of every asset's book at the end of each interval, of a stream of book events with arrival: asset_id, at_us, bids, asks."""
    columns = ["asset_id", "arrival", "event_kind", "side", "price", "size", "recv_timestamp_us", "exchange_timestamp_us", "source_event_id", "event_time"]
    return on_clock(events, delay).select(*columns).groupBy("asset_id").transformWithStateInPandas(Checkpointer(seconds * 1_000_000), CHECKPOINT_OUT, "Append", "EventTime")


def checkpoint_rows(found: DataFrame) -> DataFrame:
    """Those books as book_checkpoints rows."""
    ts, none = F.col("at_us"), F.lit(None).cast("string")
    return found.select(
        ts.alias("checkpoint_timestamp_us"), ts.alias("recv_timestamp_us"), ts.alias("exchange_timestamp_us"), "asset_id", F.lit("replay_validator").alias("source"), none.alias("source_event_id"), none.alias("source_session_id"),
        levels_to_json(F.col("bids")).alias("bids_json"), levels_to_json(F.col("asks")).alias("asks_json"),
    )


def market_bucket(recv_us: Column, period_s: int = MARKET_SECONDS, early_s: int = EARLY_SECONDS) -> Column:
    """Start (seconds) of the market that a row received at a time belongs to; the next one takes over a little early."""
    s = F.call_function("div", recv_us, F.lit(1_000_000)) + early_s
    return (s - s % period_s).cast("long")


class MarketNumberer(StatefulProcessor):
    """Numbers an asset's levels within a market and forgets the market's state when it is over.

    As the numberer of the feed, but every market starts from nothing.
    """

    def __init__(self, period_s: int):
        self.period = period_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "next long, latest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            self.handle.registerTimer((int(key[0]) + self.period) * 1000)
        following, latest = self.state.get() if self.state.exists() else (0, 0)
        table, following, latest = numbered_table(unpacked(rows, "arrival", "pos"), following, latest)
        self.state.update((following, latest))
        table = table.append_column("bucket", pa.repeat(int(key[0]), len(table))).append_column("asset_id", pa.repeat(key[1], len(table)).cast("string"))
        yield from put_out(table.select([c.split()[0] for c in ROTATED_OUT.split(", ")]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in ROTATED_OUT.split(", ")])

    def close(self) -> None:
        pass


def rotated(messages: DataFrame, period_s: int = MARKET_SECONDS, early_s: int = EARLY_SECONDS, delay: str = "1 second") -> DataFrame:
    """The stream of numbered levels and stale snapshots of a stream of messages, each market's on its own, with bucket and slug."""
    rows = entries(messages).withColumn("bucket", market_bucket(F.col("recv_timestamp_us"), period_s, early_s))
    # the clock of packed rows is that of their newest one, so the watermark is the same
    clocked = on_clock(packed(rows, "bucket", "asset_id", clock="recv_timestamp_us"), delay)
    # a market's timer must not fire before its last row, so it waits for the end of the period
    found = clocked.groupBy("bucket", "asset_id").transformWithStateInPandas(MarketNumberer(period_s), ROTATED_OUT, "Append", "EventTime")
    return found.withColumn("slug", market_slug(F.col("bucket")))


class FlushBuffer(StatefulProcessor):
    """Holds a key's rows back until there are enough of them or the oldest has waited long enough."""

    def __init__(self, rows: int, ms: int):
        self.most, self.ms = rows, ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "row string")
        self.head = handle.getValueState("head", "flush long, n long, timer long")

    def _flush(self, key, flush: int, reason: str, rows: list[str]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], flush, reason, len(rows), r) for r in rows], columns=["key", "flush", "reason", "n", "row"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        flush, n, timer = self.head.get() if self.head.exists() else (0, 0, 0)
        held: list[str] | None = None
        for frame in rows:
            for row in frame["row"].tolist():
                if held is None and n + 1 >= self.most:
                    held = [r[0] for r in self.rows.get()] if n else []
                    self.rows.clear()
                if held is None:
                    self.rows.appendValue((row,))
                    n += 1
                    continue
                held.append(row)
                if len(held) == self.most:
                    yield self._flush(key, flush, "rows", held)
                    flush, n, held = flush + 1, 0, None
                    if timer:
                        self.handle.deleteTimer(timer)
                        timer = 0
        if n and not timer:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.ms
            self.handle.registerTimer(timer)
        self.head.update((flush, n, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        flush, n, _ = self.head.get()
        held = [r[0] for r in self.rows.get()] if n else []
        self.rows.clear()
        self.head.update((flush + 1 if held else flush, 0, 0))
        yield self._flush(key, flush, "time", held)

    def close(self) -> None:
        pass


def flushed(rows: DataFrame, key: Column, most: int = FLUSH_ROWS, ms: int = FLUSH_MS) -> DataFrame:
    """The stream in flushes of a key's rows: key, flush (a number), reason (rows or time), n and row (JSON).

    A flush has exactly most rows, or fewer that have waited ms of processing
    time; a sink writes one batch for each.
    """
    held = rows.select(key.cast("string").alias("key"), F.to_json(F.struct("*")).alias("row"))
    return held.groupBy("key").transformWithStateInPandas(FlushBuffer(most, ms), FLUSH_OUT, "Append", "ProcessingTime")
