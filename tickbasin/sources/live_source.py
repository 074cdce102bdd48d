"""A live feed as a streaming data source: offsets, a journal, admission, backoff and quotas.

A transport gives texts; sockets and polled venues can give none again, so what
the client receives is journalled before Spark is told of it.  A segment of the
journal is a file of message rows, named by the offsets that it holds, and makes
one partition.  A restarted query finds the segments of the batch that it has
not finished and of those that it has never planned, so nothing is lost or
repeated.  The journal's folder must be one that the driver and the executors
share; it is opened through Arrow's file systems.
"""

from __future__ import annotations

import json
import random
import sys
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..errors import EngineError, RateLimited
from . import feed

# the source's processes need not have this package
for module in (__name__, feed.__name__, "tickbasin.errors"):
    cloudpickle.register_pickle_by_value(sys.modules[module])

#: Offset digits in a segment's name, so that names sort as offsets do.
DIGITS = 20
FIELDS = [c.split()[0] for c in feed.SCHEMA.split(", ")]


class Transport(Protocol):
    """What a client reads from; a lost connection raises ConnectionError or an EngineError."""

    def connect(self, assets: list[str]) -> None:
        """Connects and subscribes to the assets."""

    def receive(self, most: int, wait_s: float) -> list[str]:
        """Up to so many texts, after waiting so long for the first."""

    def close(self) -> None:
        """Ends the connection."""


@dataclass
class Quota:
    """A bucket of requests: so many a window, refilled evenly, full at first."""

    requests: int = 1500
    window_s: int = 10
    clock: Callable[[], float] = time.monotonic
    held: float = field(init=False)
    at: float = field(init=False)

    def __post_init__(self) -> None:
        self.rate = feed.requests_per_second(self.requests, self.window_s)
        self.held, self.at = float(self.rate), self.clock()

    def delay(self) -> float:
        """Takes a request if there is one and gives 0, or else the seconds until there is one."""
        now = self.clock()
        self.held = min(float(self.rate), self.held + (now - self.at) * self.rate)
        self.at = now
        if self.held >= 1:
            self.held -= 1
            return 0.0
        return (1 - self.held) / self.rate


class Poller:
    """A transport that asks a venue for each asset's book in turn, once an interval and within a quota.

    fetch(asset) gives (status, text); statuses other than 2xx raise.
    """

    def __init__(self, fetch: Callable[[str], tuple[int, str]], interval_s: float = 60, quota: Quota | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.fetch, self.interval, self.clock, self.sleep = fetch, interval_s, clock, sleep
        self.quota = quota or Quota(clock=clock)
        self.due: dict[str, float] = {}

    def connect(self, assets: list[str]) -> None:
        self.due = {a: self.due.get(a, self.clock()) for a in assets}

    def receive(self, most: int, wait_s: float) -> list[str]:
        out: list[str] = []
        until = self.clock() + wait_s
        while len(out) < most and self.due:
            asset = min(self.due, key=lambda a: self.due[a])
            pause = max(self.due[asset] - self.clock(), 0)
            pause = pause or self.quota.delay()
            if pause:
                if self.clock() + pause > until:
                    break
                self.sleep(pause)
                continue
            self.due[asset] = max(self.due[asset] + self.interval, self.clock())
            status, text = self.fetch(asset)
            feed.check_status(status)
            out.append(text)
        return out

    def close(self) -> None:
        self.due = {}


class Client:
    """Reads a transport and reconnects with backoff; connection changes are rows of their own."""

    def __init__(self, transport: Transport, assets: list[str], base_ms: int = 500, most_ms: int = 30_000, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, now_us: Callable[[], int] = lambda: time.time_ns() // 1000, jitter: Callable[[], float] = random.random, session: Callable[[], str] = lambda: uuid.uuid4().hex):
        self.transport, self.assets, self.base_ms, self.most_ms = transport, assets, base_ms, most_ms
        self.clock, self.sleep, self.now_us, self.jitter, self.session = clock, sleep, now_us, jitter, session
        self.connected, self.attempt, self.not_before = False, 0, 0.0

    def _row(self, kind: str, text: str | None = None, session: str | None = None, details: str | None = None) -> dict:
        return {"kind": kind, "text": text, "recv_timestamp_us": self.now_us(), "session_id": session, "details": details}

    def poll(self, most: int, wait_s: float) -> list[dict]:
        """Up to so many rows, within about so many seconds; a failure waits longer each time and never raises."""
        rows: list[dict] = []
        until = self.clock() + wait_s
        while len(rows) < most:
            left = until - self.clock()
            if not self.connected:
                pause = self.not_before - self.clock()
                if pause > 0:
                    if pause > left:
                        break
                    self.sleep(pause)
            try:
                if not self.connected:
                    self.transport.connect(self.assets)
                    self.connected = True
                    rows.append(self._row("reconnect_success", session=self.session(), details=f"connected after {self.attempt} failed attempts"))
                    continue
                texts = self.transport.receive(most - len(rows), max(0.0, left))
                self.attempt = 0
            except (ConnectionError, EngineError, TimeoutError, OSError) as e:
                if self.connected or not self.attempt:
                    rows.append(self._row("reconnect_start", details=f"{'slowed down' if isinstance(e, RateLimited) else 'lost'}: {e}"))
                self.connected = False
                self.not_before = self.clock() + feed.backoff_ms(self.attempt, self.base_ms, self.most_ms, self.jitter()) / 1000
                self.attempt += 1
                continue
            rows += [self._row("raw", text=t) for t in texts]
            if not texts or self.clock() >= until:
                break
        return rows


class Journal:
    """Segments of message rows in a shared folder, each made by one rename."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        self.fs.create_dir(self.folder, recursive=True)

    def segments(self) -> list[tuple[int, int, str]]:
        """(first offset, offset behind the last, path) of every segment, in order."""
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.folder))
        return sorted((*map(int, f.base_name.removesuffix(".json").split("-")), f.path) for f in found if f.base_name.endswith(".json"))

    def append(self, start: int, rows: list[dict]) -> int:
        """Adds rows from an offset on and gives the offset behind them."""
        end = start + len(rows)
        draft, name = f"{self.folder}/.draft-{uuid.uuid4().hex}", f"{self.folder}/{start:0{DIGITS}}-{end:0{DIGITS}}.json"
        with self.fs.open_output_stream(draft) as out:
            out.write("".join(json.dumps({"arrival": start + k, **row}) + "\n" for k, row in enumerate(rows)).encode())
        self.fs.move(draft, name)
        return end

    def read(self, path: str, first: int, end: int) -> Iterator[tuple]:
        """A segment's rows with offsets in [first, end)."""
        with self.fs.open_input_stream(path) as data:
            for line in data.read().decode().splitlines():
                row = json.loads(line)
                if first <= row["arrival"] < end:
                    yield tuple(row.get(name) for name in FIELDS)

    def forget(self, before: int) -> None:
        """Deletes segments that end at an offset or earlier, but the newest, which keeps the count."""
        for _, end, path in self.segments()[:-1]:
            if end <= before:
                self.fs.delete_file(path)


class Segment(InputPartition):
    """A part of a segment."""

    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class FeedReader(DataSourceStreamReader):
    """Offsets are counts of messages; asking for the latest one receives and journals what has come."""

    def __init__(self, client: Callable[[], Client], journal: str, most: int, wait_s: float, segments: int = 1):
        self.make, self.folder, self.most, self.wait_s, self.segments = client, journal, most, wait_s, segments
        self.client: Client | None = None

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        journal = Journal(self.folder)
        found = journal.segments()
        end = found[-1][1] if found else 0
        self.client = self.client or self.make()
        for _ in range(self.segments):
            rows = self.client.poll(self.most, self.wait_s)
            end = journal.append(end, rows) if rows else end
            if len(rows) < self.most:  # no more has come yet
                break
        return {"next": end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = start["next"], end["next"]
        return [Segment(path, max(a, first), min(b, last)) for a, b, path in Journal(self.folder).segments() if a < last and b > first]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return Journal(self.folder).read(partition.path, partition.first, partition.end)

    def commit(self, end: dict) -> None:
        Journal(self.folder).forget(end["next"])

    def stop(self) -> None:
        if self.client:
            self.client.transport.close()


def register(spark: SparkSession, client: Callable[[], Client], name: str = "live_feed") -> str:
    """Registers a source that reads a client; gives its name for spark.readStream.format().

    client() is called where the source runs, once a run of a query.  Options:
    journal (a shared folder, one for each query), most (messages of a segment
    of the journal, 10,000), segments (of a micro-batch, read by as many tasks,
    as long as each is full, 1) and wait_s (seconds that a segment waits, 1).
    """
    class LiveFeed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return feed.SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            if "journal" not in self.options:
                raise ValueError("the option journal must name a shared folder")
            return FeedReader(client, self.options["journal"], int(self.options.get("most", 10_000)), float(self.options.get("wait_s", 1)), int(self.options.get("segments", 1)))

    spark.dataSource.register(LiveFeed)
    return name
