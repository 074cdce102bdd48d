"""The live book and the feed normalizer as stateful streams, one state per asset.

Rows of a micro-batch come to a processor in no order, so each call sorts its
rows by arrival; the source must deliver arrivals in order from batch to batch.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..errors import NotFound, NotReady
from ..functions.codecs import side_code
from ..functions.fixedpoint import price_from_text, size_from_text
from ..operators import normalize
from ..sample_feed import staged
from ..schemas import ASK, BID, DELTA, SNAPSHOT
from ..sources.feed import scratch
from .packed import only, packed, put_out, unpacked, whole

# executors need not have this package: its processors travel with the plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Partitions of a stream's state: each is a task with a store of its own in every micro-batch, however few keys it has.
STATE_PARTITIONS = 16
BOOK_OUT = "asset_id string, version long, sequence long, last_update_us long, has_book boolean, full boolean, side int, price int, size long"
#: Versions after which a reader of the best levels finds all of them again, and how far behind it may be to get changes.
FULL_EVERY = BUFFER = 256
NORMAL_OUT = "asset_id string, recv_timestamp_us long, exchange_timestamp_us long, event_kind int, side int, price int, size long, sequence long, source_event_id string, stale_after_us long"


@contextmanager
def stateful(spark: SparkSession, partitions: int = STATE_PARTITIONS):
    """The settings that a stream with state takes from its session when it is started; its checkpoint keeps the partitions."""
    mine = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.shuffle.partitions": str(partitions)}
    before = {name: spark.conf.get(name) for name in mine}
    for name, value in mine.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class Levels:
    """An asset's book in state, of which a micro-batch touches only the levels that it changes.

    Pages of 64 prices hold a bit for each level that is there, and the head a
    bit for each page that is not empty, so the best levels are found without
    reading the others.
    """

    def __init__(self, sizes, pages):
        self.sizes, self.pages = sizes, pages
        self.known: dict[tuple[int, int], int] = {}
        self.bits: dict[tuple[int, int], int] = {}
        self.changed: set[tuple[int, int]] = set()
        self.cleared = False

    def clear(self) -> None:
        """Empties the book, without a look at it."""
        self.sizes.clear()
        self.pages.clear()
        self.known, self.bits, self.changed, self.cleared = {}, {}, set(), True

    def size(self, level: tuple[int, int]) -> int:
        """Size of a level; 0 if it is not there."""
        if level not in self.known:
            self.known[level] = int(self.sizes.getValue(level)[0]) if not self.cleared and self.sizes.containsKey(level) else 0
        return self.known[level]

    def page(self, key: tuple[int, int]) -> int:
        """The bits of a page."""
        if key not in self.bits:
            self.bits[key] = int(self.pages.getValue(key)[0]) & (1 << 64) - 1 if not self.cleared and self.pages.containsKey(key) else 0
        return self.bits[key]

    def put(self, level: tuple[int, int], size: int, filled: dict[int, int]) -> None:
        """Sets a level, 0 deletes; filled: the bits of the pages of each side that are not empty."""
        self.size(level)
        self.known[level] = size
        self.changed.add(level)
        side, price = level
        key, bit = (side, price // 64), 1 << price % 64
        self.bits[key] = self.page(key) | bit if size else self.page(key) & ~bit
        flag = 1 << price // 64
        filled[side] = filled.get(side, 0) | flag if self.bits[key] else filled.get(side, 0) & ~flag

    def best(self, side: int, n: int, filled: dict[int, int]) -> list[int]:
        """Prices of the n best levels of a side."""
        out: list[int] = []
        left = filled.get(side, 0)
        while left and len(out) < n:
            page = left.bit_length() - 1 if side == BID else (left & -left).bit_length() - 1
            left &= ~(1 << page)
            bits = self.page((side, page))
            while bits and len(out) < n:
                bit = bits.bit_length() - 1 if side == BID else (bits & -bits).bit_length() - 1
                bits &= ~(1 << bit)
                out.append(page * 64 + bit)
        return out

    def save(self) -> None:
        """Writes what has changed."""
        for level in self.changed:
            if self.known[level]:
                self.sizes.updateValue(level, (self.known[level],))
            elif not self.cleared and self.sizes.containsKey(level):
                self.sizes.removeKey(level)
        for key in {(side, price // 64) for side, price in self.changed}:
            bits = self.bits[key]
            if bits:
                self.pages.updateValue(key, (bits - (1 << 64) if bits >> 63 else bits,))
            elif not self.cleared and self.pages.containsKey(key):
                self.pages.removeKey(key)


class LiveBook(StatefulProcessor):
    """Keeps a book per asset and puts out the levels that each micro-batch has changed.

    Snapshot rows that follow each other with equal clocks and event id are one
    snapshot, also across micro-batches: the first one clears the book and the
    next ones add to it.  Rows of a version that cleared the book stand for all
    of it; a size of 0 deletes a level; a version of no change is one row
    without a level.  With a depth only changes among the so many best levels of
    each side are put out, and all of these every so many versions, so that a
    reader who comes late finds a start.
    """

    def __init__(self, depth: int | None = None, full_every: int = FULL_EVERY):
        self.depth, self.full_every = depth, full_every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sizes = handle.getMapState("sizes", "side int, price int", "size long")
        self.pages = handle.getMapState("pages", "side int, page int", "bits long")
        self.head = handle.getValueState("head", "version long, sequence long, last_update_us long, has_book boolean, last_key string, filled string, tops string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = unpacked(rows, "arrival")
        version, sequence, updated, has_book, last_key, filled, tops = self.head.get() if self.head.exists() else (0, 0, 0, False, "", "{}", "[]")
        filled, before = {int(k): v for k, v in json.loads(filled).items()}, {(s, p): z for s, p, z in json.loads(tops)}
        book = Levels(self.sizes, self.pages)
        snapshot = whole(table, "event_kind") == SNAPSHOT
        recv, exchange, ids = whole(table, "recv_timestamp_us"), whole(table, "exchange_timestamp_us"), pc.fill_null(table["source_event_id"], "").combine_chunks()

        def name(k: int) -> str:
            return f"{recv[k]}/{exchange[k]}/{ids[k].as_py()}" if snapshot[k] else ""

        same = snapshot[:-1] & (recv[1:] == recv[:-1]) & (exchange[1:] == exchange[:-1]) & pc.equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(snapshot & np.concatenate([[name(0) != last_key], ~same]))
        frame = pd.DataFrame({c: whole(table, c) for c in ("side", "price", "size")})
        first = starts[-1] if len(starts) else 0
        if len(starts):
            book.clear()
            filled = {}
        # of each level only the last change counts
        changed = frame[first:][~snapshot[first:] | (frame["size"][first:] > 0).to_numpy()].drop_duplicates(["side", "price"], keep="last")
        for side, price, size in zip(changed["side"].tolist(), changed["price"].tolist(), changed["size"].tolist(), strict=True):
            book.put((int(side), int(price)), int(size), filled)
        last_key, has_book = name(len(table) - 1), has_book or bool(snapshot[first:].any())
        sequence = int(whole(table, "sequence")[-1])
        updated = int(recv[-1])
        version += 1
        now: dict[tuple[int, int], int] = {}
        if self.depth:
            for side in (BID, ASK):
                for price in book.best(side, self.depth, filled):
                    level = (side, price)
                    now[level] = before[level] if level in before and level not in book.known and not book.cleared else book.size(level)
            full = version % self.full_every == 1
            changes = now if full else {x: now.get(x, 0) for x in before.keys() | now.keys() if before.get(x) != now.get(x)}
        else:
            full, changes = book.cleared, {x: book.known[x] for x in book.changed}
        book.save()
        self.head.update((version, sequence, updated, has_book, last_key, json.dumps(filled), json.dumps([[*x, z] for x, z in now.items()])))
        out = [(key[0], version, sequence, updated, has_book, full, side, price, size) for (side, price), size in sorted(changes.items())]
        yield pd.DataFrame(out or [(key[0], version, sequence, updated, has_book, full, None, None, None)], columns=[c.split()[0] for c in BOOK_OUT.split(", ")])

    def close(self) -> None:
        pass


def numbers(stamp: np.ndarray, arrival: np.ndarray, snapshot: np.ndarray, head: np.ndarray, following: int, latest: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Numbers an asset's ordered heads of snapshots and levels: (sequence, after_us, following, latest).

    following and latest are the next sequence and the newest accepted stamp,
    before and after.  sequence is -1 on heads and on the levels of stale
    snapshots; after_us is the stamp that a stale head came after, else 0.
    """
    newest = np.maximum.accumulate(np.concatenate([[latest], np.where(head, stamp, 0)]))
    stale = head & (stamp > 0) & (stamp <= newest[:-1])
    kept = ~head & ~(snapshot & np.isin(arrival, arrival[stale]))
    so_far = np.cumsum(kept)
    start = np.maximum.accumulate(np.where(head & ~stale, so_far, -following))
    return np.where(kept, so_far - 1 - start, -1), np.where(stale, newest[:-1], 0), int(so_far[-1] - start[-1]), int(newest[-1])


def numbered_table(rows: pa.Table, following: int, latest: int) -> tuple[pa.Table, int, int]:
    """The levels that have a number, and the stale heads, of which only the stamps and the event id are kept; following and latest."""
    clocks = whole(rows, "exchange_timestamp_us"), whole(rows, "arrival")
    sequence, after, following, latest = numbers(*clocks, whole(rows, "event_kind") == SNAPSHOT, whole(rows, "pos") < 0, following, latest)
    level = sequence >= 0
    out = only(rows, level, "event_kind", "side", "price", "size")
    out = out.append_column("sequence", pa.array(sequence, mask=~level)).append_column("stale_after_us", pa.array(after, mask=level | (after == 0)))
    return out.filter(pa.array(level | (after > 0))), following, latest


class Numberer(StatefulProcessor):
    """Numbers an asset's levels, starts anew at accepted snapshots and turns stale ones away.

    A row of pos -1 announces a snapshot message; a stale one is put out with
    the stamp it came after, and its levels are not.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "next long, latest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, latest = self.state.get() if self.state.exists() else (0, 0)
        table, following, latest = numbered_table(unpacked(rows, "arrival", "pos"), following, latest)
        self.state.update((following, latest))
        table = table.append_column("asset_id", pa.repeat(key[0], len(table)).cast("string"))
        yield from put_out(table.select([c.split()[0] for c in NORMAL_OUT.split(", ")]))

    def close(self) -> None:
        pass


def live_books(events: DataFrame, depth: int | None = None, full_every: int = FULL_EVERY) -> DataFrame:
    """The stream of changes of the books of a stream of book events with arrival; with a depth, of their best levels."""
    columns = ["asset_id", "arrival", "event_kind", "side", "price", "size", "sequence", "recv_timestamp_us", "exchange_timestamp_us", "source_event_id"]
    return packed(events.select(*columns), "asset_id").groupBy("asset_id").transformWithStateInPandas(LiveBook(depth, full_every), BOOK_OUT, "Update", "None")


def current_levels(changes: DataFrame) -> DataFrame:
    """The levels that a table of changes adds up to, from each asset's last full version on."""
    start = changes.where("full").groupBy("asset_id").agg(F.max("version").alias("start"))
    rows = changes.join(start, "asset_id", "left").where("start is null or version >= start").where("side is not null")
    return rows.groupBy("asset_id", "side", "price").agg(F.max_by("size", "version").alias("size")).where("size > 0")


def changes_since(changes: DataFrame, asset_id: str, version: int, buffer: int = BUFFER) -> tuple[bool, DataFrame]:
    """What a reader of one asset at a version lacks: (False, the rows of later versions), or (True, all levels) if it is too far behind.

    Levels come with the newest version.
    """
    own = changes.where(F.col("asset_id") == asset_id)
    newest = own.agg(F.max("version")).first()[0]
    if newest is None or newest - version <= buffer:
        return False, own.where(F.col("version") > version)
    return True, current_levels(own).withColumn("version", F.lit(newest).cast("long"))


def subscribed(changes: DataFrame, active: DataFrame, asset_id: str) -> DataFrame:
    """The first rows of a reader: all levels with the newest version; raises if the asset is not active or has no snapshot yet."""
    if not active.where(F.col("asset_id") == asset_id).limit(1).count():
        raise NotFound(f"{asset_id} is not active")
    newest = changes.where(F.col("asset_id") == asset_id).agg(F.max("version").alias("version"), F.bool_or("has_book").alias("has_book")).first()
    if not newest.has_book:
        raise NotReady(f"{asset_id} has no snapshot yet")
    return changes_since(changes, asset_id, -1, -1)[1].withColumn("version", F.lit(newest.version).cast("long"))


def entries(messages: DataFrame) -> DataFrame:
    """Level rows of a stream of messages, with a row of pos -1 for each snapshot message; per message, so it needs no state."""
    rows = normalize.parsed(messages)

    def level(kind: int, side, asset, event_id):
        return lambda x, i: F.struct(asset(x).alias("asset_id"), F.lit(kind).alias("event_kind"), side(x).cast("int").alias("side"), price_from_text(x["price"]).alias("price"), size_from_text(x["size"]).alias("size"), event_id(x).alias("source_event_id"))

    own, hashed = (lambda x: F.col("m.asset_id")), (lambda x: F.col("m.hash"))
    snaps = F.concat(F.transform("m.bids", level(SNAPSHOT, lambda x: F.lit(BID), own, hashed)), F.transform("m.asks", level(SNAPSHOT, lambda x: F.lit(ASK), own, hashed)))
    changes = F.filter(F.transform("m.price_changes", level(DELTA, lambda x: side_code(x["side"]), lambda x: x["asset_id"], lambda x: x["hash"])), lambda x: x["side"].isNotNull())
    is_book = F.col("m.event_type") == "book"
    listed = F.when(is_book, snaps).when(F.col("m.event_type") == "price_change", changes)
    bad = F.array_min(F.filter(F.transform("l", lambda x, i: F.when(x["price"].isNull() | x["size"].isNull(), i)), lambda i: i.isNotNull()))
    marker = F.struct(F.col("m.asset_id").alias("asset_id"), F.lit(SNAPSHOT).alias("event_kind"), F.lit(0).alias("side"), F.lit(0).alias("price"), F.lit(0).cast("long").alias("size"), F.col("m.hash").alias("source_event_id"))
    kept = F.when(F.col("bad").isNull(), F.col("l")).otherwise(F.slice("l", 1, F.col("bad")))
    placed = F.transform(kept, lambda x, i: F.struct(i.alias("pos"), x.alias("x")))
    first = F.when(is_book, F.array(F.struct(F.lit(-1).alias("pos"), marker.alias("x")))).otherwise(F.array().cast(placed_type()))
    cut = rows.withColumn("l", listed).where("l is not null").withColumn("bad", bad)
    flat = cut.select("arrival", "recv_timestamp_us", "exchange_timestamp_us", F.explode(F.concat(first, placed)).alias("e"))
    return flat.select("arrival", "recv_timestamp_us", "exchange_timestamp_us", "e.pos", "e.x.*")


def placed_type() -> str:
    """Type of the placed level rows."""
    return "array<struct<pos:int,x:struct<asset_id:string,event_kind:int,side:int,price:int,size:bigint,source_event_id:string>>>"


def normalized(messages: DataFrame) -> DataFrame:
    """The stream of numbered level rows and stale snapshots of a stream of messages.

    The session is the source row's own, as a connection stamps its rows; the
    batch form looks it up instead.
    """
    return packed(entries(messages), "asset_id").groupBy("asset_id").transformWithStateInPandas(Numberer(), NORMAL_OUT, "Append", "None")


def _finished(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and gives what it put out, with batch_id."""
    spark = stream.sparkSession
    out = scratch(spark, "stream-out")
    schema = stream.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/part_id={batch_id}")  # a repeated batch replaces itself

    with stateful(spark):
        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", scratch(spark, "stream-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema + ", part_id long").parquet(out)


def stream_final_levels(events: DataFrame) -> DataFrame:
    """Levels of every asset's book once the live stream has read all events."""
    return current_levels(_finished(live_books(staged(events)), "update")).select("asset_id", "side", "price", "size")


def stream_top_levels(events: DataFrame, depth: int, parts: int = 3, full_every: int = FULL_EVERY) -> DataFrame:
    """Changes of the best levels that the live stream puts out for all events."""
    return _finished(live_books(staged(events, parts), depth, full_every), "update")


def stream_normalized(messages: DataFrame) -> DataFrame:
    """Book rows that the streaming normalizer puts out for all messages."""
    return _finished(normalized(staged(messages)), "append").where("stale_after_us is null")


def start_live(events: DataFrame, path: str, checkpoint: str, depth: int | None = None):
    """Starts the live book; the changes of a micro-batch are one folder under path, which a repeated one replaces.

    Readers take spark.read.schema(CHANGES).parquet(path) to current_levels(),
    changes_since() or subscribed().
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/part_id={batch_id}")

    with stateful(events.sparkSession):
        return live_books(events, depth).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).start()


#: Columns of the folders of start_live().
CHANGES = BOOK_OUT + ", part_id long"
