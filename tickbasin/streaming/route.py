"""One stream to six datasets: a tagged stream, and micro-batches shared out by tag as one commit each.

Messages are parsed by Spark, and a stateful processor numbers levels, turns
stale snapshots away and stamps every row with the session of the last
connection, which its state carries.  Its keys are shards of assets, so a busy
connection is shared by several tasks; new connections go to every shard, and
the first one puts the rows of all connection changes out.  Checkpoints, validations and executions join
behind the processor.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.codecs import date_and_hour, stale_text
from ..operators import normalize
from ..operators.normalize import RESET_TEXT
from ..schemas import DATASETS, PARTITION_TIME, SNAPSHOT
from ..sources import ledger
from .books import numbers, stateful
from .packed import equals, packed, put_out, unpacked, whole

# executors need not have this package: its processors travel with the plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Shards of a connection's assets.
SHARDS = 8
FLUSH_SECONDS = 300
ENTRY = "what string, asset_id string, event_kind int, side int, price int, size long, source_event_id string, fidelity string, session_id string, kind string, details string"
FLAT = "dataset string, arrival long, recv_timestamp_us long, exchange_timestamp_us long, asset_id string, event_kind int, kind string, side int, price int, size long, sequence long, after_us long, details string, fidelity string, source_event_id string, session_id string"
_NAMES = [c.split()[0] for c in FLAT.split(", ")]


def entries(messages: DataFrame, shards: int = SHARDS) -> DataFrame:
    """What the processor reads: a head for each book message, levels, trades and connection changes, each with its shard."""
    def entry(**known: Column) -> list[Column]:
        return [known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (c.split() for c in ENTRY.split(", "))]

    clocks = ["arrival", "recv_timestamp_us", "exchange_timestamp_us"]
    kind = F.col("m.event_type")
    rows = normalize.with_trade(normalize.cut_levels(normalize.parsed(messages)))  # a text is parsed once for all
    head = F.struct(*entry(what=F.lit("book"), asset_id=F.col("m.asset_id"), source_event_id=F.col("m.hash")))
    traded = F.struct(*entry(what=F.lit("trade"), asset_id=F.col("m.asset_id"), side=F.col("side"), price=F.col("price"), size=F.col("size"), source_event_id=F.col("m.transaction_hash"), fidelity=F.col("fidelity")))
    levels = F.transform("l", lambda x: F.struct(*entry(what=F.lit("level"), **{c: x[c] for c in ("asset_id", "event_kind", "side", "price", "size", "source_event_id")})))
    listed = F.when(kind == "book", F.concat(F.array(head), levels)).when(kind == "price_change", levels).when(F.col("priced"), F.array(traded))
    of_assets = rows.select(*clocks, F.posexplode(listed).alias("pos", "e")).withColumn("shard", F.pmod(F.xxhash64("e.asset_id"), F.lit(shards)).cast("int"))
    changes = messages.where("kind in ('reconnect_start', 'reconnect_success')")
    change = F.struct(*entry(what=F.lit("session"), session_id=F.col("session_id"), kind=F.col("kind"), details=F.col("details")))
    concerned = F.when(F.col("kind") == "reconnect_success", F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.lit(0)))
    of_all = changes.select("arrival", "recv_timestamp_us", F.lit(0).cast("long").alias("exchange_timestamp_us"), F.lit(0).alias("pos"), change.alias("e"), F.explode(concerned).alias("shard"))
    return of_assets.unionByName(of_all).select("shard", *clocks, "pos", "e.*")


class Dispatcher(StatefulProcessor):
    """Rows of a shard in order of arrival, tagged with their dataset.

    State: the session of the last successful connection, and for each asset the
    next sequence and the newest accepted stamp.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "session_id string")
        self.assets = handle.getMapState("assets", "asset_id string", "next long, latest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = unpacked(rows, "arrival", "pos")
        first = self.session.get()[0] if self.session.exists() else None
        change, success, given = equals(table, "what", "session"), equals(table, "kind", "reconnect_success"), table["session_id"].combine_chunks()
        newest = np.maximum.accumulate(np.where(change & success, np.arange(len(table)), -1))
        carried = pc.if_else(pa.array(newest < 0), pa.scalar(first, pa.string()), given.take(pa.array(newest, mask=newest < 0)))
        if carried[-1].as_py() != first:
            self.session.update((carried[-1].as_py(),))

        head = equals(table, "what", "book")
        of_books = head | equals(table, "what", "level")
        stamp, arrival, snapshot = whole(table, "exchange_timestamp_us"), whole(table, "arrival"), whole(table, "event_kind") == SNAPSHOT
        assets = table["asset_id"].combine_chunks().dictionary_encode()
        code = np.where(of_books, pc.fill_null(assets.indices, -1).to_numpy(), -1)
        by_asset = np.argsort(code, kind="stable")
        ends = np.searchsorted(code[by_asset], np.arange(len(assets.dictionary) + 1))
        sequence, after = np.full(len(table), -1), np.zeros(len(table), "int64")
        for name, low, high in zip(assets.dictionary.to_pylist(), ends, ends[1:], strict=False):
            if low == high:
                continue
            at = by_asset[low:high]
            state = self.assets.getValue((name,)) if self.assets.containsKey((name,)) else (0, 0)
            sequence[at], after[at], *state = numbers(stamp[at], arrival[at], snapshot[at], head[at], *map(int, state))
            self.assets.updateValue((name,), tuple(state))

        dataset = np.select([equals(table, "what", "trade"), sequence >= 0, (after > 0) | (change & (key[0] == 0))], [0, 1, 2], -1)
        columns = {c: table[c] for c in table.column_names} | {
            "dataset": pa.array(["trade_events", "book_events", "ingest_events"]).take(pa.array(dataset, mask=dataset < 0)),
            "session_id": pc.if_else(pa.array(change), given, carried), "sequence": pa.array(sequence, mask=sequence < 0), "after_us": pa.array(after, mask=after <= 0),
            "kind": pc.if_else(pa.array(after > 0), "stale_snapshot_skip", table["kind"]),
        }
        tagged = pa.table({c: columns[c] for c in _NAMES})
        yield from put_out(tagged, dataset >= 0)
        resets = tagged.filter(pa.array(change & success & (key[0] == 0)))
        text = {"kind": "source_reset", "details": RESET_TEXT}
        yield from put_out(pa.table({c: pa.repeat(text[c], len(resets)) if c in text else resets[c] for c in _NAMES}))

    def close(self) -> None:
        pass


def tag(rows: DataFrame, dataset: str, arrival: Column | None = None) -> DataFrame:
    """Rows of a dataset in the shape of the tagged stream: a struct for each dataset, of which one is set."""
    own = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DATASETS[dataset].fields])
    nothing = F.lit(None)
    return rows.select(F.lit(dataset).alias("dataset"), (nothing if arrival is None else arrival).cast("long").alias("arrival"), *[(own if name == dataset else nothing.cast(_type(name))).alias(name) for name in DATASETS])


def _type(dataset: str) -> str:
    return DATASETS[dataset].simpleString()


def untagged(tagged: DataFrame, dataset: str) -> DataFrame:
    """The rows of a dataset in a tagged batch or stream."""
    return tagged.where(F.col("dataset") == dataset).select(f"{dataset}.*")


def dispatched(messages: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The tagged stream of a stream of messages."""
    flat = packed(entries(messages, shards), "shard").groupBy("shard").transformWithStateInPandas(Dispatcher(), FLAT, "Append", "None")
    none = F.lit(None)
    stale = F.when(F.col("after_us").isNotNull(), stale_text(F.col("exchange_timestamp_us"), F.col("after_us"))).otherwise(F.col("details"))
    more = {"source": F.lit("websocket"), "source_session_id": F.col("session_id"), "trade_id": F.col("source_event_id"), "details": stale, "expected_sequence": none, "observed_sequence": none}

    def own(dataset: str) -> Column:
        named = more | ({"event_kind": F.col("kind"), "sequence": none} if dataset == "ingest_events" else {})
        row = F.struct(*[named.get(f.name, F.col(f.name) if f.name in _NAMES else none).cast(f.dataType).alias(f.name) for f in DATASETS[dataset].fields])
        return F.when(F.col("dataset") == dataset, row)

    here = ("book_events", "trade_events", "ingest_events")
    return flat.select("dataset", "arrival", *[(own(name) if name in here else none).cast(_type(name)).alias(name) for name in DATASETS])


def fan_in(messages: DataFrame, shards: int = SHARDS, **others: DataFrame) -> DataFrame:
    """The tagged stream of messages and of streams of other datasets' rows, by their names."""
    out = dispatched(messages, shards)
    for name, rows in others.items():
        out = out.unionByName(tag(rows, name))
    return out


def dealt(rows: DataFrame, dataset: str, hours: int) -> DataFrame:
    """A micro-batch's rows of about so many hours dealt by hour, as streams pass over the rebalancing of storage.write().

    Without it every task would write a file for every hour.  If the hours are
    fewer than the tasks, several of these share an hour.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clock = PARTITION_TIME[dataset]
    share = F.pmod(F.xxhash64("asset_id", clock), F.lit(-(-tasks // max(1, hours))))
    return rows.repartition(tasks, *date_and_hour(F.col(clock)), share)


def route(tagged: DataFrame, base: str, checkpoint: str, seconds: int = FLUSH_SECONDS, available_now: bool = False):
    """Starts the query that commits every micro-batch of a tagged stream to the datasets under base.

    A batch is one entry of the ledger under the query's own id, which lives in
    the checkpoint: one that is delivered twice is stored once, and one whose
    second dataset cannot be written is not seen at all and comes again.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch.persist()
        try:
            hour = F.call_function("div", F.coalesce(*[F.col(f"{name}.{clock}") for name, clock in PARTITION_TIME.items()]), F.lit(3_600_000_000))
            hours = {r.dataset: r.n for r in batch.groupBy("dataset").agg(F.approx_count_distinct(hour).alias("n")).collect()}
            ledger.commit(spark, base, f"{query}-{batch_id:012d}", {name: dealt(untagged(batch, name), name, hours[name]) for name in DATASETS if name in hours})
        finally:
            batch.unpersist()

    writer = tagged.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")
    with stateful(tagged.sparkSession):
        return writer.start()
