"""The datasets as views over the star-schema test tables.

book_events come from the events table in blocks of six hours, so that stamps
tie; whole blocks of an asset are snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codecs import levels_to_json
from ..functions.fixedpoint import size_from_double
from ..schemas import LATENCY_FIELDS

BLOCK_US = 6 * 3_600_000_000


def stamp_us(name: str) -> Column:
    """Microseconds of a stamp without time zone, taken as UTC whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', cast({name} as timestamp_ntz))")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table with its stamp in microseconds, its asset and the number in its properties."""
    rows = spark.read.parquet(f"{folder}/events.parquet")
    us = stamp_us("ts")
    return rows.select(
        "event_id", "event_type", "user_id", "value", us.alias("ts_us"), F.concat(F.lit("A"), (F.col("user_id") % 10).cast("string")).alias("asset_id"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _source() -> list[Column]:
    return [
        F.lit("websocket").alias("source"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("source_event_id"),
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source_session_id"),
    ]


def _exchange(recv: Column) -> Column:
    return F.when(F.col("event_id") % 11 == 0, F.lit(0)).otherwise(recv - (F.col("event_id") % 7) * 1_000_000).cast("long")


def book_events(spark: SparkSession, folder: str) -> DataFrame:
    """signup, click and view events as level changes; every third block of an asset is a snapshot."""
    rows = events(spark, folder).where(F.col("event_type").isin("signup", "click", "view"))
    block = F.call_function("div", F.col("ts_us"), F.lit(BLOCK_US))
    recv = (block * BLOCK_US).cast("long")
    order = F.row_number().over(Window.partitionBy("asset_id").orderBy("recv_timestamp_us", "event_id")).cast("long")
    base = rows.withColumns({"recv_timestamp_us": recv, "event_kind": F.when((block + F.col("user_id") % 10) % 3 == 0, 1).otherwise(2).cast("tinyint")})
    size = F.when(F.col("event_id") % 5 == 0, F.lit(0)).otherwise(size_from_double(F.col("value"))).cast("long")
    return base.select(
        "recv_timestamp_us", _exchange(F.col("recv_timestamp_us")).alias("exchange_timestamp_us"), "asset_id", "event_kind",
        (F.col("k") % 2 + 1).cast("tinyint").alias("side"), (F.col("k") * 100).cast("int").alias("price"), size.alias("size"),
        F.when(F.col("event_id") % 23 == 0, F.lit(None)).otherwise(order + (F.col("event_id") % 17 == 0).cast("long")).cast("long").alias("sequence"), *_source(),
    )


def trade_events(spark: SparkSession, folder: str) -> DataFrame:
    """purchase events as trades; sizes and sides are missing here and there."""
    rows = events(spark, folder).where("event_type = 'purchase'")
    size = F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(size_from_double(F.col("value"))).cast("long")
    side = F.when(F.col("event_id") % 4 == 0, F.lit(None)).otherwise(F.col("k") % 2 + 1).cast("tinyint")
    return rows.select(
        F.col("ts_us").alias("recv_timestamp_us"), _exchange(F.col("ts_us")).alias("exchange_timestamp_us"), "asset_id", (F.col("k") * 100).cast("int").alias("price"),
        size.alias("size"), side.alias("side"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("trade_id"),
        F.when(size.isNotNull() & side.isNotNull(), "full").otherwise("partial").alias("fidelity"), F.lit(None).cast("long").alias("sequence"), *_source(),
    )


def ingest_events(spark: SparkSession, folder: str) -> DataFrame:
    """error events as continuity events; every fifth is global."""
    rows = events(spark, folder).where("event_type = 'error'")
    kinds = F.array(*map(F.lit, ["reconnect_start", "reconnect_success", "sequence_gap", "stale_snapshot_skip", "source_reset"]))
    gap = F.col("k") % 5 == 2
    return rows.select(
        F.col("ts_us").alias("recv_timestamp_us"), _exchange(F.col("ts_us")).alias("exchange_timestamp_us"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("asset_id")).cast("string").alias("asset_id"), F.get(kinds, F.col("k") % 5).alias("event_kind"),
        F.lit(None).cast("long").alias("sequence"), F.when(gap, F.col("event_id")).alias("expected_sequence"), F.when(gap, F.col("event_id") + F.col("k")).alias("observed_sequence"),
        F.concat(F.lit("k="), F.col("k").cast("string")).alias("details"), *_source(),
    )


def checkpoint_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Levels of the test checkpoints, one row each: purchases of an asset and day, stamped at the day's end."""
    rows = events(spark, folder).where("event_type = 'purchase'")
    stamp = (F.call_function("div", F.col("ts_us"), F.lit(86_400_000_000)) + 1) * 86_400_000_000 - 1
    return rows.select(
        "asset_id", stamp.cast("long").alias("checkpoint_timestamp_us"), (F.col("k") % 2 + 1).cast("tinyint").alias("side"), (F.col("k") * 100).cast("int").alias("price"),
        F.when(F.col("event_id") % 6 == 0, F.lit(0)).otherwise(size_from_double(F.col("value"))).cast("long").alias("size"), F.col("event_id").alias("pos"),
    )


def book_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """The test checkpoints, levels as JSON in the order of their events."""
    def level(side: int) -> Column:
        return F.collect_list(F.when(F.col("side") == side, F.struct("pos", "price", "size")))

    grouped = checkpoint_rows(spark, folder).groupBy("asset_id", "checkpoint_timestamp_us").agg(level(1).alias("bids"), level(2).alias("asks"))
    ts = F.col("checkpoint_timestamp_us")
    return grouped.select(
        ts, ts.alias("recv_timestamp_us"), ts.alias("exchange_timestamp_us"), "asset_id", F.lit("rest_snapshot").alias("source"), F.lit(None).cast("string").alias("source_event_id"),
        F.lit(None).cast("string").alias("source_session_id"), levels_to_json(F.array_sort("bids")).alias("bids_json"), levels_to_json(F.array_sort("asks")).alias("asks_json"),
    )


def replay_validations(spark: SparkSession, folder: str) -> DataFrame:
    """signup events as stored validation results."""
    rows = events(spark, folder).where("event_type = 'signup'")
    ok = F.col("event_id") % 4 != 0
    return rows.select(
        "asset_id", F.when(F.col("event_id") % 2 == 0, "recv_time").otherwise("exchange_time").alias("mode"), (F.col("ts_us") - 60_000_000).alias("replay_timestamp_us"),
        F.col("ts_us").alias("reference_timestamp_us"), ok.alias("matched"), F.when(~ok, F.concat(F.lit("k="), F.col("k").cast("string"))).alias("mismatch_summary"), F.col("ts_us").alias("persisted_at_us"),
    )


def execution_events(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as submit intents, their lines as fills, with latency stamps."""
    return executions(spark.read.parquet(f"{folder}/orders.parquet"), spark.read.parquet(f"{folder}/lineitem.parquet"))


def executions(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of the orders and lineitem tables, or streams of them, as execution_events rows."""
    def row(stamp: Column, key: Column, line: Column, kind: str, side: Column, price: Column, size: Column, status: Column, fill: Column) -> list[Column]:
        key = key.cast("long")
        stamps = [stamp - 5, stamp - 2, stamp - 1, stamp, stamp + 200 + key % 50, fill]
        return [
            stamp.alias("event_timestamp_us"), F.when(key % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("A"), (key % 10).cast("string"))).cast("string").alias("asset_id"), F.concat(F.lit("O"), key.cast("string")).alias("order_id"),
            F.concat(F.lit("C"), key.cast("string"), F.lit("-"), line.cast("string")).alias("client_order_id"), F.lit(None).cast("string").alias("venue_order_id"), F.lit(kind).alias("event_kind"), side.cast("tinyint").alias("side"),
            price.cast("int").alias("price"), size.cast("long").alias("size"), status.cast("string").alias("status"), F.lit(None).cast("string").alias("reason"),
            F.to_json(F.struct(*[s.cast("long").alias(n) for n, s in zip(LATENCY_FIELDS, stamps, strict=True)]), {"ignoreNullFields": "false"}).alias("latency_json"),
        ]

    none = F.lit(None).cast("long")
    submits = orders.select(*row(stamp_us("o_orderdate"), F.col("o_orderkey"), F.lit(0), "submit_intent", F.col("o_orderkey") % 2 + 1, none, none, F.col("o_orderstatus"), none))
    fill_at = stamp_us("l_shipdate")
    fills = lines.select(*row(fill_at, F.col("l_orderkey"), F.col("l_linenumber"), "fill", F.col("l_orderkey") % 2 + 1, F.round(F.col("l_discount") * 10_000), F.round(F.col("l_quantity") * 1_000_000), F.col("l_linestatus"), fill_at + 500 + F.col("l_orderkey") % 100))
    return submits.unionByName(fills)


VIEWS = {f.__name__: f for f in (book_events, trade_events, ingest_events, book_checkpoints, replay_validations, execution_events)}


def register(spark: SparkSession, folder: str) -> None:
    """Registers every dataset as a temporary view."""
    for name, view in VIEWS.items():
        view(spark, folder).createOrReplaceTempView(name)
