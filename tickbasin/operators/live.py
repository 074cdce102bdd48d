"""The live read model as queries: state of every asset from the events that have arrived.

These are the batch forms of the streaming book; rows need an arrival number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NotFound, NotReady
from ..schemas import DELTA, SNAPSHOT
from . import book

#: Arrivals that are ordered together; a hot asset is shared by as many tasks as it has such stretches.
STRETCH = 1 << 16


def warnings(ingest: DataFrame) -> DataFrame:
    """Latest continuity warning of every asset; asset_id is null for the global one."""
    warning = F.struct("kind", "recv_timestamp_us", "exchange_timestamp_us", "details")
    rows = ingest.withColumn("kind", F.col("event_kind"))
    return rows.groupBy("asset_id").agg(F.max_by(warning, "arrival").alias("latest_warning"))


def session_status(ingest: DataFrame) -> DataFrame:
    """One row: starting, connected or reconnecting, and the session of the last connection."""
    changes = F.col("event_kind").isin("reconnect_start", "reconnect_success")
    success = F.col("event_kind") == "reconnect_success"
    last = F.max_by("event_kind", F.when(changes, F.col("arrival")))
    status = F.when(last == "reconnect_start", "reconnecting").when(last == "reconnect_success", "connected").otherwise("starting")
    return ingest.agg(status.alias("session_status"), F.max_by("source_session_id", F.when(success, F.col("arrival"))).alias("current_session_id"))


def snapshot_groups(events: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Adds the group of each row: snapshot rows of one asset that follow each other with equal clocks and event id.

    Groups are counted within stretches of arrivals, the first row of each as a
    start; of a stretch one small row says how many groups it has and whether
    its first one goes on from the stretch before, and the sums of these rows
    are added.  So no asset's rows are sorted in one task.  Rows need an asset
    and an arrival number of their own.
    """
    key = F.struct("event_kind", "recv_timestamp_us", "exchange_timestamp_us", F.coalesce("source_event_id", F.lit("")).alias("source_event_id"))
    rows = events.withColumns({"stretch": F.call_function("div", "arrival", F.lit(stretch)), "key": key})
    inside = Window.partitionBy("asset_id", "stretch").orderBy("arrival")
    same = (F.col("event_kind") == SNAPSHOT) & (F.lag("key").over(inside) == F.col("key"))
    local = rows.withColumn("local", F.sum(F.when(same, 0).otherwise(1)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy("asset_id", "stretch").agg(F.max("local").alias("n"), F.min_by("key", "arrival").alias("first"), F.max_by("key", "arrival").alias("last"))
    by = Window.partitionBy("asset_id").orderBy("stretch")
    goes_on = F.when((F.col("first.event_kind") == SNAPSHOT) & (F.lag("last").over(by) == F.col("first")), 1).otherwise(0)
    ends = ends.withColumn("goes_on", goes_on)
    earlier = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = ends.select("asset_id", "stretch", (earlier - F.sum("goes_on").over(by.rowsBetween(Window.unboundedPreceding, 0))).alias("shift"))
    return local.join(shifts, ["asset_id", "stretch"]).withColumn("group", F.col("local") + F.col("shift")).select(*events.columns, "group")


def live_books(events: DataFrame) -> DataFrame:
    """Levels of every asset's live book: (asset_id, side, price, size).

    The last snapshot group is the base, deltas before any snapshot count, and
    no gap is checked.  The group starts after the last row before the last
    snapshot row that is not of its group, so maxima combined before the
    shuffle find it and no asset's rows are sorted.
    """
    snapshot = F.col("event_kind") == SNAPSHOT
    clocks = F.struct("recv_timestamp_us", "exchange_timestamp_us", F.coalesce("source_event_id", F.lit("")).alias("source_event_id"))
    last = events.where(snapshot).groupBy("asset_id").agg(F.max("arrival").alias("last_at"), F.max_by(clocks, "arrival").alias("last_clocks"))
    other = events.join(last, "asset_id").where((F.col("arrival") < F.col("last_at")) & ~(snapshot & (clocks == F.col("last_clocks"))))
    cut = other.groupBy("asset_id").agg(F.max("arrival").alias("cut"))
    rows = events.join(cut, "asset_id", "left").where(F.col("cut").isNull() | (F.col("arrival") > F.col("cut")))
    rows = rows.where((F.col("size") > 0) | (F.col("event_kind") == DELTA))
    latest = rows.groupBy("asset_id", "side", "price").agg(F.max_by("size", "arrival").alias("size"))
    return latest.where("size > 0")


def asset_states(events: DataFrame) -> DataFrame:
    """Clocks, sequence and readiness of every asset."""
    last = F.struct("recv_timestamp_us", "exchange_timestamp_us", F.coalesce("sequence", F.lit(0)).alias("sequence"))
    return events.groupBy("asset_id").agg(F.max_by(last, "arrival").alias("last"), F.max(F.col("event_kind") == SNAPSHOT).alias("has_book")).select(
        "asset_id", F.col("last.recv_timestamp_us").alias("last_recv_timestamp_us"), F.col("last.exchange_timestamp_us").alias("last_exchange_timestamp_us"), F.col("last.sequence").alias("sequence"), "has_book",
    )


def is_stale(last_recv, now_us: int, stale_after_s: int):
    """Whether the last receive time is more than so many seconds ago; no time at all is stale."""
    return F.coalesce(F.lit(now_us) - last_recv > stale_after_s * 1_000_000, F.lit(True))  # a stamp after now is not stale


def active_assets(active: DataFrame, states: DataFrame, now_us: int, stale_after_s: int) -> DataFrame:
    """Every active asset with its clocks, whether it is stale and whether it has a book."""
    joined = active.select("asset_id").join(states, "asset_id", "left")
    return joined.select("asset_id", "last_recv_timestamp_us", "last_exchange_timestamp_us", is_stale(F.col("last_recv_timestamp_us"), now_us, stale_after_s).alias("stale"), F.coalesce("has_book", F.lit(False)).alias("has_book"))


def feed_status(ingest: DataFrame, active: DataFrame, mode: str = "fixed_tokens") -> DataFrame:
    """One row: the mode, the session's status and id, how many assets are active, and the latest warning that concerns all."""
    count = active.select("asset_id").distinct().agg(F.count("*").alias("active_asset_count"))
    shared = warnings(ingest.where("asset_id is null")).select("latest_warning")
    # each of the three is one row at most
    return session_status(ingest).select(F.lit(mode).alias("mode"), "*").join(F.broadcast(count)).join(F.broadcast(shared), how="left")


def retain_active(rows: DataFrame, active: DataFrame) -> DataFrame:
    """Rows of active assets only."""
    return rows.join(active.select("asset_id").distinct(), "asset_id", "left_semi")


def live_snapshot(events: DataFrame, ingest: DataFrame, active: DataFrame, asset_id: str, depth: int, now_us: int, stale_after_s: int) -> DataFrame:
    """One asset's live book, cut to a depth; raises if the asset is not active or has no snapshot yet."""
    if not active.where(F.col("asset_id") == asset_id).limit(1).count():
        raise NotFound(f"{asset_id} is not active")
    own = events.where(F.col("asset_id") == asset_id)
    states = asset_states(own).where("has_book")
    if not states.limit(1).count():
        raise NotReady(f"{asset_id} has no snapshot yet")
    levels = live_books(own)
    keys = ["asset_id"]
    top, totals, nested = book.top_of_book(levels, keys), book.depth_totals(levels, keys), book.nested(levels, keys, depth)
    warned = warnings(ingest.where(F.col("asset_id") == asset_id))
    out = states.join(top, keys, "left").join(totals, keys, "left").join(nested, keys, "left").join(warned, keys, "left")
    return out.withColumn("stale", is_stale(F.col("last_recv_timestamp_us"), now_us, stale_after_s)).withColumnRenamed("last_recv_timestamp_us", "last_update_us")
