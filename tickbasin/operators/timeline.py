"""The live book after every single event, without rebuilding it for any.

An asset's events are dealt into parts of a bounded number of events, in order
of arrival.  What a part leaves behind is one row for each level that it
touched; such a size is valid from the next part to the part that next touches
the level or clears the book, and these intervals, met with the parts inside
them, are the books with which the parts open.  So every part stands alone, and
a hot asset is shared by as many tasks as it has parts.  Inside a part each size
is an interval of places, and the best price at every place is painted: worse
prices first, better ones over them.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixedpoint import mid, spread, weighted_mid
from ..schemas import ASK, BID, SNAPSHOT

# executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Arrivals that stay together, and with them the fewest events of a part; a part has less than twice as many.
FINE = 4096
#: Fine groups whose events are counted together.
COARSE = 256
PART = ["asset_id", "part"]
#: Level rows of a part before its first event.
OPENING = -1


def in_parts(events: DataFrame) -> DataFrame:
    """Adds part: an asset's events in order of arrival, by counts that are summed up in two steps."""
    fine, coarse = F.call_function("div", F.col("arrival"), F.lit(FINE)), F.call_function("div", F.col("fine"), F.lit(COARSE))
    rows = events.withColumn("fine", fine)
    counts = rows.groupBy("asset_id", "fine").agg(F.count("*").alias("n")).withColumn("coarse", coarse)
    before = F.sum("n").over(Window.partitionBy("asset_id", "coarse").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1))
    totals = counts.groupBy("asset_id", "coarse").agg(F.sum("n").alias("n"))
    carried = F.sum("n").over(Window.partitionBy("asset_id").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("asset_id", "coarse", F.coalesce(carried, F.lit(0)).alias("carried"))
    parts = counts.withColumn("before", F.coalesce(before, F.lit(0))).join(totals, ["asset_id", "coarse"])
    part = F.call_function("div", F.col("before") + F.col("carried"), F.lit(FINE))
    return rows.join(parts.select("asset_id", "fine", part.alias("part")), ["asset_id", "fine"]).drop("fine")


def with_clears(parts: DataFrame) -> DataFrame:
    """Adds clears: whether the event is the first row of a snapshot and so empties the book.

    Snapshot rows of one asset that follow each other with equal clocks and
    event id are one snapshot.  The row before a part's first is handed on by
    the part before.
    """
    group = F.struct("event_kind", "recv_timestamp_us", "exchange_timestamp_us", F.coalesce("source_event_id", F.lit("")).alias("source_event_id"))
    inside = F.lag(group).over(Window.partitionBy(*PART).orderBy("arrival"))
    ends = parts.groupBy(*PART).agg(F.max_by(group, "arrival").alias("end"))
    handed = F.lag("end").over(Window.partitionBy("asset_id").orderBy("part"))
    rows = parts.withColumns({"before": inside, "group": group}).join(ends.select(*PART, handed.alias("handed")), PART)
    same = F.coalesce(F.coalesce("before", "handed") == F.col("group"), F.lit(False))
    return rows.withColumn("clears", (F.col("event_kind") == SNAPSHOT) & ~same).drop("before", "group", "handed")


def openings(rows: DataFrame) -> DataFrame:
    """The book with which every part opens: (asset_id, part, side, price, size)."""
    effective = rows.where((F.col("size") > 0) | (F.col("event_kind") != SNAPSHOT))
    left = effective.groupBy(*PART, "side", "price").agg(F.max(F.struct("arrival", "size")).alias("last"))
    parts = rows.groupBy(*PART).agg(F.max(F.when(F.col("clears"), F.col("arrival"))).alias("cleared"))
    by_part = Window.partitionBy("asset_id").orderBy("part")
    following = by_part.rowsBetween(1, Window.unboundedFollowing)
    parts = parts.withColumns({
        "next_clear": F.min(F.when(F.col("cleared").isNotNull(), F.col("part"))).over(following), "last_part": F.max("part").over(by_part.rowsBetween(0, Window.unboundedFollowing)),
    })
    touched = F.lead("part").over(Window.partitionBy("asset_id", "side", "price").orderBy("part"))
    spans = left.withColumn("touched", touched).join(parts, PART)
    until = F.least(F.coalesce("touched", "last_part"), F.coalesce("next_clear", "last_part"))
    alive = (F.col("last.size") > 0) & (F.col("cleared").isNull() | (F.col("last.arrival") >= F.col("cleared"))) & (until > F.col("part"))
    spans = spans.where(alive).select("asset_id", "side", "price", F.col("last.size").alias("size"), F.explode(F.sequence(F.col("part") + 1, until)).alias("part"))
    return spans.select(*PART, "side", "price", "size")


def painted(side: np.ndarray, price: np.ndarray, size: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> list[np.ndarray]:
    """Best bid, its size, best ask, its size (0 where a side is empty) and depths at n places, of level intervals."""
    out = []
    prices, sizes = np.append(price, 0), np.append(size, 0)  # no interval is -1, the last
    for code, order in ((BID, 1), (ASK, -1)):
        some = np.flatnonzero((side == code) & (starts < ends))
        some = some[np.argsort(order * price[some], kind="stable")]
        best = np.full(n, -1, dtype=np.int64)
        for k, a, b in zip(some.tolist(), starts[some].tolist(), ends[some].tolist(), strict=True):
            best[a:b] = k
        change = np.bincount(starts[some], minlength=n + 1) - np.bincount(ends[some], minlength=n + 1)
        out.append((prices[best], sizes[best], np.cumsum(change)[:n]))
    (bid, bid_size, bids), (ask, ask_size, asks) = out
    return [bid, bid_size, ask, ask_size, bids, asks]


def tops_of_part(side: np.ndarray, price: np.ndarray, size: np.ndarray, kind: np.ndarray, clears: np.ndarray, n_open: int) -> list[np.ndarray]:
    """painted() at each event of a part, whose rows are the opening book and then the events in order."""
    n = len(side) - n_open
    place = np.concatenate((np.zeros(n_open, dtype=np.int64), np.arange(n)))
    effective = np.flatnonzero((size > 0) | (kind != SNAPSHOT))
    level = side[effective] * (1 << 40) + price[effective]
    order = np.lexsort((np.arange(len(effective)), level))
    rows, level = effective[order], level[order]
    same = np.append(level[1:] == level[:-1], False)
    ends = np.full(len(rows), n, dtype=np.int64)
    ends[:-1] = np.where(same[:-1], place[rows[1:]], n)
    cleared = np.append(np.flatnonzero(clears[n_open:]), n)
    # a snapshot's first row empties the book before it sets its own level
    after = np.where(rows < n_open, 0, place[rows] + 1)
    ends = np.minimum(ends, cleared[np.searchsorted(cleared, after)])
    held = size[rows] > 0
    return painted(side[rows[held]], price[rows[held]], size[rows[held]], place[rows[held]], ends[held], n)


OUT = "asset_id string, arrival long, best_bid int, best_bid_size long, best_ask int, best_ask_size long, bid_depth long, ask_depth long"


def _part_tops(table: pa.Table) -> pa.Table:
    table = table.sort_by([("arrival", "ascending"), ("side", "ascending"), ("price", "ascending")])
    columns = {name: table[name].to_numpy() for name in ("arrival", "side", "price", "size", "event_kind", "clears")}
    n_open = int((columns["arrival"] == OPENING).sum())
    side, price, size = (columns[c].astype(np.int64) for c in ("side", "price", "size"))
    bid, bid_size, ask, ask_size, bids, asks = tops_of_part(side, price, size, columns["event_kind"], columns["clears"].astype(bool), n_open)
    events = table.slice(n_open)

    def known(values: np.ndarray, depth: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.array(values, kind, mask=depth == 0)

    return pa.table({
        "asset_id": events["asset_id"].cast(pa.string()), "arrival": events["arrival"], "best_bid": known(bid, bids, pa.int32()), "best_bid_size": known(bid_size, bids, pa.int64()),
        "best_ask": known(ask, asks, pa.int32()), "best_ask_size": known(ask_size, asks, pa.int64()), "bid_depth": pa.array(bids), "ask_depth": pa.array(asks),
    })


def book_after_events(events: DataFrame) -> DataFrame:
    """The top of the live book and its depths after each event of events with arrival, of which no asset has two equal ones.

    Deltas count before the first snapshot too, zero sizes are ignored in
    snapshots and delete in deltas, and the rows of a snapshot come one by one
    after its first has emptied the book.  Returns asset_id, arrival, the best
    levels (null where a side is empty), depths, middle, spread and weighted
    middle; an empty table gives an empty one.
    """
    rows = with_clears(in_parts(events)).select(*PART, "arrival", "event_kind", "clears", *[F.col(c).cast("long").alias(c) for c in ("side", "price", "size")])
    opened = openings(rows).withColumns({"arrival": F.lit(OPENING).cast("long"), "event_kind": F.lit(0).cast(rows.schema["event_kind"].dataType), "clears": F.lit(False)})
    tops = rows.unionByName(opened).groupBy(*PART).applyInArrow(_part_tops, OUT)
    b, a, bs, az = (F.col(c) for c in ("best_bid", "best_ask", "best_bid_size", "best_ask_size"))
    return tops.withColumns({"mid": mid(b, a), "spread": spread(b, a), "weighted_mid": weighted_mid(b, bs, a, az)})
