"""Point-in-time reconstruction, gaps and validation, as sets instead of a loop.

points(query_id, asset_id, at_us) are the books to rebuild, any number at once.
Events meet the points by asset and time bucket.  Every event has an ordering
key; which rows make the base and which the tail follows from a few maxima of
that key for each point, so no point's events need to be sorted: the final size
of a level is the one of its largest key, combined before the shuffle, and a
hot asset does not land in one task.  Only gaps() sorts, since it compares
neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BadRequest, NoSnapshot
from ..functions.codecs import gap_text, levels_from_json, levels_to_json, ordering_us
from ..functions.fixedpoint import price_text, size_text
from ..schemas import DELTA, MODES, SNAPSHOT
from ..sources.feed import stored
from . import book

HOUR_US = 3_600_000_000
#: Time of a bucket in which an as-of join orders stamps and points.
ASOF_BUCKET_US = 6 * HOUR_US
#: Time of a bucket in which events meet points whose base may be long ago.
BASE_BUCKET_US = 24 * HOUR_US
POINT = ["query_id", "asset_id"]


@dataclass
class Replay:
    """A reconstruction: one header row and the levels of each book, and the events that were applied."""

    header: DataFrame
    levels: DataFrame
    applied: DataFrame
    points: DataFrame

    def require(self, query_id, asset_id: str, at_us: int) -> DataFrame:
        """The header of one book; raises if there is none."""
        row = self.header.where((F.col("query_id") == query_id) & (F.col("asset_id") == asset_id))
        if not row.limit(1).count():
            raise NoSnapshot(asset_id, at_us)
        return row


def ordered(events: DataFrame, mode: str) -> DataFrame:
    """Adds ots, the ordering clock, and key, a total order; ties fall to id, side, price and size."""
    if mode not in MODES:
        raise BadRequest(f"mode must be one of {', '.join(MODES)}")
    recv = F.col("recv_timestamp_us")
    ots = ordering_us(mode, recv, F.col("exchange_timestamp_us"))
    second = F.lit(0).cast("long") if mode == "recv_time" else recv
    sq = F.coalesce("sequence", F.lit(0)).cast("long")
    key = F.struct(ots.alias("ots"), second.alias("k2"), sq.alias("sq"), F.coalesce("source_event_id", F.lit("")).alias("id"), F.col("side"), F.col("price"), F.col("size"))
    return events.withColumns({"ots": ots, "key": key})


def at_points(events: DataFrame, points: DataFrame, lookback_us: int) -> DataFrame:
    """Every point's events, received in [at - lookback, at].

    The join is by asset and time bucket, so the work follows the events in the
    windows; a bucket is as long as the lookback, so a window meets two of them.
    """
    recv, at = F.col("recv_timestamp_us"), F.col("at_us")
    start = F.greatest(at - lookback_us, F.lit(0))
    near = points.withColumn("bucket", F.explode(F.sequence(F.call_function("div", start, F.lit(lookback_us)), F.call_function("div", at, F.lit(lookback_us)))))
    dealt = events.withColumn("bucket", F.call_function("div", recv, F.lit(lookback_us)))
    return dealt.join(near, ["asset_id", "bucket"]).where(recv.between(start, at)).drop("bucket")


def since_base(rows: DataFrame, known: DataFrame, bucket_us: int = BASE_BUCKET_US) -> DataFrame:
    """Every point's events from its base on, however old: known has cp_ts, the checkpoint's time, or null.

    rows are ordered().  An as-of join finds a snapshot that the point may see;
    the last one is no earlier, so nothing before it is needed, and the events
    between base and point meet it by asset and bucket of the ordering clock.
    Points with neither checkpoint nor snapshot meet none.
    """
    at, recv = F.col("at_us"), F.col("recv_timestamp_us")
    # both clocks bound what a point sees
    snapshots = rows.where(F.col("event_kind") == SNAPSHOT).select("asset_id", F.greatest("ots", "recv_timestamp_us").alias("ts"), "ots")
    first = snapshots.groupBy("asset_id", "ts").agg(F.min("ots").alias("from_us"))
    seen = nearest(first, known.where("cp_ts is null"), True).join(first, ["asset_id", "ts"]).select(*POINT, "from_us")
    near = known.join(seen, POINT, "left").withColumn("from_us", F.coalesce("cp_ts", "from_us")).where("from_us is not null").drop("cp_ts")
    near = near.withColumn("bucket", F.explode(F.sequence(F.call_function("div", "from_us", F.lit(bucket_us)), F.call_function("div", at, F.lit(bucket_us)))))
    dealt = rows.withColumn("bucket", F.call_function("div", "ots", F.lit(bucket_us)))
    return dealt.join(near, ["asset_id", "bucket"]).where((recv <= at) & F.col("ots").between(F.col("from_us"), at)).drop("bucket", "from_us")


def nearest(stamps: DataFrame, points: DataFrame, inclusive: bool, forward: bool = False) -> DataFrame:
    """As-of join of stamps (asset_id, ts): points with the last ts at or before them (forward: the first at or after), equal ones only if inclusive.

    Stamps and points are one table, ordered within buckets of time, and a
    bucket without an earlier stamp takes the last one of the buckets before,
    which is one small row each.  So no stamp meets all points of its asset, and
    a hot asset is shared by as many tasks as it has buckets.  Points without
    such a stamp are left out.
    """
    sign = -1 if forward else 1
    bucket = F.floor(F.col("t") / F.lit(ASOF_BUCKET_US)).cast("long")
    # of equal times what comes first: the stamps, if they count for the points
    first, second = (0, 1) if inclusive else (1, 0)
    known = stamps.select("asset_id", (F.col("ts") * sign).alias("t")).distinct().select("asset_id", "t", F.lit(first).alias("turn"), F.col("t").alias("stamp"))
    asked = points.select("query_id", "asset_id", "at_us", (F.col("at_us") * sign).alias("t"), F.lit(second).alias("turn"), F.lit(True).alias("asked"))
    both = known.unionByName(asked, allowMissingColumns=True).withColumn("bucket", bucket)
    inside = Window.partitionBy("asset_id", "bucket").orderBy("t", "turn").rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("own", F.max("stamp").over(inside)).where("asked")
    ends = both.groupBy("asset_id", "bucket").agg(F.max("stamp").alias("end"))
    earlier = F.max("end").over(Window.partitionBy("asset_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    found = local.join(ends.select("asset_id", "bucket", earlier.alias("carried")), ["asset_id", "bucket"]).withColumn("stamp", F.coalesce("own", "carried"))
    return found.where("stamp is not null").select(*POINT, "at_us", (F.col("stamp") * sign).alias("ts"))


def _stamped(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.select("asset_id", F.col("checkpoint_timestamp_us").alias("ts"))


def checkpoint_at(checkpoints: DataFrame, points: DataFrame, inclusive: bool = True) -> DataFrame:
    """As-of join: every point's latest checkpoint at (or strictly before) it, as columns cp_ts, cp_bids and cp_asks.

    Only stamps are searched; the levels of those found are fetched by key.  Of
    equal stamps the one received last counts.
    """
    found = nearest(_stamped(checkpoints), points, inclusive).select(*POINT, "ts")
    payload = checkpoints.select("asset_id", F.col("checkpoint_timestamp_us").alias("ts"), F.struct("recv_timestamp_us", "bids_json", "asks_json").alias("cp"))
    joined = found.join(payload, ["asset_id", "ts"]).groupBy(*POINT, "ts").agg(F.max("cp").alias("cp"))
    return joined.select(*POINT, F.col("ts").alias("cp_ts"), levels_from_json(F.col("cp.bids_json")).alias("cp_bids"), levels_from_json(F.col("cp.asks_json")).alias("cp_asks"))


def checkpoint_after(checkpoints: DataFrame, points: DataFrame, lookback_us: int = HOUR_US) -> DataFrame:
    """As-of join forward: every point's first checkpoint strictly after it and within the lookback; of equal stamps the one received first."""
    found = nearest(_stamped(checkpoints), points, False, forward=True).where(F.col("ts") <= F.col("at_us") + lookback_us)
    payload = checkpoints.select("asset_id", F.col("checkpoint_timestamp_us").alias("ts"), F.struct("recv_timestamp_us", "bids_json", "asks_json").alias("ref"))
    joined = found.join(payload, ["asset_id", "ts"]).groupBy(*POINT, "at_us", "ts").agg(F.min("ref").alias("ref"))
    return joined.select(*POINT, "at_us", F.col("ts").alias("ref_ts"), levels_from_json(F.col("ref.bids_json")).alias("ref_bids"), levels_from_json(F.col("ref.asks_json")).alias("ref_asks"))


def _max_key(condition: Column) -> Column:
    return F.max(F.when(condition, F.col("key")))


def reconstruct(events: DataFrame, points: DataFrame, mode: str = "recv_time", lookback_us: int | None = HOUR_US, checkpoints: DataFrame | None = None, inclusive: bool = True) -> Replay:
    """Rebuilds the book of every point.

    A checkpoint, if there is one at or before the point, is the base unless a
    later snapshot replaces it; else the last snapshot is.  Zero sizes are
    ignored in snapshots and checkpoints and delete a level in deltas.  Both
    modes take events by receive time; a point with neither snapshot nor
    checkpoint has no header and no levels.  Without a lookback a base may be of
    any age.

    header: query_id, asset_id, sequence, last_update_us, used_checkpoint.
    levels: query_id, asset_id, side, price, size.
    """
    if checkpoints is None:
        known = points.withColumns({"cp_ts": F.lit(None).cast("long")})
        cp = None
    else:
        cp = stored(checkpoint_at(checkpoints, points, inclusive), "checkpoints-at")  # one row for each point, used three times
        known = points.join(cp.select(*POINT, "cp_ts"), POINT, "left")
    rows = ordered(events, mode)
    rows = since_base(rows, known) if lookback_us is None else at_points(rows, points, lookback_us).where(F.col("ots") <= F.col("at_us"))
    if cp is not None:
        rows = rows.join(cp.select(*POINT, "cp_ts"), POINT, "left").where(F.col("cp_ts").isNull() | (F.col("ots") > F.col("cp_ts")))
    is_snapshot, is_delta = F.col("event_kind") == SNAPSHOT, F.col("event_kind") == DELTA
    # the last snapshot row, and the last delta among the rows of its time before it
    snaps = rows.groupBy(*POINT).agg(_max_key(is_snapshot).alias("snap"))
    rows = rows.join(snaps, POINT)
    breaks = rows.where(is_delta & (F.col("ots") == F.col("snap.ots")) & (F.col("key") < F.col("snap"))).groupBy(*POINT).agg(F.max("key").alias("brk"))
    rows = rows.join(breaks, POINT, "left")
    has_cp = F.lit(False) if cp is None else F.col("cp_ts").isNotNull()
    in_run = ~has_cp | F.col("brk").isNull() | (F.col("key") > F.col("brk"))
    is_base = is_snapshot & F.col("snap").isNotNull() & (F.col("ots") == F.col("snap.ots")) & in_run
    is_tail = is_delta & F.when(F.col("snap").isNull(), has_cp).otherwise(F.col("key") > F.col("snap"))
    rows = rows.withColumns({"is_base": is_base, "is_tail": is_tail})
    applied = rows.where("is_base or is_tail")

    slim = applied.where((F.col("size") > 0) | F.col("is_tail")).select(*POINT, "side", "price", F.struct(F.col("is_tail").cast("int").alias("phase"), "key", "size").alias("last"))
    if cp is not None:
        used = cp.join(snaps, POINT, "left").where("snap is null")  # no later snapshot replaces them
        sides = F.concat(*[F.transform(F.col(c), _with_side(s)) for c, s in (("cp_bids", 1), ("cp_asks", 2))])
        flat = used.select(*POINT, F.posexplode(sides).alias("pos", "l")).where("l.size > 0")
        first = F.struct(F.lit(-1).alias("phase"), F.struct(F.lit(0).cast("long").alias("ots"), F.lit(0).cast("long").alias("k2"), F.col("pos").cast("long").alias("sq"), F.lit("").alias("id"), F.col("l.side").alias("side"), F.col("l.price").alias("price"), F.col("l.size").alias("size")).alias("key"), F.col("l.size").alias("size"))
        slim = slim.unionByName(flat.select(*POINT, F.col("l.side").alias("side"), F.col("l.price").alias("price"), first.alias("last")))
    levels = slim.groupBy(*POINT, "side", "price").agg(F.max("last")["size"].alias("size")).where("size > 0").select(*POINT, "side", "price", "size")

    newest = applied.groupBy(*POINT).agg(F.max(F.struct(F.col("is_tail").cast("int").alias("phase"), "key", "recv_timestamp_us")).alias("last"))
    header = known.join(newest, POINT, "left").where(F.col("last").isNotNull() | F.col("cp_ts").isNotNull())
    header = header.select(
        *POINT, F.coalesce(F.col("last.key.sq"), F.lit(0).cast("long")).alias("sequence"),
        F.coalesce(F.when(F.col("last.phase") == 0, F.col("last.key.ots")).otherwise(F.col("last.recv_timestamp_us")), F.col("cp_ts")).alias("last_update_us"),
        F.col("cp_ts").isNotNull().alias("used_checkpoint"),
    )
    # with a checkpoint, rows before the last snapshot were applied too
    sequence = rows.where(F.col("is_base") | F.col("is_tail") | has_cp)
    return Replay(header, levels, sequence, points)


def _with_side(side: int):
    return lambda x: F.struct(F.lit(side).cast("tinyint").alias("side"), x["price"].alias("price"), x["size"].alias("size"))


def gaps(replay: Replay) -> DataFrame:
    """Sequence gaps of the applied deltas, as continuity events of their points.

    A delta is a gap if the row applied before it has a sequence above 0 and
    its own is not the next; a missing sequence counts as 0.
    """
    phase = F.when(F.col("is_base"), 0).otherwise(1) if "cp_ts" not in replay.applied.columns else F.when(F.col("cp_ts").isNotNull(), 0).when(F.col("is_base"), 0).otherwise(1)
    by = Window.partitionBy(*POINT).orderBy(phase, "key")
    before = F.lag(F.col("key.sq")).over(by)
    rows = replay.applied.withColumn("before", F.coalesce(before, F.lit(0)))
    rows = rows.where((F.col("event_kind") == DELTA) & (F.col("before") > 0) & (F.col("key.sq") != F.col("before") + 1))
    expected, observed = F.col("before") + 1, F.col("key.sq")
    return rows.select(
        "query_id", "recv_timestamp_us", "exchange_timestamp_us", "asset_id", F.lit("sequence_gap").alias("event_kind"), "sequence", expected.alias("expected_sequence"), observed.alias("observed_sequence"),
        gap_text(F.col("asset_id"), expected, observed).alias("details"), "source", "source_event_id", "source_session_id",
    )


def continuity(replay: Replay, ingest: DataFrame, lookback_us: int | None = HOUR_US) -> DataFrame:
    """Every point's stored continuity events (global ones too) by receive time, then its gaps.

    position orders them.
    """
    recv, at = F.col("recv_timestamp_us"), F.col("at_us")
    low = F.lit(0) if lookback_us is None else F.greatest(at - lookback_us, F.lit(0))
    points = replay.points
    # by time bucket, so no event meets all points of its asset, and global events not all points
    step = lookback_us or 24 * HOUR_US
    dealt = ingest.withColumnRenamed("asset_id", "event_asset").withColumn("bucket", F.call_function("div", recv, F.lit(step)))
    reach = points.withColumn("bucket", F.explode(F.sequence(F.call_function("div", low, F.lit(step)), F.call_function("div", at, F.lit(step)))))
    own = dealt.where("event_asset is not null").withColumn("asset_id", F.col("event_asset")).join(reach, ["asset_id", "bucket"]).drop("bucket")
    of_all = dealt.where("event_asset is null").join(reach, "bucket").drop("bucket")
    stored = own.unionByName(of_all).where(recv.between(low, at))
    columns = ["query_id", "asset_id", "event_asset", "event_kind", "recv_timestamp_us", "exchange_timestamp_us", "expected_sequence", "observed_sequence", "details", "source_event_id"]
    found = gaps(replay).withColumn("event_asset", F.col("asset_id"))
    both = stored.select(*columns, F.lit(0).alias("late")).unionByName(found.select(*columns, F.lit(1).alias("late")))
    order = Window.partitionBy(*POINT).orderBy("late", "recv_timestamp_us", F.coalesce("source_event_id", F.lit("")), F.coalesce("observed_sequence", F.lit(0)))
    return both.withColumn("position", F.row_number().over(order).cast("long")).drop("late")


def snapshot_runs(events: DataFrame, mode: str = "recv_time") -> DataFrame:
    """Runs of snapshot rows of one time that no delta interrupts: (asset_id, ots, run, n, first_sequence, last_sequence).

    The order begins with the time, so rows of one time stand together, and a
    run is the rows that have as many others of their time before them; rows
    with equal keys stand in the order of their kinds.  One
    shuffle by asset and time serves all steps, and no asset's history is
    sorted as a whole.
    """
    at = Window.partitionBy("asset_id", "ots").orderBy("key", "event_kind")
    is_snapshot = F.col("event_kind").eqNullSafe(SNAPSHOT)
    others = F.sum(F.when(is_snapshot, 0).otherwise(1)).over(at.rowsBetween(Window.unboundedPreceding, 0))
    runs = ordered(events, mode).select("asset_id", "ots", "key", "event_kind", others.alias("run")).where(is_snapshot)
    sq = F.col("key.sq")
    grouped = runs.groupBy("asset_id", "ots", "run").agg(F.count("*").alias("n"), F.min("key")["sq"].alias("first_sequence"), F.max("key")["sq"].alias("last_sequence"), F.sum((sq == 0).cast("long")).alias("n_unnumbered"))
    order = Window.partitionBy("asset_id", "ots").orderBy("run")
    return grouped.withColumn("run", F.row_number().over(order).cast("long"))


def validate(events: DataFrame, points: DataFrame, checkpoints: DataFrame, mode: str = "recv_time", base: str = "strict", lookback_us: int = HOUR_US, persisted_at_us: int = 0) -> DataFrame:
    """Compares each point's next checkpoint with the book rebuilt at that checkpoint's time.

    base "inclusive" may rebuild from the reference checkpoint itself, which
    tests little; "strict" uses only earlier checkpoints and so shows drift.
    Points without a checkpoint in reach give no row; a book that cannot be
    rebuilt does not match.  Returns replay_validations rows with query_id.
    """
    if base not in ("strict", "inclusive"):
        raise BadRequest("base must be strict or inclusive")
    refs = stored(checkpoint_after(checkpoints, points, lookback_us), "references")
    at_refs = refs.select("query_id", "asset_id", F.col("ref_ts").alias("at_us"))
    replay = reconstruct(events, at_refs, mode, lookback_us, checkpoints, inclusive=base == "inclusive")
    levels = stored(replay.levels, "rebuilt-levels")
    sides = F.concat(*[F.transform(F.col(c), _with_side(s)) for c, s in (("ref_bids", 1), ("ref_asks", 2))])
    want = refs.select(*POINT, F.explode(sides).alias("l")).select(*POINT, "l.side", "l.price", "l.size")
    # a level counts as often as it is listed: duplicates never match
    want_n = want.groupBy(*POINT, "side", "price", "size").agg(F.count("*").alias("n"))
    both = levels.withColumn("have", F.lit(1).cast("long")).join(want_n, [*POINT, "side", "price", "size"], "full_outer")
    wrong = both.groupBy(*POINT).agg(F.sum(F.when(F.col("have").eqNullSafe(F.col("n")), 0).otherwise(1)).alias("wrong"))

    def tops(levels: DataFrame, name: str) -> DataFrame:
        s = book.summary(levels)
        text = [F.coalesce(F.concat(price_text(F.col(f"{c}.price")), F.lit(" @ "), size_text(F.col(f"{c}.size"))), F.lit("none")) for c in ("bid", "ask")]
        return s.select(*POINT, F.col("bid_depth").alias(f"{name}_bd"), F.col("ask_depth").alias(f"{name}_ad"), text[0].alias(f"{name}_b"), text[1].alias(f"{name}_a"))

    joined = refs.join(wrong, POINT, "left").join(replay.header.select(*POINT, F.lit(True).alias("rebuilt")), POINT, "left").join(tops(levels, "book"), POINT, "left").join(tops(want, "ref"), POINT, "left")
    matched = F.coalesce(F.col("wrong"), F.lit(0)).eqNullSafe(F.lit(0)) & F.coalesce("rebuilt", F.lit(False))

    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("string")

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("none"))

    parts = [("bid_depth=", number("book_bd")), (" checkpoint_bid_depth=", number("ref_bd")), (" ask_depth=", number("book_ad")), (" checkpoint_ask_depth=", number("ref_ad")), (" best_bid=", text("book_b")), (" checkpoint_best_bid=", text("ref_b")), (" best_ask=", text("book_a")), (" checkpoint_best_ask=", text("ref_a"))]
    said = F.concat(*[x for label, value in parts for x in (F.lit(label), value)])
    return joined.select("query_id", "asset_id", F.lit(mode).alias("mode"), F.col("at_us").alias("replay_timestamp_us"), F.col("ref_ts").alias("reference_timestamp_us"), matched.alias("matched"), F.when(~matched, said).alias("mismatch_summary"), F.lit(persisted_at_us).cast("long").alias("persisted_at_us"))


def derived_checkpoints(replay: Replay) -> DataFrame:
    """The rebuilt books as book_checkpoints rows stamped with their points' times."""
    books = replay.header.select(*POINT).join(book.nested(replay.levels), POINT, "left").join(replay.points, POINT)
    empty = F.array().cast("array<struct<price:int,size:bigint>>")
    ts = F.col("at_us")
    return books.select(
        ts.alias("checkpoint_timestamp_us"), ts.alias("recv_timestamp_us"), ts.alias("exchange_timestamp_us"), "asset_id", F.lit("replay_validator").alias("source"), F.lit(None).cast("string").alias("source_event_id"),
        F.lit(None).cast("string").alias("source_session_id"), levels_to_json(F.coalesce("bids", empty)).alias("bids_json"), levels_to_json(F.coalesce("asks", empty)).alias("asks_json"),
    )


def series(events: DataFrame, points: DataFrame, mode: str = "recv_time", lookback_us: int | None = HOUR_US, checkpoints: DataFrame | None = None) -> DataFrame:
    """Top of book of one asset or many at many times: the points' books in time order."""
    replay = reconstruct(events, points, mode, lookback_us, checkpoints)
    return replay.points.join(replay.header, POINT).join(book.top_of_book(replay.levels), POINT, "left")
