"""Raw feed messages to typed rows, as windows over arrival order.

messages(arrival, kind, text, recv_timestamp_us, session_id, details): kind is
"raw" for a JSON text, "reconnect_start" or "reconnect_success" for a change of
the connection.  arrival is a number that grows along the feed (an offset, not
monotonically_increasing_id after a shuffle).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codecs import feed_timestamp_us, side_code, stale_text
from ..functions.fixedpoint import price_from_text, size_from_text
from ..schemas import ASK, BID, DATASETS, DELTA, SNAPSHOT

_TEXT = T.StringType()
_LEVEL = T.ArrayType(T.StructType([T.StructField("price", _TEXT), T.StructField("size", _TEXT)]))
_CHANGE = T.ArrayType(T.StructType([T.StructField(n, _TEXT) for n in ("asset_id", "price", "size", "side", "hash", "best_bid", "best_ask")]))
_FIELDS = ("event_type", "asset_id", "market", "timestamp", "hash", "price", "size", "side", "fee_rate_bps", "transaction_hash")
MESSAGE = T.StructType([T.StructField(n, _TEXT) for n in _FIELDS] + [T.StructField("bids", _LEVEL), T.StructField("asks", _LEVEL), T.StructField("price_changes", _CHANGE)])
RESET_TEXT = "connection re-established; downstream readers should treat continuity as reset"


@dataclass
class Normalized:
    """The typed rows of a feed."""

    book_events: DataFrame
    trade_events: DataFrame
    ingest_events: DataFrame


def _complete(levels: Column, names: list[str]) -> Column:
    """Whether the list is there and every entry has the fields."""
    def missing(x: Column) -> Column:
        out = x.isNull()
        for n in names:
            out = out | x[n].isNull()
        return out

    return levels.isNotNull() & ~F.exists(levels, missing)


def parsed(messages: DataFrame) -> DataFrame:
    """Raw messages with their fields; texts that are no complete message of a known type go."""
    # a generator keeps the filters below from being pushed into many copies of the parser
    m = messages.where("kind = 'raw'").select("*", F.explode(F.array(F.from_json("text", MESSAGE))).alias("m"))
    kind = F.col("m.event_type")
    book = (kind == "book") & F.col("m.asset_id").isNotNull() & _complete(F.col("m.bids"), ["price", "size"]) & _complete(F.col("m.asks"), ["price", "size"])
    change = (kind == "price_change") & _complete(F.col("m.price_changes"), ["asset_id", "price", "size", "side"])
    trade = (kind == "last_trade_price") & F.col("m.asset_id").isNotNull() & F.col("m.price").isNotNull()
    return m.where(book | change | trade).withColumn("exchange_timestamp_us", feed_timestamp_us(F.col("m.timestamp")))


#: Arrivals of a bucket in which a message looks up its session.
SESSION_BUCKET = 512
#: Arrivals of a bucket in which an asset's rows are numbered.
NUMBER_BUCKET = 1_000_000


def with_session(messages: DataFrame) -> DataFrame:
    """Adds the session of the last successful connection so far.

    Connections are few, so they are listed by the buckets of arrivals that
    they reach into, and each message looks through its own bucket's short
    list: the messages are neither sorted nor moved.  The last connection has
    no end and is one row for all.
    """
    changes = messages.where("kind = 'reconnect_success'").select("arrival", "session_id")
    bucket = F.call_function("div", F.col("arrival"), F.lit(SESSION_BUCKET))
    until = F.lead(bucket).over(Window.orderBy("arrival"))
    spans = changes.withColumns({"first": bucket, "until": until}).where("until is not null")
    listed = spans.select("arrival", "session_id", F.explode(F.sequence("first", "until")).alias("bucket")).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("arrival", "session_id")), asc=False).alias("sessions"))
    last = changes.agg(F.max(F.struct("arrival", "session_id")).alias("newest"))
    joined = messages.drop("session_id").withColumn("bucket", bucket).join(listed, "bucket", "left").join(F.broadcast(last))
    earlier = F.get(F.filter("sessions", lambda s: s["arrival"] <= F.col("arrival")), F.lit(0))["session_id"]
    found = F.when(F.col("arrival") >= F.col("newest.arrival"), F.col("newest.session_id")).otherwise(earlier)
    return joined.withColumn("session_id", found).drop("sessions", "bucket", "newest")


def book_messages(rows: DataFrame) -> DataFrame:
    """The heads of book messages, without their levels, with latest (largest earlier stamp of the asset) and stale.

    Maxima are taken within buckets of arrivals and carried from bucket to
    bucket by one small row per asset and bucket, as in numbered().
    """
    heads = rows.where(F.col("m.event_type") == "book").select("arrival", "recv_timestamp_us", "exchange_timestamp_us", "session_id", F.col("m.asset_id").alias("asset_id"), F.col("m.hash").alias("source_event_id"))
    ts = F.col("exchange_timestamp_us")
    heads = heads.withColumns({"bucket": F.call_function("div", F.col("arrival"), F.lit(NUMBER_BUCKET)), "stamp": F.when(ts > 0, ts)})
    inside = Window.partitionBy("asset_id", "bucket").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    ends = heads.groupBy("asset_id", "bucket").agg(F.max("stamp").alias("end"))
    before = F.max("end").over(Window.partitionBy("asset_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("asset_id", "bucket", before.alias("carried"))
    latest = F.greatest(F.max("stamp").over(inside), F.col("carried"))
    placed = heads.join(carried, ["asset_id", "bucket"]).withColumn("latest", latest)
    return placed.withColumn("stale", F.coalesce((ts > 0) & (ts <= F.col("latest")), F.lit(False))).drop("bucket", "stamp", "carried")


def cut_levels(rows: DataFrame) -> DataFrame:
    """Adds l, the level changes of each message in its order, and takes m away.

    Changes of an unknown side are skipped; the first bad price or size cuts
    the rest of its message.  Both are found in the message's own array.
    """
    asset, hashed = F.col("m.asset_id"), F.col("m.hash")

    def level(kind: int, side, asset_of, hash_of):
        return lambda x: F.struct(
            F.lit(kind).cast("tinyint").alias("event_kind"), asset_of(x).alias("asset_id"), hash_of(x).alias("source_event_id"), side(x).cast("tinyint").alias("side"),
            price_from_text(x["price"]).alias("price"), size_from_text(x["size"]).alias("size"),
        )

    snaps = F.concat(*[F.transform(f"m.{name}", level(SNAPSHOT, lambda x, s=side: F.lit(s), lambda x: asset, lambda x: hashed)) for name, side in (("bids", BID), ("asks", ASK))])
    changes = F.filter(F.transform("m.price_changes", level(DELTA, lambda x: side_code(x["side"]), lambda x: x["asset_id"], lambda x: x["hash"])), lambda x: x["side"].isNotNull())
    # a generator keeps the list from being built anew for each of its uses
    listed = F.when(F.col("m.event_type") == "book", snaps).when(F.col("m.event_type") == "price_change", changes)
    rows = rows.select("*", F.explode(F.array(listed)).alias("all"))
    bad = F.array_min(F.filter(F.transform("all", lambda x, i: F.when(x["price"].isNull() | x["size"].isNull(), i)), lambda i: i.isNotNull()))
    return rows.withColumn("l", F.slice("all", F.lit(1), F.coalesce(bad, F.size("all")))).drop("all")


def level_rows(books: DataFrame, rows: DataFrame) -> DataFrame:
    """Level changes of accepted snapshots and price changes before numbering: one row per level, in message order.

    Of the books only the few stale ones meet the messages.
    """
    flat = cut_levels(rows).select("arrival", "recv_timestamp_us", "exchange_timestamp_us", "session_id", F.posexplode("l").alias("pos", "x")).select("*", "x.*").drop("x")
    return flat.join(books.where("stale").select("arrival"), "arrival", "left_anti")


def numbered(levels: DataFrame, books: DataFrame) -> DataFrame:
    """Adds the sequence: per asset from 0, anew from every accepted snapshot, empty ones too.

    Rows are counted within buckets of arrivals first; what a bucket hands on
    to the next follows from one small row per asset and bucket.  So an asset
    that holds most of the feed is numbered by many tasks.
    """
    bucket = F.call_function("div", F.col("arrival"), F.lit(NUMBER_BUCKET))
    starts = books.where("not stale").select("asset_id", "arrival", F.lit(-1).alias("pos"), F.lit(1).alias("start"))
    columns = [c for c in levels.columns if c not in ("asset_id", "arrival", "pos")]
    both = levels.withColumn("start", F.lit(0)).unionByName(starts, allowMissingColumns=True).withColumn("bucket", bucket)
    inside = Window.partitionBy("asset_id", "bucket").orderBy("arrival", "pos")
    local = both.withColumn("epoch", F.sum("start").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.row_number().over(Window.partitionBy("asset_id", "bucket", "epoch").orderBy("arrival", "pos")).cast("long")
    # the start of an epoch is its row 1; rows before the bucket's first start go on from the bucket before
    placed = local.withColumn("rank", F.when(F.col("epoch") == 0, rank - 1).otherwise(rank - 2))

    ends = placed.groupBy("asset_id", "bucket").agg(F.max("epoch").alias("starts"), F.max(F.struct("epoch", "rank"))["rank"].alias("last"))
    by_bucket = Window.partitionBy("asset_id").orderBy("bucket")
    runs = ends.withColumn("run", F.sum((F.col("starts") > 0).cast("int")).over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)))
    given = runs.withColumn("given", F.sum(F.col("last") + 1).over(Window.partitionBy("asset_id", "run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    carried = given.select("asset_id", "bucket", F.coalesce(F.lag("given").over(by_bucket), F.lit(0)).alias("carry"))
    joined = placed.where("start = 0").join(carried, ["asset_id", "bucket"])
    sequence = F.col("rank") + F.when(F.col("epoch") == 0, F.col("carry")).otherwise(0)
    return joined.select("asset_id", "arrival", "pos", *columns, sequence.alias("sequence"))


def lifecycle_rows(messages: DataFrame) -> DataFrame:
    """Continuity rows of connection changes; a success gives a reset as well."""
    kinds = F.when(F.col("kind") == "reconnect_success", F.array(F.lit("reconnect_success"), F.lit("source_reset"))).otherwise(F.array(F.col("kind")))
    rows = messages.where("kind in ('reconnect_start', 'reconnect_success')").withColumn("event_kind", F.explode(kinds))
    details = F.when(F.col("event_kind") == "source_reset", RESET_TEXT).otherwise(F.col("details"))
    return _ingest(rows, F.lit(None), F.col("event_kind"), F.lit(0), F.lit(None), details)


def _ingest(rows: DataFrame, asset: Column, kind: Column, exchange: Column, event_id: Column, details: Column) -> DataFrame:
    none = F.lit(None)
    return rows.select(
        F.col("recv_timestamp_us"), exchange.cast("long").alias("exchange_timestamp_us"), asset.cast("string").alias("asset_id"), kind.alias("event_kind"), none.cast("long").alias("sequence"), none.cast("long").alias("expected_sequence"),
        none.cast("long").alias("observed_sequence"), details.cast("string").alias("details"), F.lit("websocket").alias("source"), event_id.cast("string").alias("source_event_id"), F.col("session_id").alias("source_session_id"),
    )


def with_trade(rows: DataFrame) -> DataFrame:
    """Adds price, size, side and fidelity of trade messages, and priced: whether it is a trade whose price and size are not bad."""
    t = rows.withColumns({"price": price_from_text(F.col("m.price")), "size": size_from_text(F.col("m.size")), "side": side_code(F.col("m.side"))})
    full = F.col("size").isNotNull() & F.col("side").isNotNull()
    priced = (F.col("m.event_type") == "last_trade_price") & F.col("price").isNotNull() & (F.col("m.size").isNull() | F.col("size").isNotNull())
    return t.withColumns({"fidelity": F.when(full, "full").otherwise("partial"), "priced": priced})


def priced_trades(rows: DataFrame) -> DataFrame:
    """Trade messages with price, size, side and fidelity; one with a bad price or size is dropped, an unknown side is null."""
    return with_trade(rows.where(F.col("m.event_type") == "last_trade_price")).where("priced")


def trade_rows(rows: DataFrame) -> DataFrame:
    """Trades as trade_events rows."""
    return priced_trades(rows).select(
        "recv_timestamp_us", "exchange_timestamp_us", F.col("m.asset_id").alias("asset_id"), "price", "size", "side", F.col("m.transaction_hash").alias("trade_id"), "fidelity",
        F.lit(None).cast("long").alias("sequence"), F.lit("websocket").alias("source"), F.col("m.transaction_hash").alias("source_event_id"), F.col("session_id").alias("source_session_id"),
    )


def normalize(messages: DataFrame) -> Normalized:
    """All typed rows of a feed's messages."""
    rows = parsed(with_session(messages))
    books = book_messages(rows)
    levels = numbered(level_rows(books, rows), books)
    events = levels.withColumn("source", F.lit("websocket")).withColumnRenamed("session_id", "source_session_id")
    stale = _ingest(books.where("stale"), F.col("asset_id"), F.lit("stale_snapshot_skip"), F.col("exchange_timestamp_us"), F.col("source_event_id"), stale_text(F.col("exchange_timestamp_us"), F.col("latest")))
    return Normalized(events.select([f.name for f in DATASETS["book_events"].fields]), trade_rows(rows), stale.unionByName(lifecycle_rows(messages)))


def metric_counts(messages: DataFrame) -> DataFrame:
    """Counters of a feed: (metric, label, n)."""
    rows = parsed(messages)
    books = book_messages(rows)
    levels = numbered(level_rows(books, rows), books)

    def count(df: DataFrame, metric: str, label: Column = F.lit("")) -> DataFrame:
        return df.groupBy(label.alias("label")).agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), "label", "n")

    parts = [
        count(rows, "messages_received", F.col("m.event_type")), count(books.where("not stale"), "snapshots_reconciled"), count(books.where("stale"), "stale_snapshots_skipped"),
        count(levels.where(F.col("event_kind") == SNAPSHOT), "snapshots_applied"), count(levels.where(F.col("event_kind") == DELTA), "deltas_applied"), count(trade_rows(rows), "trades_received"),
        count(messages.where("kind = 'reconnect_success'"), "reconnections"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
