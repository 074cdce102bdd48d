"""One query for each operator, over the datasets as views of the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sample_feed, schemas
from .functions import codecs, fixedpoint
from .operators import book, execution, integrity, live, markets, normalize, replay, timeline
from .schemas import PARTITION_TIME
from .sources import feed, ledger, live_source, storage, tables, views

DAY_US = 86_400_000_000
#: The times (query_id, at_us) of the books that the replay queries rebuild, for every asset, and their lookback.
TIMES = [(1, 1_704_862_800_000_000), (2, 1_705_755_600_000_000), (3, 1_706_518_799_999_999)]
LOOKBACK_US = 3 * DAY_US
START_US, END_US = 1_704_499_200_000_000, 1_705_363_200_000_000
NOW_US = 1_706_572_800_000_000


def points(spark: SparkSession) -> DataFrame:
    """Every asset at every time."""
    times = F.array(*[F.struct(F.lit(q).alias("query_id"), F.lit(t).cast("long").alias("at_us")) for q, t in TIMES])
    assets = spark.range(10).select(F.concat(F.lit("A"), F.col("id").cast("string")).alias("asset_id"))
    return assets.select("asset_id", F.explode(times).alias("t")).select("t.query_id", "asset_id", "t.at_us")


def _replay(spark: SparkSession, folder: str, mode: str = "recv_time", checkpoints: bool = False, lookback_us: int | None = LOOKBACK_US) -> replay.Replay:
    cps = views.book_checkpoints(spark, folder) if checkpoints else None
    return replay.reconstruct(views.book_events(spark, folder), points(spark), mode, lookback_us, cps)


def _levels(df: DataFrame) -> DataFrame:
    return df.select("query_id", "asset_id", F.col("side").cast("int").alias("side"), "price", "size")


def _arrivals(df: DataFrame) -> DataFrame:
    """Rows with an arrival number: the id of the event they come from."""
    return df.withColumn("arrival", F.substring("source_event_id", 2, 20).cast("long"))


def _exact_sum(name: str):
    """The sum of a clock as a decimal: some 5,400 stamps of today already add up to more than a long holds."""
    return F.sum(F.col(name).cast("decimal(20,0)"))


def _totals(df: DataFrame, name: str) -> DataFrame:
    """Rows with exact sums in a column: as longs where all of them fit, or else as decimals."""
    rows = feed.stored(df, "totals")
    return rows if rows.where(F.abs(name) > (1 << 63) - 1).limit(1).count() else rows.withColumn(name, F.col(name).cast("long"))


def scan_book_window(spark, folder):
    rows = storage.scan(views.book_events(spark, folder), "book_events", START_US, END_US, "A3")
    return rows.select("source_event_id", "recv_timestamp_us", "exchange_timestamp_us", codecs.code_name(F.col("event_kind"), {1: "Snapshot", 2: "Delta"}).alias("kind"), codecs.code_name(F.col("side"), {1: "Bid", 2: "Ask"}).alias("side_name"), "price", "size", "sequence")


def scan_trades(spark, folder):
    return storage.scan(views.trade_events(spark, folder), "trade_events", START_US, END_US, "A3").select("trade_id", "price", "size", F.col("side").cast("int").alias("side"), "fidelity")


def scan_ingest_asset_or_global(spark, folder):
    return storage.scan(views.ingest_events(spark, folder), "ingest_events", START_US, END_US, "A3").select("source_event_id", "asset_id", "event_kind", "expected_sequence", "observed_sequence", "details")


def scan_checkpoints(spark, folder):
    rows = storage.in_time(storage.scan(views.book_checkpoints(spark, folder), "book_checkpoints", START_US, END_US, "A3"), "book_checkpoints")
    levels = F.concat(*[F.transform(c, replay._with_side(s)) for c, s in (("bids", 1), ("asks", 2))])
    flat = storage.checkpoint_levels(rows).select("checkpoint_timestamp_us", F.explode(levels).alias("l"))
    return flat.select("checkpoint_timestamp_us", F.col("l.side").cast("int").alias("side"), "l.price", "l.size")


def scan_validations(spark, folder):
    rows = storage.in_time(storage.scan(views.replay_validations(spark, folder), "replay_validations", START_US, END_US, "A3"), "replay_validations")
    return rows.select("asset_id", "mode", "replay_timestamp_us", "reference_timestamp_us", "matched", "mismatch_summary", "persisted_at_us")


def scan_executions(spark, folder):
    rows = storage.with_latency(storage.scan(views.execution_events(spark, folder), "execution_events", 0, NOW_US * 2, order_id="O7"))
    return rows.select("event_timestamp_us", "asset_id", "order_id", "event_kind", F.col("side").cast("int").alias("side"), "price", "size", "status", "latency.exchange_ack_us", "latency.exchange_fill_us")


def replay_window(spark, folder):
    """The raw window of one asset: the three scans, as counts by dataset."""
    parts = [storage.scan(views.VIEWS[d](spark, folder), d, START_US, END_US, "A3").agg(F.lit(d).alias("dataset"), F.count("*").alias("n")) for d in ("book_events", "trade_events", "ingest_events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def storage_roundtrip(spark, folder):
    """Book events written to the hour-partitioned layout, read back and scanned with pruning."""
    base = feed.scratch(spark, "datasets")
    storage.write(views.book_events(spark, folder), base, "book_events", "overwrite")
    rows = storage.scan(storage.read(spark, base, "book_events"), "book_events", START_US, END_US, "A3")
    return rows.select("source_event_id", "recv_timestamp_us", "price", "size", "sequence")


def latest_checkpoint_asof(spark, folder):
    found = replay.checkpoint_at(views.book_checkpoints(spark, folder), points(spark))
    return found.select("query_id", "asset_id", "cp_ts", F.size("cp_bids").cast("long").alias("n_bids"), F.size("cp_asks").cast("long").alias("n_asks"))


def next_checkpoint_asof(spark, folder):
    found = replay.checkpoint_after(views.book_checkpoints(spark, folder), points(spark), LOOKBACK_US)
    return found.select("query_id", "asset_id", "at_us", "ref_ts", F.size("ref_bids").cast("long").alias("n_bids"), F.size("ref_asks").cast("long").alias("n_asks"))


def recon_recv_levels(spark, folder):
    return _levels(_replay(spark, folder).levels)


def recon_exchange_levels(spark, folder):
    return _levels(_replay(spark, folder, "exchange_time").levels)


def recon_checkpoint_levels(spark, folder):
    return _levels(_replay(spark, folder, checkpoints=True).levels)


def recon_checkpoint_exchange_levels(spark, folder):
    return _levels(_replay(spark, folder, "exchange_time", True).levels)


def recon_whole_levels(spark, folder):
    """Books rebuilt from their last snapshot, however old that is."""
    return _levels(_replay(spark, folder, lookback_us=None).levels)


def recon_whole_checkpoint_levels(spark, folder):
    """Books rebuilt from their last checkpoint, however old that is."""
    return _levels(_replay(spark, folder, "exchange_time", True, None).levels)


def recon_whole_gaps(spark, folder):
    """Sequence gaps since the last snapshot, however old that is."""
    return _gap_columns(replay.gaps(_replay(spark, folder, lookback_us=None)))


def recon_header(spark, folder):
    return _replay(spark, folder).header


def recon_checkpoint_header(spark, folder):
    return _replay(spark, folder, "exchange_time", True).header


def _gap_columns(df):
    return df.select("query_id", "asset_id", "source_event_id", "expected_sequence", "observed_sequence", "details")


def recon_gaps(spark, folder):
    return _gap_columns(replay.gaps(_replay(spark, folder)))


def recon_checkpoint_gaps(spark, folder):
    return _gap_columns(replay.gaps(_replay(spark, folder, checkpoints=True)))


def replay_continuity(spark, folder):
    rows = replay.continuity(_replay(spark, folder), views.ingest_events(spark, folder), LOOKBACK_US)
    return rows.select("query_id", "asset_id", "position", "event_asset", "event_kind", "recv_timestamp_us", "observed_sequence", "source_event_id")


def snapshot_islands(spark, folder):
    return replay.snapshot_runs(views.book_events(spark, folder), "exchange_time").select("asset_id", "ots", "run", "n", "first_sequence", "last_sequence")


def top_of_book(spark, folder):
    return book.top_of_book(_replay(spark, folder).levels)


def book_series(spark, folder):
    """Headers and tops of every asset's book in time order, from checkpoints where there are any."""
    rows = replay.series(views.book_events(spark, folder), points(spark), "recv_time", LOOKBACK_US, views.book_checkpoints(spark, folder))
    return rows.select("query_id", "asset_id", "at_us", "sequence", "last_update_us", "used_checkpoint", "best_bid", "best_ask", "mid", "spread")


def mid_spread_wmid(spark, folder):
    return book.top_of_book(_replay(spark, folder, "exchange_time").levels).select("query_id", "asset_id", "mid", "spread", "weighted_mid")


def depth_totals(spark, folder):
    return book.depth_totals(_replay(spark, folder).levels)


def top_n_levels(spark, folder):
    return book.top_n(_replay(spark, folder).levels, 5).select("query_id", "asset_id", F.col("side").cast("int").alias("side"), "rank", "price", "size")


def crossed_books(spark, folder):
    return book.crossed(_replay(spark, folder).levels)


def validate_parity(spark, folder):
    rows = replay.validate(views.book_events(spark, folder), points(spark), views.book_checkpoints(spark, folder), base="inclusive", lookback_us=LOOKBACK_US)
    return rows.select("query_id", "asset_id", "replay_timestamp_us", "reference_timestamp_us", "matched")


def validate_strict(spark, folder):
    rows = replay.validate(views.book_events(spark, folder), points(spark), views.book_checkpoints(spark, folder), "exchange_time", "strict", LOOKBACK_US)
    return rows.select("query_id", "asset_id", "replay_timestamp_us", "reference_timestamp_us", "matched")


def derived_checkpoint_levels(spark, folder):
    """Books stored as checkpoints and read again."""
    rows = storage.checkpoint_levels(replay.derived_checkpoints(_replay(spark, folder)))
    flat = rows.select("asset_id", "checkpoint_timestamp_us", F.explode(F.concat(*[F.transform(c, replay._with_side(s)) for c, s in (("bids", 1), ("asks", 2))])).alias("l"))
    return flat.select("asset_id", "checkpoint_timestamp_us", F.col("l.side").cast("int").alias("side"), "l.price", "l.size")


def integrity_summary(spark, folder):
    assets = points(spark).select("asset_id").distinct()
    return integrity.summary(views.book_events(spark, folder), views.ingest_events(spark, folder), views.replay_validations(spark, folder), assets, START_US, END_US)


def continuity_events(spark, folder):
    return integrity.continuity_events(views.ingest_events(spark, folder), "A3", START_US, END_US)


def collected_continuity(spark, folder):
    rows = integrity.collected_continuity(views.ingest_events(spark, folder))
    return rows.select("asset_id", F.size("events").cast("long").alias("n"), F.array_join(F.transform("events", lambda e: e["kind"]), ",").alias("kinds"))


def execution_timeline(spark, folder):
    rows = execution.timeline(views.execution_events(spark, folder), 0, 2 * NOW_US, 200, asset_id="A3")
    return rows.select("event_timestamp_us", "order_id", "client_order_id", "event_kind", "side", "price", "size", "total_count")


def execution_append(spark, folder):
    """Append input, texts for sides, prices and sizes, as execution events."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    key, stamp = F.col("l_orderkey").cast("long"), views.stamp_us("l_shipdate")
    known = {"event_timestamp_us": stamp, "order_id": F.concat(F.lit("O"), key.cast("string")), "client_order_id": F.concat(F.lit("C"), F.col("l_linenumber").cast("string")), "event_kind": F.lit("fill"),
             "side": F.get(F.array(*map(F.lit, ["bid", "Bid", "ask", "Ask"])), (key % 4).cast("int")), "price": F.col("l_discount").cast("string"), "size": F.col("l_quantity").cast("string"), "exchange_fill_us": stamp + 500}
    rows = lines.select(*[(known.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in execution.INPUT.fields])
    out = storage.with_latency(execution.from_input(rows))
    return out.select("event_timestamp_us", "order_id", "client_order_id", "event_kind", F.col("side").cast("int").alias("side"), "price", "size", "latency.exchange_fill_us")


def execution_latency(spark, folder):
    return execution.latency_breakdown(views.execution_events(spark, folder)).select("order_id", "client_order_id", "event_kind", "normalize_us", "decide_us", "submit_us", "ack_us", "fill_us", "total_us")


def execution_with_book(spark, folder):
    """Trades as fills, each with the last checkpoint top before it."""
    cps = views.book_checkpoints(spark, folder)
    levels = storage.checkpoint_levels(cps).select("asset_id", F.col("checkpoint_timestamp_us").alias("at_us"), F.explode(F.concat(*[F.transform(c, replay._with_side(s)) for c, s in (("bids", 1), ("asks", 2))])).alias("l")).select("asset_id", "at_us", "l.side", "l.price", "l.size")
    tops = book.top_of_book(levels, ["asset_id", "at_us"]).select("asset_id", "at_us", "best_bid", "best_ask")
    fills = views.trade_events(spark, folder).select(F.col("recv_timestamp_us").alias("event_timestamp_us"), "asset_id", "trade_id")
    return execution.with_book(fills, tops, DAY_US).select("trade_id", "asset_id", "top_at_us", "best_bid", "best_ask")


def latency_percentiles(spark, folder):
    samples = integrity.feed_latency(views.book_events(spark, folder))
    return integrity.latency_percentiles(samples, ["asset_id"])


def latency_histogram(spark, folder):
    samples = integrity.feed_latency(views.book_events(spark, folder))
    return integrity.latency_histogram(samples, [1_000_000, 2_000_000, 4_000_000, 8_000_000])


def dataset_stats(spark, folder):
    out = None
    for name in ("book_events", "trade_events", "ingest_events"):
        df = integrity.dataset_stats(views.VIEWS[name](spark, folder), name)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def partition_counts(spark, folder):
    return integrity.partition_counts(views.ingest_events(spark, folder), "ingest_events").withColumn("event_date", F.col("event_date").cast("string"))


def normalize_sequences(spark, folder):
    n = normalize.normalize(sample_feed.written_messages(spark, folder))
    return n.book_events.select("recv_timestamp_us", "exchange_timestamp_us", "asset_id", F.col("event_kind").cast("int").alias("event_kind"), F.col("side").cast("int").alias("side"), "price", "size", "sequence", "source_event_id", "source_session_id")


def normalize_stale(spark, folder):
    n = normalize.normalize(sample_feed.written_messages(spark, folder)).ingest_events
    return n.where("event_kind = 'stale_snapshot_skip'").select("asset_id", "recv_timestamp_us", "exchange_timestamp_us", "details", "source_event_id")


def normalize_trades(spark, folder):
    n = normalize.normalize(sample_feed.written_messages(spark, folder)).trade_events
    return n.select("asset_id", "recv_timestamp_us", "exchange_timestamp_us", "price", "size", F.col("side").cast("int").alias("side"), "trade_id", "fidelity", "source_session_id")


def lifecycle_expand(spark, folder):
    n = normalize.normalize(sample_feed.written_messages(spark, folder)).ingest_events
    return n.where("asset_id is null").select("recv_timestamp_us", "event_kind", "details", "source_session_id")


def ws_metrics_counts(spark, folder):
    return normalize.metric_counts(sample_feed.written_messages(spark, folder))


def active_assets_status(spark, folder):
    active = spark.range(12).select(F.concat(F.lit("A"), F.col("id").cast("string")).alias("asset_id"))
    states = live.asset_states(_arrivals(views.book_events(spark, folder)))
    return live.active_assets(active, states, NOW_US, 12 * 3600)


def retained_state(spark, folder):
    active = spark.range(3, 6).select(F.concat(F.lit("A"), F.col("id").cast("string")).alias("asset_id"))
    return live.retain_active(live.asset_states(_arrivals(views.book_events(spark, folder))), active).select("asset_id", "last_recv_timestamp_us", "sequence", "has_book")


def session_status(spark, folder):
    return live.session_status(_arrivals(views.ingest_events(spark, folder)))


def latest_warnings(spark, folder):
    rows = live.warnings(_arrivals(views.ingest_events(spark, folder)))
    return rows.select("asset_id", "latest_warning.kind", "latest_warning.recv_timestamp_us", "latest_warning.details")


def live_books(spark, folder):
    return live.live_books(_arrivals(views.book_events(spark, folder))).select("asset_id", F.col("side").cast("int").alias("side"), "price", "size")


def book_after_each_event(spark, folder):
    """Top of the live book and depths after every book event."""
    return timeline.book_after_events(_arrivals(views.book_events(spark, folder)))


def live_snapshot_groups(spark, folder):
    """Snapshot rows that are one snapshot, as counts by group."""
    rows = live.snapshot_groups(_arrivals(views.book_events(spark, folder))).where("event_kind = 1")
    return rows.groupBy("asset_id", "group").agg(F.count("*").alias("n"), F.min("arrival").alias("first_arrival"), F.max("arrival").alias("last_arrival"))


def live_snapshot(spark, folder):
    active = spark.range(10).select(F.concat(F.lit("A"), F.col("id").cast("string")).alias("asset_id"))
    rows = live.live_snapshot(_arrivals(views.book_events(spark, folder)), _arrivals(views.ingest_events(spark, folder)), active, "A3", 20, NOW_US, 3600)
    return rows.select("asset_id", "sequence", "last_update_us", "best_bid", "best_ask", "bid_depth", "ask_depth", "stale")


def live_snapshot_levels(spark, folder):
    """The live snapshot's own levels, cut to a depth of five."""
    active = spark.range(10).select(F.concat(F.lit("A"), F.col("id").cast("string")).alias("asset_id"))
    row = live.live_snapshot(_arrivals(views.book_events(spark, folder)), _arrivals(views.ingest_events(spark, folder)), active, "A3", 5, NOW_US, 3600)
    sides = [row.select("asset_id", F.lit(name).alias("side_name"), F.posexplode(c).alias("pos", "l")) for name, c in (("bid", "bids"), ("ask", "asks"))]
    return sides[0].unionByName(sides[1]).select("asset_id", "side_name", F.col("pos").cast("long").alias("pos"), "l.price", "l.size")


def feed_status(spark, folder):
    active = spark.range(10).select(F.concat(F.lit("A"), F.col("id").cast("string")).alias("asset_id"))
    rows = live.feed_status(_arrivals(views.ingest_events(spark, folder)), active)
    return rows.select("mode", "session_status", "current_session_id", "active_asset_count", F.col("latest_warning.kind").alias("warning"), F.col("latest_warning.recv_timestamp_us").alias("warned_us"))


def validate_texts(spark, folder):
    """What validations say of the books that do not match."""
    rows = replay.validate(views.book_events(spark, folder), points(spark), views.book_checkpoints(spark, folder), "exchange_time", "strict", LOOKBACK_US)
    return rows.where("not matched").select("query_id", "asset_id", "mismatch_summary")


def clustered_scans(spark, folder):
    """The five scans of the clustered tables, as counts and sums of their clocks."""
    database = f"tb{uuid.uuid4().hex[:12]}"
    tables.create(spark, database, feed.scratch(spark, "clustered"), 8)
    for name in schemas.DATASETS:
        tables.append(views.VIEWS[name](spark, folder), database, name, 8)
    found = {**tables.market_data(spark, database, "A3", START_US, END_US), "book_checkpoints": tables.checkpoints(spark, database, "A3", START_US, END_US), "replay_validations": tables.validations(spark, database, "A3", START_US, END_US), "execution_events": tables.executions(spark, database, 0, 2 * NOW_US, "O7")}
    parts = [rows.agg(F.lit(name).alias("scan"), F.count("*").alias("n"), _exact_sum(PARTITION_TIME[name]).alias("clocks")) for name, rows in found.items()]
    parts.append(tables.latest_checkpoint(spark, database, "A3", START_US).agg(F.lit("latest_checkpoint").alias("scan"), F.count("*").alias("n"), _exact_sum("checkpoint_timestamp_us").alias("clocks")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return _totals(out, "clocks")


def stream_metrics(spark, folder):
    """Counters and the latency histogram of the tagged rows of the feed, as the stream observes them."""
    from .streaming import metrics, route

    n = normalize.normalize(sample_feed.written_messages(spark, folder))
    tagged = route.tag(n.book_events, "book_events").unionByName(route.tag(n.trade_events, "trade_events")).unionByName(route.tag(n.ingest_events, "ingest_events"))
    row = tagged.agg(*metrics.of_tagged(tagged)).drop("ws_latency_sketch")
    bounds = [*metrics.HISTOGRAMS["ws_latency_us"], None]
    entries = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("n")) for c in row.columns if c != "ws_latency_us"]
    entries += [F.struct(F.lit(f"ws_latency_us_{'above' if b is None else b}").alias("metric"), F.get("ws_latency_us", F.lit(k)).alias("n")) for k, b in enumerate(bounds)]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def market_buckets_5m(spark, folder):
    s = F.call_function("div", F.col("ts_us"), F.lit(1_000_000))
    return views.events(spark, folder).groupBy(codecs.bucket_5m(s).alias("bucket"), codecs.market_slug(s).alias("slug")).agg(F.count("*").alias("n"))


def _discovery(spark, folder):
    c = spark.read.parquet(f"{folder}/customer.parquet")
    key = F.col("c_custkey").cast("string")
    ids = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("t"), key, F.lit(" , u"), key)).when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit('["t'), key, F.lit('","u'), key, F.lit('"]')))
    market = F.struct(F.concat(F.lit("m"), key).alias("id"), F.concat(F.lit("Will "), F.col("c_mktsegment"), F.lit(" win?")).alias("question"), ids.alias("clobTokenIds"), F.lit(True).alias("active"))
    text = F.to_json(F.array(F.struct(key.alias("id"), F.col("c_name").alias("title"), F.array(market).alias("markets"))))
    return markets.parse_events(c.select(text.alias("text")))


def token_ids_explode(spark, folder):
    return markets.token_ids(_discovery(spark, folder)).select("id", "market_id", F.col("pos").cast("long").alias("pos"), "token_id")


def market_keyword(spark, folder):
    return markets.with_keyword(_discovery(spark, folder), "BUILDing").select("id", "title")


def market_page(spark, folder):
    return markets.page(_discovery(spark, folder), 20, 10).select("id", "title")


def ms_us_timestamp_fix(spark, folder):
    e = views.events(spark, folder)
    text = F.when(F.col("event_id") % 5 == 0, (F.col("ts_us") / 1000).cast("long").cast("string")).when(F.col("event_id") % 5 == 1, F.lit(None)).when(F.col("event_id") % 5 == 2, F.lit("x1")).when(F.col("event_id") % 5 == 3, F.lit("0")).otherwise(F.col("ts_us").cast("string"))
    rows = e.withColumn("text", text)
    return rows.select("event_id", codecs.feed_timestamp_us(F.col("text")).alias("feed_us"), codecs.rest_timestamp_us(F.col("text"), F.lit(NOW_US).cast("long")).alias("rest_us"))


def side_parse(spark, folder):
    words = F.array(*map(F.lit, ["BUY", "buy", "Bid", "bid", "Buy", "SELL", "sell", "Ask", "ask", "SELl"]))
    rows = views.events(spark, folder).withColumn("word", F.get(words, F.col("k") % 10))
    return rows.groupBy("word").agg(F.first(codecs.side_code(F.col("word")).cast("int")).alias("side"), F.count("*").alias("n"))


def fixed_point_roundtrip(spark, folder):
    p = spark.read.parquet(f"{folder}/lineitem.parquet")
    rows = p.select("l_orderkey", "l_linenumber", fixedpoint.price_from_text(F.col("l_discount").cast("string")).alias("price"), fixedpoint.size_from_text(F.col("l_extendedprice").cast("string")).alias("size"))
    return rows.select("l_orderkey", "l_linenumber", "price", "size", fixedpoint.price_text(F.col("price")).alias("price_text"), fixedpoint.size_text(F.col("size")).alias("size_text"))


def display_texts(spark, folder):
    rows = views.ingest_events(spark, folder).select(codecs.title_words(F.col("event_kind")).alias("title")).groupBy("title").agg(F.count("*").alias("n"))
    return rows


def peek_rows(spark, folder):
    return views.book_events(spark, folder).orderBy(F.substring("source_event_id", 2, 20).cast("long")).limit(20).select("source_event_id", "asset_id", "price", "size")


def live_book_stream(spark, folder):
    """The streaming book's levels after all rows have arrived."""
    from .streaming import books

    return books.stream_final_levels(_arrivals(views.book_events(spark, folder))).select("asset_id", F.col("side").cast("int").alias("side"), "price", "size")


def top_levels_stream(spark, folder):
    """The five best levels of each side that the changes of the live stream add up to."""
    from .streaming import books

    changes = books.stream_top_levels(_arrivals(views.book_events(spark, folder)), 5)
    return books.current_levels(changes).select("asset_id", F.col("side").cast("int").alias("side"), "price", "size")


def normalize_stream(spark, folder):
    """The streaming normalizer's book rows after all messages have arrived."""
    from .streaming import books

    n = books.stream_normalized(sample_feed.written_messages(spark, folder))
    return n.select("recv_timestamp_us", "exchange_timestamp_us", "asset_id", F.col("event_kind").cast("int").alias("event_kind"), F.col("side").cast("int").alias("side"), "price", "size", "sequence", "source_event_id")


def _routed(spark, folder, **others):
    """The base of the datasets to which one stream of the test feed has been routed."""
    from .streaming import route

    base = f"{feed.scratch(spark, 'routed')}"
    stream = route.fan_in(sample_feed.staged(sample_feed.messages(spark, folder)), **others)
    route.route(stream, base, feed.scratch(spark, "route-checkpoint"), available_now=True).awaitTermination()
    return base


def routed_book_events(spark, folder):
    """Book events that one stream of all messages committed, with the session that its state carried."""
    rows = ledger.read(spark, _routed(spark, folder), "book_events")
    return rows.select("recv_timestamp_us", "exchange_timestamp_us", "asset_id", F.col("event_kind").cast("int").alias("event_kind"), F.col("side").cast("int").alias("side"), "price", "size", "sequence", "source_event_id", "source_session_id")


def routed_trades(spark, folder):
    rows = ledger.read(spark, _routed(spark, folder), "trade_events")
    return rows.select("asset_id", "recv_timestamp_us", "exchange_timestamp_us", "price", "size", F.col("side").cast("int").alias("side"), "trade_id", "fidelity", "source_session_id")


def routed_ingest(spark, folder):
    """Stale snapshots and connection changes of the same stream."""
    rows = ledger.read(spark, _routed(spark, folder), "ingest_events")
    return rows.select("asset_id", "recv_timestamp_us", "exchange_timestamp_us", "event_kind", "details", "source_event_id", "source_session_id")


def routed_datasets(spark, folder):
    """Rows and clocks of all six datasets of one stream that the other datasets' streams have joined."""
    def stream(rows, clock):
        return sample_feed.staged(rows.withColumn("arrival", clock), 2, 4 * sample_feed.STAGED_ROWS)  # no state, so larger batches

    others = {name: stream(views.VIEWS[name](spark, folder), F.col(PARTITION_TIME[name])) for name in ("book_checkpoints", "replay_validations")}
    # executions are made of the streams' rows, as those of the tables are much shorter
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderstatus")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_linestatus", "l_shipdate")
    others["execution_events"] = views.executions(stream(orders, views.stamp_us("o_orderdate")), stream(lines, views.stamp_us("l_shipdate")))
    base = _routed(spark, folder, **others)
    parts = [ledger.read(spark, base, name).agg(F.lit(name).alias("dataset"), F.count("*").alias("n"), F.min(clock).alias("first_us"), F.max(clock).alias("last_us")) for name, clock in PARTITION_TIME.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def live_source_messages(spark, folder):
    """The test feed's texts as a live source received them, by type, and the rows that its connection added."""
    texts, out = feed.scratch(spark, "texts"), feed.scratch(spark, "received")
    sample_feed.messages(spark, folder).where("kind = 'raw'").sort("arrival").select("text").write.text(texts)
    name = live_source.register(spark, sample_feed.recorded(texts))
    stream = spark.readStream.format(name).option("journal", feed.scratch(spark, "journal")).option("most", 5000).option("segments", 64).option("wait_s", 0).load()
    query = stream.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/part_id={n}")).option("checkpointLocation", feed.scratch(spark, "source-checkpoint")).start()
    query.processAllAvailable()
    query.stop()
    rows = spark.read.schema(feed.SCHEMA + ", part_id long").parquet(out)
    kind = F.coalesce(F.when(F.col("kind") == "raw", F.coalesce(F.get_json_object("text", "$.event_type"), F.lit("none"))), F.col("kind"))
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("arrival").alias("n_offsets"))


def stream_checkpoints(spark, folder):
    """Every asset's book at the end of each day, as timers of the live stream put it out, silent days too."""
    from .streaming import books, periodic

    found = books._finished(periodic.checkpoints(sample_feed.staged(_arrivals(views.book_events(spark, folder))), 86_400), "append")
    rows = storage.checkpoint_levels(periodic.checkpoint_rows(found))
    flat = rows.select("asset_id", "checkpoint_timestamp_us", F.explode(F.concat(*[F.transform(c, replay._with_side(s)) for c, s in (("bids", 1), ("asks", 2))])).alias("l"))
    return flat.select("asset_id", "checkpoint_timestamp_us", F.col("l.side").cast("int").alias("side"), "l.price", "l.size")


def rotated_sequences(spark, folder):
    """Levels numbered anew in markets of a week, each of which begins ten seconds early."""
    from .streaming import books, periodic

    found = books._finished(periodic.rotated(sample_feed.staged(sample_feed.messages(spark, folder)), 7 * 86_400), "append")
    return found.where("stale_after_us is null").select("bucket", "slug", "asset_id", "recv_timestamp_us", "event_kind", "side", "price", "size", "sequence", "source_event_id")


def repeated_append(spark, folder):
    """Validations of which every third asset's batch is delivered twice: they are stored once."""
    base = feed.scratch(spark, "appended")
    rows = views.replay_validations(spark, folder)
    for k in range(3):
        part = rows.where(F.substring("asset_id", 2, 9).cast("int") % 3 == k)
        for _ in range(1 + (k == 1)):
            ledger.commit(spark, base, f"append-{k}", {"replay_validations": part})
    ledger.compact(spark, base)
    return _totals(ledger.read(spark, base, "replay_validations").groupBy("asset_id", "mode").agg(F.count("*").alias("n"), _exact_sum("persisted_at_us").alias("stamps")), "stamps")


_HELPERS = {"points"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in _HELPERS and n != "queries"}
