"""Checkpoints by timer, rotation and flushes."""

import json
import random
import time

from pyspark.sql import functions as F
from test_timeline import feed as book_feed

from tickbasin import sample_feed
from tickbasin.operators import live, replay
from tickbasin.schemas import DATASETS
from tickbasin.sources import feed, storage
from tickbasin.streaming import books, periodic

BASE = 1_700_000_100_000_000
S = 1_000_000
SCHEMA = "arrival long, asset_id string, event_kind int, side int, price int, size long, recv_timestamp_us long, exchange_timestamp_us long, source_event_id string"


def levels(df):
    return sorted((r.asset_id, r.checkpoint_timestamp_us, s, x.price, x["size"]) for r in storage.checkpoint_levels(df).collect() for s, xs in ((1, r.bids), (2, r.asks)) for x in xs)


def test_checkpoints_of_the_stream(spark):
    rng = random.Random(9)
    rows = [(n, a, k, s, p, z, BASE + n * S // 2, 0, i) for n, a, k, s, p, z, _, _, i in book_feed(rng, 300, ["a", "a", "a", "b"])]
    rows = [r for r in rows if not (r[1] == "b" and r[0] > 400)]  # one asset goes silent
    # the rows of a snapshot come together
    group, fixed = None, []
    for r in rows:
        group = r[6] if r[2] == 2 or group is None or not (fixed and fixed[-1][2] == 1 and fixed[-1][1] == r[1]) else group
        fixed.append((*r[:6], group, 0, r[8]))
    events = spark.createDataFrame(fixed, SCHEMA)
    found = books._finished(periodic.checkpoints(sample_feed.staged(events, 5), 30), "append").cache()
    stamps = {}
    for r in found.collect():
        stamps.setdefault(r.asset_id, []).append(r.at_us)
    newest = max(r[6] for r in fixed)
    for asset, at in stamps.items():
        first = min(r[6] for r in fixed if r[1] == asset)
        want = list(range((first // (30 * S) + 1) * 30 * S, newest - S, 30 * S))
        assert sorted(at) == want and len(want) > 5  # every interval once, silent ones too
    out = periodic.checkpoint_rows(found)
    assert out.columns == [f.name for f in DATASETS["book_checkpoints"].fields]
    got = levels(out)
    want = []
    for at in sorted({a for ats in stamps.values() for a in ats}):
        book = live.live_books(events.where(F.col("recv_timestamp_us") <= at)).collect()
        want += [(r.asset_id, at, r.side, r.price, r["size"]) for r in book if at in stamps[r.asset_id]]
    assert got == sorted(want)
    # where a snapshot has come and its stamps tell it from others, it is the book that a replay rebuilds
    at = stamps["a"][-1]
    typed = events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in events.columns else (F.col("arrival") if f.name == "sequence" else F.lit("websocket" if f.name == "source" else None)).cast(f.dataType).alias(f.name) for f in DATASETS["book_events"].fields])
    rebuilt = replay.reconstruct(typed, spark.createDataFrame([(1, "a", at)], "query_id int, asset_id string, at_us long"), "recv_time", 10**12)
    assert sorted((r.side, r.price, r["size"]) for r in rebuilt.levels.collect()) == sorted(x[2:] for x in got if x[:2] == ("a", at))


def message(k, us, asset, kind="book", stamp=None):
    level = {"price": "0.5", "size": "1"}
    text = {"event_type": "book", "asset_id": asset, "timestamp": str(stamp or us), "bids": [level, level], "asks": []} if kind == "book" else {"event_type": "price_change", "timestamp": str(us), "price_changes": [{"asset_id": asset, "side": "BUY", **level}]}
    return k, "raw", json.dumps(text), us, None, None


def test_rotation(spark):
    """Markets begin ten seconds early, number from 0, know no stamp of the one before, and leave no state."""
    start = 1_700_000_100 * S  # a market's start
    assert start % (300 * S) == 0
    rows = [message(0, start, "x"), message(1, start + S, "x", "delta"), message(2, start + 2 * S, "x", stamp=start - S), message(3, start + 289 * S, "x", "delta"), message(4, start + 291 * S, "x", "delta"), message(5, start + 292 * S, "x", stamp=start - S), message(6, start + 293 * S, "x", "delta"), message(7, start + 2000 * S, "y", "delta"), message(8, start + 4000 * S, "y", "delta")]
    df = spark.createDataFrame(rows, feed.SCHEMA)
    assert [r.b for r in df.select(periodic.market_bucket(F.col("recv_timestamp_us")).alias("b")).orderBy("recv_timestamp_us").collect()][:6] == [1_700_000_100] * 4 + [1_700_000_400] * 2
    out, stream = feed.scratch(spark, "rotated"), periodic.rotated(sample_feed.staged(df, 5))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", books.STATE_STORE)
    query = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/n={n}")).option("checkpointLocation", feed.scratch(spark, "rotated-cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.bucket, r.recv_timestamp_us - start, r.sequence, r.stale_after_us is not None) for r in spark.read.parquet(out).collect())
    b, c = 1_700_000_100, 1_700_000_400
    assert got[:8] == [(b, 0, 0, False), (b, 0, 1, False), (b, S, 2, False), (b, 2 * S, None, True), (b, 289 * S, 3, False), (c, 291 * S, 0, False), (c, 292 * S, 0, False), (c, 292 * S, 1, False)]
    assert [x[2] for x in got[8:]] == [2, 0, 0] and {r.slug for r in spark.read.parquet(out).collect()} >= {"btc-updown-5m-1700000100", "btc-updown-5m-1700000400"}
    # only the last market is still open: all others' state and timers are gone
    rows_left = [p["stateOperators"][0]["customMetrics"] for p in query.recentProgress if p["stateOperators"]]
    total = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert total[-1] <= 3 and rows_left


def test_flush_by_rows_and_by_time(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(25).selectExpr("id", "'k' as name").coalesce(1).write.parquet(source)
    stream = periodic.flushed(spark.readStream.schema("id long, name string").parquet(source), F.col("name"), 10, 1000)
    out = str(tmp_path / "out")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", books.STATE_STORE)
    query = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/part_id={n}")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        found, until = [], time.time() + 90
        while len(found) < 25 and time.time() < until:
            time.sleep(2)
            try:
                found = spark.read.parquet(out).collect()
            except Exception:  # not yet written
                continue
    finally:
        query.stop()
    by = {}
    for r in found:
        by.setdefault((r.flush, r.reason, r.n), []).append(json.loads(r.row)["id"])
    assert {k: len(v) for k, v in by.items()} == {(0, "rows", 10): 10, (1, "rows", 10): 10, (2, "time", 5): 5}
    assert sorted(x for v in by.values() for x in v) == list(range(25))
