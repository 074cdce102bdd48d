"""Clustered tables and their scans; metrics of a stream."""

import json
import uuid

import pytest
from pyspark.sql import functions as F
from test_route import messages, trades

from tickbasin import sample_feed
from tickbasin.errors import BadRequest
from tickbasin.operators import normalize
from tickbasin.schemas import DATASETS
from tickbasin.sources import feed, storage, tables
from tickbasin.streaming import books, metrics, route

BASE = 1_700_000_000_000_000
HOUR = 3_600_000_000


@pytest.fixture
def database(spark, tmp_path):
    name = f"t{uuid.uuid4().hex[:10]}"
    tables.create(spark, name, f"file://{tmp_path}/db", 4)
    yield name
    spark.sql(f"drop database {name} cascade")


def test_clustered_tables(spark, database):
    rows = trades(spark, 60).unionByName(trades(spark, 60).withColumn("asset_id", F.lit("b")))
    books = spark.createDataFrame([(BASE + k * HOUR, 0, "ab"[k % 2], 1, 1, 5000, 1, k, "websocket", f"e{k}", None) for k in range(40)], DATASETS["book_events"])
    for _ in range(2):
        tables.append(rows, database, "trade_events", 4)
    tables.append(books, database, "book_events", 4)
    found = tables.market_data(spark, database, "a", BASE, BASE + 9 * HOUR)
    assert {k: v.count() for k, v in found.items()} == {"book_events": 5, "trade_events": 20, "ingest_events": 0}
    want = storage.scan(rows, "trade_events", BASE, BASE + 9 * HOUR, "a")
    assert sorted(map(tuple, found["trade_events"].distinct().collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    plan = found["trade_events"]._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters: ")[1][:60] and "Exchange" not in plan
    # a join on the asset needs no exchange
    a, b = (spark.table(f"{database}.{t}") for t in ("book_events", "trade_events"))
    joined = a.hint("merge").join(b, "asset_id").groupBy("asset_id").count()
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 2


def test_scans_of_other_tables(spark, database):
    cps = spark.createDataFrame([(BASE + k, BASE + k, BASE + k, "a", "rest_snapshot", None, None, "[]", "[]") for k in (3, 1, 2)], DATASETS["book_checkpoints"])
    tables.append(cps, database, "book_checkpoints", 4)
    assert [r.checkpoint_timestamp_us - BASE for r in tables.checkpoints(spark, database, "a", BASE + 2, BASE + 9).collect()] == [2, 3]
    assert tables.latest_checkpoint(spark, database, "a", BASE + 2).first().checkpoint_timestamp_us == BASE + 2
    assert tables.latest_checkpoint(spark, database, "a", BASE).count() == 0 and tables.validations(spark, database, "a", 0, BASE).count() == 0
    runs = spark.createDataFrame([(BASE + k, "a", f"O{k % 2}", None, None, "fill", 1, 1, 1, None, None, "{}") for k in range(4)], DATASETS["execution_events"])
    tables.append(runs, database, "execution_events", 4)
    assert [r.event_timestamp_us - BASE for r in tables.executions(spark, database, BASE, BASE + 9).collect()] == [0, 1, 2, 3]
    # a text that looks like SQL is a value
    assert tables.executions(spark, database, BASE, BASE + 9, "O1").count() == 2 and tables.executions(spark, database, BASE, BASE + 9, "x' or '1'='1").count() == 0
    with pytest.raises(BadRequest):
        tables.create(spark, "a; drop table b")


def test_histograms():
    m = metrics.Metrics()
    for x in (0, 5, 6, 1e9):
        m.add("storage_flush_ms", x)
    assert m.histograms["storage_flush_ms"] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 1]
    with pytest.raises(KeyError):
        m.count("nope")
    with m.flush():
        pass
    m.count("rest_requests", 3)
    assert m.counters["storage_flushes"] == 1 and m.counters["rest_requests"] == 3 and set(m.counters) == set(metrics.COUNTERS) and len(metrics.COUNTERS) == 12 and len(metrics.HISTOGRAMS) == 3


def test_metrics_of_a_stream(spark):
    import random

    rows = [(*r[:3], r[3] + 7000 * (r[0] % 5), *r[4:]) for r in messages(random.Random(4), 200)]
    df = spark.createDataFrame(rows, feed.SCHEMA)
    want = normalize.normalize(df)
    counts = {"book": want.book_events.count(), "trade": want.trade_events.count(), "ingest": want.ingest_events.count()}
    m = metrics.Metrics()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", books.STATE_STORE)
    spark.streams.addListener(m)
    try:
        tagged = metrics.measured(route.dispatched(sample_feed.staged(df, 3), 2))
        query = tagged.writeStream.foreachBatch(m.timed(lambda batch, n: batch.count())).option("checkpointLocation", feed.scratch(spark, "metrics-cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        assert m.counters["messages_received"] == sum(counts.values()) and m.counters["trades_received"] == counts["trade"]
        assert m.counters["snapshots_applied"] + m.counters["deltas_applied"] == counts["book"] and m.counters["stale_snapshots_skipped"] == want.ingest_events.where("event_kind = 'stale_snapshot_skip'").count() > 0
        assert m.counters["reconnections"] == want.ingest_events.where("event_kind = 'reconnect_success'").count() and m.counters["storage_flushes"] >= 3
        late = sorted(r.v for x in (want.book_events, want.trade_events) for r in x.where("exchange_timestamp_us > 0 and recv_timestamp_us > exchange_timestamp_us").selectExpr("recv_timestamp_us - exchange_timestamp_us as v").collect())
        assert sum(m.histograms["ws_latency_us"]) == len(late) > 10 and sum(m.histograms["message_processing_us"]) >= 200 and sum(m.histograms["storage_flush_ms"]) >= 3
        got = m.quantiles(spark, [0.0, 0.5, 1.0])
        assert got[0] == late[0] and got[2] == late[-1] and late[len(late) // 3] <= got[1] <= late[2 * len(late) // 3]
        m.reset()
        assert m.quantiles(spark, [0.5]) == [] and json.dumps(m.histograms)
    finally:
        spark.streams.removeListener(m)
