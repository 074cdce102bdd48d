"""One stream to six datasets, and appends that can be repeated."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tickbasin import sample_feed
from tickbasin.errors import BadRequest
from tickbasin.operators import normalize
from tickbasin.schemas import DATASETS
from tickbasin.sources import feed, ledger, storage
from tickbasin.streaming import route

BASE = 1_700_000_000_000_000


def messages(rng, n):
    """A random feed of three assets: books, stale ones too, changes over several assets, trades, connection changes and junk."""
    rows = []
    for k in range(n):
        asset, stamp = rng.choice("abc"), str(BASE + rng.choice([k, k, k - 9]))
        levels = [{"price": rng.choice(["0.1", "0.2", "bad"] if rng.random() < 0.2 else ["0.1", "0.2"]), "size": rng.choice(["1", "0"])} for _ in range(rng.randint(0, 3))]
        text, kind, session = None, "raw", None
        match rng.randrange(7):
            case 0:
                text = {"event_type": "book", "asset_id": asset, "timestamp": stamp, "hash": f"h{k}", "bids": levels, "asks": levels[:1]}
            case 1 | 2 | 3:
                text = {"event_type": "price_change", "timestamp": stamp, "price_changes": [{"asset_id": rng.choice("abc"), "side": rng.choice(["BUY", "SELL", "Buy"]), "hash": f"c{k}", **x} for x in levels]}
            case 4:
                text = {"event_type": "last_trade_price", "asset_id": asset, "timestamp": stamp, "price": rng.choice(["0.5", "9"]), "size": rng.choice(["1", None]), "side": rng.choice(["BUY", "x"]), "transaction_hash": f"t{k}"}
            case 5:
                kind, session = rng.choice(["reconnect_start", "reconnect_success"]), f"s{k}"
            case _:
                text = {"event_type": "odd"}
        rows.append((k, kind, json.dumps(text) if kind == "raw" else None, BASE + k, session, "why" if session else None))
    return rows


def sorted_rows(df, dataset):
    return sorted(map(tuple, df.select([f.name for f in DATASETS[dataset].fields]).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_batch_form(spark, tmp_path, seed):
    df = spark.createDataFrame(messages(random.Random(seed), 150), feed.SCHEMA)
    want = normalize.normalize(df)
    base, checkpoint = f"file://{tmp_path}/base", str(tmp_path / "cp")
    cps = spark.createDataFrame([(BASE, BASE, BASE, "a", "rest_snapshot", None, None, "[]", "[]")], DATASETS["book_checkpoints"])
    cps.write.parquet(str(tmp_path / "cps"))
    stream = route.fan_in(sample_feed.staged(df, 4), 3, book_checkpoints=spark.readStream.schema(cps.schema).parquet(str(tmp_path / "cps")))
    route.route(stream, base, checkpoint, available_now=True).awaitTermination()
    for name in ("book_events", "trade_events", "ingest_events"):
        assert sorted_rows(ledger.read(spark, base, name), name) == sorted_rows(getattr(want, name), name)
        assert getattr(want, name).count() > 2
    assert ledger.read(spark, base, "book_checkpoints").count() == 1 and ledger.read(spark, base, "execution_events").count() == 0
    found = ledger.entries(spark, base)
    assert len(found) >= 4 and len({e["token"].rpartition("-")[0] for e in found}) == 1
    # a restart finds nothing new, and compaction keeps the rows
    before = ledger.read(spark, base, "book_events").count()
    route.route(stream, base, checkpoint, available_now=True).awaitTermination()
    ledger.compact(spark, base)
    assert ledger.read(spark, base, "book_events").count() == before
    assert ledger.vacuum(spark, base) == len(found) and ledger.read(spark, base, "book_events").count() == before
    assert not ledger.commit(spark, base, found[0]["token"], {"book_events": want.book_events}) and ledger.read(spark, base, "book_events").count() == before


def trades(spark, n, first=0):
    rows = [(BASE + k * 3_600_000_000, 0, "a", 5000, 1, 1, f"t{k}", "full", None, "websocket", None, None) for k in range(first, first + n)]
    return spark.createDataFrame(rows, DATASETS["trade_events"])


def test_a_batch_counts_once(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}"
    assert ledger.commit(spark, base, "q-1", {"trade_events": trades(spark, 3)})
    assert not ledger.commit(spark, base, "q-1", {"trade_events": trades(spark, 3)})
    assert ledger.read(spark, base, "trade_events").count() == 3
    # the second dataset fails: nothing of the batch is seen, and the repeated batch replaces what was left behind
    real = storage.write

    def broken(rows, where, folder, mode="append", dataset=None):
        if dataset == "ingest_events":
            raise RuntimeError("closed")
        real(rows, where, folder, mode, dataset)

    ingest = spark.createDataFrame([(BASE, 0, "a", "source_reset", None, None, None, None, "websocket", None, None)], DATASETS["ingest_events"])
    monkeypatch.setattr(storage, "write", broken)
    with pytest.raises(RuntimeError, match="closed"):
        ledger.commit(spark, base, "q-2", {"trade_events": trades(spark, 2, 3), "ingest_events": ingest})
    assert ledger.read(spark, base, "trade_events").count() == 3
    monkeypatch.setattr(storage, "write", real)
    assert ledger.commit(spark, base, "q-2", {"trade_events": trades(spark, 2, 3), "ingest_events": ingest})
    assert ledger.read(spark, base, "trade_events").count() == 5 and ledger.read(spark, base, "ingest_events").count() == 1


def test_an_entry_is_made_once(spark, tmp_path):
    base = f"file://{tmp_path}"
    assert ledger._create(spark, f"{base}/x", "1") and not ledger._create(spark, f"{base}/x", "2")
    assert (tmp_path / "x").read_text() == "1" and not [p for p in tmp_path.iterdir() if "draft" in p.name]
    with pytest.raises(BadRequest):
        ledger.commit(spark, base, "../x", {})
    with pytest.raises(BadRequest):
        ledger.commit(spark, base, "x", {"nope": trades(spark, 1)})


def test_scans_prune_committed_batches(spark, tmp_path):
    base = f"file://{tmp_path}"
    for k in range(3):
        ledger.commit(spark, base, f"q-{k}", {"trade_events": trades(spark, 5, 5 * k)})
    rows = storage.scan(ledger.read(spark, base, "trade_events"), "trade_events", BASE, BASE + 2 * 3_600_000_000, "a")
    assert rows.count() == 3
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters")[1][:200]


def test_a_micro_batch_has_one_file_for_an_hour(spark, tmp_path):
    base = f"file://{tmp_path}/base"
    rows = trades(spark, 400).withColumn("asset_id", F.concat(F.lit("a"), F.spark_partition_id().cast("string")))
    rows.repartition(8).write.parquet(str(tmp_path / "in"))
    stream = route.tag(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "trade_events")
    route.route(stream, base, str(tmp_path / "cp"), available_now=True).awaitTermination()
    files = list((tmp_path / "base" / "trade_events").glob("batch=*/event_date=*/event_hour=*/*.parquet"))
    assert ledger.read(spark, base, "trade_events").count() == 400 == len(files)


def test_tasks_share_an_hour_if_hours_are_few(spark):
    rows = trades(spark, 2000).withColumn("recv_timestamp_us", F.lit(BASE) + F.substring("trade_id", 2, 9).cast("long"))
    sizes = [r[0] for r in route.dealt(rows, "trade_events", 1).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 2000 and len(sizes) > 1
    many = route.dealt(trades(spark, 2000), "trade_events", 2000).withColumn("at", F.spark_partition_id())
    assert many.groupBy("recv_timestamp_us").agg(F.count_distinct("at").alias("n")).where("n > 1").count() == 0


def test_starts_of_connections_go_to_one_shard(spark):
    df = spark.createDataFrame([(k, kind, None, BASE + k, "s", None) for k, kind in enumerate(["reconnect_start", "reconnect_success"])], feed.SCHEMA)
    assert sorted((r["kind"], r["count"]) for r in route.entries(df, 5).groupBy("kind").count().collect()) == [("reconnect_start", 1), ("reconnect_success", 5)]
