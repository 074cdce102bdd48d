"""Normalization, storage, integrity, executions, live state, streams and the workbench on the fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tickbasin.errors import BadRequest, NotFound, NotReady
from tickbasin.operators import execution, integrity, live, markets, normalize
from tickbasin.plans import workbench
from tickbasin.schemas import DATASETS
from tickbasin.sources import feed, storage
from tickbasin.streaming import books, sinks

BASE = 1_700_000_000_000_000
S = 1_000_000


def messages(spark, *texts):
    """Texts, or (kind, session) of a connection change, in order of arrival."""
    rows = [(k, "raw", t if isinstance(t, str) else json.dumps(t), BASE + k, None, None) if not isinstance(t, tuple) else (k, t[0], None, BASE + k, t[1], "why") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, feed.SCHEMA)


def book(ts, bids, asks, asset="token-1", **more):
    return {"event_type": "book", "asset_id": asset, "timestamp": ts, "bids": [{"price": p, "size": s} for p, s in bids], "asks": [{"price": p, "size": s} for p, s in asks], **more}


def change(ts, *levels):
    return {"event_type": "price_change", "timestamp": ts, "price_changes": [{"asset_id": "token-1", "price": p, "size": s, "side": side, "best_bid": "0.1"} for side, p, s in levels]}


def sequences(n):
    return [(r.side, r.price, r.sequence) for r in n.book_events.orderBy("recv_timestamp_us", "sequence").collect()]


def test_dispatcher_fixture(spark):
    n = normalize.normalize(messages(spark, book("1700000000000000", [("0.55", "100")], [("0.60", "200")], hash="book-1"), change("1700000000001000", ("BUY", "0.54", "75")), {"event_type": "last_trade_price", "asset_id": "token-1", "price": "0.58"}, book("1699999999999000", [("0.1", "1")], [])))
    assert sequences(n) == [(1, 5500, 0), (2, 6000, 1), (1, 5400, 2)]
    trade = n.trade_events.first()
    assert (trade.price, trade.fidelity, trade["size"]) == (5800, "partial", None)
    stale = n.ingest_events.first()
    assert stale.event_kind == "stale_snapshot_skip" and stale.details == "snapshot exchange timestamp 1699999999999000 <= latest accepted 1700000000000000"


def test_lifecycle_fixture(spark):
    n = normalize.normalize(messages(spark, ("reconnect_success", "session-123"), change("1", ("SELL", "0.5", "1"))))
    rows = n.ingest_events.orderBy("event_kind").collect()
    assert [(r.event_kind, r.source_session_id) for r in rows] == [("reconnect_success", "session-123"), ("source_reset", "session-123")]
    assert n.book_events.first().source_session_id == "session-123" and n.book_events.first().exchange_timestamp_us == 1000


def test_sequences_sides_and_bad_levels(spark):
    n = normalize.normalize(messages(
        spark, change("1", ("BUY", "0.5", "1"), ("Buy", "0.6", "1"), ("sell", "0.7", "1")), change("2", ("BUY", "0.4", "1"), ("BUY", "2", "1"), ("BUY", "0.3", "1")), book("100", [("0.2", "1")], [("0.3", "1")]), book("50", [("0.9", "1")], []),
        book("200", [], []), change("3", ("ask", "0.8", "0")), book("0", [("0.1", "5")], []), '{"event_type":"other"}', "[]", "{", {"event_type": "book", "asset_id": "token-1"}, {"event_type": "last_trade_price", "asset_id": "t", "price": "0.5", "size": "-1"},
    ))
    assert sequences(n) == [(1, 5000, 0), (2, 7000, 1), (1, 4000, 2), (1, 2000, 0), (2, 3000, 1), (2, 8000, 0), (1, 1000, 0)]
    assert n.ingest_events.count() == 1 and n.trade_events.count() == 0


def test_numbering_across_buckets(spark, monkeypatch):
    """Small buckets give the same sequences as one large one."""
    import random

    rng = random.Random(4)
    texts = [book(str(10**13 + k), [("0.1", "1")] * rng.randint(0, 2), []) if rng.random() < 0.15 else change("1", *[("BUY", "0.5", "1")] * rng.randint(1, 2)) for k in range(80)]
    m = messages(spark, *texts)
    key = lambda n: sorted((r.recv_timestamp_us, r.sequence) for r in n.book_events.collect())
    whole = key(normalize.normalize(m))
    monkeypatch.setattr(normalize, "NUMBER_BUCKET", 3)
    assert key(normalize.normalize(m)) == whole
    following, want = 0, []
    for k, t in enumerate(texts):
        following = 0 if t["event_type"] == "book" else following
        for _ in t.get("bids") or t.get("price_changes") or []:
            want.append((BASE + k, following))
            following += 1
    assert whole == sorted(want)


def test_stream_equals_batch(spark):
    m = messages(spark, book("100", [("0.2", "1"), ("0.1", "2")], [("0.3", "1")]), change("101", ("BUY", "0.15", "3"), ("BUY", "bad", "3"), ("BUY", "0.16", "3")), book("90", [("0.9", "1")], []), change("102", ("SELL", "0.3", "0")), book("110", [], []), change("103", ("BUY", "0.4", "1")))
    columns = ["asset_id", "event_kind", "side", "price", "size", "sequence", "exchange_timestamp_us"]
    kinds = {"event_kind": F.col("event_kind").cast("int"), "side": F.col("side").cast("int")}
    batch = normalize.normalize(m).book_events.withColumns(kinds).select(columns)
    assert sorted(books.stream_normalized(m).select(columns).collect()) == sorted(batch.collect())


def test_storage_round_trip(spark, tmp_path):
    rows = [(BASE + k * 1800 * S, 0, f"a{k % 2}", 1, 1, 5000 + k, k, None, "websocket", f"e{k}", None) for k in range(10)]
    df = spark.createDataFrame(rows, DATASETS["book_events"])
    base = f"file://{tmp_path}"
    storage.write(df, base, "book_events")
    storage.write(df.limit(0), base, "book_events")
    back = storage.read(spark, base, "book_events")
    assert sorted(back.select(df.columns).collect()) == sorted(df.collect())
    part = storage.scan(back, "book_events", BASE, BASE + 3600 * S, "a0")
    assert sorted(r.price for r in part.collect()) == [5000, 5002]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters")[1][:200] and "IsNotNull(asset_id)" in plan.split("PushedFilters")[1]
    assert storage.read(spark, base, "trade_events").count() == 0 and len(storage.files_of(back)) >= 5
    with pytest.raises(BadRequest):
        storage.write(df.drop("price"), base, "book_events")


def test_foreign_unsigned_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    kinds = {"long": pa.uint64(), "int": pa.uint32(), "tinyint": pa.uint8(), "string": pa.string()}
    row = (BASE, 0, "a", 1, 2, 5500, 12_000_000, None, "websocket", None, None)
    names = [(f.name, kinds[{"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString())]) for f in DATASETS["book_events"].fields]
    folder = tmp_path / "book_events/2023/11/14/22"
    folder.mkdir(parents=True)
    pq.write_table(pa.table({n: pa.array([v], t) for (n, t), v in zip(names, row, strict=True)}), folder / "a_1.parquet")
    assert tuple(storage.read_foreign(spark, str(tmp_path), "book_events").first()) == row
    pq.write_table(pa.table({n: pa.array([9 if n == "side" else v], t) for (n, t), v in zip(names, row, strict=True)}), folder / "a_2.parquet")
    with pytest.raises(Exception, match="unknown value 9"):
        storage.read_foreign(spark, str(tmp_path), "book_events").collect()


def ingest(spark, rows):
    """rows: (recv, asset, kind)."""
    return spark.createDataFrame([(t, 0, a, k, None, None, None, None, "websocket", f"i{t}", "s1") for t, a, k in rows], DATASETS["ingest_events"])


def test_integrity_fixture(spark):
    df = spark.createDataFrame([(BASE, BASE, "a", 1, 1, 5000, 1, 0, "websocket", None, None)], DATASETS["book_events"])
    none = spark.createDataFrame([], DATASETS["replay_validations"])
    assets = spark.createDataFrame([("a",), ("b",)], "asset_id string")
    r = {x.asset_id: x for x in integrity.summary(df, ingest(spark, [(BASE, "a", "sequence_gap"), (BASE + 1, None, "reconnect_start")]), none, assets, BASE, BASE + 10).collect()}
    assert (r["a"].total_book_events, r["a"].total_ingest_events, r["a"].reconnect_count, r["a"].gap_count, r["a"].stale_snapshot_skip_count, r["a"].completeness) == (1, 2, 1, 1, 0, "best_effort")
    assert r["b"].gap_count == 0 and r["b"].completeness == "best_effort"
    r = integrity.summary(df, ingest(spark, [(BASE, "a", "stale_snapshot_skip")]), none, assets, BASE, BASE + 10).where("asset_id = 'a'").first()
    assert r.completeness == "complete" and r.stale_snapshot_skip_count == 1


def test_execution_append_and_timeline(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"order_id": "A", "event_kind": "submit_intent", "event_timestamp_us": 5, "side": "bid", "price": "0.5", "size": "2", "order_submit_us": 1, "exchange_ack_us": 3}, {"order_id": "B", "event_kind": "exchange_ack", "event_timestamp_us": 105, "asset_id": "a"}]))
    df = execution.read_input(spark, str(tmp_path / "x.json"))
    rows = execution.timeline(df, 0, 200, 10).collect()
    assert [(r.order_id, r.total_count) for r in rows] == [("A", 2), ("B", 2)] and rows[0].price == 5000 and rows[0].side == "bid"
    assert execution.timeline(df, 0, 200, 10, order_id="A").count() == 1 and execution.timeline(df, 0, 200, 10, asset_id="a").first().order_id == "B"
    assert execution.timeline(df, 0, 200, 1).collect()[0].total_count == 2
    assert execution.latency_breakdown(df).where("order_id = 'A'").first().ack_us == 2
    assert '"exchange_fill_us":null' in df.first().latency_json
    (tmp_path / "one.json").write_text(json.dumps({"order_id": "A", "event_kind": "fill", "event_timestamp_us": 1, "odd": 1}))
    with pytest.raises(BadRequest, match="odd"):
        execution.read_input(spark, str(tmp_path / "one.json"))
    (tmp_path / "two.json").write_text(json.dumps({"order_id": "A", "event_kind": "nope", "event_timestamp_us": 1}))
    with pytest.raises(Exception, match="unknown event kind"):
        execution.read_input(spark, str(tmp_path / "two.json")).collect()


def live_events(spark, rows):
    """rows: (arrival, asset, kind, side, price, size, seq); equal clocks."""
    return spark.createDataFrame([(BASE, BASE, a, k, s, p, z, q, "websocket", "h", None, n) for n, a, k, s, p, z, q in rows], "recv_timestamp_us long, exchange_timestamp_us long, asset_id string, event_kind int, side int, price int, size long, sequence long, source string, source_event_id string, source_session_id string, arrival long")


def test_live_state(spark):
    ev = live_events(spark, [(1, "tok1", 1, 1, 5000, 5, 0), (2, "tok1", 1, 2, 6000, 5, 1)])
    warn = ingest(spark, [(BASE, "tok2", "sequence_gap"), (BASE + 1, None, "reconnect_start")]).withColumn("arrival", F.col("recv_timestamp_us"))
    active = spark.createDataFrame([("tok1",), ("tok2",)], "asset_id string")
    snap = live.live_snapshot(ev, warn, active, "tok1", 5, BASE + S, 10).first()
    assert (snap.bid_depth, snap.ask_depth, snap.sequence, snap.stale) == (1, 1, 1, False)
    with pytest.raises(NotReady):
        live.live_snapshot(ev, warn, active, "tok2", 5, BASE, 10)
    with pytest.raises(NotFound):
        live.live_snapshot(ev, warn, active, "tok3", 5, BASE, 10)
    got = {r.asset_id: r for r in live.active_assets(active, live.asset_states(ev), BASE + 11 * S, 10).collect()}
    assert got["tok1"].stale and got["tok1"].has_book and got["tok2"].stale and not got["tok2"].has_book
    assert live.session_status(warn).first().session_status == "reconnecting" and live.session_status(warn.limit(0)).first().session_status == "starting"
    assert {r.asset_id for r in live.warnings(warn).collect()} == {"tok2", None}


def test_live_stream_groups_snapshots(spark):
    ev = live_events(spark, [(1, "a", 2, 1, 100, 7, 0), (2, "a", 1, 1, 5000, 5, 0), (3, "a", 1, 2, 6000, 0, 1), (4, "a", 2, 1, 5100, 3, 2), (5, "a", 1, 1, 4000, 2, 3), (6, "b", 2, 2, 10, 1, 0), (7, "a", 1, 1, 4100, 2, 4), (8, "a", 2, 1, 4000, 0, 5)])
    want = sorted(tuple(r) for r in live.live_books(ev).select("asset_id", "side", "price", "size").collect())
    assert want == [("a", 1, 4100, 2), ("b", 2, 10, 1)]
    assert sorted(tuple(r) for r in books.stream_final_levels(ev).collect()) == want


def test_fan_out_fails_closed(spark, tmp_path):
    df = messages(spark, "{}")
    df.write.json(str(tmp_path / "in"))
    seen = []

    def broken(batch, batch_id):
        raise RuntimeError("closed")

    query = sinks.fan_out(feed.read_messages(spark, str(tmp_path / "in")), [lambda b, i: seen.append(b.count()), broken], str(tmp_path / "cp"), available_now=True)
    with pytest.raises(Exception, match="closed"):
        query.awaitTermination()
    assert seen == [1]


def test_workbench(spark):
    spark.range(30).createOrReplaceTempView("numbers")
    r = workbench.run(spark, "select id from numbers order by id", most=10)
    assert r["row_count"] == 10 and r["truncated"] and r["columns"] == [{"name": "id", "data_type": "bigint"}]
    assert not workbench.run(spark, "with x as (select 1 as drop_it) select * from x")["truncated"]
    for sql in ("drop table numbers", "insert into numbers values (1)", "create table t as select 1", "set a=b", "selec 1", "select nope from numbers", "show tables", "truncate table numbers"):
        with pytest.raises(BadRequest):
            workbench.run(spark, sql)
    with pytest.raises(BadRequest):
        workbench.run(spark, "select 1", enabled=False)


@pytest.mark.parametrize(
    "sql",
    [
        "select IDENTIFIER('java_method')('java.lang.System','getProperty','user.home') from numbers", "select IDENTIFIER('java' || '_method')('java.lang.System','getProperty','user.home') from numbers",
        "select IDENTIFIER(concat('java','_method'))('java.lang.System','getenv','HOME') from numbers", "select row_number() over w from numbers window w as (order by java_method('java.lang.System','getProperty','user.home'))",
        "select row_number() over (partition by reflect('java.lang.System','getProperty','user.home') order by id) from numbers", "select * from IDENTIFIER('numbers')", "select * from parquet.`/tmp`", "select * from range(5)",
        "select (select max(java_method('java.lang.System','getProperty','user.home')) from numbers)", "select filter(array(1), x -> java_method('java.lang.System','getProperty','user.home') = 'a') from numbers",
        "select id from numbers where exists (select 1 from numbers where try_reflect('java.lang.System','getProperty','user.home') is null)", "from numbers |> select java_method('java.lang.System','getProperty','user.home')",
        "select id from numbers order by java_method('java.lang.System','getProperty','user.home')", "select sum(id) from numbers group by reflect('a','b')", "select session.f(id) from numbers",
    ],
)
def test_workbench_refuses(spark, sql):
    spark.range(30).createOrReplaceTempView("numbers")
    with pytest.raises(BadRequest):
        workbench.run(spark, sql)


@pytest.mark.parametrize(
    "sql",
    [
        "select id, row_number() over w as r, sum(id) over (partition by id % 2 order by id rows between 1 preceding and current row) from numbers window w as (order by id desc)", "select id % 3 as k, count(*) filter (where id > 4), avg(id) from numbers group by 1 having count(*) > 1 order by k limit 5 offset 1",
        "with a as (select id from numbers where id between 3 and 9), b as (select id + 1 as id from a) select a.id, b.id from a left join b on a.id = b.id where a.id in (select id from numbers) and not exists (select 1 from b where b.id = a.id + 100)",
        "select case when id > 3 then 'x' else null end, cast(id as string) like '1%', id::string rlike '2', transform(array(id, 2), x -> x + 1), named_struct('a', id).a, array(id)[0], -id, coalesce(null, id) is not null, (select max(id) from numbers) from numbers",
        "select distinct id from numbers union all select 7 except select 3", "select e from numbers lateral view explode(array(id, id)) as e", "select id, k, count(*) from (select id, id % 2 as k from numbers) group by rollup (id, k)", "select * from (values (1), (2)) t(x) join numbers on x = id",
    ],
)
def test_workbench_allows(spark, tmp_path, sql):
    spark.range(30).write.mode("overwrite").parquet(str(tmp_path / "n"))
    spark.read.parquet(str(tmp_path / "n")).createOrReplaceTempView("numbers")
    assert workbench.run(spark, sql)["row_count"] > 0


def test_discovery(spark):
    text = json.dumps([{"id": "1", "title": "Bitcoin up", "markets": [{"id": "m", "question": "Will it?", "clobTokenIds": "[\"tok1\",\"tok2\"]"}]}, {"id": "2", "title": None, "markets": [{"id": "n", "question": "BITCOIN?", "clobTokenIds": " a , b,"}]}, {"id": "3", "title": "x"}])
    df = markets.parse_events(spark.createDataFrame([(text,)], "text string"))
    assert [r.token_id for r in markets.token_ids(df).orderBy("id", "pos").collect()] == ["tok1", "tok2", "a", "b"]
    assert sorted(r.id for r in markets.with_keyword(df, "bitcoin").collect()) == ["1", "2"]


def test_rest_checkpoint(spark):
    good = json.dumps({"asset_id": "a", "hash": "h", "timestamp": "1700000000000", "bids": [{"price": "0.5", "size": "1"}], "asks": []})
    bad = json.dumps({"asset_id": "b", "bids": [{"price": "7", "size": "1"}], "asks": []})
    r = feed.rest_checkpoints(spark.createDataFrame([(good,), (bad,), ("{",)], "text string"), 9).collect()
    assert len(r) == 1 and r[0].checkpoint_timestamp_us == BASE and r[0].bids_json == '[{"price":"0.5000","size":"1.000000"}]' and r[0].asks_json == "[]"
