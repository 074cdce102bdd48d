import random

import pytest
from simulate import replay as simulated

from tickbasin.errors import BadRequest, NoSnapshot
from tickbasin.operators import book, replay
from tickbasin.schemas import DATASETS
from tickbasin.sources import storage

BASE = 1_700_000_000_000_000
S = 1_000_000


def events(spark, rows):
    """rows: dicts of asset, recv, ex, kind, side, price, size, seq, id."""
    data = [(r["recv"], r["ex"], r["asset"], r["kind"], r["side"], r["price"], r["size"], r["seq"], "websocket", r["id"], None) for r in rows]
    return spark.createDataFrame(data, DATASETS["book_events"])


def checkpoints(spark, rows):
    """rows: (asset, ts, [(side, price, size)])."""
    from pyspark.sql import functions as F

    from tickbasin.functions.codecs import levels_to_json

    flat = spark.createDataFrame([(a, t, [(p, z) for s, p, z in lv if s == 1], [(p, z) for s, p, z in lv if s == 2]) for a, t, lv in rows], "asset_id string, ts long, b array<struct<price:int,size:long>>, a array<struct<price:int,size:long>>")
    none = F.lit(None).cast("string")
    return flat.select(F.col("ts").alias("checkpoint_timestamp_us"), F.col("ts").alias("recv_timestamp_us"), F.col("ts").alias("exchange_timestamp_us"), "asset_id", F.lit("rest_snapshot").alias("source"), none.alias("source_event_id"), none.alias("source_session_id"), levels_to_json(F.col("b")).alias("bids_json"), levels_to_json(F.col("a")).alias("asks_json"))


def points(spark, rows):
    return spark.createDataFrame(rows, "query_id long, asset_id string, at_us long")


def row(t, kind, side, price, units, seq, asset="token-1"):
    return {"asset": asset, "recv": BASE + t * S, "ex": BASE + t * S, "kind": kind, "side": side, "price": price, "size": units * S, "seq": seq, "id": f"e{seq}"}


FIXTURE = [row(0, 1, 1, 5000, 100, 0), row(0, 1, 1, 4900, 200, 1), row(0, 1, 2, 5500, 150, 2), row(0, 1, 2, 5600, 250, 3), row(1, 2, 1, 5000, 500, 4), row(2, 2, 2, 5200, 75, 5)]
REFERENCE = ("token-1", BASE + 2 * S, [(1, 5000, 500 * S), (1, 4900, 200 * S), (2, 5200, 75 * S), (2, 5500, 150 * S), (2, 5600, 250 * S)])


def levels(r):
    return {(x.side, x.price): x.size for x in r.levels.collect()}


def test_fixture_without_checkpoint(spark):
    ev = events(spark, FIXTURE)
    r = replay.reconstruct(ev, points(spark, [(1, "token-1", BASE)]))
    assert levels(r) == {(1, 5000): 100 * S, (1, 4900): 200 * S, (2, 5500): 150 * S, (2, 5600): 250 * S}
    assert not r.header.first().used_checkpoint
    r = replay.reconstruct(ev, points(spark, [(1, "token-1", BASE + S)]))
    head = r.header.first()
    assert (head.sequence, levels(r)[1, 5000], replay.gaps(r).count()) == (4, 500 * S, 0)


def test_fixture_with_checkpoint(spark):
    r = replay.reconstruct(events(spark, FIXTURE), points(spark, [(1, "token-1", BASE + 2 * S)]), "exchange_time", checkpoints=checkpoints(spark, [REFERENCE]))
    assert r.header.first().used_checkpoint
    assert levels(r)[1, 5000] == 500 * S
    assert book.top_of_book(r.levels).first().best_ask == 5200


def test_fixture_gap(spark):
    rows = [x for x in FIXTURE if x["seq"] != 4]
    r = replay.reconstruct(events(spark, rows), points(spark, [(1, "token-1", BASE + 2 * S)]))
    gap = replay.gaps(r).collect()
    assert [(g.expected_sequence, g.observed_sequence) for g in gap] == [(4, 5)]
    assert gap[0].details == "orderbook token-1: sequence gap 4 -> 5 (dropped 1 updates)"


def test_no_snapshot_raises(spark):
    r = replay.reconstruct(events(spark, FIXTURE[4:]), points(spark, [(1, "token-1", BASE + 5 * S)]))
    with pytest.raises(NoSnapshot):
        r.require(1, "token-1", BASE + 5 * S)
    assert r.levels.count() == 0
    with pytest.raises(BadRequest):
        replay.reconstruct(events(spark, FIXTURE), points(spark, [(1, "token-1", BASE)]), "other")


def test_validation(spark):
    ev = events(spark, FIXTURE)
    at = points(spark, [(1, "token-1", BASE)])
    for base in ("strict", "inclusive"):
        v = replay.validate(ev, at, checkpoints(spark, [REFERENCE]), base=base, persisted_at_us=7).first()
        assert v.matched and v.reference_timestamp_us == BASE + 2 * S and v.persisted_at_us == 7 and v.mismatch_summary is None
    off = (*REFERENCE[:2], [(2, 5200, 80 * S) if x[1] == 5200 else x for x in REFERENCE[2]])
    cps = checkpoints(spark, [off])
    assert replay.validate(ev, at, cps, base="inclusive").first().matched
    v = replay.validate(ev, at, cps, base="strict").first()
    assert not v.matched and "best_ask=0.5200 @ 75.000000 checkpoint_best_ask=0.5200 @ 80.000000" in v.mismatch_summary
    assert replay.validate(ev, points(spark, [(1, "token-1", BASE + 2 * S)]), cps).count() == 0


def test_derived_checkpoints_validate(spark):
    ev = events(spark, FIXTURE)
    made = replay.derived_checkpoints(replay.reconstruct(ev, points(spark, [(1, "token-1", BASE + S), (2, "token-1", BASE + 2 * S)])))
    v = replay.validate(ev, points(spark, [(1, "token-1", BASE), (2, "token-1", BASE + S)]), made).collect()
    assert len(v) == 2 and all(x.matched for x in v)
    assert storage.latest_checkpoint(made, "token-1", BASE + 10**12).first().checkpoint_timestamp_us == BASE + 2 * S


@pytest.mark.parametrize("mode", ["recv_time", "exchange_time"])
@pytest.mark.parametrize("with_checkpoint", [False, True])
@pytest.mark.parametrize("bounded", [False, True])
def test_random_against_loop(spark, monkeypatch, mode, with_checkpoint, bounded):
    # without a lookback the events from the base on, in many buckets
    monkeypatch.setattr(replay.since_base, "__defaults__", (3,))
    rng = random.Random(f"{mode}{with_checkpoint}")
    all_rows, all_points, cps, want = [], [], [], {}
    for case in range(150):
        asset = f"a{case}"
        rows = []
        for k in range(rng.randint(0, 25)):
            recv = rng.randint(1, 12)
            kind = 1 if rng.random() < 0.35 else 2
            rows.append({"asset": asset, "recv": recv, "ex": rng.choice([0, recv, max(1, recv - rng.randint(0, 4)), recv + 1]), "kind": kind, "side": rng.randint(1, 2), "price": rng.randint(1, 4), "size": rng.choice([0, 1, 2, 3]), "seq": rng.choice([None, *range(0, 8)]), "id": f"{k:03d}"})
        at, lookback = rng.randint(1, 13), 9 if bounded else 10**9
        cp = None
        if with_checkpoint and rng.random() < 0.8:
            cp = (rng.randint(1, 13), [(s, p, rng.randint(0, 3)) for s in (1, 2) for p in rng.sample(range(1, 5), rng.randint(0, 3))])
            cps.append((asset, *cp))
            if cp[0] > at:
                cp = None
        all_rows += rows
        all_points.append((case, asset, at))
        want[case] = simulated(rows, at, mode, lookback, cp)
    r = replay.reconstruct(events(spark, all_rows), points(spark, all_points), mode, lookback if bounded else None, checkpoints(spark, cps) if with_checkpoint else None)
    heads = {h.query_id: (h.sequence, h.last_update_us) for h in r.header.collect()}
    books, found = {}, {}
    for x in r.levels.collect():
        books.setdefault(x.query_id, {})[x.side, x.price] = x.size
    for g in replay.gaps(r).collect():
        found.setdefault(g.query_id, []).append((g.source_event_id, g.expected_sequence, g.observed_sequence))
    for case, expected in want.items():
        if expected is None:
            assert case not in heads and case not in books
        else:
            assert books.get(case, {}) == expected[0]
            assert heads[case] == (expected[1], expected[2])
            assert sorted(found.get(case, [])) == sorted(expected[3])


def test_nearest_stamps_of_a_hot_asset(spark):
    """Forward and backward, inclusive and strict, against a search in the sorted stamps; one asset holds nearly all, in many buckets."""
    import bisect
    import random

    from tickbasin.operators import replay

    rng = random.Random(4)
    span = 40 * replay.ASOF_BUCKET_US
    stamps = {"hot": sorted(rng.randrange(span) for _ in range(3000)), "cold": [5, 5, 7], "none": []}
    asked = [(k, "hot", rng.choice([rng.randrange(span), rng.choice(stamps["hot"])])) for k in range(800)] + [(900 + k, "cold", k) for k in range(10)] + [(990, "none", 3)]
    known = spark.createDataFrame([(a, t) for a, ts in stamps.items() for t in ts], "asset_id string, ts long")
    points = spark.createDataFrame(asked, "query_id long, asset_id string, at_us long")
    for forward in (False, True):
        for inclusive in (True, False):
            want = {}
            for q, a, at in asked:
                ts = stamps[a]
                k = (bisect.bisect_left if inclusive else bisect.bisect_right)(ts, at) if forward else (bisect.bisect_right if inclusive else bisect.bisect_left)(ts, at) - 1
                if 0 <= k < len(ts):
                    want[q] = ts[k]
            got = replay.nearest(known, points, inclusive, forward).collect()
            assert len(got) == len(want) and {r.query_id: r.ts for r in got} == want


def test_workbench_runs_listed_things_only(spark):
    import pytest

    from tickbasin.errors import BadRequest
    from tickbasin.plans import workbench

    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").createOrReplaceTempView("listed_view")
    for sql, n in (
        ("select k, upper(v) u from listed_view where k > 1 order by k limit 5", 1), ("with w as (select max(k) m from listed_view) select * from w join listed_view on k = m", 1), ("select v, count(*) c from listed_view group by v having count(*) > 0", 2),
        ("select * from listed_view where k in (select k from listed_view where k = 1)", 1), ("select k, row_number() over (order by k) r from listed_view union all select 3, 3", 3), ("select explode(array(1, 2, 3)) x", 3), ("select (select max(k) from listed_view) m", 1),
    ):
        assert workbench.run(spark, sql)["row_count"] == n, sql
    for sql in (
        "select * from parquet.`/root/testdata/sf0.001/region.parquet`", "select reflect('java.lang.System', 'getProperty', 'user.home')", "select java_method('java.lang.System', 'exit', '0')", "select * from unknown_table", "select * from default.listed_view",
        "drop view listed_view", "create table t as select 1", "insert into listed_view values (3, 'c')", "set spark.sql.ansi.enabled=false", "select * from range(10)", "show tables", "select * from listed_view where k in (select k from csv.`/etc/passwd`)",
        "with w as (select * from text.`/etc/passwd`) select * from w", "select (select value from text.`/etc/passwd` limit 1)", "select transform(k) using 'cat' from listed_view", "select system.builtin.reflect('a', 'b')", "select 1; select 2", "select exists(select * from text.`/etc/passwd`)",
    ):
        with pytest.raises(BadRequest):
            workbench.guarded(spark, sql)
