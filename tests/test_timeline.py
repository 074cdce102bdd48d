"""The book after each event against a sequential one, in small parts."""

import random

import pytest
from pyspark.sql import functions as F

from tickbasin.operators import timeline

BASE = 1_700_000_000_000_000


def feed(rng, n, assets):
    """Random events: (arrival, asset, kind, side, price, size, recv, exchange, id); long and short snapshots, some empty."""
    rows, arrival = [], rng.randrange(50)
    while len(rows) < n:
        asset, recv = rng.choice(assets), BASE + len(rows) // 7
        if rng.random() < 0.08:
            for _ in range(rng.choice([1, 2, 9])):
                rows.append((arrival, asset, 1, rng.choice([1, 2]), rng.randrange(1, 8) * 100, rng.choice([0, 1, 5]), recv, recv - 3, rng.choice(["h", None])))
                arrival += 1
        else:
            rows.append((arrival, asset, 2, rng.choice([1, 2]), rng.randrange(1, 8) * 100, rng.choice([0, 0, 1, 2, 3]), recv, recv - 3, None))
        arrival += rng.choice([1, 1, 1, 40])
    return rows


def slow(rows):
    books, last, out = {}, {}, []
    for arrival, asset, kind, side, price, size, recv, ex, name in sorted(rows):
        b, group = books.setdefault(asset, {}), (kind, recv, ex, name or "")
        if kind == 1 and last.get(asset) != group:
            b.clear()
        last[asset] = group
        if size > 0:
            b[side, price] = size
        elif kind == 2:
            b.pop((side, price), None)
        bids, asks = sorted(p for s, p in b if s == 1), sorted(p for s, p in b if s == 2)
        bid, ask = (bids[-1] if bids else None), (asks[0] if asks else None)
        out.append((asset, arrival, bid, b.get((1, bid)), ask, b.get((2, ask)), len(bids), len(asks)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_against_a_sequential_book(spark, monkeypatch, seed):
    rng = random.Random(seed)
    fine, coarse = [(2, 2), (5, 3), (64, 2), (4096, 256)][seed]
    monkeypatch.setattr(timeline, "FINE", fine)
    monkeypatch.setattr(timeline, "COARSE", coarse)
    rows = feed(rng, 500, ["a", "a", "a", "b", "quiet", "c"])
    schema = "arrival long, asset_id string, event_kind tinyint, side tinyint, price int, size long, recv_timestamp_us long, exchange_timestamp_us long, source_event_id string"
    events = spark.createDataFrame(rows, schema).repartition(3)
    found = timeline.book_after_events(events)
    columns = ["asset_id", "arrival", "best_bid", "best_bid_size", "best_ask", "best_ask_size", "bid_depth", "ask_depth"]
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(slow(rows), key=repr)
    assert timeline.book_after_events(events.limit(0)).count() == 0
    if seed == 0:  # a hot asset is shared: no part holds more events than its bound
        parts = timeline.in_parts(events).groupBy("asset_id", "part").count()
        assert parts.agg(F.max("count")).first()[0] < 2 * fine and parts.where("asset_id = 'a'").count() > 50
