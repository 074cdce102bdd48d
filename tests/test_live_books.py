"""The streaming book and its best levels: changes only, against the batch book at every version."""

import random

import pytest
from test_timeline import feed

from tickbasin.errors import NotFound, NotReady
from tickbasin.operators import book, live
from tickbasin.schemas import ASK, BID
from tickbasin.streaming import books

SCHEMA = "arrival long, asset_id string, event_kind int, side int, price int, size long, recv_timestamp_us long, exchange_timestamp_us long, source_event_id string"


class Map(dict):
    """A map state, which counts what is read."""

    reads = 0

    def containsKey(self, k):
        self.reads += 1
        return k in self

    def getValue(self, k):
        self.reads += 1
        return self[k]

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        del self[k]


def test_levels_read_little():
    """Best levels against sorting, and few reads of a large book."""
    rng, sizes, pages, filled, want = random.Random(3), Map(), Map(), {}, {}
    for step in range(300):
        level = books.Levels(sizes, pages)
        if step % 97 == 96:
            level.clear()
            filled, want = {}, {}
        for _ in range(rng.choice([1, 40])):
            key, size = (rng.choice([1, 2]), rng.randrange(0, 10_001)), rng.choice([0, 1, 2, 3])
            level.put(key, size, filled)
            want.pop(key, None)
            if size:
                want[key] = size
        for side in (BID, ASK):
            prices = sorted((p for s, p in want if s == side), reverse=side == BID)
            assert level.best(side, 7, filled) == prices[:7]
        level.save()
        assert {k: v[0] for k, v in sizes.items()} == want
    sizes.reads = pages.reads = 0
    level = books.Levels(sizes, pages)
    level.put((1, 500), 4, filled)
    level.best(1, 10, filled)
    level.save()
    assert len(want) > 100 and sizes.reads + pages.reads < 20


def test_best_levels_stream(spark):
    rows = feed(random.Random(5), 240, ["a", "a", "b", "late"])
    rows = [(n, a, k, s, p + 37 * (n % 9), z, *rest) for n, a, k, s, p, z, *rest in rows if a != "late"] + [(999, "late", 2, 1, 100, 1, 5, 5, None)]
    events = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "cast(arrival as long) as sequence")
    changes = books.stream_top_levels(events, 3, parts=6, full_every=4).cache()
    top = book.top_n(live.live_books(events), 3, ["asset_id"]).select("asset_id", "side", "price", "size")
    got = sorted(map(tuple, books.current_levels(changes).select("asset_id", "side", "price", "size").collect()))
    assert got == sorted(map(tuple, top.collect())) and len({r[0] for r in got}) == 3
    newest = {r.asset_id: r.v for r in changes.groupBy("asset_id").agg({"version": "max"}).toDF("asset_id", "v").collect()}
    assert newest["a"] == 6 and not changes.where("size is not null").groupBy("asset_id", "version").count().where("count > 12").count()
    # a reader who applies the changes since any version gets the same levels; one too far behind gets all of them
    for version in (1, 3, 5):
        late, rest = books.changes_since(changes, "a", version)
        assert not late
        at = {(r.side, r.price): r["size"] for r in books.current_levels(changes.where(f"asset_id = 'a' and version <= {version}")).collect()}
        by_version = {}
        for r in rest.collect():
            by_version.setdefault(r.version, []).append(r)
        for _, got_rows in sorted(by_version.items()):
            at = {} if got_rows[0].full else at
            at |= {(r.side, r.price): r["size"] for r in got_rows if r.side is not None}
        assert {(s, p, z) for (s, p), z in at.items() if z} == {r[1:] for r in got if r[0] == "a"}
    late, rest = books.changes_since(changes, "a", 1, buffer=2)
    assert late and {(r.side, r.price, r["size"]) for r in rest.collect()} == {r[1:] for r in got if r[0] == "a"}
    active = spark.createDataFrame([("a",), ("late",)], "asset_id string")
    first = books.subscribed(changes, active, "a").collect()
    assert {(r.side, r.price, r["size"]) for r in first} == {r[1:] for r in got if r[0] == "a"} and {r.version for r in first} == {6}
    with pytest.raises(NotReady):
        books.subscribed(changes, active, "late")
    with pytest.raises(NotFound):
        books.subscribed(changes, active, "b")
