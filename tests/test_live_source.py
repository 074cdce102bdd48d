"""The live source: client, quota, poller and journal with injected clocks, and a query that is stopped and started again."""

import json

import pytest

from tickbasin.errors import RateLimited
from tickbasin.sources import feed, live_source


class Clock:
    def __init__(self):
        self.t = 100.0

    def __call__(self):
        return self.t

    def sleep(self, s):
        self.t += s


class Scripted:
    """A transport of steps: texts, or errors to raise."""

    def __init__(self, *steps, refuse=0):
        self.steps, self.refuse, self.connects = list(steps), refuse, 0

    def connect(self, assets):
        self.connects += 1
        if self.connects <= self.refuse:
            raise ConnectionError("refused")

    def receive(self, most, wait_s):
        if not self.steps:
            return []
        step = self.steps.pop(0)
        if isinstance(step, Exception):
            raise step
        self.steps[:0] = [step[most:]] if step[most:] else []
        return step[:most]

    def close(self):
        pass


def client(transport, clock, **more):
    return live_source.Client(transport, ["a"], 500, 4000, clock, clock.sleep, lambda: int(clock.t * 1e6), lambda: 0.0, lambda: "s", **more)


def test_client_reconnects_with_backoff():
    clock = Clock()
    c = client(Scripted(["1", "2"], ConnectionError("gone"), ["3"], refuse=3), clock)
    rows = c.poll(100, 60)
    assert [r["kind"] for r in rows] == ["reconnect_start", "reconnect_success", "raw", "raw", "reconnect_start", "reconnect_success", "raw"]
    assert [r["text"] for r in rows if r["text"]] == ["1", "2", "3"]
    assert clock.t == pytest.approx(100 + 0.5 + 1 + 2 + 0.5)  # doubled while refused, from the start again after a success


def test_client_keeps_to_its_time_and_number():
    clock = Clock()
    c = client(Scripted([str(k) for k in range(10)], refuse=1), clock)
    assert [r["kind"] for r in c.poll(100, 0.2)] == ["reconnect_start"] and clock.t == 100  # the pause is longer than it may wait
    clock.t += 1
    assert len(c.poll(4, 1)) == 4 and len(c.poll(4, 1)) == 4 and len(c.poll(4, 1)) == 3 and c.poll(4, 1) == []


def test_quota_and_poller():
    clock = Clock()
    quota = live_source.Quota(40, 10, clock)
    assert [quota.delay() for _ in range(5)] == [0, 0, 0, 0, 0.25]
    clock.t += 0.25
    assert quota.delay() == 0
    asked = []

    def fetch(asset):
        asked.append((asset, clock.t))
        return (429 if len(asked) == 5 else 200), f"book of {asset}"

    p = live_source.Poller(fetch, 60, live_source.Quota(20, 10, clock), clock, clock.sleep)
    p.connect(["a", "b", "c", "d"])
    assert p.receive(10, 5) == [f"book of {x}" for x in "abcd"]
    assert [t - asked[0][1] for _, t in asked] == [0, 0, 0.5, 1.0]  # two at once, then two a second
    with pytest.raises(RateLimited):
        p.receive(10, 100)
    assert p.receive(10, 1)[0].startswith("book of")


def test_poller_makes_checkpoints(spark):
    body = json.dumps({"asset_id": "a", "hash": "h", "timestamp": "1700000000000", "bids": [{"price": "0.5", "size": "1"}], "asks": []})
    clock = Clock()
    c = client(live_source.Poller(lambda asset: (200, body), 60, None, clock, clock.sleep), clock)
    texts = [(r["text"],) for r in c.poll(3, 130) if r["kind"] == "raw"]
    assert len(texts) == 2 and feed.rest_checkpoints(spark.createDataFrame(texts, "text string"), 9).count() == 2


def test_journal(tmp_path):
    j = live_source.Journal(str(tmp_path))
    rows = [{"kind": "raw", "text": "é\n" + str(k), "recv_timestamp_us": k, "session_id": None, "details": None} for k in range(5)]
    assert j.append(0, rows[:2]) == 2 and j.append(2, rows[2:]) == 5
    assert [(a, b) for a, b, _ in j.segments()] == [(0, 2), (2, 5)]
    assert [r[2] for r in j.read(j.segments()[1][2], 3, 5)] == ["é\n3", "é\n4"]
    j.forget(5)
    assert [(a, b) for a, b, _ in live_source.Journal(f"file://{tmp_path}").segments()] == [(2, 5)]  # the newest stays and keeps the count


def counting(folder):
    """A client of a venue that numbers its texts on and on, over connections and runs, as a file beside the test remembers."""
    class Counting:
        def connect(self, assets):
            pass

        def receive(self, most, wait_s):
            import os

            path = f"{folder}/venue"
            first = int(open(path).read()) if os.path.exists(path) else 0
            last = min(first + 7, 60)
            with open(path, "w") as f:
                f.write(str(last))
            return [str(k) for k in range(first, last)][:most]

        def close(self):
            pass

    from tickbasin.sources import live_source

    return lambda: live_source.Client(Counting(), ["a"])


def test_restart_loses_and_repeats_nothing(spark, tmp_path):
    name = live_source.register(spark, counting(str(tmp_path)))
    stored, failing = str(tmp_path / "out"), {"at": 2}

    def each(batch, batch_id):
        if batch_id == failing["at"]:
            raise RuntimeError("executor lost")
        batch.write.mode("overwrite").parquet(f"{stored}/b={batch_id}")

    def start():
        stream = spark.readStream.format(name).option("journal", str(tmp_path / "journal")).option("most", 10).option("wait_s", 0).load()
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).start()

    query = start()
    with pytest.raises(Exception, match="executor lost"):
        query.processAllAvailable()
    failing["at"] = -1
    query = start()
    query.processAllAvailable()
    query.stop()
    rows = spark.read.parquet(stored).orderBy("arrival").collect()
    assert [r.arrival for r in rows] == list(range(len(rows)))
    assert [r.text for r in rows if r.kind == "raw"] == [str(k) for k in range(60)]
    assert sum(r.kind == "reconnect_success" for r in rows) == 2  # one a run
