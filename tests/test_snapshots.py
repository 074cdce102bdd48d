"""Snapshot groups of the live stream and snapshot runs of a replay against loops."""

import random

from tickbasin.operators import live, replay

KINDS = "asset_id string, arrival long, event_kind int, recv_timestamp_us long, exchange_timestamp_us long, source_event_id string, sequence long, side int, price int, size long"


def made(seed, n):
    draw = random.Random(seed)
    # one asset has most rows
    return [(draw.choice(["hot"] * 6 + ["a", "b"]), k, draw.choice([1, 1, 1, 2]), draw.randrange(2), draw.choice([None, 5]), draw.choice([None, "", "x"]), draw.choice([0, k, None]), 1, draw.randrange(9), draw.randrange(5)) for k in range(n)]


def looped(rows):
    last, group, out = {}, {}, {}
    for r in sorted(rows, key=lambda r: r[1]):
        key = (r[2], r[3], r[4], r[5] or "")
        if not (r[2] == 1 and last.get(r[0]) == key):
            group[r[0]] = group.get(r[0], 0) + 1
        last[r[0]] = key
        out[r[1]] = group[r[0]]
    return out


def test_groups_over_stretches(spark):
    """Groups that go on over several stretches, gaps without any row, and one asset with most rows."""
    rows = made(3, 400) + [("hot", 1000 + k, 1, 7, 7, "same", 0, 1, k, 1) for k in range(60)] + [("hot", 5000, 1, 7, 7, "same", 0, 1, 1, 1), ("a", 5001, 2, 7, 7, "same", 0, 1, 1, 1)]
    df = spark.createDataFrame(rows, KINDS).repartition(5)
    want = looped(rows)
    for stretch in (1, 7, 16, 1 << 16):
        out = live.snapshot_groups(df, stretch)
        assert out.columns == [*df.columns, "group"]
        assert {r.arrival: r.group for r in out.collect()} == want, stretch
    assert live.snapshot_groups(df.limit(0)).count() == 0


def test_no_window_over_an_asset(spark):
    """The rows' own windows are by asset and stretch, or by asset and time."""
    df = spark.createDataFrame(made(1, 50), KINDS)

    def shuffles(out):
        text = out._jdf.queryExecution().optimizedPlan().toString()
        return [line.split("windowspecdefinition(")[1].split(", ")[:2] for line in text.splitlines() if "windowspecdefinition(" in line and "local#" in line]

    assert all(second.startswith("stretch") for _, second in shuffles(live.snapshot_groups(df)))
    runs = replay.snapshot_runs(df, "recv_time")._jdf.queryExecution().executedPlan().toString()
    assert runs.count("Exchange hashpartitioning") == 1


def test_runs(spark):
    """A run ends at a row of another kind of the same time; other times do not part it."""
    rows = made(5, 300)
    found = {(r.asset_id, r.ots, r.run): (r.n, r.first_sequence, r.last_sequence, r.n_unnumbered) for r in replay.snapshot_runs(spark.createDataFrame(rows, KINDS).repartition(3)).collect()}
    order = sorted(rows, key=lambda r: (r[0], r[3], r[6] or 0, r[5] or "", r[7], r[8], r[9], r[2]))
    want, last, run = {}, None, {}
    for r in order:
        at = (r[0], r[3])
        if r[2] == 1:
            if last != (*at, 1):
                run[at] = run.get(at, 0) + 1
            want.setdefault((*at, run[at]), []).append(r[6] or 0)
        last = (*at, r[2])
    assert found == {k: (len(v), min(v), max(v), v.count(0)) for k, v in want.items()}
