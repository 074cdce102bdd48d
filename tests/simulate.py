"""Sequential book, replay and dispatcher of plain Python: the differential oracle of the tests."""

SNAPSHOT, DELTA, BID = 1, 2, 1


def order(event, mode):
    recv, ex, sq = event["recv"], event["ex"], event["seq"] or 0
    first = (recv, 0) if mode == "recv_time" else (ex or recv, recv)
    return (*first, sq, event["id"], event["side"], event["price"], event["size"])


def replay(events, at, mode, lookback, checkpoint=None):
    """(levels, sequence, last update, gaps) or None; checkpoint: (ts, [(side, price, size)])."""
    rows = sorted((e for e in events if max(0, at - lookback) <= e["recv"] <= at), key=lambda e: order(e, mode))
    ots = lambda e: order(e, mode)[0]
    book, sequence, updated, gaps = {}, 0, 0, []

    def snapshot(run):
        nonlocal sequence, updated
        book.clear()
        for e in run:
            if e["size"] > 0:
                book[e["side"], e["price"]] = e["size"]
        sequence, updated = run[-1]["seq"] or 0, ots(run[-1])

    if checkpoint:
        book.update({(s, p): z for s, p, z in checkpoint[1] if z > 0})
        updated = checkpoint[0]
        at_row = next((k for k, e in enumerate(rows) if ots(e) > checkpoint[0]), len(rows))
    else:
        last = max((k for k, e in enumerate(rows) if e["kind"] == SNAPSHOT and ots(e) <= at), default=None)
        if last is None:
            return None
        snapshot([e for e in rows if e["kind"] == SNAPSHOT and ots(e) == ots(rows[last])])
        at_row = last + 1
    while at_row < len(rows) and ots(rows[at_row]) <= at:
        e = rows[at_row]
        if e["kind"] == SNAPSHOT:
            end = at_row
            while end < len(rows) and rows[end]["kind"] == SNAPSHOT and ots(rows[end]) == ots(e):
                end += 1
            snapshot(rows[at_row:end])
            at_row = end
            continue
        seq = e["seq"] or 0
        if sequence > 0 and seq != sequence + 1:
            gaps.append((e["id"], sequence + 1, seq))
        if e["size"] > 0:
            book[e["side"], e["price"]] = e["size"]
        else:
            book.pop((e["side"], e["price"]), None)
        sequence, updated = seq, e["recv"]
        at_row += 1
    return book, sequence, updated, gaps
