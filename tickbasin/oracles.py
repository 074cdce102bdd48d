"""DuckDB SQL of the queries, written on its own: rank-based where the engine uses maxima."""

from __future__ import annotations

from .queries import DAY_US, END_US, LOOKBACK_US, NOW_US, START_US, TIMES

EV = """ev as (select event_id, event_type, user_id, value, epoch_us(ts) as ts_us, 'A' || (user_id % 10) as asset_id, cast(json_extract_string(props, '$.k') as integer) as k from events)"""
RAW = "(cast(floor(value * 1000000) as bigint) + case when value * 1000000 - floor(value * 1000000) >= 0.5 then 1 else 0 end)"
PROV = "'e' || event_id as source_event_id, 's' || (user_id % 3) as source_session_id"
BE = f"""be as (select recv_timestamp_us, case when event_id % 11 = 0 then 0 else recv_timestamp_us - (event_id % 7) * 1000000 end as exchange_timestamp_us, asset_id,
 case when (block + user_id % 10) % 3 = 0 then 1 else 2 end as event_kind, k % 2 + 1 as side, k * 100 as price, case when event_id % 5 = 0 then 0 else {RAW} end as size,
 case when event_id % 23 = 0 then null else row_number() over (partition by asset_id order by recv_timestamp_us, event_id) + case when event_id % 17 = 0 then 1 else 0 end end as sequence, {PROV}, event_id as arrival, user_id
 from (select *, ts_us // 21600000000 as block, ts_us // 21600000000 * 21600000000 as recv_timestamp_us from ev where event_type in ('signup', 'click', 'view')))"""
EX = "case when event_id % 11 = 0 then 0 else ts_us - (event_id % 7) * 1000000 end"
TE = f"""te as (select *, case when size is not null and side is not null then 'full' else 'partial' end as fidelity from (select ts_us as recv_timestamp_us, {EX} as exchange_timestamp_us, asset_id, k * 100 as price,
 case when event_id % 3 = 0 then null else {RAW} end as size, case when event_id % 4 = 0 then null else k % 2 + 1 end as side, 't' || event_id as trade_id, {PROV}, event_id as arrival from ev where event_type = 'purchase'))"""
IE = f"""ie as (select ts_us as recv_timestamp_us, {EX} as exchange_timestamp_us, case when event_id % 5 = 0 then null else asset_id end as asset_id,
 case k % 5 when 0 then 'reconnect_start' when 1 then 'reconnect_success' when 2 then 'sequence_gap' when 3 then 'stale_snapshot_skip' else 'source_reset' end as event_kind,
 case when k % 5 = 2 then event_id end as expected_sequence, case when k % 5 = 2 then event_id + k end as observed_sequence, 'k=' || k as details, {PROV}, event_id as arrival from ev where event_type = 'error')"""
CP = f"""cp as (select asset_id, (ts_us // {DAY_US} + 1) * {DAY_US} - 1 as checkpoint_timestamp_us, k % 2 + 1 as side, k * 100 as price, case when event_id % 6 = 0 then 0 else {RAW} end as size, event_id as pos from ev where event_type = 'purchase')"""
RV = """rv as (select asset_id, case when event_id % 2 = 0 then 'recv_time' else 'exchange_time' end as mode, ts_us - 60000000 as replay_timestamp_us, ts_us as reference_timestamp_us, event_id % 4 <> 0 as matched,
 case when event_id % 4 = 0 then 'k=' || k end as mismatch_summary, ts_us as persisted_at_us from ev where event_type = 'signup')"""
XE = """xe as (select o as event_timestamp_us, case when key % 7 = 0 then null else 'A' || (key % 10) end as asset_id, 'O' || key as order_id, 'C' || key || '-' || line as client_order_id, kind as event_kind, key % 2 + 1 as side, price, size, status, o + 200 + key % 50 as ack, fill
 from (select epoch_us(o_orderdate) as o, o_orderkey as key, 0 as line, 'submit_intent' as kind, null as price, null as size, o_orderstatus as status, null as fill from orders
 union all select epoch_us(l_shipdate), l_orderkey, l_linenumber, 'fill', cast(round(l_discount * 10000) as integer), cast(round(l_quantity * 1000000) as bigint), l_linestatus, epoch_us(l_shipdate) + 500 + l_orderkey % 100 from lineitem))"""
PTS = "pts as (select q.query_id, 'A' || a.i as asset_id, q.at_us from (values " + ", ".join(f"({q}, {t})" for q, t in TIMES) + ") q(query_id, at_us), range(10) a(i))"


def sql(*ctes: str, select: str) -> str:
    """A statement of named parts; the events come first."""
    return "with " + ",\n".join([EV, *ctes]) + "\n" + select


def recon(mode: str, checkpoints: str | None = None, points: str = "pts", lookback_us: int = LOOKBACK_US) -> list[str]:
    """Parts of a reconstruction by row numbers: n (rows), base, tail, lv (levels), hd (headers), gp (gaps)."""
    ots = "recv_timestamp_us" if mode == "recv_time" else "case when exchange_timestamp_us = 0 then recv_timestamp_us else exchange_timestamp_us end"
    k2 = "0" if mode == "recv_time" else "recv_timestamp_us"
    op = {None: None, "inclusive": "<=", "strict": "<"}[checkpoints]
    cps = f"ca as (select p.query_id, p.asset_id, max(c.checkpoint_timestamp_us) as cp_ts from {points} p join cp c on c.asset_id = p.asset_id and c.checkpoint_timestamp_us {op} p.at_us group by all)" if op else "ca as (select 0 as query_id, '' as asset_id, 0 as cp_ts where false)"
    return [
        cps,
        f"""n as (select *, row_number() over (partition by query_id, asset_id order by ots, k2, sq, source_event_id, side, price, size) as rn from
 (select p.query_id, p.at_us, ca.cp_ts, b.*, {ots} as ots, {k2} as k2, coalesce(sequence, 0) as sq from be b join {points} p on p.asset_id = b.asset_id and b.recv_timestamp_us between greatest(p.at_us - {lookback_us}, 0) and p.at_us
 left join ca on ca.query_id = p.query_id and ca.asset_id = p.asset_id) where ots <= at_us and (cp_ts is null or ots > cp_ts))""",
        "n2 as (select *, rn - row_number() over (partition by query_id, asset_id, event_kind, ots order by rn) as isl from n)",
        "sn as (select query_id, asset_id, max(rn) as last_s, arg_max(ots, rn) as snap_ts, arg_max(isl, rn) as last_isl from n2 where event_kind = 1 group by all)",
        """ap as (select n2.*, s.last_s, s.snap_ts, event_kind = 1 and n2.ots = s.snap_ts and (cp_ts is null or isl = last_isl) as is_base, event_kind = 2 and case when last_s is null then cp_ts is not null else rn > last_s end as is_tail
 from n2 left join sn s on s.query_id = n2.query_id and s.asset_id = n2.asset_id)""",
        """lv as (select query_id, asset_id, side, price, arg_max(size, rn) as size from (select query_id, asset_id, side, price, size, rn from ap where (is_base and size > 0) or is_tail
 union all select ca.query_id, ca.asset_id, c.side, c.price, c.size, -1000000000000 + c.pos from ca join cp c on c.asset_id = ca.asset_id and c.checkpoint_timestamp_us = ca.cp_ts
 where c.size > 0 and not exists (select 1 from sn where sn.query_id = ca.query_id and sn.asset_id = ca.asset_id)) group by all having arg_max(size, rn) > 0)""",
        "la as (select query_id, asset_id, arg_max(sq, (is_tail::int, rn)) as sq, arg_max(case when event_kind = 1 then ots else recv_timestamp_us end, (is_tail::int, rn)) as upd from ap where is_base or is_tail group by all)",
        f"""hd as (select p.query_id, p.asset_id, coalesce(la.sq, 0) as sequence, coalesce(la.upd, ca.cp_ts) as last_update_us, ca.cp_ts is not null as used_checkpoint from {points} p left join la on la.query_id = p.query_id and la.asset_id = p.asset_id
 left join ca on ca.query_id = p.query_id and ca.asset_id = p.asset_id where la.query_id is not null or ca.cp_ts is not null)""",
        """gp as (select *, prev + 1 as expected, sq as observed from (select *, coalesce(lag(sq) over (partition by query_id, asset_id order by case when cp_ts is not null or is_base then 0 else 1 end, rn), 0) as prev
 from ap where is_base or is_tail or cp_ts is not null) where event_kind = 2 and prev > 0 and sq <> prev + 1)""",
    ]


LEVELS = "select query_id, asset_id, side, price, size from lv"
GAPS = """select query_id, asset_id, source_event_id, expected as expected_sequence, observed as observed_sequence,
 'orderbook ' || asset_id || ': sequence gap ' || expected || ' -> ' || observed || ' (dropped ' || abs(observed - expected) || ' updates)' as details from gp"""
TOP = """tp as (select *, best_bid / 10000.0::double as b, best_ask / 10000.0::double as a, best_bid_size / 1000000.0::double as bs, best_ask_size / 1000000.0::double as az from (select query_id, asset_id, max(case when side = 1 then price end) as best_bid,
 arg_max(size, case when side = 1 then price end) as best_bid_size, min(case when side = 2 then price end) as best_ask, arg_min(size, case when side = 2 then price end) as best_ask_size from lv group by all))"""
TOP_COLS = "query_id, asset_id, (b + a) / 2 as mid, a - b as spread, case when bs + az = 0 then (b + a) / 2 else (b * az + a * bs) / (bs + az) end as weighted_mid"
WINDOW = f"between {START_US} and {END_US}"


BINS = [1_000, 5_000, 10_000, 50_000, 100_000, 500_000, 1_000_000, 5_000_000, 10_000_000]
LATENCY_BINS = ", ".join(f"('{b}', {a}, {b})" for a, b in zip([0, *BINS], BINS, strict=False)) + f", ('above', {BINS[-1]}, 9000000000000000000)"
LEVEL_TEXT = "coalesce(printf('%.4f', {p} / 10000.0) || ' @ ' || printf('%.6f', {z} / 1000000.0), 'none')"
SIDES = "count(*) filter (side = 1) as bd, count(*) filter (side = 2) as ad, max(price) filter (side = 1) as b, max((price, size)) filter (side = 1) as bt, min(price) filter (side = 2) as a, min((price, size)) filter (side = 2) as at"
TEXTS = f"""select r.query_id, r.asset_id, 'bid_depth=' || coalesce(l.bd, 0) || ' checkpoint_bid_depth=' || coalesce(w.bd, 0) || ' ask_depth=' || coalesce(l.ad, 0) || ' checkpoint_ask_depth=' || coalesce(w.ad, 0) || ' best_bid=' || {LEVEL_TEXT.format(p='l.b', z='struct_extract(l.bt, 2)')} || ' checkpoint_best_bid=' || {LEVEL_TEXT.format(p='w.b', z='struct_extract(w.bt, 2)')}
 || ' best_ask=' || {LEVEL_TEXT.format(p='l.a', z='struct_extract(l.at, 2)')} || ' checkpoint_best_ask=' || {LEVEL_TEXT.format(p='w.a', z='struct_extract(w.at, 2)')} as mismatch_summary
 from rf r left join bd on bd.query_id = r.query_id and bd.asset_id = r.asset_id left join hd on hd.query_id = r.query_id and hd.asset_id = r.asset_id left join (select query_id, asset_id, {SIDES} from lv group by all) l on l.query_id = r.query_id and l.asset_id = r.asset_id
 left join (select query_id, asset_id, {SIDES} from wa group by all) w on w.query_id = r.query_id and w.asset_id = r.asset_id where bd.query_id is not null or hd.query_id is null"""


def validation(mode: str, base: str, select: str | None = None) -> str:
    """Levels of the next checkpoint against the book rebuilt at its time, as multisets."""
    refs = f"rf as (select p.query_id, p.asset_id, p.at_us as t, min(c.checkpoint_timestamp_us) as at_us from pts p join cp c on c.asset_id = p.asset_id and c.checkpoint_timestamp_us > p.at_us and c.checkpoint_timestamp_us <= p.at_us + {LOOKBACK_US} group by all)"
    want = "wa as (select r.query_id, r.asset_id, c.side, c.price, c.size from rf r join cp c on c.asset_id = r.asset_id and c.checkpoint_timestamp_us = r.at_us)"
    bad = "bd as (select query_id, asset_id from ((select * from wa except all select * from lv) union all (select * from lv except all select * from wa)) group by all)"
    return sql(BE, CP, PTS, refs, *recon(mode, base, "rf"), want, bad, select=select or """select r.query_id, r.asset_id, r.t as replay_timestamp_us, r.at_us as reference_timestamp_us,
 bd.query_id is null and hd.query_id is not null as matched from rf r left join bd on bd.query_id = r.query_id and bd.asset_id = r.asset_id left join hd on hd.query_id = r.query_id and hd.asset_id = r.asset_id""")


# the test feed
US = "({r} - ({n} % 7) * 1000000 - case when {n} % 17 < 4 then 259200000000 else 0 end)"
STAMP = f"case when {{n}} % 13 = 0 then 0 when {{n}} % 31 = 0 then 0 when {{n}} % 2 = 0 then {US} else {US} // 1000 * 1000 end"
SESSION = "(select arg_max(source_session_id, i.arrival) from ie i where i.event_kind = 'reconnect_success' and i.arrival <= {a})"
FEED = [
    "gr as (select *, case when event_kind = 1 then min(arrival) over (partition by event_kind, asset_id, recv_timestamp_us) else arrival end as msg from be)",
    f"ms as (select asset_id, msg, any_value(event_kind) as event_kind, any_value(recv_timestamp_us) as recv, any_value({STAMP.format(n='msg', r='recv_timestamp_us')}) as ex from gr group by asset_id, msg)",
    "bk as (select *, max(case when ex > 0 then ex end) over (partition by asset_id order by msg rows between unbounded preceding and 1 preceding) as latest from ms where event_kind = 1)",
    "st as (select *, coalesce(ex > 0 and ex <= latest, false) as stale from bk)",
    "ps as (select *, row_number() over (partition by asset_id, msg order by side, arrival) - 1 as pos from gr)",
    "bp as (select *, min(case when arrival % 29 = 0 then pos end) over (partition by asset_id, msg) as bad from ps where event_kind = 1 or arrival % 19 <> 0)",
    "ok as (select p.*, m.ex from bp p join ms m on m.asset_id = p.asset_id and m.msg = p.msg left join st s on s.asset_id = p.asset_id and s.msg = p.msg where (bad is null or pos < bad) and not coalesce(s.stale, false))",
    "ep as (select o.*, (select count(*) from st s where s.asset_id = o.asset_id and not s.stale and s.msg <= o.msg) as epoch from ok o)",
    "nm as (select *, row_number() over (partition by asset_id, epoch order by msg, pos) - 1 as seq from ep)",
]
NORMAL = "select recv_timestamp_us, ex as exchange_timestamp_us, asset_id, event_kind, side, price, size, seq as sequence, 'h' || msg as source_event_id"
ROUTED_INGEST = f"""select asset_id, recv as recv_timestamp_us, ex as exchange_timestamp_us, 'stale_snapshot_skip' as event_kind, 'snapshot exchange timestamp ' || ex || ' <= latest accepted ' || latest as details, 'h' || msg as source_event_id, {SESSION.format(a='st.msg')} as source_session_id from st where stale
 union all select null, recv_timestamp_us, 0, event_kind, details, null, source_session_id from ie where event_kind in ('reconnect_start', 'reconnect_success')
 union all select null, recv_timestamp_us, 0, 'source_reset', 'connection re-established; downstream readers should treat continuity as reset', null, source_session_id from ie where event_kind = 'reconnect_success'"""
BUCKET = "(({r} // 1000000 + 10) // 604800 * 604800)"
ROTATED = [
    f"rb as (select *, {BUCKET.format(r='recv')} as bucket from ms where event_kind = 1)",
    "rs as (select *, coalesce(ex > 0 and ex <= max(case when ex > 0 then ex end) over (partition by asset_id, bucket order by msg rows between unbounded preceding and 1 preceding), false) as stale from rb)",
    f"ro as (select p.*, {BUCKET.format(r='p.recv_timestamp_us')} as bucket from bp p left join rs s on s.asset_id = p.asset_id and s.msg = p.msg and p.event_kind = 1 where (bad is null or pos < bad) and not coalesce(s.stale, false))",
    "rp as (select o.*, (select count(*) from rs s where s.asset_id = o.asset_id and s.bucket = o.bucket and not s.stale and s.msg <= o.msg) as epoch from ro o)",
]
TRADES = f"tr as (select *, {STAMP.format(n='arrival', r='recv_timestamp_us')} as ex from te where arrival % 37 <> 0)"
LIVE = [
    "lg as (select *, case when event_kind = 1 and (event_kind, recv_timestamp_us, exchange_timestamp_us, source_event_id) = lag((event_kind, recv_timestamp_us, exchange_timestamp_us, source_event_id)) over (partition by asset_id order by arrival) then 0 else 1 end as new from be)",
    "lh as (select *, sum(new) over (partition by asset_id order by arrival) as grp from lg)",
    "lb as (select asset_id, max(grp) as base from lh where event_kind = 1 group by 1)",
    "ll as (select h.asset_id, side, price, arg_max(size, arrival) as size from lh h left join lb on lb.asset_id = h.asset_id where (base is null or grp >= base) and (size > 0 or event_kind = 2) group by all having arg_max(size, arrival) > 0)",
]
# every event against all rows of its book before it
AFTER_EACH = """select asset_id, arrival, best_bid, best_bid_size, best_ask, best_ask_size, bid_depth, ask_depth, (b + a) / 2 as mid, a - b as spread, case when bs + az = 0 then (b + a) / 2 else (b * az + a * bs) / (bs + az) end as weighted_mid from (
 select *, best_bid / 10000.0::double as b, best_ask / 10000.0::double as a, best_bid_size / 1000000.0::double as bs, best_ask_size / 1000000.0::double as az from (
  select e.asset_id, e.arrival, max(price) filter (side = 1) as best_bid, arg_max(size, price) filter (side = 1) as best_bid_size, min(price) filter (side = 2) as best_ask, arg_min(size, price) filter (side = 2) as best_ask_size,
   count(*) filter (side = 1) as bid_depth, count(*) filter (side = 2) as ask_depth from (select asset_id, arrival from lh) e left join (
    select e.asset_id, e.at, h.side, h.price, arg_max(h.size, h.arrival) as size from (select asset_id, arrival as at, coalesce(max(case when event_kind = 1 then grp end) over (partition by asset_id order by arrival), 0) as base from lh) e
    join lh h on h.asset_id = e.asset_id and h.arrival <= e.at and h.grp >= e.base and (h.size > 0 or h.event_kind = 2) group by all having arg_max(h.size, h.arrival) > 0
   ) l on l.asset_id = e.asset_id and l.at = e.arrival group by all))"""
DISCOVERY = "dc as (select cast(c_custkey as varchar) as id, c_name as title, c_mktsegment as seg, c_custkey as key from customer)"
STATES = "select asset_id, arg_max(recv_timestamp_us, arrival) as last_recv_timestamp_us, arg_max(exchange_timestamp_us, arrival) as last_exchange_timestamp_us, arg_max(coalesce(sequence, 0), arrival) as sequence, bool_or(event_kind = 1) as has_book from be group by 1"


def oracle_sql() -> dict[str, str]:
    """Statement of every query."""
    both = [BE, CP, PTS]
    return {
        "scan_book_window": sql(BE, select=f"select source_event_id, recv_timestamp_us, exchange_timestamp_us, case event_kind when 1 then 'Snapshot' else 'Delta' end as kind, case side when 1 then 'Bid' else 'Ask' end as side_name, price, size, sequence from be where asset_id = 'A3' and recv_timestamp_us {WINDOW}"),
        "scan_trades": sql(TE, select=f"select trade_id, price, size, side, fidelity from te where asset_id = 'A3' and recv_timestamp_us {WINDOW}"),
        "scan_ingest_asset_or_global": sql(IE, select=f"select source_event_id, asset_id, event_kind, expected_sequence, observed_sequence, details from ie where (asset_id = 'A3' or asset_id is null) and recv_timestamp_us {WINDOW}"),
        "scan_checkpoints": sql(CP, select=f"select checkpoint_timestamp_us, side, price, size from cp where asset_id = 'A3' and checkpoint_timestamp_us {WINDOW}"),
        "scan_validations": sql(RV, select=f"select * from rv where asset_id = 'A3' and persisted_at_us {WINDOW}"),
        "scan_executions": sql(XE, select="select event_timestamp_us, asset_id, order_id, event_kind, side, price, size, status, ack as exchange_ack_us, fill as exchange_fill_us from xe where order_id = 'O7'"),
        "replay_window": sql(BE, TE, IE, select=f"select 'book_events' as dataset, count(*) as n from be where asset_id = 'A3' and recv_timestamp_us {WINDOW} union all select 'trade_events', count(*) from te where asset_id = 'A3' and recv_timestamp_us {WINDOW} union all select 'ingest_events', count(*) from ie where (asset_id = 'A3' or asset_id is null) and recv_timestamp_us {WINDOW}"),
        "storage_roundtrip": sql(BE, select=f"select source_event_id, recv_timestamp_us, price, size, sequence from be where asset_id = 'A3' and recv_timestamp_us {WINDOW}"),
        "latest_checkpoint_asof": sql(CP, PTS, select="select p.query_id, p.asset_id, m.ts as cp_ts, count(*) filter (side = 1) as n_bids, count(*) filter (side = 2) as n_asks from (select p.query_id, p.asset_id, max(checkpoint_timestamp_us) as ts from pts p join cp c on c.asset_id = p.asset_id and checkpoint_timestamp_us <= at_us group by all) m join pts p using (query_id, asset_id) join cp c on c.asset_id = p.asset_id and c.checkpoint_timestamp_us = m.ts group by all"),
        "next_checkpoint_asof": sql(CP, PTS, select=f"select p.query_id, p.asset_id, p.at_us, m.ts as ref_ts, count(*) filter (side = 1) as n_bids, count(*) filter (side = 2) as n_asks from (select p.query_id, p.asset_id, min(checkpoint_timestamp_us) as ts from pts p join cp c on c.asset_id = p.asset_id and checkpoint_timestamp_us > at_us and checkpoint_timestamp_us <= at_us + {LOOKBACK_US} group by all) m join pts p using (query_id, asset_id) join cp c on c.asset_id = p.asset_id and c.checkpoint_timestamp_us = m.ts group by all"),
        "recon_recv_levels": sql(BE, PTS, CP, *recon("recv_time"), select=LEVELS),
        "recon_exchange_levels": sql(BE, PTS, CP, *recon("exchange_time"), select=LEVELS),
        "recon_checkpoint_levels": sql(*both, *recon("recv_time", "inclusive"), select=LEVELS),
        "recon_checkpoint_exchange_levels": sql(*both, *recon("exchange_time", "inclusive"), select=LEVELS),
        "recon_whole_levels": sql(BE, PTS, CP, *recon("recv_time", lookback_us=END_US), select=LEVELS),
        "recon_whole_checkpoint_levels": sql(*both, *recon("exchange_time", "inclusive", lookback_us=END_US), select=LEVELS),
        "recon_whole_gaps": sql(*both, *recon("recv_time", lookback_us=END_US), select=GAPS),
        "recon_header": sql(*both, *recon("recv_time"), select="select * from hd"),
        "recon_checkpoint_header": sql(*both, *recon("exchange_time", "inclusive"), select="select * from hd"),
        "recon_gaps": sql(*both, *recon("recv_time"), select=GAPS),
        "recon_checkpoint_gaps": sql(*both, *recon("recv_time", "inclusive"), select=GAPS),
        "replay_continuity": sql(*both, IE, *recon("recv_time"), select=f"""select query_id, asset_id, row_number() over (partition by query_id, asset_id order by late, recv_timestamp_us, source_event_id, coalesce(observed_sequence, 0)) as position, event_asset, event_kind, recv_timestamp_us, observed_sequence, source_event_id from
 (select p.query_id, p.asset_id, i.asset_id as event_asset, i.event_kind, i.recv_timestamp_us, i.observed_sequence, i.source_event_id, 0 as late from pts p join ie i on (i.asset_id = p.asset_id or i.asset_id is null) and i.recv_timestamp_us between greatest(p.at_us - {LOOKBACK_US}, 0) and p.at_us
 union all select query_id, asset_id, asset_id, 'sequence_gap', recv_timestamp_us, observed, source_event_id, 1 from gp)"""),
        "snapshot_islands": sql(BE, select="""select asset_id, ots, row_number() over (partition by asset_id, ots order by isl) as run, n, first_sequence, last_sequence from (select asset_id, ots, isl, count(*) as n, arg_min(sq, rn) as first_sequence, arg_max(sq, rn) as last_sequence from
 (select *, rn - row_number() over (partition by asset_id, event_kind, ots order by rn) as isl from (select *, row_number() over (partition by asset_id order by ots, recv_timestamp_us, sq, source_event_id, side, price, size) as rn from
 (select *, case when exchange_timestamp_us = 0 then recv_timestamp_us else exchange_timestamp_us end as ots, coalesce(sequence, 0) as sq from be))) where event_kind = 1 group by all)"""),
        "book_series": sql(*both, *recon("recv_time", "inclusive"), TOP, select="select query_id, asset_id, at_us, sequence, last_update_us, used_checkpoint, best_bid, best_ask, (b + a) / 2 as mid, a - b as spread from hd join pts using (query_id, asset_id) left join tp using (query_id, asset_id)"),
        "execution_append": "select epoch_us(l_shipdate) as event_timestamp_us, 'O' || l_orderkey as order_id, 'C' || l_linenumber as client_order_id, 'fill' as event_kind, case when l_orderkey % 4 < 2 then 1 else 2 end as side, cast(round(l_discount * 10000) as integer) as price, cast(round(l_quantity * 1000000) as bigint) as size, epoch_us(l_shipdate) + 500 as exchange_fill_us from lineitem",
        "top_of_book": sql(*both, *recon("recv_time"), TOP, select=f"select {TOP_COLS}, best_bid, best_bid_size, best_ask, best_ask_size from tp"),
        "mid_spread_wmid": sql(*both, *recon("exchange_time"), TOP, select=f"select {TOP_COLS} from tp"),
        "depth_totals": sql(*both, *recon("recv_time"), select="select query_id, asset_id, count(*) filter (side = 1) as bid_depth, count(*) filter (side = 2) as ask_depth, cast(coalesce(sum(size) filter (side = 1), 0) as bigint) as bid_total, cast(coalesce(sum(size) filter (side = 2), 0) as bigint) as ask_total from lv group by all"),
        "top_n_levels": sql(*both, *recon("recv_time"), select="select * from (select query_id, asset_id, side, row_number() over (partition by query_id, asset_id, side order by case when side = 1 then -price else price end) as rank, price, size from lv) where rank <= 5"),
        "crossed_books": sql(*both, *recon("recv_time"), select="select query_id, asset_id, max(price) filter (side = 1) as best_bid, min(price) filter (side = 2) as best_ask, coalesce(max(price) filter (side = 1) >= min(price) filter (side = 2), false) as crossed from lv group by all"),
        "validate_parity": validation("recv_time", "inclusive"),
        "validate_strict": validation("exchange_time", "strict"),
        "derived_checkpoint_levels": sql(*both, *recon("recv_time"), select="select asset_id, at_us as checkpoint_timestamp_us, side, price, size from lv join pts using (query_id, asset_id)"),
        "integrity_summary": sql(BE, IE, RV, select=f"""select *, case when reconnect_count > 0 or gap_count > 0 then 'best_effort' else 'complete' end as completeness from (select a.asset_id, {START_US}::bigint as start_us, {END_US}::bigint as end_us,
 (select count(*) from be where be.asset_id = a.asset_id and recv_timestamp_us {WINDOW}) as total_book_events, {", ".join(f"(select count(*) from ie where (ie.asset_id = a.asset_id or ie.asset_id is null) and recv_timestamp_us {WINDOW} {c}) as {n}" for n, c in (("total_ingest_events", ""), ("reconnect_count", "and event_kind in ('reconnect_start', 'reconnect_success')"), ("gap_count", "and event_kind in ('sequence_gap', 'source_reset')"), ("stale_snapshot_skip_count", "and event_kind = 'stale_snapshot_skip'")))},
 {", ".join(f"(select count(*) from rv where rv.asset_id = a.asset_id and persisted_at_us {WINDOW} {c}) as {n}" for n, c in (("validation_count", ""), ("validations_matched", "and matched"), ("validations_mismatched", "and not matched")))} from (select 'A' || i as asset_id from range(10) t(i)) a)"""),
        "continuity_events": sql(IE, select=f"select event_kind as kind, recv_timestamp_us, exchange_timestamp_us, details, source_event_id from ie where (asset_id = 'A3' or asset_id is null) and recv_timestamp_us {WINDOW}"),
        "collected_continuity": sql(IE, select="select asset_id, count(*) as n, string_agg(event_kind, ',' order by recv_timestamp_us, event_kind, details) as kinds from ie where asset_id is not null group by 1"),
        "execution_timeline": sql(XE, select="select event_timestamp_us, order_id, client_order_id, event_kind, case side when 1 then 'bid' else 'ask' end as side, price, size, (select count(*) from xe where asset_id = 'A3') as total_count from xe where asset_id = 'A3' order by event_timestamp_us, order_id, client_order_id, event_kind limit 200"),
        "execution_latency": sql(XE, select="select order_id, client_order_id, event_kind, 3 as normalize_us, 1 as decide_us, 1 as submit_us, ack - event_timestamp_us as ack_us, fill - event_timestamp_us as fill_us, fill - event_timestamp_us + 5 as total_us from xe"),
        "execution_with_book": sql(TE, CP, select=f"""select trade_id, t.asset_id, c.at_us as top_at_us, best_bid, best_ask from te t asof left join (select asset_id, checkpoint_timestamp_us as at_us, max(price) filter (side = 1) as best_bid, min(price) filter (side = 2) as best_ask from cp group by all) c on t.asset_id = c.asset_id and t.recv_timestamp_us >= c.at_us""").replace("c.at_us as top_at_us, best_bid, best_ask from", f"case when c.at_us >= t.recv_timestamp_us - {DAY_US} then c.at_us end as top_at_us, case when c.at_us >= t.recv_timestamp_us - {DAY_US} then best_bid end as best_bid, case when c.at_us >= t.recv_timestamp_us - {DAY_US} then best_ask end as best_ask from"),
        "latency_percentiles": sql(BE, select="select asset_id, count(*) as sample_count, quantile_cont((recv_timestamp_us - exchange_timestamp_us)::double, 0.5) as p50_us, quantile_cont((recv_timestamp_us - exchange_timestamp_us)::double, 0.99) as p99_us from be where exchange_timestamp_us > 0 and recv_timestamp_us > exchange_timestamp_us group by 1"),
        "latency_histogram": sql(BE, select="select b.le::bigint as le_us, count(*) filter (recv_timestamp_us - exchange_timestamp_us <= b.le) as n from be, (values (1000000), (2000000), (4000000), (8000000)) b(le) where exchange_timestamp_us > 0 and recv_timestamp_us > exchange_timestamp_us group by 1"),
        "dataset_stats": sql(BE, TE, IE, select=" union all ".join(f"select '{d}' as dataset, count(*) as n_rows, min(recv_timestamp_us) as first_us, max(recv_timestamp_us) as last_us, count(distinct asset_id) as n_assets, {s}, {t} from {v}" for d, v, s, t in (("book_events", "be", "count(*) filter (event_kind = 1) as n_snapshots", "count(*) filter (event_kind = 2) as n_deltas"), ("trade_events", "te", "null", "null"), ("ingest_events", "ie", "null", "null")))),
        "partition_counts": sql(IE, select="select coalesce(asset_id, 'global') as asset_id, cast(cast(make_timestamp(recv_timestamp_us) as date) as varchar) as event_date, hour(make_timestamp(recv_timestamp_us)) as event_hour, count(*) as n_rows from ie group by all"),
        "normalize_sequences": sql(BE, IE, *FEED, select=f"{NORMAL}, {SESSION.format(a='nm.msg')} as source_session_id from nm"),
        "normalize_stream": sql(BE, IE, *FEED, select=f"{NORMAL} from nm"),
        "normalize_stale": sql(BE, *FEED, select="select asset_id, recv as recv_timestamp_us, ex as exchange_timestamp_us, 'snapshot exchange timestamp ' || ex || ' <= latest accepted ' || latest as details, 'h' || msg as source_event_id from st where stale"),
        "normalize_trades": sql(TE, IE, TRADES, select=f"select asset_id, recv_timestamp_us, ex as exchange_timestamp_us, price, size, side, trade_id, fidelity, {SESSION.format(a='tr.arrival')} as source_session_id from tr"),
        "lifecycle_expand": sql(IE, select="select recv_timestamp_us, event_kind, details, source_session_id from ie where event_kind in ('reconnect_start', 'reconnect_success') union all select recv_timestamp_us, 'source_reset', 'connection re-established; downstream readers should treat continuity as reset', source_session_id from ie where event_kind = 'reconnect_success'"),
        "ws_metrics_counts": sql(BE, TE, IE, *FEED, select="""select * from (select 'messages_received' as metric, 'book' as label, count(*) as n from st union all select 'messages_received', 'price_change', count(*) from ms where event_kind = 2 union all select 'messages_received', 'last_trade_price', count(*) from te
 union all select 'snapshots_reconciled', '', count(*) from st where not stale union all select 'stale_snapshots_skipped', '', count(*) from st where stale union all select 'snapshots_applied', '', count(*) from nm where event_kind = 1 union all select 'deltas_applied', '', count(*) from nm where event_kind = 2
 union all select 'trades_received', '', count(*) from te where arrival % 37 <> 0 union all select 'reconnections', '', count(*) from ie where event_kind = 'reconnect_success') where n > 0"""),
        "routed_book_events": sql(BE, IE, *FEED, select=f"{NORMAL}, {SESSION.format(a='nm.msg')} as source_session_id from nm"),
        "routed_trades": sql(TE, IE, TRADES, select=f"select asset_id, recv_timestamp_us, ex as exchange_timestamp_us, price, size, side, trade_id, fidelity, {SESSION.format(a='tr.arrival')} as source_session_id from tr"),
        "routed_ingest": sql(BE, IE, *FEED, select=f"select * from ({ROUTED_INGEST})"),
        "routed_datasets": sql(BE, TE, IE, CP, RV, XE, *FEED, TRADES, select=" union all ".join(f"select '{d}' as dataset, count(*) as n, min({c}) as first_us, max({c}) as last_us from {t}" for d, c, t in (
            ("book_events", "recv_timestamp_us", "nm"), ("trade_events", "recv_timestamp_us", "tr"), ("ingest_events", "recv_timestamp_us", f"({ROUTED_INGEST})"),
            ("book_checkpoints", "checkpoint_timestamp_us", "(select distinct asset_id, checkpoint_timestamp_us from cp)"), ("replay_validations", "persisted_at_us", "rv"), ("execution_events", "event_timestamp_us", "xe")))),
        "stream_checkpoints": sql(BE, *LIVE[:2], select=f"""select l.asset_id, l.at_us as checkpoint_timestamp_us, l.side, l.price, arg_max(l.size, l.arrival) as size from (
 select h.*, c.at_us, max(case when event_kind = 1 then grp end) over (partition by h.asset_id, c.at_us) as base from (select a.asset_id, unnest(range((first // {DAY_US} + 1) * {DAY_US}, last, {DAY_US})) as at_us
 from (select asset_id, min(recv_timestamp_us) as first from be group by 1) a, (select max(recv_timestamp_us) as last from be)) c join lh h on h.asset_id = c.asset_id and h.recv_timestamp_us <= c.at_us) l
 where grp >= coalesce(base, 0) and (size > 0 or event_kind = 2) group by all having arg_max(l.size, l.arrival) > 0"""),
        "rotated_sequences": sql(BE, *FEED, *ROTATED, select="select bucket, 'btc-updown-5m-' || (bucket - bucket % 300) as slug, asset_id, recv_timestamp_us, event_kind, side, price, size, row_number() over (partition by asset_id, bucket, epoch order by msg, pos) - 1 as sequence, 'h' || msg as source_event_id from rp"),
        "repeated_append": sql(RV, select="select asset_id, mode, count(*) as n, cast(sum(persisted_at_us) as bigint) as stamps from rv group by all"),
        "active_assets_status": sql(BE, select=f"select 'A' || i as asset_id, last_recv_timestamp_us, last_exchange_timestamp_us, (last_recv_timestamp_us is null or {NOW_US} - last_recv_timestamp_us > 43200000000) as stale, coalesce(has_book, false) as has_book from range(12) t(i) left join ({STATES}) s on s.asset_id = 'A' || i"),
        "retained_state": sql(BE, select=f"select asset_id, last_recv_timestamp_us, sequence, has_book from ({STATES}) where asset_id in ('A3', 'A4', 'A5')"),
        "session_status": sql(IE, select="select case arg_max(event_kind, arrival) filter (event_kind in ('reconnect_start', 'reconnect_success')) when 'reconnect_start' then 'reconnecting' when 'reconnect_success' then 'connected' else 'starting' end as session_status, arg_max(source_session_id, arrival) filter (event_kind = 'reconnect_success') as current_session_id from ie"),
        "latest_warnings": sql(IE, select="select asset_id, arg_max(event_kind, arrival) as kind, arg_max(recv_timestamp_us, arrival) as recv_timestamp_us, arg_max(details, arrival) as details from ie group by 1"),
        "live_snapshot_groups": sql(BE, *LIVE[:2], select='select asset_id, grp as "group", count(*) as n, min(arrival) as first_arrival, max(arrival) as last_arrival from lh where event_kind = 1 group by all'),
        "live_books": sql(BE, *LIVE, select="select asset_id, side, price, size from ll"),
        "book_after_each_event": sql(BE, *LIVE[:2], select=AFTER_EACH),
        "live_book_stream": sql(BE, *LIVE, select="select asset_id, side, price, size from ll"),
        "top_levels_stream": sql(BE, *LIVE, select="select asset_id, side, price, size from (select *, row_number() over (partition by asset_id, side order by case when side = 1 then -price else price end) as rank from ll) where rank <= 5"),
        "live_source_messages": sql(BE, TE, *FEED, select="""select kind, n, n as n_offsets from (select 'book' as kind, count(*) as n from st union all select 'price_change', count(*) from ms where event_kind = 2 union all select 'last_trade_price', count(*) from te
 union all select 'unknown', count(*) from te where arrival % 41 = 0 union all select 'none', count(*) from te where arrival % 43 = 0 union all select 'reconnect_success', 1) where n > 0"""),
        "live_snapshot": sql(BE, *LIVE, select=f"select s.asset_id, s.sequence, s.last_recv_timestamp_us as last_update_us, max(price) filter (side = 1) as best_bid, min(price) filter (side = 2) as best_ask, count(*) filter (side = 1) as bid_depth, count(*) filter (side = 2) as ask_depth, {NOW_US} - s.last_recv_timestamp_us > 3600000000 as stale from ({STATES}) s join ll on ll.asset_id = s.asset_id where s.asset_id = 'A3' group by all"),
        "live_snapshot_levels": sql(BE, *LIVE, select="select * from (select asset_id, case side when 1 then 'bid' else 'ask' end as side_name, row_number() over (partition by side order by case when side = 1 then -price else price end) - 1 as pos, price, size from ll where asset_id = 'A3') where pos < 5"),
        "feed_status": sql(IE, select="select 'fixed_tokens' as mode, case arg_max(event_kind, arrival) filter (event_kind in ('reconnect_start', 'reconnect_success')) when 'reconnect_start' then 'reconnecting' when 'reconnect_success' then 'connected' else 'starting' end as session_status, arg_max(source_session_id, arrival) filter (event_kind = 'reconnect_success') as current_session_id, 10::bigint as active_asset_count, arg_max(event_kind, arrival) filter (asset_id is null) as warning, arg_max(recv_timestamp_us, arrival) filter (asset_id is null) as warned_us from ie"),
        "validate_texts": validation("exchange_time", "strict", TEXTS),
        "clustered_scans": sql(BE, TE, IE, CP, RV, XE, select=f"""select 'book_events' as scan, count(*) as n, cast(sum(recv_timestamp_us) as bigint) as clocks from be where asset_id = 'A3' and recv_timestamp_us {WINDOW} union all select 'trade_events', count(*), cast(sum(recv_timestamp_us) as bigint) from te where asset_id = 'A3' and recv_timestamp_us {WINDOW}
 union all select 'ingest_events', count(*), cast(sum(recv_timestamp_us) as bigint) from ie where (asset_id = 'A3' or asset_id is null) and recv_timestamp_us {WINDOW} union all select 'book_checkpoints', count(*), cast(sum(t) as bigint) from (select distinct checkpoint_timestamp_us as t from cp where asset_id = 'A3' and checkpoint_timestamp_us {WINDOW})
 union all select 'replay_validations', count(*), cast(sum(persisted_at_us) as bigint) from rv where asset_id = 'A3' and persisted_at_us {WINDOW} union all select 'execution_events', count(*), cast(sum(event_timestamp_us) as bigint) from xe where order_id = 'O7'
 union all select 'latest_checkpoint', count(*), max(t) from (select max(checkpoint_timestamp_us) as t from cp where asset_id = 'A3' and checkpoint_timestamp_us <= {START_US}) where t is not null"""),
        "stream_metrics": sql(BE, TE, IE, *FEED, TRADES, select=f"""select metric, n from (select 'messages_received' as metric, (select count(*) from nm) + (select count(*) from tr) + (select count(*) from ({ROUTED_INGEST})) as n union all select 'snapshots_applied', count(*) from nm where event_kind = 1 union all select 'deltas_applied', count(*) from nm where event_kind = 2
 union all select 'trades_received', count(*) from tr union all select 'gaps_detected', 0 union all select 'reconnections', count(*) from ie where event_kind = 'reconnect_success' union all select 'snapshots_reconciled', count(*) from nm where event_kind = 1 and seq = 0 union all select 'stale_snapshots_skipped', count(*) from st where stale
 union all select 'ws_latency_us_' || name, count(late) from (values {LATENCY_BINS}) b(name, low, high) left join (select recv_timestamp_us - ex as late from (select recv_timestamp_us, ex from nm union all select recv_timestamp_us, ex from tr) where ex > 0 and recv_timestamp_us > ex) on late > low and late <= high group by name)"""),
        "market_buckets_5m": sql(select="select ts_us // 1000000 - ts_us // 1000000 % 300 as bucket, 'btc-updown-5m-' || (ts_us // 1000000 - ts_us // 1000000 % 300) as slug, count(*) as n from ev group by all"),
        "token_ids_explode": sql(DISCOVERY, select="select id, 'm' || id as market_id, pos, tok || id as token_id from dc, (values (0, 't'), (1, 'u')) t(pos, tok) where key % 3 = 0 or key % 7 <> 0"),
        "market_keyword": sql(DISCOVERY, select="select id, title from dc where contains(lower(title), 'building') or contains(lower(seg), 'building')"),
        "market_page": sql(DISCOVERY, select="select id, title from dc order by id limit 10 offset 20"),
        "ms_us_timestamp_fix": sql(select=f"select event_id, case event_id % 5 when 0 then ts_us // 1000 * 1000 when 4 then ts_us else 0 end as feed_us, case event_id % 5 when 0 then ts_us // 1000 * 1000 when 4 then ts_us when 3 then 0 else {NOW_US} end as rest_us from ev"),
        "side_parse": sql(select="select word, case when word in ('BUY', 'buy', 'Bid', 'bid') then 1 when word in ('SELL', 'sell', 'Ask', 'ask') then 2 end as side, count(*) as n from (select ['BUY', 'buy', 'Bid', 'bid', 'Buy', 'SELL', 'sell', 'Ask', 'ask', 'SELl'][k % 10 + 1] as word from ev) group by all"),
        "fixed_point_roundtrip": "select l_orderkey, l_linenumber, cast(round(l_discount * 10000) as integer) as price, cast(round(l_extendedprice * 1000000) as bigint) as size, printf('%.4f', round(l_discount * 10000) / 10000) as price_text, printf('%.6f', round(l_extendedprice * 1000000) / 1000000) as size_text from lineitem",
        "display_texts": sql(IE, select="select case event_kind when 'reconnect_start' then 'Reconnect Start' when 'reconnect_success' then 'Reconnect Success' when 'sequence_gap' then 'Sequence Gap' when 'stale_snapshot_skip' then 'Stale Snapshot Skip' else 'Source Reset' end as title, count(*) as n from ie group by 1"),
        "peek_rows": sql(BE, select="select source_event_id, asset_id, price, size from be order by arrival limit 20"),
    }
