"""The six datasets: fixed schemas, codes and partition keys."""

from __future__ import annotations

from pyspark.sql import types as T

BIGINT, INT, TINYINT, STRING, BOOLEAN = T.LongType(), T.IntegerType(), T.ByteType(), T.StringType(), T.BooleanType()


def struct(text: str) -> T.StructType:
    """Schema of "name kind, ..."; a kind that ends in ! is not null."""
    kinds = {"long": BIGINT, "int": INT, "tinyint": TINYINT, "string": STRING, "boolean": BOOLEAN}
    fields = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, kinds[kind.rstrip("!")], not kind.endswith("!")) for name, kind in fields])


PROVENANCE = "source string!, source_event_id string, source_session_id string"
CLOCKS = "recv_timestamp_us long!, exchange_timestamp_us long!"

DATASETS: dict[str, T.StructType] = {
    "book_events": struct(f"{CLOCKS}, asset_id string!, event_kind tinyint!, side tinyint!, price int!, size long!, sequence long, {PROVENANCE}"),
    "trade_events": struct(f"{CLOCKS}, asset_id string!, price int!, size long, side tinyint, trade_id string, fidelity string!, sequence long, {PROVENANCE}"),
    "ingest_events": struct(f"{CLOCKS}, asset_id string, event_kind string!, sequence long, expected_sequence long, observed_sequence long, details string, {PROVENANCE}"),
    "book_checkpoints": struct(f"checkpoint_timestamp_us long!, {CLOCKS}, asset_id string!, {PROVENANCE}, bids_json string!, asks_json string!"),
    "replay_validations": struct("asset_id string!, mode string!, replay_timestamp_us long!, reference_timestamp_us long!, matched boolean!, mismatch_summary string, persisted_at_us long!"),
    "execution_events": struct("event_timestamp_us long!, asset_id string, order_id string!, client_order_id string, venue_order_id string, event_kind string!, side tinyint, price int, size long, status string, reason string, latency_json string!"),
}

#: The clock that partitions, and that window scans filter.
PARTITION_TIME = {
    "book_events": "recv_timestamp_us",
    "trade_events": "recv_timestamp_us",
    "ingest_events": "recv_timestamp_us",
    "book_checkpoints": "checkpoint_timestamp_us",
    "replay_validations": "persisted_at_us",
    "execution_events": "event_timestamp_us",
}

# Codes in storage.
SNAPSHOT, DELTA = 1, 2
BID, ASK = 1, 2
BOOK_KINDS = {1: "Snapshot", 2: "Delta"}
SIDES = {1: "Bid", 2: "Ask"}
SOURCES = ["websocket", "rest_snapshot", "replay_validator", "strategy", "exchange", "system"]
FIDELITIES = ["partial", "full"]
INGEST_KINDS = ["reconnect_start", "reconnect_success", "sequence_gap", "stale_snapshot_skip", "source_reset"]
MODES = ["recv_time", "exchange_time"]
EXECUTION_KINDS = ["submit_intent", "exchange_ack", "cancel_request", "cancel_ack", "reject", "partial_fill", "fill", "terminal"]
#: String columns whose values are checked on strict reads.
ENUMS = {
    "trade_events": {"fidelity": FIDELITIES, "source": SOURCES},
    "book_events": {"event_kind": [1, 2], "side": [1, 2], "source": SOURCES},
    "ingest_events": {"event_kind": INGEST_KINDS, "source": SOURCES},
    "book_checkpoints": {"source": SOURCES},
    "replay_validations": {"mode": MODES},
    "execution_events": {"event_kind": EXECUTION_KINDS},
}

LEVELS = T.ArrayType(T.StructType([T.StructField("price", STRING), T.StructField("size", STRING)]))
LATENCY_FIELDS = ["market_data_recv_us", "normalization_done_us", "strategy_decision_us", "order_submit_us", "exchange_ack_us", "exchange_fill_us"]
LATENCY = T.StructType([T.StructField(name, BIGINT) for name in LATENCY_FIELDS])
