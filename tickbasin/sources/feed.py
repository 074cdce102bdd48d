"""Feed messages: a folder of JSON lines as a stream, and the rules of a live source's client."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, RateLimited

SCHEMA = "arrival long, kind string, text string, recv_timestamp_us long, session_id string, details string"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or a local one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tickbasin-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a new shared folder and read again: a plan that uses them several times computes them once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_messages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of JSON lines as a stream of messages; files_per_trigger bounds a micro-batch."""
    reader = spark.readStream.schema(SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)


def check_status(status: int) -> None:
    """Raises for HTTP statuses other than 2xx, with an error of its own for 429."""
    if status == 429:
        raise RateLimited("the venue asks to slow down")
    if not 200 <= status < 300:
        raise EngineError(f"HTTP status {status}")


def requests_per_second(requests: int = 1500, window_s: int = 10) -> int:
    """Steady rate, and burst, of a quota; at least 1."""
    return max(1, requests // max(1, window_s))


def backoff_ms(attempt: int, base_ms: int, most_ms: int, jitter: float = 0.0) -> int:
    """Delay before a reconnect: doubled for each attempt, plus jitter (0 to 1) of a quarter, up to a maximum."""
    delay = base_ms << min(attempt, 15)
    return min(delay + int(jitter * (delay // 4)), most_ms)


def discovery_delays_ms(attempts: int = 5, first_ms: int = 2000, most_ms: int = 8000) -> list[int]:
    """Delays between the attempts of a market discovery."""
    return [min(first_ms << k, most_ms) for k in range(attempts - 1)]


def subscription(assets: list[str]) -> dict:
    """The message that subscribes to assets."""
    return {"assets_ids": assets, "type": "market"}


def rest_checkpoints(books: DataFrame, now_us: int) -> DataFrame:
    """REST book responses (text) as book_checkpoints rows; a response with a bad level is dropped."""
    from ..functions.codecs import levels_from_json, levels_to_json, rest_timestamp_us

    shape = "asset_id string, market string, hash string, timestamp string, bids string, asks string"
    rows = books.select(F.from_json("text", shape).alias("b")).select("b.*").where("asset_id is not null and bids is not null and asks is not null")
    rows = rows.withColumns({"bids": levels_from_json(F.col("bids")), "asks": levels_from_json(F.col("asks"))})
    for c in ("bids", "asks"):
        rows = rows.where(F.col(c).isNotNull() & ~F.exists(c, lambda x: x["price"].isNull() | x["size"].isNull()))
    ts = rest_timestamp_us(F.col("timestamp"), F.lit(now_us).cast("long"))
    return rows.select(
        ts.alias("checkpoint_timestamp_us"), F.lit(now_us).cast("long").alias("recv_timestamp_us"), ts.alias("exchange_timestamp_us"), "asset_id", F.lit("rest_snapshot").alias("source"), F.col("hash").alias("source_event_id"),
        F.lit(None).cast("string").alias("source_session_id"), levels_to_json(F.col("bids")).alias("bids_json"), levels_to_json(F.col("asks")).alias("asks_json"),
    )
