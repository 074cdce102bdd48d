"""The datasets as clustered catalog tables, and their five scans as parameter-bound SQL.

A second storage dialect: partitioned by date like the folders, and bucketed and
sorted by asset, so that joins and windows of an asset need no exchange.
Executions are few for a day, so theirs are partitioned by the month's first.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadRequest
from ..functions.codecs import date_and_hour
from ..schemas import DATASETS, PARTITION_TIME
from .storage import conform

BUCKETS = 64
#: What buckets a dataset: its asset, or its order.
CLUSTER = {name: "order_id" if name == "execution_events" else "asset_id" for name in DATASETS}
#: Datasets whose event_date is the first of its month.
MONTHLY = frozenset({"execution_events"})


def ddl(database: str, dataset: str, buckets: int = BUCKETS) -> str:
    """The statement that creates a dataset's table."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in DATASETS[dataset].fields)
    key, clock = CLUSTER[dataset], PARTITION_TIME[dataset]
    return f"create table if not exists {database}.{dataset} ({columns}, event_date date) using parquet options (compression 'zstd') partitioned by (event_date) clustered by ({key}) sorted by ({key}, {clock}) into {buckets} buckets"


def create(spark: SparkSession, database: str, location: str | None = None, buckets: int = BUCKETS) -> None:
    """Creates the database and its six tables, where they are missing."""
    if not database.replace("_", "").isalnum():
        raise BadRequest(f"{database!r} is no name of a database")
    place = "" if location is None else " location '" + location.replace("'", "") + "'"
    spark.sql(f"create database if not exists {database}{place}")
    for dataset in DATASETS:
        spark.sql(ddl(database, dataset, buckets))


def append(rows: DataFrame, database: str, dataset: str, buckets: int = BUCKETS) -> None:
    """Appends rows to a table; rows are dealt by bucket first, so a task writes few files."""
    key, clock = CLUSTER[dataset], PARTITION_TIME[dataset]
    day, _ = date_and_hour(F.col(clock))
    dealt = conform(rows, dataset).withColumn("event_date", F.trunc(day, "month") if dataset in MONTHLY else day).repartition(buckets, key)
    dealt.write.mode("append").format("parquet").option("compression", "zstd").partitionBy("event_date").bucketBy(buckets, key).sortBy(key, clock).saveAsTable(f"{database}.{dataset}")


def _run(spark: SparkSession, database: str, dataset: str, where: str, start_us: int, end_us: int, order: str = "", **args) -> DataFrame:
    clock = PARTITION_TIME[dataset]
    columns = ", ".join(f"`{f.name}`" for f in DATASETS[dataset].fields)
    first, last = (datetime.fromtimestamp(max(0, min(t, 253_402_300_799_000_000)) / 1e6, UTC).date() for t in (start_us, end_us))
    first = first.replace(day=1) if dataset in MONTHLY else first
    text = f"select {columns} from identifier(:table) where event_date between :first and :last and {clock} between :start_us and :end_us{where}{order}"
    return spark.sql(text, args={"table": f"{database}.{dataset}", "first": first, "last": last, "start_us": start_us, "end_us": end_us, **args})


def market_data(spark: SparkSession, database: str, asset_id: str, start_us: int, end_us: int) -> dict[str, DataFrame]:
    """Book, trade and continuity events of a window; continuity events of no asset too."""
    own = " and asset_id = :asset"
    return {
        "book_events": _run(spark, database, "book_events", own, start_us, end_us, asset=asset_id), "trade_events": _run(spark, database, "trade_events", own, start_us, end_us, asset=asset_id),
        "ingest_events": _run(spark, database, "ingest_events", " and (asset_id = :asset or asset_id is null)", start_us, end_us, asset=asset_id),
    }


def checkpoints(spark: SparkSession, database: str, asset_id: str, start_us: int, end_us: int) -> DataFrame:
    """Checkpoints of a window in time order."""
    return _run(spark, database, "book_checkpoints", " and asset_id = :asset", start_us, end_us, " order by checkpoint_timestamp_us", asset=asset_id)


def latest_checkpoint(spark: SparkSession, database: str, asset_id: str, at_us: int) -> DataFrame:
    """The last checkpoint at a time or before."""
    return _run(spark, database, "book_checkpoints", " and asset_id = :asset", 0, at_us, " order by checkpoint_timestamp_us desc, recv_timestamp_us desc limit 1", asset=asset_id)


def validations(spark: SparkSession, database: str, asset_id: str, start_us: int, end_us: int) -> DataFrame:
    """Validations stored in a window, in that order."""
    return _run(spark, database, "replay_validations", " and asset_id = :asset", start_us, end_us, " order by persisted_at_us", asset=asset_id)


def executions(spark: SparkSession, database: str, start_us: int, end_us: int, order_id: str | None = None) -> DataFrame:
    """Executions of a window in time order, of one order if given."""
    where, args = ("", {}) if order_id is None else (" and order_id = :order_id", {"order_id": order_id})
    return _run(spark, database, "execution_events", where, start_us, end_us, " order by event_timestamp_us", **args)
