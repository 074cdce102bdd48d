"""Execution timelines, latencies and appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadRequest
from ..functions.codecs import execution_side_code
from ..functions.fixedpoint import price_from_text, size_from_text
from ..schemas import DATASETS, EXECUTION_KINDS, LATENCY, LATENCY_FIELDS, SIDES
from .replay import HOUR_US

_TEXTS = ["order_id", "event_kind", "asset_id", "client_order_id", "venue_order_id", "side", "price", "size", "status", "reason"]
INPUT = T.StructType([T.StructField(n, T.StringType()) for n in _TEXTS] + [T.StructField(n, T.LongType()) for n in ["event_timestamp_us", *LATENCY_FIELDS]])


def timeline(executions: DataFrame, start_us: int, end_us: int, limit: int, order_id: str | None = None, asset_id: str | None = None) -> DataFrame:
    """The first events of a window in time order, with the count before the limit.

    The count is an aggregate of its own and the limit a top-k, so no task
    sorts the whole window.  An asset filter drops events without an asset.
    """
    rows = executions.where(F.col("event_timestamp_us").between(start_us, end_us))
    if order_id is not None:
        rows = rows.where(F.col("order_id") == order_id)
    if asset_id is not None:
        rows = rows.where(F.col("asset_id") == asset_id)
    side = F.when(F.col("side") == 1, SIDES[1].lower()).when(F.col("side") == 2, SIDES[2].lower())
    first = rows.orderBy("event_timestamp_us", "order_id", F.coalesce("client_order_id", F.lit("")), "event_kind").limit(limit)
    total = rows.agg(F.count("*").alias("total_count"))
    return first.join(F.broadcast(total)).withColumn("side", side)  # total is one row


def latency_breakdown(executions: DataFrame) -> DataFrame:
    """Differences of the latency stamps of every execution; null where one is missing."""
    rows = executions.withColumn("t", F.from_json("latency_json", LATENCY))
    steps = [("normalize_us", 0, 1), ("decide_us", 1, 2), ("submit_us", 2, 3), ("ack_us", 3, 4), ("fill_us", 3, 5), ("total_us", 0, 5)]
    return rows.select("order_id", "client_order_id", "event_kind", "event_timestamp_us", *[(F.col(f"t.{LATENCY_FIELDS[b]}") - F.col(f"t.{LATENCY_FIELDS[a]}")).alias(n) for n, a, b in steps])


def from_input(rows: DataFrame) -> DataFrame:
    """Append input (texts for prices and sizes) as execution_events rows; bad values raise."""
    def checked(name: str, value: Column) -> Column:
        bad = F.raise_error(F.concat(F.lit(f"bad {name}: "), F.col(name)))
        return F.when(F.col(name).isNull(), F.lit(None)).otherwise(F.coalesce(value, bad.cast("long")))

    kind = F.when(F.col("event_kind").isin(EXECUTION_KINDS), F.col("event_kind")).otherwise(F.raise_error(F.concat(F.lit("unknown event kind: "), F.coalesce("event_kind", F.lit("null")))).cast("string"))
    order = F.coalesce("order_id", F.raise_error(F.lit("order_id is required")).cast("string"))
    stamp = F.coalesce("event_timestamp_us", F.raise_error(F.lit("event_timestamp_us is required")).cast("long"))
    out = rows.select(
        stamp.alias("event_timestamp_us"), "asset_id", order.alias("order_id"), "client_order_id", "venue_order_id", kind.alias("event_kind"), execution_side_code(F.col("side")).alias("side"),
        checked("price", price_from_text(F.col("price"))).cast("int").alias("price"), checked("size", size_from_text(F.col("size"))).alias("size"), "status", "reason",
        F.to_json(F.struct(*LATENCY_FIELDS), {"ignoreNullFields": "false"}).alias("latency_json"),
    )
    return out.select([f.name for f in DATASETS["execution_events"].fields])


def read_input(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with one execution event or a list of them; unknown fields are an error."""
    found = spark.read.option("multiLine", "true").option("mode", "FAILFAST").json(path)
    unknown = sorted(set(found.columns) - set(INPUT.fieldNames()))
    if unknown:
        raise BadRequest(f"unknown fields: {', '.join(unknown)}")
    return from_input(spark.read.option("multiLine", "true").option("mode", "FAILFAST").schema(INPUT).json(path))


def with_book(executions: DataFrame, tops: DataFrame, lookback_us: int = HOUR_US) -> DataFrame:
    """Combined view: every execution with its asset's last top of book at or before it.

    tops(asset_id, at_us, ...): an as-of join as a union and one window, each
    asset cut into buckets of the lookback so that a hot asset is shared by
    many tasks; a top is carried into the next bucket.
    """
    extra = [c for c in tops.columns if c not in ("asset_id", "at_us")]
    bucket = F.call_function("div", F.col("at_us"), F.lit(lookback_us))
    left = executions.withColumn("at_us", F.col("event_timestamp_us")).withColumn("bucket", bucket).withColumn("is_top", F.lit(0))
    right = tops.select("asset_id", "at_us", F.struct("at_us", *extra).alias("top"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"), F.lit(1).alias("is_top"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy("asset_id", "bucket").orderBy("at_us", F.desc("is_top")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("top", F.last("top", ignorenulls=True).over(order)).where("is_top = 0")
    near = F.col("top.at_us") >= F.col("event_timestamp_us") - lookback_us
    return found.select(*executions.columns, F.when(near, F.col("top.at_us")).alias("top_at_us"), *[F.when(near, F.col(f"top.{c}")).alias(c) for c in extra])
