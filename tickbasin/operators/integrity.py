"""Integrity of stored windows: counts, completeness, statistics, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DATASETS, PARTITION_TIME
from ..functions.codecs import date_and_hour


def _kind(*names: str) -> Column:
    return F.coalesce(F.sum(F.col("event_kind").isin(*names).cast("long")), F.lit(0))


def summary(books: DataFrame, ingest: DataFrame, validations: DataFrame, assets: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Counts of the window for every asset of assets(asset_id), and whether its data is complete.

    Global continuity events count for every asset: they are counted once and
    added.  Reconnects and gaps (resets too) make a window best effort, stale
    snapshots do not.
    """
    def window(df: DataFrame, dataset: str) -> DataFrame:
        return df.where(F.col(PARTITION_TIME[dataset]).between(start_us, end_us))

    b = window(books, "book_events").groupBy("asset_id").agg(F.count("*").alias("n_book"))
    counts = [F.count("*").alias("n"), _kind("reconnect_start", "reconnect_success").alias("rec"), _kind("sequence_gap", "source_reset").alias("gap"), _kind("stale_snapshot_skip").alias("stale")]
    i = window(ingest, "ingest_events")
    own = i.where("asset_id is not null").groupBy("asset_id").agg(*counts)
    shared = i.where("asset_id is null").agg(*[c.alias(f"g_{n}") for c, n in zip(counts, ("n", "rec", "gap", "stale"), strict=True)])
    ok = F.coalesce(F.sum(F.col("matched").cast("long")), F.lit(0)).alias("ok")
    v = window(validations, "replay_validations").groupBy("asset_id").agg(F.count("*").alias("n_val"), ok)
    # shared is one row
    joined = assets.select("asset_id").distinct().join(b, "asset_id", "left").join(own, "asset_id", "left").join(v, "asset_id", "left").join(F.broadcast(shared))

    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long")

    rec, gap = number("rec") + F.col("g_rec"), number("gap") + F.col("g_gap")
    return joined.select(
        "asset_id", F.lit(start_us).cast("long").alias("start_us"), F.lit(end_us).cast("long").alias("end_us"), number("n_book").alias("total_book_events"), (number("n") + F.col("g_n")).alias("total_ingest_events"),
        rec.alias("reconnect_count"), gap.alias("gap_count"), (number("stale") + F.col("g_stale")).alias("stale_snapshot_skip_count"), number("n_val").alias("validation_count"), number("ok").alias("validations_matched"),
        (number("n_val") - number("ok")).alias("validations_mismatched"), F.when((rec > 0) | (gap > 0), "best_effort").otherwise("complete").alias("completeness"),
    )


def continuity_events(ingest: DataFrame, asset_id: str, start_us: int, end_us: int) -> DataFrame:
    """The asset's continuity events of a window, global ones too."""
    rows = ingest.where(F.col("recv_timestamp_us").between(start_us, end_us) & ((F.col("asset_id") == asset_id) | F.col("asset_id").isNull()))
    return rows.select(F.col("event_kind").alias("kind"), "recv_timestamp_us", "exchange_timestamp_us", "details", "source_event_id")


def collected_continuity(ingest: DataFrame, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Every asset's own continuity events in time order, of the whole history or of a window, which bounds the array."""
    event = F.struct("recv_timestamp_us", F.col("event_kind").alias("kind"), "details")
    rows = ingest.where("asset_id is not null")
    for bound in ([] if start_us is None else [F.col("recv_timestamp_us") >= start_us]) + ([] if end_us is None else [F.col("recv_timestamp_us") <= end_us]):
        rows = rows.where(bound)
    return rows.groupBy("asset_id").agg(F.array_sort(F.collect_list(event)).alias("events"))


def dataset_stats(df: DataFrame, dataset: str) -> DataFrame:
    """Rows, first and last stamp, assets; of book events also snapshots and deltas."""
    ts = F.col(PARTITION_TIME[dataset])
    out = [F.lit(dataset).alias("dataset"), F.count("*").alias("n_rows"), F.min(ts).alias("first_us"), F.max(ts).alias("last_us"), F.countDistinct("asset_id").alias("n_assets")]
    if dataset == "book_events":
        out += [F.coalesce(F.sum((F.col("event_kind") == k).cast("long")), F.lit(0)).alias(n) for k, n in ((1, "n_snapshots"), (2, "n_deltas"))]
    return df.agg(*out)


def partition_counts(df: DataFrame, dataset: str) -> DataFrame:
    """Rows by asset ("global" if none), date and hour."""
    day, hour = date_and_hour(F.col(PARTITION_TIME[dataset]))
    return df.groupBy(F.coalesce("asset_id", F.lit("global")).alias("asset_id"), day.alias("event_date"), hour.cast("long").alias("event_hour")).agg(F.count("*").alias("n_rows"))


def feed_latency(df: DataFrame) -> DataFrame:
    """Samples of receive less exchange clock, where the exchange clock is known and earlier."""
    recv, exchange = F.col("recv_timestamp_us"), F.col("exchange_timestamp_us")
    return df.where((exchange > 0) & (recv > exchange)).withColumn("latency_us", recv - exchange)


def latency_percentiles(samples: DataFrame, keys: list[str], exact: bool = True) -> DataFrame:
    """Count, median and 99th percentile of latency_us; a sketch instead of exact values for large groups."""
    q = F.percentile if exact else (lambda c, p: F.percentile_approx(c, p, 10_000))
    return samples.groupBy(*keys).agg(F.count("*").alias("sample_count"), q("latency_us", 0.5).cast("double").alias("p50_us"), q("latency_us", 0.99).cast("double").alias("p99_us"))


def latency_histogram(samples: DataFrame, bounds: list[int]) -> DataFrame:
    """Cumulative counts of latency_us by upper bound."""
    rows = samples.agg(*[F.coalesce(F.sum((F.col("latency_us") <= b).cast("long")), F.lit(0)).alias(str(b)) for b in bounds])
    return rows.select(F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias("le_us"), F.col(f"`{b}`").alias("n")) for b in bounds])).alias("x")).select("x.*")


def dataset_columns(dataset: str) -> list[tuple[str, str]]:
    """Column names and types of a dataset."""
    return [(f.name, f.dataType.simpleString()) for f in DATASETS[dataset].fields]
