"""Datasets as hour-partitioned Parquet: writing, window scans, foreign layouts.

A dataset is partitioned by the UTC date and hour of its clock.  Catalyst does
not derive partition filters from a microsecond range, so scans add them.
Within a partition files are sorted by asset and time, so that row groups of
other assets are skipped.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadRequest
from ..functions.codecs import date_and_hour, levels_from_json
from ..schemas import DATASETS, ENUMS, LATENCY, PARTITION_TIME

#: Rows of a Parquet file, about.
FILE_ROWS = 4_000_000


def conform(df: DataFrame, dataset: str) -> DataFrame:
    """The dataset's columns in order and type; a missing column is an error, unsigned types become signed."""
    missing = [f.name for f in DATASETS[dataset].fields if f.name not in df.columns]
    if missing:
        raise BadRequest(f"{dataset} lacks {', '.join(missing)}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in DATASETS[dataset].fields])


def checked(df: DataFrame, dataset: str) -> DataFrame:
    """Raises on a code that the dataset does not know."""
    for name, known in ENUMS[dataset].items():
        bad = F.raise_error(F.concat(F.lit(f"{dataset}.{name}: unknown value "), F.col(name).cast("string")))
        df = df.withColumn(name, F.when(F.col(name).isNull() | F.col(name).isin(known), F.col(name)).otherwise(bad.cast(df.schema[name].dataType)))
    return df


def with_partition(df: DataFrame, dataset: str) -> DataFrame:
    """Adds event_date and event_hour."""
    day, hour = date_and_hour(F.col(PARTITION_TIME[dataset]))
    return df.withColumns({"event_date": day, "event_hour": hour})


def write(df: DataFrame, base: str, folder: str, mode: str = "append", dataset: str | None = None) -> None:
    """Appends rows to a dataset's folder, which has its name if the dataset isn't given.

    An append is not repeatable; ledger.commit is.

    Rows are dealt by hour in tasks of about equal size, so that a hot hour is
    shared by several of them and a small one gets one file.
    """
    dataset = dataset or folder
    rows = with_partition(conform(df, dataset), dataset)
    ordered = rows.hint("rebalance", "event_date", "event_hour").sortWithinPartitions("event_date", "event_hour", "asset_id", PARTITION_TIME[dataset])
    writer = ordered.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS)
    writer.partitionBy("event_date", "event_hour").parquet(f"{base}/{folder}")


def _empty(spark: SparkSession, dataset: str) -> DataFrame:
    return spark.createDataFrame([], DATASETS[dataset])


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read(spark: SparkSession, base: str, dataset: str) -> DataFrame:
    """A whole dataset with event_date and event_hour; a missing one is empty."""
    path = f"{base}/{dataset}"
    if not _exists(spark, path):
        return with_partition(_empty(spark, dataset), dataset)
    schema = DATASETS[dataset].simpleString()[7:-1].replace(":", " ") + ", event_date date, event_hour int"
    return spark.read.schema(schema).parquet(path)


def read_foreign(spark: SparkSession, path: str, dataset: str, strict: bool = True) -> DataFrame:
    """Files of another writer in dataset/YYYY/MM/DD/HH folders, unsigned types included.

    They are read without a schema, as Spark refuses to read unsigned columns
    as signed ones, and then cast.
    """
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{path}/{dataset}")
    rows = conform(found, dataset)
    return checked(rows, dataset) if strict else rows


def in_window(df: DataFrame, dataset: str, start_us: int, end_us: int) -> DataFrame:
    """Rows of the inclusive window; partitions outside are not read."""
    if "event_date" in df.columns:
        first, last = (datetime.fromtimestamp(max(0, t) / 1e6, UTC) for t in (start_us, end_us))
        df = df.where(F.col("event_date").between(F.lit(first.date()), F.lit(last.date())))
        df = df.where((F.col("event_date") > F.lit(first.date())) | (F.col("event_hour") >= first.hour))
        df = df.where((F.col("event_date") < F.lit(last.date())) | (F.col("event_hour") <= last.hour))
    return df.where(F.col(PARTITION_TIME[dataset]).between(start_us, end_us))


def scan(df: DataFrame, dataset: str, start_us: int, end_us: int, asset_id: str | None = None, order_id: str | None = None) -> DataFrame:
    """A window of a dataset, of one asset or order if given.

    Continuity events of no asset concern every asset and are kept.
    """
    rows = in_window(df, dataset, start_us, end_us)
    if asset_id is not None:
        own = F.col("asset_id") == asset_id
        rows = rows.where(own | F.col("asset_id").isNull()) if dataset == "ingest_events" else rows.where(own)
    if order_id is not None:
        rows = rows.where(F.col("order_id") == order_id)
    return rows.select([f.name for f in DATASETS[dataset].fields])


def in_time(df: DataFrame, dataset: str) -> DataFrame:
    """Rows in the order of the dataset's clock; ties fall to the asset or order, then to the other columns."""
    clock = PARTITION_TIME[dataset]
    first = [clock, "order_id" if dataset == "execution_events" else "asset_id"]
    return df.orderBy(*first, *[f.name for f in DATASETS[dataset].fields if f.name not in first])


def checkpoint_levels(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints with arrays of raw levels, bids and asks, for their JSON."""
    return checkpoints.withColumns({"bids": levels_from_json(F.col("bids_json")), "asks": levels_from_json(F.col("asks_json"))})


def with_latency(executions: DataFrame) -> DataFrame:
    """Executions with the latency struct for its JSON."""
    return executions.withColumn("latency", F.from_json("latency_json", LATENCY))


def latest_checkpoint(checkpoints: DataFrame, asset_id: str, at_us: int, inclusive: bool = True) -> DataFrame:
    """The asset's last checkpoint at (or strictly before) a time; no lower bound."""
    ts = F.col("checkpoint_timestamp_us")
    before = ts <= at_us if inclusive else ts < at_us
    return checkpoints.where((F.col("asset_id") == asset_id) & before).orderBy(ts.desc(), F.col("recv_timestamp_us").desc()).limit(1)


def files_of(df: DataFrame) -> list[str]:
    """The files that a scan reads."""
    return sorted(df.inputFiles())


def describe(df: DataFrame) -> list[tuple[str, str, bool]]:
    """Name, type and nullability of every column."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
