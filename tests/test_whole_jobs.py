"""Queries on tables larger than the test tables, where sums and windows would cut them short."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tickbasin import queries

SMALLEST = Path("/root/testdata/sf0.001")
#: Their stamps add up to more than a long holds.
ROWS = 12_000
STAMP_US = 1_704_844_800_000_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of which one asset has many signups at one time."""
    out = tmp_path_factory.mktemp("tables")
    for name in ("orders", "lineitem"):
        (out / f"{name}.parquet").symlink_to(SMALLEST / f"{name}.parquet")
    rows = spark.range(ROWS).select((F.col("id") * 2).alias("event_id"), F.timestamp_micros(F.lit(STAMP_US)).alias("ts"), F.lit(3).cast("long").alias("user_id"), F.lit("signup").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    rows.write.parquet(str(out / "events.parquet"))
    return str(out)


def test_clustered_scans_of_sums_beyond_a_long(spark, folder):
    rows = {r["scan"]: (r["n"], r["clocks"]) for r in queries.clustered_scans(spark, folder).collect()}
    assert rows["book_events"] == rows["replay_validations"] == (ROWS, ROWS * STAMP_US)
    assert rows["trade_events"] == (0, None)


def test_sums_within_a_long_stay_longs(spark):
    assert dict(queries.clustered_scans(spark, str(SMALLEST)).dtypes)["clocks"] == "bigint"


def test_repeated_append_of_sums_beyond_a_long(spark, folder):
    assert [tuple(r) for r in queries.repeated_append(spark, folder).collect()] == [("A3", "recv_time", ROWS, ROWS * STAMP_US)]


def test_collected_continuity_is_of_the_whole_history(spark):
    from tickbasin.sources import views

    own = views.ingest_events(spark, str(SMALLEST)).where("asset_id is not null")
    assert own.where(~F.col("recv_timestamp_us").between(queries.START_US, queries.END_US)).count() > 0
    assert queries.collected_continuity(spark, str(SMALLEST)).agg(F.sum("n")).first()[0] == own.count()
