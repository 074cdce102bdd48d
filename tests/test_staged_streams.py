"""Streams of files whose micro-batches are bounded by what their rows become, and read by several tasks."""

from pyspark.sql import functions as F

from tickbasin import sample_feed
from tickbasin.sources import live_source
from tickbasin.streaming import books


def _batches(stream):
    rows = books._finished(stream.withColumn("file", F.input_file_name()), "append")
    return {r.part_id: r for r in rows.groupBy("part_id").agg(F.count("*").alias("n"), F.min("arrival").alias("low"), F.max("arrival").alias("high"), F.count_distinct("file").alias("files")).collect()}


def test_a_micro_batch_is_several_files_in_order_of_arrival(spark):
    found = _batches(sample_feed.staged(spark.range(4000).select(F.col("id").alias("arrival")), 2, 1600))
    assert [found[k].n for k in sorted(found)] and sum(r.n for r in found.values()) == 4000 and len(found) == 3
    assert all(found[k].high < found[k + 1].low for k in range(2)) and min(r.files for r in found.values()) > 4


def test_long_texts_share_a_micro_batch_with_fewer_rows(spark):
    long = F.when(F.col("id") < 100, F.repeat(F.lit("x"), 128 * 19))
    found = _batches(sample_feed.staged(spark.range(2100).select(F.col("id").alias("arrival"), long.alias("text")), 2))
    assert max(found[0].n, found[1].n) > 1900 and found[0].n < 200


def test_a_micro_batch_takes_several_segments(tmp_path):
    class Venue:
        left = [str(k) for k in range(25)]

        def connect(self, assets):
            pass

        def receive(self, most, wait_s):
            out, self.left = self.left[:most], self.left[most:]
            return out

        def close(self):
            pass

    reader = live_source.FeedReader(lambda: live_source.Client(Venue(), []), str(tmp_path), 5, 0, 4)
    assert reader.latestOffset() == {"next": 20} and len(reader.partitions({"next": 0}, {"next": 20})) == 4
    assert reader.latestOffset() == {"next": 26} and reader.latestOffset() == {"next": 26}
    rows = [r for a, b, path in live_source.Journal(str(tmp_path)).segments() for r in live_source.Journal(str(tmp_path)).read(path, a, b)]
    assert [r[0] for r in rows] == list(range(26)) and [r[2] for r in rows if r[1] == "raw"] == [str(k) for k in range(25)]


def test_places_among_many_bounds(spark):
    for bounds in ([], [3], [3, 3, 7], list(range(0, 3000, 3))):
        found = spark.range(3010).select("id", sample_feed._places(F.col("id"), bounds).alias("n")).collect()
        assert [r.n for r in found] == [sum(b < r.id for b in bounds) for r in found]
    # the bounds are halved, not looked through: the filter that was there grew with their number
    plan = spark.range(10).select(sample_feed._places(F.col("id"), list(range(1000))))._jdf.queryExecution().analyzed().toString()
    assert "aggregate(" in plan and "filter(" not in plan


def test_a_stream_has_few_states_whatever_the_session_says(spark, tmp_path):
    before = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = spark.range(30).selectExpr("id arrival", "concat('a', id % 3) asset_id", "2 event_kind", "1 side", "cast(id as int) price", "1L size", "id sequence", "id recv_timestamp_us", "id exchange_timestamp_us", "'e' source_event_id")
        sample = sample_feed.staged(rows, 2)
        checkpoint = tmp_path / "cp"
        query = books.start_live(sample, f"file://{tmp_path}/out", str(checkpoint))
        query.processAllAvailable()
        query.stop()
        assert len([p for p in (checkpoint / "state" / "0").iterdir() if p.name.isdigit()]) == books.STATE_PARTITIONS < 40
        assert books.current_levels(spark.read.schema(books.CHANGES).parquet(f"file://{tmp_path}/out")).count() == 30
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
