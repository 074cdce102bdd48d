"""Rows packed for stateful processors: few rows for Python, none lost, nulls and order kept."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from tickbasin.streaming import books, packed


def test_rows_come_back_in_order(spark):
    rows = [(random.Random(k).choice(["a", "b", None]), k, k % 3 - 1, None if k % 5 == 0 else f"t{k}") for k in range(500)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "asset_id string, arrival long, pos int, text string").repartition(3)
    found = packed.packed(df, "asset_id", clock="arrival").toPandas()
    assert len(found) <= 9
    for key in ("a", "b", None):
        own = found[found["asset_id"].isna() if key is None else found["asset_id"] == key]
        want = sorted((r[2], r[1], r[3]) for r in rows if r[0] == key)
        table = packed.unpacked([own.iloc[:1], own.iloc[1:]], "pos", "arrival")
        assert list(zip(*(table[c].to_pylist() for c in ("pos", "arrival", "text")), strict=True)) == want
        assert own["arrival"].max() == max(w[1] for w in want)


def test_frames_are_bounded_and_filtered():
    table = pa.table({"n": list(range(50_000))})
    frames = list(packed.put_out(table, packed.whole(table, "n") % 2 == 0))
    assert len(frames) == 3 and sum(len(f) for f in frames) == 25_000 and frames[2]["n"].iloc[-1] == 49_998


def test_a_processor_is_handed_few_rows(spark, tmp_path, capsys):
    df = spark.range(0, 3000, 1, 2).select((F.col("id") % 3).cast("string").alias("asset_id"), F.col("id").alias("arrival"), F.lit(2).alias("event_kind"), F.lit(1).alias("side"), F.col("id").cast("int").alias("price"), F.lit(1).cast("long").alias("size"), "id", F.col("id").alias("recv_timestamp_us"), F.lit(0).cast("long").alias("exchange_timestamp_us"), F.lit(None).cast("string").alias("source_event_id"), F.lit(1).cast("long").alias("sequence"))
    df.write.parquet(str(tmp_path / "in"))
    stream = books.live_books(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    with books.stateful(spark):
        query = stream.writeStream.outputMode("update").format("memory").queryName("few").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert spark.table("few").where("size = 1").count() == 3000
    query.explain()
    assert "MapInArrow" in capsys.readouterr().out
