"""Fixtures of the queries: a feed made of the test tables, and a table as a stream of files."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.fixedpoint import price_text, size_text
from .sources import live_source, views
from .sources.feed import SCHEMA, scratch, stored

#: Rows of a micro-batch of a staged stream, about, and the files that it has then.
STAGED_ROWS, BATCH_FILES = 2_000_000, 16
#: Characters of a message of one row at most, and those of each further level.
SHORT_TEXT, ROW_CHARS = 256, 32


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Feed messages made of the test tables.

    A snapshot block of an asset is one book message, a delta a price change,
    a purchase a trade; error events give connection changes.  Some prices and
    sides are bad, some stamps missing, 0, in milliseconds or in microseconds.
    """
    def stamp(number) -> object:
        us = F.col("recv_timestamp_us") - (number % 7) * 1_000_000 - F.when(number % 17 < 4, 3 * 86_400_000_000).otherwise(0)
        return F.when(number % 13 == 0, "0").when(number % 31 == 0, F.lit(None)).when(number % 2 == 0, us.cast("string")).otherwise((us / 1000).cast("long").cast("string"))

    number = F.substring("source_event_id", 2, 20).cast("long")
    rows = views.book_events(spark, folder).withColumn("number", number)
    price = F.when(F.col("number") % 29 == 0, "x").otherwise(price_text(F.col("price")))
    rows = rows.withColumns({"p": price, "s": size_text(F.col("size"))})
    entry = F.struct("number", F.col("p").alias("price"), F.col("s").alias("size"))

    def side(code: int):
        listed = F.array_sort(F.collect_list(F.when(F.col("side") == code, entry)))
        return F.transform(listed, lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))

    snaps = rows.where("event_kind = 1").groupBy("asset_id", "recv_timestamp_us").agg(F.min("number").alias("arrival"), side(1).alias("bids"), side(2).alias("asks"))
    book = F.to_json(F.struct(F.lit("book").alias("event_type"), "asset_id", stamp(F.col("arrival")).alias("timestamp"), F.concat(F.lit("h"), F.col("arrival").cast("string")).alias("hash"), "bids", "asks"))
    words = F.array(*map(F.lit, ["BUY", "buy", "Bid", "bid"])), F.array(*map(F.lit, ["SELL", "sell", "Ask", "ask"]))
    word = F.when(F.col("number") % 19 == 0, "Buy").otherwise(F.when(F.col("side") == 1, F.get(words[0], (F.col("number") % 4).cast("int"))).otherwise(F.get(words[1], (F.col("number") % 4).cast("int"))))
    change = F.struct("asset_id", F.col("p").alias("price"), F.col("s").alias("size"), word.alias("side"), F.concat(F.lit("h"), F.col("number").cast("string")).alias("hash"))
    delta = F.to_json(F.struct(F.lit("price_change").alias("event_type"), stamp(F.col("number")).alias("timestamp"), F.array(change).alias("price_changes")))
    trades = views.trade_events(spark, folder).withColumn("number", F.substring("trade_id", 2, 20).cast("long"))
    trade = F.to_json(F.struct(F.lit("last_trade_price").alias("event_type"), "asset_id", price_text(F.col("price")).alias("price"), F.when(F.col("number") % 37 == 0, "-1").otherwise(size_text(F.col("size"))).alias("size"), F.when(F.col("side") == 1, "BUY").when(F.col("side") == 2, "SELL").alias("side"), stamp(F.col("number")).alias("timestamp"), F.col("trade_id").alias("transaction_hash")))
    changes = views.ingest_events(spark, folder).where("event_kind in ('reconnect_start', 'reconnect_success')")
    none = F.lit(None).cast("string")

    def raw(df: DataFrame, arrival, text) -> DataFrame:
        return df.select(arrival.alias("arrival"), F.lit("raw").alias("kind"), text.alias("text"), "recv_timestamp_us", none.alias("session_id"), none.alias("details"))

    junk = raw(trades.where("number % 41 = 0"), F.col("number") + 1_000_000_000, F.lit('{"event_type":"unknown"}')).unionByName(raw(trades.where("number % 43 = 0"), F.col("number") + 2_000_000_000, F.lit("[1]")))
    life = changes.select(number.alias("arrival"), F.col("event_kind").alias("kind"), none.alias("text"), "recv_timestamp_us", F.col("source_session_id").alias("session_id"), "details")
    deltas = rows.where("event_kind = 2")
    return raw(snaps, F.col("arrival"), book).unionByName(raw(deltas, F.col("number"), delta)).unionByName(raw(trades, F.col("number"), trade)).unionByName(junk).unionByName(life)


def _places(number: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are below a number, by halving, so many bounds cost little more than few."""
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    listed = F.array(*map(F.lit, bounds)).cast("array<long>")
    return F.aggregate(F.array(*map(F.lit, steps)).cast("array<int>"), F.lit(0), lambda found, step: F.when(F.get(listed, found + step - 1) < number, found + step).otherwise(found))


def staged(df: DataFrame, parts: int = 3, rows: int = STAGED_ROWS) -> DataFrame:
    """The rows as a stream of files in order of arrival, at least so many micro-batches of about so many rows.

    A micro-batch is several files, so several tasks parse it.  Files are ranges
    of arrivals of about equal weight, as the levels of a long text are rows
    later on; their times of change are set in that order, as the source reads
    by them.  Texts are computed once; of other rows only the arrivals are
    computed again.
    """
    spark = df.sparkSession
    weight = F.lit(1).cast("long")
    kept = df
    if "text" in df.columns:
        more = F.greatest(F.coalesce(F.length("text"), F.lit(0)) - SHORT_TEXT, F.lit(0))
        kept = stored(df.withColumn("weight", weight + F.call_function("div", more, F.lit(ROW_CHARS))), "stream-rows")
    total = kept.agg(F.sum("weight") if "text" in df.columns else F.count("*")).first()[0] or 0
    batches = max(parts, -(-total // rows))
    each = max(1, -(-total // (batches * (rows // BATCH_FILES))))
    n = batches * each
    weighed = kept.select("arrival", F.explode(F.sequence(weight, F.col("weight")))) if "text" in df.columns else kept.select("arrival")
    bounds = weighed.agg(F.percentile_approx("arrival", [k / n for k in range(1, n)] or [1.0], 100 * n)).first()[0] or []
    file = _places(F.col("arrival"), bounds)
    path = scratch(spark, "stream-in")
    kept.select(*df.columns, F.least(file, F.lit(n - 1)).alias("file")).repartitionById(n, "file").drop("file").write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    newest = min(f.getModificationTime() for f in fs.listStatus(where))
    for k, file in enumerate(files):
        fs.setTimes(file, newest - 1000 * (len(files) - k), -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def written_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The feed as stored messages: written once, then read by every part of a plan."""
    path = scratch(spark, "messages")
    messages(spark, folder).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def recorded(folder: str):
    """A client, for live_source.register(), of a venue that sends the lines of a folder's text files in order."""
    class Recorded:
        lines = None

        def connect(self, assets):
            from pyarrow import fs

            if self.lines is None:
                files, path = fs.FileSystem.from_uri(folder)
                found = sorted(f.path for f in files.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-"))
                self.lines = (line for f in found for line in files.open_input_stream(f).read().decode().split("\n") if line)

        def receive(self, most, wait_s):
            return list(islice(self.lines, most))

        def close(self):
            pass

    return lambda: live_source.Client(Recorded(), [])
