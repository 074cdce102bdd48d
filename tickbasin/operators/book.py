"""Book analytics on level tables: (keys..., side, price, size), one row per level with size above 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixedpoint import mid, spread, weighted_mid
from ..schemas import ASK, BID

BOOK = ["query_id", "asset_id"]


def _of(side: int, value: Column) -> Column:
    return F.when(F.col("side") == side, value)


def summary(levels: DataFrame, keys: list[str] = BOOK) -> DataFrame:
    """Best levels, depths and total sizes of every book: one aggregation, combined before the shuffle."""
    level = F.struct("price", "size")
    return levels.groupBy(*keys).agg(
        F.max(_of(BID, level)).alias("bid"), F.min(_of(ASK, level)).alias("ask"), F.count(_of(BID, F.lit(1))).alias("bid_depth"), F.count(_of(ASK, F.lit(1))).alias("ask_depth"),
        F.coalesce(F.sum(_of(BID, F.col("size"))), F.lit(0)).alias("bid_total"), F.coalesce(F.sum(_of(ASK, F.col("size"))), F.lit(0)).alias("ask_total"),
    )


def top_of_book(levels: DataFrame, keys: list[str] = BOOK) -> DataFrame:
    """Best bid and ask with sizes, middle, spread and weighted middle; null where a side is empty."""
    b, a, bs, asz = F.col("bid.price"), F.col("ask.price"), F.col("bid.size"), F.col("ask.size")
    return summary(levels, keys).select(
        *keys, b.alias("best_bid"), bs.alias("best_bid_size"), a.alias("best_ask"), asz.alias("best_ask_size"), mid(b, a).alias("mid"), spread(b, a).alias("spread"),
        weighted_mid(b, bs, a, asz).alias("weighted_mid"),
    )


def depth_totals(levels: DataFrame, keys: list[str] = BOOK) -> DataFrame:
    """Levels and total size of each side."""
    return summary(levels, keys).select(*keys, "bid_depth", "ask_depth", "bid_total", "ask_total")


def crossed(levels: DataFrame, keys: list[str] = BOOK) -> DataFrame:
    """Whether each book's best bid reaches its best ask (locked counts)."""
    is_crossed = F.coalesce(F.col("bid.price") >= F.col("ask.price"), F.lit(False))
    return summary(levels, keys).select(*keys, F.col("bid.price").alias("best_bid"), F.col("ask.price").alias("best_ask"), is_crossed.alias("crossed"))


def top_n(levels: DataFrame, n: int, keys: list[str] = BOOK) -> DataFrame:
    """The n best levels of each side, ranked from 1: bids from the highest, asks from the lowest."""
    best_first = F.when(F.col("side") == BID, -F.col("price")).otherwise(F.col("price"))
    rank = F.row_number().over(Window.partitionBy(*keys, "side").orderBy(best_first)).cast("long")
    return levels.withColumn("rank", rank).where(F.col("rank") <= n).select(*keys, "side", "rank", "price", "size")


def nested(levels: DataFrame, keys: list[str] = BOOK, depth: int | None = None) -> DataFrame:
    """Books as arrays: bids from the highest, asks from the lowest price, cut to a depth."""
    level = F.struct("price", "size")
    out = levels.groupBy(*keys).agg(
        F.sort_array(F.collect_list(_of(BID, level)), asc=False).alias("bids"), F.sort_array(F.collect_list(_of(ASK, level))).alias("asks"),
    )
    return out if depth is None else out.withColumns({"bids": F.slice("bids", 1, depth), "asks": F.slice("asks", 1, depth)})
