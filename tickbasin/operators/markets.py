"""Market discovery: events with markets and their token ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _BOOL = T.StringType(), T.BooleanType()
MARKET = T.StructType([T.StructField(n, _TEXT) for n in ("id", "conditionId", "question", "tokenId", "clobTokenIds")] + [T.StructField("active", _BOOL), T.StructField("closed", _BOOL)])
EVENT = T.StructType([T.StructField(n, _TEXT) for n in ("id", "title", "slug", "description")] + [T.StructField("markets", T.ArrayType(MARKET))])


def token_list(text: Column) -> Column:
    """Ids of a JSON list in a text, else of a comma-separated one; empty ids go."""
    listed = F.from_json(text, "array<string>")
    split = F.transform(F.split(text, ","), lambda x: F.trim(x))
    return F.filter(F.coalesce(F.when(text.startswith("["), listed), split, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def parse_events(texts: DataFrame, column: str = "text") -> DataFrame:
    """Discovery responses (a JSON list of events each) as event rows."""
    return texts.select(F.explode(F.from_json(column, T.ArrayType(EVENT))).alias("e")).select("e.*")


def token_ids(events: DataFrame) -> DataFrame:
    """(id, market_id, pos, token_id) of every token."""
    markets = events.select("id", F.explode("markets").alias("m"))
    return markets.select("id", F.col("m.id").alias("market_id"), F.posexplode(token_list(F.col("m.clobTokenIds"))).alias("pos", "token_id"))


def with_keyword(events: DataFrame, keyword: str) -> DataFrame:
    """Events whose title or one of whose questions holds the keyword in any case."""
    k = keyword.lower()
    question = F.exists(F.coalesce("markets", F.array().cast(T.ArrayType(MARKET))), lambda m: F.coalesce(F.contains(F.lower(m["question"]), F.lit(k)), F.lit(False)))
    return events.where(F.coalesce(F.contains(F.lower("title"), F.lit(k)), F.lit(False)) | question)


def page(events: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of events by id."""
    return events.orderBy("id").offset(offset).limit(limit)
