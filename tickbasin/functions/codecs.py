"""Clocks, sides, orderings and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ASK, BID, LEVELS
from .fixedpoint import price_from_text, price_text, size_from_text, size_text

#: Stamps below this are milliseconds.
MILLISECONDS_BELOW = 10_000_000_000_000
# Texts of the two sides.
BUY_WORDS, SELL_WORDS = ["BUY", "buy", "Bid", "bid"], ["SELL", "sell", "Ask", "ask"]


def _stamp(text: Column) -> Column:
    """A whole non-negative number, or null."""
    return F.regexp_extract(text, r"^\+?[0-9]+$", 0).try_cast("long")


def _microseconds(raw: Column) -> Column:
    """Milliseconds scaled; microseconds as they are."""
    return raw * F.when(raw < MILLISECONDS_BELOW, 1000).otherwise(1)


def feed_timestamp_us(text: Column) -> Column:
    """Microseconds of a feed stamp: milliseconds are scaled, missing and bad stamps are 0."""
    return F.coalesce(_microseconds(_stamp(text)), F.lit(0).cast("long"))


def rest_timestamp_us(text: Column, now_us: Column) -> Column:
    """Microseconds of a REST stamp: milliseconds (0 too) are scaled, missing and bad stamps are now."""
    return F.coalesce(_microseconds(_stamp(text)), now_us)


def side_code(text: Column) -> Column:
    """Side of a feed text, or null if it is unknown."""
    return F.when(text.isin(BUY_WORDS), F.lit(BID)).when(text.isin(SELL_WORDS), F.lit(ASK)).cast("tinyint")


def execution_side_code(text: Column) -> Column:
    """Side of an execution; null stays null, an unknown text raises."""
    known = F.when(text.isin("bid", "Bid"), F.lit(BID)).when(text.isin("ask", "Ask"), F.lit(ASK))
    return F.when(text.isNull(), F.lit(None)).otherwise(F.coalesce(known, F.raise_error(F.concat(F.lit("unknown side: "), text)).cast("int"))).cast("tinyint")


def code_name(code: Column, names: dict[int, str], strict: bool = False) -> Column:
    """Name of a code; an unknown code is null, or raises if strict."""
    out = None
    for key, name in names.items():
        out = F.when(code == key, name) if out is None else out.when(code == key, name)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown code: "), code.cast("string"))).cast("string")) if strict else out


def exchange_or_recv(exchange: Column, recv: Column) -> Column:
    """The exchange clock; 0 is unknown and falls back to the receive clock."""
    return F.when(exchange == 0, recv).otherwise(exchange)


def ordering_us(mode: str, recv: Column, exchange: Column) -> Column:
    """The clock that orders events in a mode."""
    return recv if mode == "recv_time" else exchange_or_recv(exchange, recv)


def levels_from_json(text: Column) -> Column:
    """Array of (price, size) raw values of a JSON list of levels."""
    return F.transform(F.from_json(text, LEVELS), lambda x: F.struct(price_from_text(x["price"]).alias("price"), size_from_text(x["size"]).alias("size")))


def levels_to_json(levels: Column) -> Column:
    """JSON list of levels with decimal texts of an array of raw (price, size)."""
    return F.to_json(F.transform(levels, lambda x: F.struct(price_text(x["price"]).alias("price"), size_text(x["size"]).alias("size"))))


def gap_text(asset: Column, expected: Column, observed: Column) -> Column:
    """Text of a sequence gap."""
    return F.format_string("orderbook %s: sequence gap %d -> %d (dropped %d updates)", asset, expected, observed, F.abs(observed - expected))


def stale_text(exchange: Column, latest: Column) -> Column:
    """Text of a stale snapshot."""
    return F.format_string("snapshot exchange timestamp %d <= latest accepted %d", exchange, latest)


def title_words(text: Column) -> Column:
    """snake_case to Title Case, the tails of words as they are."""
    words = F.split(text, "_")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def price_at_size(price: Column, size: Column) -> Column:
    """A level as "price @ size"; a dash if the price is missing."""
    return F.when(price.isNull(), "-").otherwise(F.concat(price_text(price), F.lit(" @ "), size_text(size)))


def bucket_5m(seconds: Column) -> Column:
    """Start of the five-minute bucket."""
    return seconds - seconds % 300


def market_slug(seconds: Column, prefix: str = "btc-updown-5m-") -> Column:
    """Slug of the five-minute market of a time."""
    return F.concat(F.lit(prefix), bucket_5m(seconds).cast("string"))


def date_and_hour(us: Column) -> tuple[Column, Column]:
    """UTC date and hour of a stamp, whatever the session's time zone."""
    day = F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(us / 86_400_000_000).cast("int"))
    return day, F.floor((us % 86_400_000_000) / 3_600_000_000).cast("int")
