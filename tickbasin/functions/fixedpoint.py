"""Fixed-point prices and sizes: prices are INT of 1/10,000 in 0..10,000, sizes BIGINT of 1/1,000,000."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE_SCALE, SIZE_SCALE = 10_000, 1_000_000
#: What a decimal text may look like: no white space, no type suffix.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: The first double that a BIGINT does not hold.
TOO_LARGE = 9.223372036854775807e18


# The functions name their argument as rarely as they can: it may be a long
# expression itself, and Catalyst copies it to every place.  NaN is above every
# number, so the upper bounds turn it away too.


def price_from_double(value: Column) -> Column:
    """Raw price, half away from zero, or null if the value is negative, not finite or above 1."""
    scaled = value * float(PRICE_SCALE)
    return F.when((scaled >= 0) & (scaled < PRICE_SCALE + 0.5), F.round(scaled)).cast("int")


def size_from_double(value: Column) -> Column:
    """Raw size, half away from zero, or null if the value is negative, not finite or beyond BIGINT."""
    scaled = value * float(SIZE_SCALE)
    return F.when((scaled >= 0) & (scaled < TOO_LARGE), F.round(scaled)).cast("long")


def _number(text: Column) -> Column:
    return F.regexp_extract(text, NUMBER, 0).try_cast("double")


def price_from_text(text: Column) -> Column:
    """Raw price of a decimal text, or null."""
    return price_from_double(_number(text))


def size_from_text(text: Column) -> Column:
    """Raw size of a decimal text, or null."""
    return size_from_double(_number(text))


def price_value(raw: Column) -> Column:
    """The price as a double."""
    return raw / F.lit(float(PRICE_SCALE))


def size_value(raw: Column) -> Column:
    """The size as a double."""
    return raw / F.lit(float(SIZE_SCALE))


def price_text(raw: Column) -> Column:
    """The price with four decimals."""
    return F.when(raw.isNotNull(), F.call_function("printf", F.lit("%d.%04d"), F.call_function("div", raw, F.lit(PRICE_SCALE)), (raw % PRICE_SCALE).cast("long")))


def size_text(raw: Column) -> Column:
    """The size with six decimals; whole-number arithmetic keeps large sizes exact."""
    return F.when(raw.isNotNull(), F.call_function("printf", F.lit("%d.%06d"), F.call_function("div", raw, F.lit(SIZE_SCALE)), (raw % SIZE_SCALE).cast("long")))


def mid(bid: Column, ask: Column) -> Column:
    """Middle of the best prices; null if one is missing."""
    return (price_value(bid) + price_value(ask)) / 2


def spread(bid: Column, ask: Column) -> Column:
    """Best ask less best bid."""
    return price_value(ask) - price_value(bid)


def weighted_mid(bid: Column, bid_size: Column, ask: Column, ask_size: Column) -> Column:
    """Best prices weighted by the other side's size; the middle if both sizes are 0."""
    b, a, bs, asz = price_value(bid), price_value(ask), size_value(bid_size), size_value(ask_size)
    total = bs + asz
    return F.when(total == 0, mid(bid, ask)).otherwise((b * asz + a * bs) / F.nullif(total, F.lit(0.0)))
