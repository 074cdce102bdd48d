import math
import random

import pytest
from pyspark.sql import functions as F

from tickbasin.errors import BadRequest, EngineError, RateLimited
from tickbasin.functions import codecs, fixedpoint
from tickbasin.operators import book
from tickbasin.plans import guards
from tickbasin.sources import feed


def prices(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    return {r.t: (r.p, r.s) for r in df.select("t", fixedpoint.price_from_text(F.col("t")).alias("p"), fixedpoint.size_from_text(F.col("t")).alias("s")).collect()}


def test_texts_to_fixed_point(spark):
    got = prices(spark, ["0.5", "0.1234", "1", "1.00004", "1.00005", "-0.5", "nan", "inf", "x", " 0.5 ", "1d", "1e-2", ".5", "5.", "0.00005", "0.49999999999999994", "100.5", "123.456789", "1e300", "", "+0.25"])
    assert got["0.5"] == (5000, 500_000) and got["0.1234"] == (1234, 123_400) and got["1"] == (10_000, 1_000_000)
    assert got["1.00004"][0] == 10_000 and got["1.00005"][0] is None
    assert got["100.5"] == (None, 100_500_000) and got["123.456789"][1] == 123_456_789
    for bad in ("-0.5", "nan", "inf", "x", " 0.5 ", "1d", ""):
        assert got[bad] == (None, None), bad
    assert got["1e-2"][0] == 100 and got[".5"][0] == 5000 and got["5."] == (None, 5_000_000) and got["+0.25"][0] == 2500
    assert got["0.00005"][0] == 1 and got["1e300"] == (None, None)


def test_doubles_to_fixed_point(spark):
    values = [0.5, float("nan"), float("inf"), -0.5, 1.0, 0.0, 0.99995]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.p for r in df.select(fixedpoint.price_from_double(F.col("v")).alias("p")).collect()] == [5000, None, None, None, 10000, 0, 10000]


def test_round_trip_and_order(spark):
    rng = random.Random(5)
    raws = [(rng.randint(0, 10_000), rng.randint(0, 10**15)) for _ in range(300)] + [(0, 0), (10_000, 2**62)]
    df = spark.createDataFrame(raws, "p int, s long")
    out = df.select("p", "s", fixedpoint.price_text(F.col("p")).alias("pt"), fixedpoint.size_text(F.col("s")).alias("st"))
    for r in out.withColumns({"p2": fixedpoint.price_from_text(F.col("pt"))}).collect():
        assert r.p2 == r.p and r.pt == f"{r.p // 10_000}.{r.p % 10_000:04d}" and r.st == f"{r.s // 10**6}.{r.s % 10**6:06d}"


def test_stamps(spark):
    df = spark.createDataFrame([("100",), ("1757908892351",), ("1700000000000000",), ("0",), (None,), ("x",), ("-1",), (" 1",)], "t string")
    rows = df.select("t", codecs.feed_timestamp_us(F.col("t")).alias("f"), codecs.rest_timestamp_us(F.col("t"), F.lit(9).cast("long")).alias("r")).collect()
    assert [(r.f, r.r) for r in rows] == [(100_000, 100_000), (1757908892351000, 1757908892351000), (1700000000000000, 1700000000000000), (0, 0), (0, 9), (0, 9), (0, 9), (0, 9)]


def test_sides_and_codes(spark):
    df = spark.createDataFrame([("bid",), ("Ask",), (None,)], "s string")
    assert [r[0] for r in df.select(codecs.execution_side_code(F.col("s"))).collect()] == [1, 2, None]
    with pytest.raises(Exception, match="unknown side"):
        spark.createDataFrame([("BUY",)], "s string").select(codecs.execution_side_code(F.col("s"))).collect()
    with pytest.raises(Exception, match="unknown code"):
        spark.createDataFrame([(3,)], "c int").select(codecs.code_name(F.col("c"), {1: "Bid"}, strict=True)).collect()


def test_levels_json_shape(spark):
    df = spark.sql("select array(named_struct('price', 5000, 'size', 100000000L)) l")
    text = df.select(codecs.levels_to_json(F.col("l")).alias("t")).first().t
    assert text == '[{"price":"0.5000","size":"100.000000"}]'
    assert df.select(codecs.levels_from_json(F.lit(text)).alias("l")).first().l[0].asDict() == {"price": 5000, "size": 100_000_000}


def test_display_and_buckets(spark):
    r = spark.range(1).select(codecs.title_words(F.lit("sequence_gap")), codecs.price_at_size(F.lit(5000), F.lit(1_500_000).cast("long")), codecs.market_slug(F.lit(1700000123).cast("long")), codecs.bucket_5m(F.lit(1700000123).cast("long"))).first()
    assert tuple(r) == ("Sequence Gap", "0.5000 @ 1.500000", "btc-updown-5m-1700000100", 1700000100)


def test_guards():
    assert guards.time_window(0, 10) == (0, 10) and guards.depth(None) == 20 and guards.limit(None) == 100 and guards.mode(None) == "recv_time"
    for bad in (lambda: guards.time_window(200, 100), lambda: guards.time_window(0, guards.DAY_US + 1), lambda: guards.depth(0), lambda: guards.depth(201), lambda: guards.limit(0), lambda: guards.limit(1001), lambda: guards.mode("x"), lambda: guards.source("x")):
        with pytest.raises(BadRequest):
            bad()
    assert guards.tokens(" a, ,b") == ["a", "", "b"] and guards.tokens(" a, ,b", True) == ["a", "b"]


def test_client_side():
    feed.check_status(204)
    with pytest.raises(RateLimited):
        feed.check_status(429)
    with pytest.raises(EngineError):
        feed.check_status(500)
    assert feed.requests_per_second() == 150 and feed.requests_per_second(1, 10) == 1
    assert [feed.backoff_ms(k, 100, 3000) for k in (0, 1, 5, 40)] == [100, 200, 3000, 3000] and feed.backoff_ms(0, 100, 3000, 0.9) == 122
    assert feed.discovery_delays_ms() == [2000, 4000, 8000, 8000]


BOOK = [(1, 5000, 100), (1, 4900, 200), (1, 4800, 300), (2, 5500, 150), (2, 5600, 250)]


def levels(spark, rows):
    return spark.createDataFrame([(1, "a", s, p, z * 1_000_000) for s, p, z in rows], "query_id long, asset_id string, side int, price int, size long")


def test_book_fixture(spark):
    df = levels(spark, BOOK)
    top, total = book.top_of_book(df).first(), book.depth_totals(df).first()
    assert (top.best_bid, top.best_ask, total.bid_depth, total.ask_depth) == (5000, 5500, 3, 2)
    assert math.isclose(top.mid, 0.525) and math.isclose(top.spread, 0.05) and math.isclose(top.weighted_mid, 0.52)
    assert (total.bid_total, total.ask_total) == (600_000_000, 400_000_000)
    assert sorted((r.side, r["rank"], r.price) for r in book.top_n(df, 2).collect()) == [(1, 1, 5000), (1, 2, 4900), (2, 1, 5500), (2, 2, 5600)]
    nested = book.nested(df, depth=1).first()
    assert [x.price for x in nested.bids] == [5000] and [x.price for x in nested.asks] == [5500]
    assert not book.crossed(df).first().crossed and book.crossed(levels(spark, [(1, 6000, 1), (2, 5000, 1)])).first().crossed and book.crossed(levels(spark, [(1, 5000, 1), (2, 5000, 1)])).first().crossed


def test_one_sided_and_empty_books(spark):
    top = book.top_of_book(levels(spark, [(1, 5000, 1)])).first()
    assert top.best_ask is None and top.mid is None and top.spread is None and top.weighted_mid is None
    assert book.top_of_book(levels(spark, BOOK).limit(0)).count() == 0


def test_random_books_hold_invariants(spark):
    rng = random.Random(11)
    rows = [(q, "a", s, p, rng.randint(1, 10**9)) for q in range(60) for s in (1, 2) for p in rng.sample(range(1, 5000) if s == 1 else range(5000, 10_000), rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "query_id long, asset_id string, side int, price int, size long")
    for r in book.top_of_book(df).join(book.depth_totals(df), ["query_id", "asset_id"]).collect():
        own = [x for x in rows if x[0] == r.query_id]
        assert r.spread >= 0 and r.best_bid / 1e4 <= r.mid <= r.best_ask / 1e4 and r.best_bid / 1e4 - 1e-12 <= r.weighted_mid <= r.best_ask / 1e4 + 1e-12
        assert r.bid_total == sum(x[4] for x in own if x[2] == 1) and r.ask_depth == sum(x[2] == 2 for x in own)
