"""Benchmark decontamination by spaced seeds.

Native: every step is a DataFrame or SQL expression.  A seed is a fixed mask
over consecutive tokens that ignores some positions, so a window still hashes
alike when an ignored token was replaced.  Inside the projection that makes a
text's windows, a bit table of the benchmark's hashes drops nearly all of them
before any row is made of one.  The others are joined with the benchmark's
windows by hash, and a text and an item that share some are verified: at every
shift that two windows suggest or, where a text repeats itself so much that
these are more than the shifts there are, at every shift.

Texts are told apart by a 128-bit hash, not by ids, so copies of a text are
searched as one and neither a hot nor a null id gathers the hits of different
texts.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fewest_partitions, fresh, join_sized, kept, workspace, written

# The seeds; 1 compares a token, 0 ignores it.  Together they hit every stretch of 10 to 20 tokens that SHARE
# admits, whichever tokens are replaced; shorter items have seeds of their own, by their length (tests try all choices).
SEEDS = ("1101011", "11111", "110001011")
SHORT_SEEDS = {5: ("1111", "11101", "11011", "10111"), 4: ("1111",), 3: ("111",), 2: ("11",), 1: ("1",)}
#: The stretch that is verified, and the share of its tokens that must agree.
STRETCH, SHARE = 20, 0.8
#: Items of fewer tokens occur in ordinary texts by chance, so only a text that is the item and nothing else holds them.
LEAST_TOKENS = 3
#: Bits of the table of hashes: at least so many for each, within bounds.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 12, 1 << 23


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hashes(tokens: Column, seed: str) -> Column:
    """One hash for each place of the seed, in order; none if the text is shorter."""
    n = F.size(tokens) - len(seed)
    starts = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    places = [k for k, c in enumerate(seed) if c == "1"]
    return F.transform(starts, lambda i: F.xxhash64(F.lit(seed), *[F.get(tokens, i + k) for k in places]))


def seeds_for(n: int) -> tuple[str, ...]:
    """The seeds by which items of n tokens are looked for."""
    return SEEDS if n >= 10 else SHORT_SEEDS[5] if n >= 5 else SHORT_SEEDS[n]


def text_key(text: Column) -> Column:
    """A 128-bit hash of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))


def windows(seeds: list[str]) -> Column:
    """All windows (place, hash) of the column tokens."""
    parts = [F.transform(window_hashes(F.col("tokens"), s), lambda h, i: F.struct(i.alias("place"), h.alias("hash"))) for s in seeds]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def bit_table(hashes: DataFrame, n: int) -> tuple[Column, int]:
    """The table of n hashes as a constant array of 32-bit words, and how many these are, a power of two.

    A hash that is in the table always passes; with BITS_EACH bits for a hash
    about 1 in BITS_EACH others does, and more beyond MOST_BITS bits.
    """
    bits = LEAST_BITS
    while bits < min(MOST_BITS, n * BITS_EACH):
        bits *= 2
    table = [0] * (bits // 32)
    word, bit = places_of(F.col("hash"), len(table))
    for w, b in hashes.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("b")).collect():  # a row for each word at most
        table[w] = b
    return F.from_json(F.lit(json.dumps(table)), "array<bigint>"), len(table)


def places_of(h: Column, words: int) -> tuple[Column, Column]:
    """Word and bit of a hash in a table of so many words."""
    return F.shiftrightunsigned(h, 5).bitwiseAND(words - 1).cast("int"), h.bitwiseAND(31).cast("int")


def passes(table: tuple[Column, int], h: Column) -> Column:
    """Whether a hash may be in the table."""
    word, bit = places_of(h, table[1])
    return F.getbit(F.get(table[0], word), bit) == 1


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds the documents that hold a passage of a benchmark item; see contaminated_texts().

    Returns one row per document id and item: id, item_id, matched, stretch
    and position.  Rows of one id count together, null ids as one id; of several
    texts the most tokens and then the first position count.
    """
    held = contaminated_texts(docs, benchmark, text_col)
    rows = join_sized(docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key")), held, "key", "inner")
    best = F.max(F.struct("matched", (-F.col("position")).alias("back"))).alias("best")
    top = rows.groupBy("id", "item_id", "stretch").agg(best)
    return top.select(F.col("id").alias(id_col), "item_id", "best.matched", "stretch", (-F.col("best.back")).alias("position"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, tokens, n) of the items that have tokens; those of equal tokens are one, of the smallest item_id."""
    tokens = benchmark.select("item_id", token_hashes(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    return tokens.groupBy("tokens").agg(F.min("item_id").alias("item_id")).select("item_id", "tokens", F.size("tokens").alias("n"))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Finds the texts that hold a passage of a benchmark item.

    An item is held if, at some shift, at least SHARE of the tokens of some
    stretch of STRETCH of its tokens (of the whole item, if it is shorter)
    equal the text's; the seeds miss none of these.  An item of four or three
    tokens is thus held only whole; one of two or one is held by a text that
    has no other tokens.  Items without tokens are not looked for; items of
    equal tokens count as one, named by the smallest item_id.

    Returns one row per text and item: key (of text_key()), item_id, matched,
    stretch and position (the token of the text at which the stretch starts; of
    ties the first).  Null and empty texts hold nothing; very long texts are
    searched whole; other columns, whatever their names, are not read; an empty
    table gives an empty table.
    """
    with workspace(docs.sparkSession):
        items, _ = written(items_of(benchmark), "items")
        kinds = [r.k for r in items.select(F.when(F.col("n") >= 10, 10).when(F.col("n") >= 5, 5).otherwise(F.col("n")).alias("k")).distinct().collect()] or [10]
        seeds = sorted({s for k in kinds for s in seeds_for(k)})
        parts = []
        for k in kinds:
            under = {10: F.lit(True), 5: F.col("n") < 10}.get(k, F.col("n") == k)
            some = items.where((F.col("n") >= k) & under).select("item_id", F.explode(windows(list(seeds_for(k)))).alias("w"))
            parts.append(some.select("item_id", "w.place", "w.hash"))
        # the places of a hash in an item, and the items of a hash
        places = reduce(DataFrame.unionByName, parts).groupBy("hash", "item_id").agg(F.collect_list("place").alias("item_places"))
        wanted, _ = written(places, "item-windows")
        table = bit_table(wanted, wanted.count())

        key = text_key(F.col(text_col)).alias("key")
        read = docs.select(key, token_hashes(F.col(text_col)).alias("tokens"))
        some = F.filter(windows(seeds), lambda w: passes(table, w["hash"]))
        seen = read.select("key", F.size("tokens").alias("of"), F.explode(some).alias("w")).select("key", "of", "w.place", "w.hash")
        # copies of a text make equal rows
        grouped = join_sized(seen, wanted.select("hash").distinct(), "hash", "left_semi").groupBy("key", "of", "hash").agg(F.collect_set("place").alias("places"))
        met = join_sized(grouped, wanted, "hash", "inner")
        pairs = F.sum(F.size("places").cast("long") * F.size("item_places")).alias("pairs")
        # lists whose product is more than all shifts are not kept
        few = F.size("places").cast("long") * F.size("item_places") <= F.col("of")
        lists = F.collect_list(F.when(few, F.struct("places", "item_places"))).alias("lists")
        hits, _ = written(met.groupBy("key", "of", "item_id").agg(pairs, lists).select(F.col("key").alias("hit"), "of", "item_id", "pairs", "lists"), "seed-hits")

        hits = hits.repartition(fewest_partitions(hits.count(), 500, docs.sparkSession.sparkContext.defaultParallelism), "hit", "item_id")
        texts, _ = written(hits.select("hit").distinct(), "hit-texts")
        again = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), key)
        found = join_sized(again, texts, F.col("key") == F.col("hit"), "inner").groupBy("key").agg(F.first("text").alias("text"))
        held, _ = written(found.select("key", token_hashes(F.col("text")).alias("tokens")), "hit-tokens")
        both = join_sized(join_sized(hits, held, F.col("key") == F.col("hit"), "inner"), items.withColumnRenamed("tokens", "item"), "item_id", "inner")

        suggested = F.flatten(F.transform("lists", lambda x: F.flatten(F.transform(x["places"], lambda p: F.transform(x["item_places"], lambda q: p - q)))))
        every = F.sequence(1 - F.col("n"), F.col("of") - 1)
        shifts = F.when(F.col("n") < LEAST_TOKENS, F.when(F.col("of") == F.col("n"), F.array(F.lit(0)))).when(F.col("pairs") <= F.col("of"), F.array_distinct(suggested)).otherwise(every)
        aligned = both.select("key", "item_id", "n", F.least("n", F.lit(STRETCH)).alias("stretch"), "tokens", "item", shifts.alias("shifts"))
        least = F.ceil(F.col("stretch") * SHARE)

        def agreement(shift: Column) -> Column:
            """A mark for each token of the item: 1 if the text has it at the shift."""
            marks = F.transform("item", lambda t, i: F.when(F.get(F.col("tokens"), i + shift) == t, "1").otherwise("0"))
            return F.struct(shift.alias("shift"), F.array_join(marks, "").alias("marks"))

        def ones(marks: Column) -> Column:
            return F.length(F.replace(marks, F.lit("0"), F.lit("")))

        def best_stretch(at: Column) -> Column:
            whole = F.instr(at["marks"], F.repeat(F.lit("1"), F.col("stretch")))
            stretches = F.sequence(F.lit(0), F.col("n") - F.col("stretch"))
            most = F.array_max(F.transform(stretches, lambda i: F.struct(ones(F.substring(at["marks"], i + 1, F.col("stretch"))).alias("matched"), (-(at["shift"] + i)).alias("back"))))
            return F.when(whole > 0, F.struct(F.col("stretch").alias("matched"), (1 - whole - at["shift"]).alias("back"))).otherwise(most)

        enough = F.filter(F.transform("shifts", agreement), lambda at: ones(at["marks"]) >= least)
        best = aligned.select("key", "item_id", "stretch", F.array_max(F.transform(enough, best_stretch)).alias("best"))
        top = best.where(F.col("best.matched") >= least)
        return kept(top.select("key", "item_id", F.col("best.matched").cast("long").alias("matched"), F.col("stretch").cast("long").alias("stretch"), (-F.col("best.back")).cast("long").alias("position")), "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without the rows whose text holds a benchmark passage; see contaminated_texts().

    All columns stay, whatever their names; null and empty texts, null ids and
    repeated rows stay unless their text is contaminated; an empty table gives
    an empty table, an empty benchmark leaves all rows.
    """
    gone = fresh(docs, "gone")
    texts = kept(contaminated_texts(docs, benchmark, text_col).select(F.col("key").alias(gone)).distinct(), "contaminated")
    return join_sized(docs, texts, text_key(F.col(text_col)) == F.col(gone), "left_anti")
