"""URL filters: longest-prefix rules, then a logistic regression on hashed n-grams.

Native: host and path, n-grams, hashing and scoring are SQL expressions inside
one projection, with no shuffle of the scored table.  Training reads only the
small labelled table: each round is a grouped sum, and the weights (at most
DIMENSIONS numbers) go back into the plan as one constant array.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled_urls import BLOCKED, ORDINARY, made_by_rule

#: Hash buckets of the n-grams, n-gram lengths, training rounds, step and ridge, and the probability from which a url is blocked.
DIMENSIONS, LENGTHS, ROUNDS, STEP, RIDGE, BLOCK_AT = 8192, (3, 4, 5), 30, 1.5, 0.00002, 0.5

# The rules (host, path) and what they decide.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or end, A-Z lower-cased; path: up to ? # or end; else empty."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    known = url.isNotNull() & (at > 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(known, lower).otherwise(""), F.when(known, path).otherwise("")


def ngram_buckets(host: Column, path: Column) -> Column:
    """Buckets of the distinct character n-grams of "^host" and of "path$"; n-grams of the two parts differ.

    A part is cut into characters once, which the inner functions take from the
    outer one's variable, so the work is linear in the url's length.
    """

    def hashed(tag: str, chars: Column, n: int) -> Column:
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(tag), F.concat(*[F.get(chars, i + k) for k in range(n)])), F.lit(DIMENSIONS)).cast("int"))

    def part(tag: str, text: Column) -> Column:
        return F.flatten(F.transform(F.array(F.split(text, "")), lambda chars: F.concat(*[hashed(tag, chars, n) for n in LENGTHS])))

    return F.array_distinct(F.concat(part("h:", F.concat(F.lit("^"), host, F.lit("$"))), part("p:", F.concat(path, F.lit("$")))))


def score(buckets: Column, weights: list[float]) -> Column:
    """Log-odds: the bias (last weight) plus the mean-scaled sum of the buckets' weights."""
    w = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    total = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(w, b))
    return total / F.sqrt(F.greatest(F.size(buckets), F.lit(1)).cast("double")) + F.lit(weights[-1])


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, bad) of labelled_urls.py, 1 for addresses to block: well-known ones, and those made by its rule."""
    rows = [(url, float(bad)) for bad, texts in ((1, BLOCKED), (0, ORDINARY)) for url in texts.split()] + [(url, float(bad)) for url, bad in made_by_rule()]
    return spark.createDataFrame(rows, "url string, bad double").coalesce(1)


def held_out(labelled: DataFrame, every: int = 4) -> tuple[DataFrame, DataFrame]:
    """The rows to learn from, and one host in so many, by its hash, to measure on."""
    host, _ = host_and_path(F.col("url"))
    apart = F.pmod(F.xxhash64(host), F.lit(every)) == 0
    return labelled.where(~apart), labelled.where(apart)


def measured(labelled: DataFrame, weights: list[float]) -> dict[str, float]:
    """Precision, recall and the share of ordinary addresses that are blocked, of the model without rules, on labelled urls."""
    judged = filter_urls(labelled.withColumn("page_id", F.col("bad")), weights, rules=[])
    blocked, bad = (F.col("verdict") == "block").cast("int"), F.col("page_id").cast("int")
    n, hits, of, rows = judged.agg(F.sum(blocked), F.sum(blocked * bad), F.sum(bad), F.count("*")).first()
    return {"precision": (hits or 0) / n if n else 1.0, "recall": (hits or 0) / of if of else 1.0, "false_positives": ((n or 0) - (hits or 0)) / max(1, rows - (of or 0))}


def train(labelled: DataFrame) -> list[float]:
    """Weights of DIMENSIONS buckets and the bias, by full-batch gradient steps in SQL.

    A weight's step shrinks with the root of its summed squared gradients.

    labelled(url, bad): rows with a null label are left out; an empty table
    gives zero weights, which allow everything.  A round sums the gradient by
    bucket over the labelled rows; only those sums, DIMENSIONS + 1 at most,
    reach the driver.
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("bad is not null").select(F.col("bad").cast("double").alias("bad"), ngram_buckets(host, path).alias("b")).persist()
    n = rows.count()
    # the labelled table is small, so a round is one task
    weights, squares = [0.0] * (DIMENSIONS + 1), [1e-12] * (DIMENSIONS + 1)
    for _ in range(ROUNDS if n else 0):
        error = (F.lit(1.0) / (1.0 + F.exp(-score(F.col("b"), weights))) - F.col("bad")).alias("e")
        scaled = rows.select("b", error, F.sqrt(F.size("b").cast("double")).alias("z"))
        terms = scaled.select(F.explode(F.concat("b", F.array(F.lit(DIMENSIONS)))).alias("j"), "e", "z")
        sums = terms.groupBy("j").agg(F.sum(F.when(F.col("j") == DIMENSIONS, F.col("e")).otherwise(F.col("e") / F.col("z"))).alias("g"))
        for j, g in sums.collect():
            slope = g / n + RIDGE * weights[j] * (j < DIMENSIONS)
            squares[j] += slope * slope
            weights[j] -= STEP * slope / squares[j] ** 0.5
    rows.unpersist()
    return weights


def filter_urls(pages: DataFrame, weights: list[float], rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judges every url: the longest fitting rule's verdict, else the model's.

    A rule fits its host and the host's subdomains if the path starts with the
    rule's; of equally long rules the one listed first wins.  Returns id, host,
    path, rule, verdict and the model's probability; one half itself is
    blocked.  Null urls and urls without :// have empty host and path and get
    the model's verdict on those; very long urls are read whole; repeated rows
    give repeated rows; null ids stay; other columns, whatever their names, are
    not read; an empty table gives an empty table.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url")).select(id_col, host.alias("host"), path.alias("path"))
    # longest rule first; of equally long ones the one listed first
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))

    def pick(value):
        out = F.lit(None).cast("string")
        for rule in reversed(ordered):
            fits = ((F.col("host") == rule[0]) | F.col("host").endswith("." + rule[0])) & F.col("path").startswith(rule[1])
            out = F.when(fits, F.lit(value(rule))).otherwise(out)
        return out

    p = F.lit(1.0) / (1.0 + F.exp(-score(ngram_buckets(F.col("host"), F.col("path")), weights)))
    ruled = base.select(id_col, "host", "path", pick(lambda r: r[0] + r[1]).alias("rule"), pick(lambda r: r[2]).alias("ruled"), p.alias("p_block"))
    return ruled.select(id_col, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("p_block") >= BLOCK_AT, "block").otherwise("allow")).alias("verdict"), "p_block")
