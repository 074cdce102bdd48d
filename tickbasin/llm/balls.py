"""Dense groups of vectors, taken as balls before any comparison.

Two unit vectors within half the threshold's angle of one center are within the
threshold of each other, so a ball's members all link and none of their pairs
need be compared.  Balls are looked for where a cell of the forest would be too
large: a node's mean direction is the center of its dense group, if it has one;
what lies outside is split at the mean of a random projection and looked at
again.  A vector is in one ball at most, and a ball holds at least half a
cell's classes and 1/MOST_BALLS of all, so there are MOST_BALLS at most.

Vectors near a ball are either near all of it, by the center's distance alone,
or are compared with its members in blocks of BLOCK by BLOCK.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_sized, written

MOST_BALLS, BLOCK, LEVELS, SLACK = 4000, 2048, 40, 1e-6


def unit_rows(raw) -> np.ndarray:
    """Unit vectors in double precision of stored ones, all of the precision that their first byte names."""
    raw = list(raw)
    kind = np.float64 if raw[0][:1] == b"d" else np.float32
    x = np.stack([np.frombuffer(b, dtype=kind, offset=1) for b in raw]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(batch: pd.DataFrame) -> list[pd.DataFrame]:
    """The rows of a batch, apart by the length of their vectors."""
    return [rows for _, rows in batch.groupby(batch["raw"].map(len))] if len(batch) else []


def angles(unit: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Angles of rows to a direction."""
    return np.arccos(np.clip(unit @ center, -1, 1))


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the unit vectors of each node of a batch."""
    for batch in batches:
        for node, rows in batch.groupby("node"):
            unit = unit_rows(rows["raw"])
            yield pd.DataFrame({"node": [node], "n": [len(rows)], "total": [unit.sum(axis=0)]})


def means(rows: DataFrame, cell: int) -> DataFrame:
    """(node, mean): mean unit vectors of the nodes of more than cell rows."""
    sums = rows.select("node", "raw").mapInPandas(_sums, "node long, n long, total array<double>")
    parts = sums.select("node", "n", F.posexplode("total").alias("k", "x")).groupBy("node", "k").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    listed = parts.where(F.col("n") > cell).groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v"))
    return listed.select("node", F.transform("v", lambda s: s["x"] / F.col("n")).alias("mean"))


def extract(classes: DataFrame, cell: int, threshold: float) -> tuple[DataFrame, DataFrame] | None:
    """Members (rep, ball) and balls (ball, label, center, radius, copies, least) of the classes of large labels.

    None if there is no dense group.
    """
    spark = classes.sparkSession
    reach = float(np.arccos(threshold)) / 2 - SLACK
    least = max(cell // 2, classes.count() // MOST_BALLS)
    rows = classes.select("rep", "copies", "raw", "label", F.xxhash64("label").alias("node"))
    found = None

    for level in range(LEVELS):
        big, _ = written(means(rows, cell), "node-means")
        if not big.limit(1).count():
            break

        def look(batches: Iterator[pd.DataFrame], level: int = level) -> Iterator[pd.DataFrame]:
            for frame in batches:
                for batch in by_length(frame):
                    unit, mean = unit_rows(batch["raw"]), np.stack(batch["mean"])
                    size = np.linalg.norm(mean, axis=1)
                    cos = (unit * mean).sum(axis=1) / np.where(size > 0, size, 1)
                    along = np.random.default_rng([11, level]).standard_normal(unit.shape[1])
                    angle = np.where(size > 0, np.arccos(np.clip(cos, -1, 1)), 9.0)
                    out = batch[["rep", "copies", "raw", "label", "node"]].copy()
                    out["angle"], out["side"] = angle, (unit @ along > mean @ along).astype(np.int32)
                    yield out

        schema = "rep long, copies long, raw binary, label string, node long, angle double, side int"
        looked, _ = written(join_sized(rows, big, "node", "inner", 20_000).mapInPandas(look, schema), "nodes-looked-at")
        core = looked.where(F.col("angle") <= reach)
        dense = core.groupBy("node").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.sum("copies").alias("copies"), F.min("rep").alias("least"), F.first("label").alias("label")).where(F.col("n") >= least)
        balls, _ = written(dense.join(big, "node"), "balls")
        if balls.limit(1).count():
            members = join_sized(core, balls.select("node", "radius"), "node", "inner").select("rep", F.col("node").alias("ball"))
            held = balls.select(F.col("node").alias("ball"), "label", F.col("mean").alias("center"), "radius", "copies", "least")
            found = (members, held) if found is None else (found[0].unionByName(members), found[1].unionByName(held))
        rest = join_sized(looked, balls.select("node", F.lit(True).alias("dense")), "node", "left").where(F.col("dense").isNull() | (F.col("angle") > reach))
        rows, _ = written(rest.select("rep", "copies", "raw", "label", F.xxhash64("node", F.lit(level), "side").alias("node")), "nodes")
    if found is None:
        return None
    return written(found[0], "ball-members")[0], written(found[1], "balls")[0]


def links(classes: DataFrame, members: DataFrame, balls: DataFrame, threshold: float) -> DataFrame:
    """Links of and to the balls' members as partial sums: (rep, links, root)."""
    full = float(np.arccos(threshold))
    centers = balls.select("ball", "label", "center", "radius")
    own = classes.join(members, "rep", "left").withColumnRenamed("ball", "own")
    inside = join_sized(own.where("own is not null").select("rep", "copies", F.col("own").alias("ball")), balls.select("ball", F.col("copies").alias("total"), "least"), "ball", "inner")
    parts = inside.select("rep", (F.col("total") - F.col("copies")).alias("links"), F.col("least").alias("root"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for batch in by_length(frame):
                unit, center = unit_rows(batch["raw"]), np.stack(batch["center"])
                center /= np.linalg.norm(center, axis=1, keepdims=True)
                angle = np.arccos(np.clip((unit * center).sum(axis=1), -1, 1))
                out = batch[["rep", "copies", "raw", "ball"]].copy()
                out["near_all"] = angle + batch["radius"].to_numpy() <= full - SLACK
                yield out[angle - batch["radius"].to_numpy() <= full + SLACK]

    # a pair of members of two balls is met from one of them
    pairs = join_sized(own, centers, "label", "inner").where(F.col("own").isNull() | (F.col("own") < F.col("ball")))
    met, _ = written(pairs.select("rep", "copies", "raw", "ball", "center", "radius").mapInPandas(meet, "rep long, copies long, raw binary, ball long, near_all boolean"), "near-balls")
    sure = join_sized(met.where("near_all").select("rep", "copies", "ball"), balls.select("ball", F.col("copies").alias("total"), "least"), "ball", "inner")
    parts = parts.unionByName(sure.select("rep", F.col("total").alias("links"), F.col("least").alias("root")))
    gained, _ = written(sure.groupBy("ball").agg(F.sum("copies").alias("gain")), "ball-gains")
    to_members = join_sized(inside.select("rep", "ball", "least"), gained, "ball", "inner")
    parts = parts.unionByName(to_members.select("rep", F.col("gain").alias("links"), F.col("least").alias("root")))

    unsure = met.where("not near_all").select("rep", "copies", "raw", "ball")
    sizes, _ = written(unsure.groupBy("ball").agg(F.count("*").alias("outside")).join(members.groupBy("ball").agg(F.count("*").alias("within")), "ball").join(balls.select("ball", "least"), "ball").select(
        "ball", "least", F.ceil(F.col("outside") / BLOCK).alias("rows"), F.ceil(F.col("within") / BLOCK).alias("columns")), "ball-blocks")
    if not sizes.limit(1).count():
        return parts

    def dealt(side: DataFrame, mine: str, other: str, is_member: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("rep"), F.col(mine))
        across = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        return join_sized(side, sizes, "ball", "inner").select("ball", "least", "rep", "copies", "raw", F.lit(is_member).alias("is_member"), block.alias(mine[0]), across.alias(other[0]))

    held = own.where("own is not null").select("rep", "copies", "raw", F.col("own").alias("ball"))
    both = dealt(unsure, "rows", "columns", False).unionByName(dealt(held, "columns", "rows", True))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        ins, outs = frame[frame["is_member"]], frame[~frame["is_member"]]
        if not len(ins) or not len(outs):
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        hit = unit_rows(outs["raw"]) @ unit_rows(ins["raw"]).T >= threshold
        linked = hit.astype(np.float64)
        rep = np.concatenate([outs["rep"], ins["rep"]])
        n = np.concatenate([linked @ ins["copies"].to_numpy(np.float64), linked.T @ outs["copies"].to_numpy(np.float64)]).astype(np.int64)
        return pd.DataFrame({"rep": rep, "links": n, "root": frame["least"].iloc[0]})[n > 0]

    return parts.unionByName(both.groupBy("ball", "r", "c").applyInPandas(compare, "rep long, links long, root long"))
