"""Embedding near-duplicates by a forest of random-projection trees.

Equal vectors of a label become one class with a count.  The trees deal the
classes to cells: a node of more than CELL classes is split at the mean of a
random projection, and classes near the split go to both sides, until every
cell fits in a task; a label that fits at once is one cell.  A cell is a leaf of
the forest: all its pairs are compared, in double precision and in blocks of
LEAF rows.  Classes that share several cells are compared in the first of them
only.  Tasks report link counts and links to the first of each local component,
never pairs.

Two kinds of large groups do not survive splits.  Dense ones are taken out
first, as balls whose members all link (see balls.py).  A node in which a sample
finds more than DENSE of all pairs linked, a loose group whose pairs lie around
the threshold, is not split: it is a cell of any size, compared by pairs of
blocks in as many tasks, work in proportion to the links that it holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import balls
from .balls import by_length, unit_rows
from .common import connected_components, delete_path, join_sized, keep, kept, workspace, written

THRESHOLD = 0.93
#: Classes of a cell at most; rows of a cell compared at once; trees; spill as a share of the projections' deviation; levels.
CELL, LEAF, TOP_TREES, SPILL, LEVELS = 8192, 1024, 3, 0.15, 40
#: Classes of a node whose pairs are looked at, about, and the share of linked pairs from which it is not split.
SAMPLE, DENSE = 256, 1 / 32


def components(linked: np.ndarray) -> np.ndarray:
    """For each row of a link table the first row of its component."""
    n = len(linked)
    root, free = np.arange(n), np.ones(n, dtype=bool)
    for first in np.flatnonzero(linked.any(axis=1)):
        if free[first]:
            front = np.array([first])
            free[first] = False
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & free)
                free[front] = False
                root[front] = first
    return root


def compare_cell(unit: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The link table of a cell's rows, every pair compared (no row links itself)."""
    n = len(unit)
    linked = np.zeros((n, n), dtype=bool)
    for i in range(0, n, LEAF):
        for j in range(i, n, LEAF):
            hit = unit[i : i + LEAF] @ unit[j : j + LEAF].T >= threshold
            linked[i : i + LEAF, j : j + LEAF] = hit
            linked[j : j + LEAF, i : i + LEAF] = hit.T
    np.fill_diagonal(linked, False)
    return linked


def usable(vector, double: bool) -> bytes | None:
    """The vector's bytes in its own precision, or None if it is null or zero or has a null or non-finite component."""
    if vector is None or not len(vector):
        return None
    x = np.asarray(vector, dtype=np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    return (x + 0.0).astype(np.float64 if double else np.float32).tobytes()


def grow(classes: DataFrame, large: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Cells (rep, cell) of the classes of large labels, and the cells (cell, blocks) that are compared by blocks.

    A level's table holds the classes of nodes that are still too large, once
    for each node, and is deleted when the next one is written; classes whose
    node has become small enough leave it with the node's name.
    """

    def projected(rows: DataFrame, level: int) -> DataFrame:
        """With the place of each class along its tree's random direction."""

        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                for batch in by_length(frame):
                    unit = unit_rows(batch["raw"])
                    directions = np.random.default_rng([7, level]).standard_normal((TOP_TREES, unit.shape[1]))
                    yield batch.assign(along=(unit * directions[batch["tree"].to_numpy()]).sum(axis=1))

        return rows.mapInPandas(project, "rep long, raw binary, tree int, node long, along double")

    def linked_share(frame: pd.DataFrame) -> pd.DataFrame:
        unit = unit_rows(frame["raw"])
        n = len(unit)
        share = ((unit @ unit.T >= threshold).sum() - n) / max(1, n * (n - 1))
        return pd.DataFrame({"node": [frame["node"].iloc[0]], "share": [float(share)]})

    spark = classes.sparkSession
    trees = F.explode(F.array(*[F.lit(t) for t in range(TOP_TREES)]))
    start = join_sized(classes.select("rep", "label", "raw"), large, "label", "left_semi").select("rep", "raw", trees.alias("tree"), F.xxhash64("label").alias("label"))
    rows = start.select("rep", "raw", "tree", F.xxhash64("label", "tree").alias("node"))
    closed, blocks, moved = [], [], None
    for level in range(LEVELS):
        with workspace(spark):
            now, _ = written(projected(rows, level), "nodes")
            if moved:
                delete_path(spark, moved)
            stats, _ = written(now.groupBy("node").agg(F.count("*").alias("n"), F.avg("along").alias("cut"), F.stddev_pop("along").alias("spread")), "node-sizes")
            big, _ = written(stats.where(F.col("n") > CELL), "large-nodes")
            closed.append(kept(join_sized(now, big.select("node"), "node", "left_anti").select("rep", F.col("node").alias("cell")), "cells"))
            if not big.limit(1).count():
                break
            chosen = F.pmod(F.xxhash64("rep", F.lit(level)), F.col("n")) < SAMPLE
            sample = join_sized(now, big.select("node", "n"), "node", "inner").where(chosen).select("node", "raw")
            dense, _ = written(sample.groupBy("node").applyInPandas(linked_share, "node long, share double").where(F.col("share") >= (DENSE if level < LEVELS - 1 else -1)), "dense-nodes")
            kept_whole = big.join(dense, "node", "left_semi").select(F.col("node").alias("cell"), F.ceil(2 * F.col("n") / CELL).cast("int").alias("blocks"))
            blocks.append(kept(kept_whole, "dense-cells"))
            closed.append(kept(join_sized(now, dense, "node", "left_semi").select("rep", F.col("node").alias("cell")), "cells"))
            split = join_sized(now, big.join(dense, "node", "left_anti"), "node", "inner")
            margin = SPILL * F.col("spread")
            sides = F.filter(F.array(F.when(F.col("along") <= F.col("cut") + margin, F.lit(0)), F.when(F.col("along") > F.col("cut") - margin, F.lit(1))), lambda s: s.isNotNull())
            parts = split.select("rep", "raw", "tree", "node", F.explode(sides).alias("side"))
            rows, moved = written(parts.select("rep", "raw", "tree", F.xxhash64("node", F.lit(level), "side").alias("node")), "split-nodes")
            keep(moved)
    cells = closed[0]
    for more in closed[1:]:
        cells = cells.unionByName(more)
    listed = blocks[0] if blocks else None
    for more in blocks[1:]:
        listed = listed.unionByName(more)
    return cells, listed


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Links vectors of one label whose cosine reaches the threshold.

    Returns one row per row: id, n_links (other rows linked directly),
    component_id (smallest id reachable) and kept (id = component_id).  Rows
    with a null label, a null or zero vector, or a null or non-finite component
    link with nothing, nor do vectors of different lengths.  Components keep
    their own precision and are compared in double precision.  Ids are integers;
    rows of one id are one node of the components.  A row of a null id has no
    component, is not kept and is no link of others, but counts those that it
    links with.  A cosine of the threshold itself links.  Vectors of any length
    are read whole; other columns, whatever their names, are not read; an empty
    table gives an empty table.
    """
    spark = vectors.sparkSession
    double = "double" in vectors.schema[vector_col].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [usable(v, double) if label is not None else None for v, label in zip(batch["v"], batch["label"], strict=True)]
            key = [hashlib.blake2b(f"{label}\0{len(b)}\0".encode() + b, digest_size=16).digest() if b else None for b, label in zip(raw, batch["label"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "key": key, "label": [f"{label}/{len(b) // (8 if double else 4)}/{'d' if double else 'f'}" if b else None for b, label in zip(raw, batch["label"], strict=True)], "raw": raw})

    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    rows = base.mapInPandas(read, "id long, key binary, label string, raw binary")
    with workspace(spark):
        # sums of a class's rows before the shuffle; its least id names it
        grouped = rows.where("key is not null and id is not null").groupBy("key", "label").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
        everything, _ = written(grouped.withColumn("raw", F.when(F.lit(double), F.concat(F.lit(b"d"), "raw")).otherwise(F.concat(F.lit(b"f"), "raw"))), "vector-classes")
        classes = everything

        def large_labels() -> DataFrame:
            return written(classes.groupBy("label").count().where(F.col("count") > CELL).select("label"), "large-labels")[0]

        large = large_labels()
        dense = balls.extract(join_sized(classes, large, "label", "left_semi"), CELL, threshold) if large.limit(1).count() else None
        if dense:
            classes = everything.join(dense[0].select("rep"), "rep", "left_anti")
            large = large_labels()
        blocks = None
        dealt = classes.select("rep", "copies", "raw", F.array(F.xxhash64("label")).alias("cells"))
        if large.limit(1).count():
            cells, blocks = grow(classes, large, threshold)
            cells, _ = written(cells.groupBy("rep").agg(F.array_sort(F.collect_set("cell")).alias("found")), "cells")
            dealt = dealt.join(cells, "rep", "left").select("rep", "copies", "raw", F.coalesce("found", "cells").alias("cells"))

        def cell_links(frame: pd.DataFrame) -> pd.DataFrame:
            """Links of a cell, or of two blocks of one: what an earlier cell or another task holds is counted there."""
            frame = frame.sort_values("rep")
            unit, copies, rep = unit_rows(frame["raw"]), frame["copies"].to_numpy(np.int64), frame["rep"].to_numpy(np.int64)
            cell, block = int(frame["cell"].iloc[0]), frame["block"].to_numpy()
            linked = compare_cell(unit, threshold)
            roots = components(linked)
            if frame["i"].iloc[0] != frame["j"].iloc[0]:
                linked &= block[:, None] != block[None]
            earlier = [{int(c) for c in cells if c < cell} for cells in frame["cells"]]
            for c in sorted(set().union(*earlier)):
                inside = np.array([c in cells for cells in earlier])
                linked[np.ix_(inside, inside)] = False
            links = np.concatenate([linked[k : k + 256] @ copies for k in range(0, len(copies), 256)])
            return pd.DataFrame({"rep": rep, "links": links, "root": rep[roots]})

        per_cell = dealt.select("rep", "copies", "raw", "cells", F.explode("cells").alias("cell"))
        if blocks is None:
            per_cell = per_cell.select("*", F.lit(0).alias("block"), F.lit(0).alias("i"), F.lit(0).alias("j"))
        else:
            per_cell = join_sized(per_cell, blocks, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            per_cell = per_cell.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
            pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
            per_cell = per_cell.withColumn("p", F.explode(pairs)).select("rep", "copies", "raw", "cells", "cell", "block", "p.i", "p.j")
        found = per_cell.groupBy("cell", "i", "j").applyInPandas(cell_links, "rep long, links long, root long")
        if dense:
            near = join_sized(everything, dense[1].select("label").distinct(), "label", "left_semi")
            found = found.unionByName(balls.links(near, *dense, threshold))
        found, _ = written(found, "cell-links")
        sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
        joined, _ = written(connected_components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))), "components")
        named = everything.select("key", "rep", "copies").join(sums, "rep").join(joined, F.col("rep") == F.col("id"), "left")
        named = kept(named.select("key", (F.col("copies") - 1 + F.col("links")).alias("links"), F.coalesce("component", "rep").alias("component")), "named-classes")
    final = join_sized(rows.select("id", "key"), named, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    # a row of a null id is not among the copies of its class
    links = F.coalesce(F.col("links") + F.col("id").isNull().cast("long"), F.lit(0).cast("long"))
    kind = vectors.schema[id_col].dataType
    return final.select(F.col("id").cast(kind).alias(id_col), links.alias("n_links"), component.cast(kind).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
