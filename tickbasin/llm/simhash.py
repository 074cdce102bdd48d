"""SimHash near-duplicates with pivot distance tables.

Fingerprints are made in one pass over the texts.  Equal fingerprints become
one class, so copies cost one row.  Fingerprints at two differing bits or
fewer agree on two of four quarters at least, so each class goes to six
buckets, one for each pair of quarters.  Of the 32 bits left, two fingerprints
of a bucket again agree on two of four bytes at least, and of the 16 bits left
then on two of four half bytes: a large bucket is split by these, so no bucket
holds more than LARGE_BUCKET fingerprints or 256, and no pair is lost.  In a
bucket a table holds the Hamming distances of every fingerprint to the pivots:
by the triangle inequality two fingerprints at distance d differ by d at most in
every coordinate, so pairs whose largest coordinate difference is above d are
discarded and the rest are verified.

A task reports each fingerprint's link to the first of its local component and
never pairs; components over all buckets are then joined by star contraction.

near_copies() is for texts that share SIMILARITY of their five-word shingles.
Their 64-bit fingerprints differ by ten bits and more, which no bucket scheme
finds, as unrelated ones differ by 32 with a deviation of 4.  So it takes
fingerprints of LONG bits, which tell such texts apart to a few hundredths of
similarity, and buckets of texts that share the least hashes of a band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fewest_partitions, fresh, join_sized, kept, workspace, written

SEED, SHINGLE, DISTANCE = 42, 3, 2
#: Reference fingerprints: 24 numbers of a fixed generator.
PIVOTS = np.random.default_rng(20240229).integers(0, 1 << 63, 24, dtype=np.uint64) * np.uint64(2) + np.arange(24, dtype=np.uint64) % np.uint64(2)
#: Fingerprints of a bucket from which it is split.
LARGE_BUCKET = 2000
#: Rows of a bucket up to which all its rows are compared at once.
SMALL_BUCKET = 48
#: Near copies: words of a shingle, similarity, bits of a fingerprint; bands of least hashes and how many make a band's key.
COPY_SHINGLE, SIMILARITY, LONG, BANDS, BAND = 5, 0.8, 512, 12, 4
#: Near copies: rows of a bucket compared in one task, in blocks of half as many if there are more; reference rows of a bucket.
TOGETHER, LONG_PIVOTS = 8192, 8


def masks() -> list[int]:
    """Bits that the fingerprints of a bucket share, by kind: 6 pairs of quarters, 36 with a pair of the other bytes, 216 with a pair of the other half bytes."""
    out, level = [], [(0, [(16 * k, 16) for k in range(4)])]
    for _ in range(3):
        below = []
        for mask, parts in level:
            for i in range(4):
                for j in range(i):
                    own = mask | sum(((1 << n) - 1) << at for at, n in (parts[i], parts[j]))
                    rest = [parts[k] for k in range(4) if k not in (i, j)]
                    below.append((own, [(at + h * n // 2, n // 2) for at, n in rest for h in (0, 1)]))
        out += [mask for mask, _ in below]
        level = below
    return out


MASKS = np.array(masks(), dtype=np.uint64).view(np.int64).tolist()


def fingerprint(text: str) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats included.

    A-Z are lower-cased; words are runs without ASCII white space.  A text of
    fewer words than a shingle has one shingle, its words; one of none has the
    fingerprint 0.
    """
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else iter([b" ".join(words)])
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        block = hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) of every row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "fp": np.fromiter((fingerprint(t) for t in batch["text"]), dtype=np.int64, count=len(batch))})

    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read.mapInPandas(rows, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def buckets(fp: Column, first: Column) -> Column:
    """Six buckets (kind, part) of a fingerprint, of the kinds from first on."""
    all_masks = F.array(*map(F.lit, MASKS))
    return F.transform(F.sequence(first, first + 5), lambda k: F.struct(k.alias("kind"), fp.bitwiseAND(F.get(all_masks, k)).alias("part")))


def split_buckets(classes: DataFrame) -> DataFrame:
    """(fp, rep, kind, part): each class in its buckets, large ones split."""
    rows = classes.select("fp", "rep", F.explode(buckets(F.col("fp"), F.lit(0))).alias("b")).select("fp", "rep", "b.kind", "b.part")
    for first in (0, 6):  # kinds that can be split; those from 42 on hold 256 fingerprints at most
        large, _ = written(rows.where(F.col("kind") >= first).groupBy("kind", "part").count().where(F.col("count") > LARGE_BUCKET).select("kind", "part", F.lit(True).alias("large")), "large-buckets")
        if not large.limit(1).count():
            break
        flagged = join_sized(rows, large, ["kind", "part"], "left")
        own = F.array(F.struct("kind", "part"))
        finer = F.explode(F.when(F.col("large"), buckets(F.col("fp"), 6 * F.col("kind") + 6)).otherwise(own)).alias("b")
        rows, _ = written(flagged.select("fp", "rep", finer).select("fp", "rep", "b.kind", "b.part"), "buckets")
    return rows


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances, a column for each pivot."""
    return np.stack([np.bitwise_count(fps ^ p) for p in PIVOTS], axis=1).astype(np.int8)


def near(fp: np.uint64, row: np.ndarray, fps: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of fps lie within DISTANCE: coordinate by coordinate, then verified."""
    left = np.arange(len(fps))
    for k in range(0, table.shape[1], 6):
        left = left[(np.abs(table[left, k : k + 6] - row[k : k + 6]) <= DISTANCE).all(axis=1)]
        if not len(left):
            return left
    return left[np.bitwise_count(fps[left] ^ fp) <= DISTANCE]


def bucket_components(fps: np.ndarray) -> np.ndarray:
    """For each fingerprint of a bucket the position of the first one of its component.

    Walks each component from its first member; whatever is reached leaves the
    table, so a group of near copies of any size is read a few times, not once
    for each of its pairs.
    """
    table, root = pivot_table(fps), np.arange(len(fps))
    rest = np.arange(len(fps))
    while len(rest):
        first, rest = rest[0], rest[1:]
        todo = [first]
        while todo and len(rest):
            at = todo.pop()
            hits = near(fps[at], table[at], fps[rest], table[rest])
            if len(hits):
                found = rest[hits]
                root[found] = first
                todo += found.tolist()
                rest = np.delete(rest, hits)
    return root


def small_components(key: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """The same for many sorted small buckets at once: rows at each offset are compared in whole columns."""
    n = len(fps)
    root, a, b = np.arange(n), [], []
    table = pivot_table(fps)
    for gap in range(1, SMALL_BUCKET):
        i = np.flatnonzero(key[:-gap] == key[gap:]) if gap < n else np.empty(0, dtype=int)
        if not len(i):
            break
        i = i[np.abs(table[i] - table[i + gap]).max(axis=1) <= DISTANCE]
        i = i[np.bitwise_count(fps[i] ^ fps[i + gap]) <= DISTANCE]
        a.append(i)
        b.append(i + gap)
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        while len(a):
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if (root == before).all():
                break
    return root


def bucket_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) of the rows of one partition, whole buckets sorted by kind and part."""
    parts = [(b["kind"].to_numpy(np.int64), b["part"].to_numpy(np.int64), b["fp"].to_numpy(np.int64).view(np.uint64), b["rep"].to_numpy(np.int64)) for b in batches]
    if not parts:
        return
    kind, part, fps, rep = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((rep, part, kind))
    kind, part, fps, rep = kind[order], part[order], fps[order], rep[order]
    new = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (part[1:] != part[:-1]))))
    sizes = np.diff(np.append(new, len(kind)))
    group = np.repeat(np.arange(len(new)), sizes)
    some = np.repeat((sizes > 1) & (sizes <= SMALL_BUCKET), sizes)
    if some.any():
        at = np.flatnonzero(some)
        root = small_components(group[at], fps[at])
        moved = np.flatnonzero(root != np.arange(len(at)))
        yield pd.DataFrame({"a": rep[at[moved]], "b": rep[at[root[moved]]]})
    for start, size in zip(new[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
        root = bucket_components(fps[start : start + size])
        moved = np.flatnonzero(root != np.arange(size))
        yield pd.DataFrame({"a": rep[start + moved], "b": rep[start + root[moved]]})


def labelled(rows: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, component_id) of every class, from rows (id, fp), classes (fp, rep) and links (a, b) of reps.

    The rows of one id link the classes of their texts as well.
    """
    several, _ = written(rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated-ids")
    if several.limit(1).count():
        same = join_sized(rows, several, "id", "left_semi").join(classes, "fp").select(F.col("id").cast("long").alias("a"), F.col("rep").alias("b"))
        links = links.unionByName(same)
    found, _ = written(connected_components(links), "components")
    return classes.where("rep is not null").join(found, F.col("rep") == F.col("id"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups documents whose fingerprints link at two differing bits or fewer.

    Returns id, fingerprint (16 hex digits) and component_id, the smallest id
    reachable.  Ids are integers; rows of one id are one document and share its
    rows' links; a null id gets its fingerprint's component, or null if only
    null ids have it.  Null and empty texts have the fingerprint 0 and link
    like any other; very long texts are read whole; a bit set in just half the
    hashes is 0; other columns, whatever their names, are not read; an empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")[0]
    with workspace(spark):
        classes, _ = written(fps.groupBy("fp").agg(F.min("id").cast("long").alias("rep")), "fingerprint-classes")
        known = classes.where("rep is not null")
        rows = split_buckets(known)
        dealt = rows.repartition(fewest_partitions(6 * known.count(), 250_000, spark.sparkContext.defaultParallelism), "kind", "part")
        component = kept(labelled(fps, classes, dealt.mapInPandas(bucket_links, "a long, b long")), "labelled-classes")
    kind = docs.schema[id_col].dataType
    return join_sized(fps, component, "fp", "left").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component_id").cast(kind))


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of hashes: multiplications and shifts that spread every bit (murmur's finalizer)."""
    x = h ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Odd factors by which hashes are permuted, one for each least hash.
FACTORS = mixed(np.arange(BANDS * BAND, dtype=np.uint64), 1) | np.uint64(1)


def long_fingerprint(text: str) -> tuple[bytes, np.ndarray]:
    """SimHash of LONG bits of a text's distinct five-word shingles, and the keys of its bands.

    Words and short texts as in fingerprint(); a text of no words has the
    fingerprint 0 and keys of its own.
    """
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(LONG // 8), np.arange(BANDS, dtype=np.int64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(COPY_SHINGLE)), strict=False)) if len(words) >= COPY_SHINGLE else iter([b" ".join(words)])
    h = np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64))
    ones, least = np.zeros(LONG, dtype=np.int64), np.full(BANDS * BAND, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(h), 1 << 12):
        part = h[at : at + (1 << 12)]
        bits = np.stack([mixed(part, 2 + k) for k in range(LONG // 64)], axis=1)
        ones += np.unpackbits(bits.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int32)
        least = np.minimum(least, (part[None] * FACTORS[:, None]).min(axis=1))
    keys = least.reshape(BANDS, BAND)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND):
        key = mixed(key ^ keys[:, k], 100 + k)
    return np.packbits(2 * ones > len(h)).tobytes(), key.view(np.int64)


def most_bits(similarity: float = SIMILARITY) -> int:
    """Bits by which long fingerprints of texts of that similarity differ: the angle of two sets of equal size."""
    return round(LONG * float(np.arccos(2 * similarity / (1 + similarity))) / np.pi)


def copy_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (found, from) of the rows of a bucket: each component is walked from its first member, and what is reached leaves the table.

    A table of distances to the first rows of the bucket discards rows as in near().
    """
    within = most_bits()
    pivots = np.stack([np.bitwise_count(fps ^ fps[k]).sum(axis=1) for k in range(min(LONG_PIVOTS, len(fps)))], axis=1).astype(np.int16)
    a, b, rest = [], [], np.arange(len(fps))
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            left = np.flatnonzero((np.abs(pivots[rest] - pivots[at]) <= within).all(axis=1))
            hits = left[np.bitwise_count(fps[rest[left]] ^ fps[at]).sum(axis=1) <= within]
            if len(hits):
                found = rest[hits]
                a.append(found)
                b.append(np.full(len(found), at))
                todo += found.tolist()
                rest = np.delete(rest, hits)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, dtype=int), np.empty(0, dtype=int))


def copies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) of the rows of one partition, whole buckets (key, i, j)."""
    parts = [f for f in frames if len(f)]
    if not parts:
        return
    rows = pd.concat(parts).sort_values(["key", "i", "j", "rep"])
    bucket = rows[["key", "i", "j"]].to_numpy()
    rep, fps = rows["rep"].to_numpy(), np.frombuffer(b"".join(rows["fp"]), dtype=np.uint64).reshape(len(rows), -1)
    cuts = np.append(np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]).any(axis=1))), len(rows))
    for start, end in zip(cuts, cuts[1:], strict=False):
        if end - start > 1:
            a, b = copy_links(fps[start:end])
            yield pd.DataFrame({"a": rep[start + a], "b": rep[start + b]})


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups documents whose five-word shingles agree to SIMILARITY, as their long fingerprints measure it.

    Two texts of that similarity share one of the bands with a probability of
    0.998, and the measure deviates by 0.03.  A bucket of more than TOGETHER
    texts is compared by pairs of blocks, so none gathers in one task.

    Returns id and component_id, the smallest id reachable; cases as in
    near_duplicates().
    """
    spark = docs.sparkSession

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [long_fingerprint(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "fp": [f for f, _ in made], "keys": [k for _, k in made]})

    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prints = written(read.mapInPandas(rows, f"id {docs.schema[id_col].dataType.simpleString()}, fp binary, keys array<bigint>"), "long-fingerprints")[0]
    fps = prints.select("id", "fp")
    with workspace(spark):
        # texts of one fingerprint may differ in a few shingles, and so in keys: those of all of them serve
        classes, _ = written(prints.groupBy("fp").agg(F.min("id").cast("long").alias("rep"), F.min("keys").alias("keys"), F.max("keys").alias("other")), "long-classes")
        known = classes.where("rep is not null and keys = other").select("fp", "rep", F.explode("keys").alias("key"))
        several, _ = written(classes.where("rep is not null and keys <> other").select("fp", "rep"), "several-keys")
        variants = join_sized(prints.select("fp", "keys").distinct(), several, "fp", "inner")
        known = known.unionByName(variants.select("fp", "rep", F.explode("keys").alias("key")).distinct())
        blocks = F.when(F.col("n") > TOGETHER, F.ceil(F.col("n") / (TOGETHER // 2))).otherwise(1).cast("int")
        shared, _ = written(known.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", blocks.alias("blocks")), "shared-keys")
        met = join_sized(known, shared, "key", "inner")
        own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
        dealt = met.select("key", "fp", "rep", F.explode(pairs).alias("p")).select("key", "fp", "rep", "p.i", "p.j")
        n = shared.count()
        links = dealt.repartition(fewest_partitions(4 * n, 50_000, spark.sparkContext.defaultParallelism), "key", "i", "j").mapInPandas(copies, "a long, b long").distinct()
        component = kept(labelled(fps, classes.select("fp", "rep"), links), "labelled-copies")
    kind = docs.schema[id_col].dataType
    return join_sized(fps, component, "fp", "left").select(F.col("id").alias(id_col), F.col("component_id").cast(kind))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies, with all its columns and rows.

    Null ids stay, whatever their texts; empty and null texts are one group;
    repeated rows of the kept id stay; columns may have any names; an empty
    table gives an empty table.
    """
    gone = fresh(docs, "gone")
    with workspace(docs.sparkSession):
        found = near_copies(docs, id_col, text_col)
        out = kept(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone)).distinct(), "near-duplicates")
    return join_sized(docs, out, F.col(id_col) == F.col(gone), "left_anti")
