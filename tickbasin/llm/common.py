"""Helpers shared by the operators: shared folders, sized joins, components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side of measured size is broadcast; beyond them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20

_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none and runs on one machine (tests) a
    temporary folder is set for it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tickbasin-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which the workspaces around it own."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_open, "stack", None):
        _open.stack[-1].append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a path that shared_path() gave, through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the tables written inside when the block ends, but those that were passed on by keep().

    Around a job that writes the result of an operator it leaves nothing of
    the operator's intermediate tables behind.
    """
    stack = _open.stack = getattr(_open, "stack", None) or []
    mine: list[str] = []
    stack.append(mine)
    try:
        yield mine
    finally:
        stack.remove(mine)
        for path in mine:
            delete_path(spark, path)


def keep(path: str) -> None:
    """Passes a path on to the workspace around the present one, as the result reads it."""
    for depth, paths in enumerate(getattr(_open, "stack", [])):
        if path in paths:
            paths.remove(path)
            if depth:
                _open.stack[depth - 1].append(path)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: writes the rows to the shared folder and reads them again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same for a table that the operator's result reads."""
    table, path = written(df, name)
    keep(path)
    return table


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bytes_of(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about: texts and arrays by their length, other values 8."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(kind, T.StructType):
        size = sum((bytes_of(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            size = F.aggregate(value, F.lit(8).cast("long"), lambda total, x: total + bytes_of(x, kind.elementType))
        else:
            size = 8 * F.size(value)
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(0).cast("long")) + 8


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table, already written, is proven to have at most so many rows and bytes; rows + 1 are read at most."""
    width = sum((bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields), F.lit(0).cast("long"))
    n, total = table.select(width.alias("width")).limit(rows + 1).agg(F.count("*"), F.sum("width")).first()
    return n <= rows and (total or 0) <= size


def join_sized(left: DataFrame, right: DataFrame, on, how: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Joins; the right side, already written, is broadcast only if rows and bytes are proven small.

    A larger right side is shuffled, and AQE splits skewed partitions of the
    left side.
    """
    return left.join(F.broadcast(right) if is_small(right, bound) else right, on, how)


def fewest_partitions(rows: int, per_partition: int, least: int = 1) -> int:
    """Partitions of at most per_partition rows."""
    return max(least, -(-rows // per_partition))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every id in edges(a, b).

    Alternates large-star and small-star: each round links every neighbour of
    a node to the smallest one, so stars form in O(log n) rounds and no path is
    enumerated.  A round is a map-side combined minimum and a join, whose hot
    keys AQE can split.  Rounds are written to the shared folder, so a lost
    executor costs one round at most.

    Returns (id, component): ids of no edge are absent.  Null ids and loops
    are ignored; repeated edges count once.
    """
    spark = edges.sparkSession

    def star(pairs: DataFrame, larger_only: bool) -> DataFrame:
        """Links, for every u, its neighbours v to the least of u and its neighbours."""
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        if larger_only:
            joined = pairs.where("v > u").join(low, "u")
            return joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
        joined = pairs.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return joined.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b")

    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a > b").distinct()
    now, path = written(now, "components")
    before = (0, None)  # of no links
    for _ in range(max_rounds if now.limit(1).count() else 0):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both, True).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        after, next_path = written(star(down, False).distinct(), "components")
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        delete_path(spark, path)
        now, path = after, next_path
        if mark == before:
            break
        before = mark
    else:
        if before != (0, None):
            raise RuntimeError("components did not converge")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def slices(batch, rows: int = 1000) -> Iterator:
    """Parts of a pandas frame or an Arrow batch, so that what is made of them stays small."""
    for at in range(0, len(batch), rows):
        yield batch[at : at + rows]


def release_memory() -> None:
    """Gives Arrow's unused memory back to the system: Python workers live on from one job to the next."""
    pa.default_memory_pool().release_unused()


def text_or_empty(column: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
