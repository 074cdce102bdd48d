"""Vector code compression: a codebook for each part of the vectors, trained by exact integer sums.

Components are integers, so no order of addition changes a result.  Vectors come
to the tasks as blocks of columns, a row of a block for each dimension; a
block's distances to a codebook grow dimension by dimension, and its sums and
counts are added in place into two int64 tensors, of one size for any number of
vectors, which meet in a reduction tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_small, kept, release_memory

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block.
BLOCK = 2048
#: Largest scaled component in either direction: squares of differences, summed over 64 dimensions, stay in 64 bits.
LARGEST = 1 << 27


def usable(vec_col: str) -> F.Column:
    """Whether a vector is there, not empty, and all its components are finite."""
    return (F.size(vec_col) > 0) & F.coalesce(F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(values: np.ndarray) -> np.ndarray:
    """The integers of components."""
    whole = np.floor(values.astype(np.float64) * SCALE)
    if len(whole) and float(np.abs(whole).max()) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST / SCALE:.0f}, where sums of squares leave 64 bits")
    return whole.astype(np.int64)


def columns_of(vectors: pa.Array, dimension: int) -> np.ndarray:
    """A block of columns: a row for each dimension."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(vectors) * dimension or not bool((np.diff(vectors.offsets.to_numpy()) == dimension).all()):
        raise ValueError(f"every vector must have {dimension} components")
    return np.ascontiguousarray(scaled(flat).reshape(len(vectors), dimension).T)


def nearest(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of a codebook (entries, width) and its squared distance, for part columns (width, n)."""
    distance = np.zeros((columns.shape[1], len(book)), dtype=np.int64)
    for values, entries in zip(columns, book.T, strict=True):
        difference = values[:, None] - entries[None, :]
        difference *= difference
        distance += difference
    index = distance.argmin(axis=1)  # of equal ones the first
    return index, distance[np.arange(len(index)), index]


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, width) of a table of id and vec, all usable; None if it is empty.

    They start as the parts of the vectors of the smallest ids, of equal ids the
    smaller vector first; only those few come to the driver.
    """
    first = [r.vec for r in vectors.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()]
    if not first:
        return None
    dimension = len(first[0])
    if dimension % parts:
        raise ValueError(f"{dimension} components do not make {parts} equal parts")
    if any(len(v) != dimension for v in first):
        raise ValueError(f"every vector must have {dimension} components")
    width = dimension // parts
    books = scaled(np.array(first, dtype=np.float64)).reshape(len(first), parts, width).transpose(1, 0, 2)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), BLOCK):
                columns = columns_of(whole.slice(at, BLOCK).column(0), dimension)
                yield pa.RecordBatch.from_arrays([pa.array([columns.tobytes()], pa.binary())], ["columns"])

    dealt = vectors.select("vec").mapInArrow(blocks, "columns binary").rdd
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(books)

        def add(total, row, shared=shared):
            sums, counts = total
            block = np.frombuffer(row.columns, dtype=np.int64).reshape(parts, width, -1)
            for part, columns in enumerate(block):
                index, _ = nearest(columns, shared.value[part])
                np.add.at(sums[part], index, columns.T)
                np.add.at(counts[part], index, 1)
            return sums, counts

        def merge(a, b):
            return a[0] + b[0], a[1] + b[1]

        sums, counts = dealt.treeAggregate((np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)), add, merge)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in order, as decimal texts joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """The table of id, label and vec with code (binary, a byte for each part) and error instead of the vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = shared.value.shape
        for whole in batches:
            for at in range(0, len(whole), BLOCK):
                batch = whole.slice(at, BLOCK)
                block = columns_of(batch.column(2), parts * width).reshape(parts, width, -1)
                found = [nearest(columns, book) for columns, book in zip(block, shared.value, strict=True)]
                code = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
                error = np.sum([distance for _, distance in found], axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], ["id", "label", "code", "error"])
            release_memory()

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.select("id", "label", "vec").mapInArrow(rows, f"id {kinds['id']}, label {kinds['label']}, code binary, error long")


def decode(coded: DataFrame, books: np.ndarray, code_col: str = "code", vec_col: str = "vec") -> DataFrame:
    """The table with each code (binary) replaced by the middle of the vectors' cells, in floats; null codes give null."""
    centers = [[F.array(*[F.lit((int(x) + 0.5) / SCALE).cast("float") for x in entry]) for entry in book] for book in books]
    code = F.hex(F.col(f"`{code_col}`"))
    parts = [F.get(F.array(*book), F.conv(F.substring(code, 2 * k + 1, 2), 16, 10).cast("int")) for k, book in enumerate(centers)]
    vector = F.when(F.col(f"`{code_col}`").isNotNull(), F.flatten(F.array(*parts)))
    return coded.select(*[F.col(f"`{c}`") for c in coded.columns if c != code_col], vector.alias(vec_col))


def compress(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of all usable vectors, by codebooks trained on all of them.

    Returns id, label, code (two hex digits for each part), error (squared
    distance to the entries, in scaled units), label_error (summed over equal
    labels, nulls together) and codebooks_sha256.  Vectors that are null, empty or
    hold null or non-finite components are left out; repeated rows count and are
    coded each; null ids come last when the codebooks start; ties go to the
    lower index; other columns, whatever their names, are not read; an empty
    table gives an empty one.  Vectors of different lengths, of a length that
    the parts do not divide, or of components beyond 524,288 raise an error.
    """
    if entries > 256:
        raise ValueError("a code is one byte")
    vectors = embeddings.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec")).where(usable("vec"))
    books = train(vectors, parts, entries, rounds)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    if books is None:
        return embeddings.sparkSession.createDataFrame([], f"`{id_col}` {kinds['id']}, `{label_col}` {kinds['label']}, code string, error long, label_error long, codebooks_sha256 string")
    coded = kept(encode(vectors, books).select("id", "label", F.lower(F.hex("code")).alias("code"), "error"), "codes")
    by_label = kept(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label"), "label-errors")
    by_label = F.broadcast(by_label) if is_small(by_label) else by_label
    rows = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return rows.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
