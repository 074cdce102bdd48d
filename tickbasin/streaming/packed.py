"""Rows of a stream for its stateful processors, many to a row.

Spark hands a processor's rows to Python one by one, which costs more than what
is done with them.  So the tasks before the exchange put the rows that they have
of a key into one Arrow stream, and the processor works on whole columns.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# executors need not have this package: it travels with the plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that a task packs at a time, and rows of a frame that a processor puts out.
PACK_ROWS, OUT_ROWS = 32_768, 20_000


def packs(batches: list[pa.RecordBatch], keys: list[str], clock: str | None = None) -> pa.RecordBatch:
    """A row for each key of some batches: the key, with a clock its largest value, and the other columns as an Arrow stream."""
    table = pa.Table.from_batches(batches)
    placed = table.select([*keys, *([clock] if clock else [])]).append_column("place", pa.array(np.arange(len(table))))
    groups = placed.group_by(keys, use_threads=False).aggregate([("place", "list"), *([(clock, "max")] if clock else [])])
    places = groups["place_list"].combine_chunks()
    rows = table.drop_columns(keys).take(places.flatten()).combine_chunks()
    streams, at = [], 0
    for n in pc.list_value_length(places).to_pylist():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows.slice(at, n))
        streams.append(sink.getvalue().to_pybytes())
        at += n
    columns = [groups[k].combine_chunks() for k in keys] + ([groups[f"{clock}_max"].combine_chunks()] if clock else [])
    return pa.RecordBatch.from_arrays([*columns, pa.array(streams, pa.binary())], [*keys, *([clock] if clock else []), "packed"])


def packed(rows: DataFrame, *keys: str, clock: str | None = None) -> DataFrame:
    """The stream with the rows of a key that a task has in one row: the keys, with a clock its largest value, and packed."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= PACK_ROWS:
                yield packs(held, list(keys), clock)
                held, n = [], 0
                pa.default_memory_pool().release_unused()
        if held:
            yield packs(held, list(keys), clock)

    fields = [rows.schema[c] for c in (*keys, *([clock] if clock else []))]
    return rows.mapInArrow(pack, T.StructType([*fields, T.StructField("packed", T.BinaryType())]))


def unpacked(frames: Iterable[pd.DataFrame], *order: str) -> pa.Table:
    """All rows of a key, in order of some columns of whole numbers; they are copied column by column."""
    table = pa.concat_tables(pa.ipc.open_stream(b).read_all() for frame in frames for b in frame["packed"])
    places = pa.array(np.lexsort([whole(table, c) for c in reversed(order)]))
    columns = {}
    for name in table.column_names:
        columns[name] = pc.take(table[name], places)
        table = table.drop_columns(name)
    return pa.table(columns)


def whole(table: pa.Table, name: str, nothing: int = 0) -> np.ndarray:
    """A column of whole numbers, with a number for nulls."""
    return pc.fill_null(table[name], nothing).to_numpy().astype("int64")


def equals(table: pa.Table, name: str, value: str) -> np.ndarray:
    """Where a column has a value."""
    return pc.fill_null(pc.equal(table[name], value), False).to_numpy()


def only(table: pa.Table, where: np.ndarray, *names: str) -> pa.Table:
    """The table with nulls in some columns where a condition does not hold."""
    for name in names:
        column = pc.if_else(pa.array(where), table[name], pa.scalar(None, table[name].type))
        table = table.set_column(table.column_names.index(name), name, column)
    return table


def put_out(table: pa.Table, where: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """The table, or its rows where a condition holds, as frames that Spark takes without a look at their rows."""
    for k in range(0, len(table), OUT_ROWS):
        part = table.slice(k, OUT_ROWS)
        part = part if where is None else part.filter(pa.array(where[k : k + OUT_ROWS]))
        if len(part):
            yield part.to_pandas(types_mapper=pd.ArrowDtype)
    pa.default_memory_pool().release_unused()
