"""Repeatable appends: each batch in folders of its own, and a ledger of the batches that count.

    base/<dataset>/batch=<token>/event_date=.../event_hour=.../*.parquet
    base/_ledger/<token>

A batch's entry in the ledger is made last, by a rename that fails if the entry
is there, and covers all its datasets.  Readers see batches of the ledger only,
so one that failed half-way is not seen, a repeated one replaces what it left
behind, and one that is repeated after its entry was made is passed over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from ..errors import BadRequest
from ..schemas import DATASETS
from . import storage

LEDGER = "_ledger"


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with the text, all at once; False if it is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where, fs = _path(spark, path)
    if fs.exists(where):
        return False
    draft, _ = _path(spark, f"{path.rpartition('/')[0]}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(text.encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, where, options)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    return True


def entries(spark: SparkSession, base: str) -> list[dict]:
    """The ledger: token, datasets and the tokens that it replaces, of every committed batch."""
    where, fs = _path(spark, f"{base}/{LEDGER}")
    if not fs.exists(where):
        return []
    found = spark.read.option("wholetext", True).text(f"{base}/{LEDGER}").collect()
    return sorted((json.loads(r.value) for r in found), key=lambda e: e["token"])


def committed(spark: SparkSession, base: str, token: str) -> bool:
    """Whether a batch counts, by an entry of its own or of a compaction."""
    where, fs = _path(spark, f"{base}/{LEDGER}/{token}")
    return fs.exists(where) or any(token in e["replaces"] for e in entries(spark, base))


def commit(spark: SparkSession, base: str, token: str, tables: dict[str, DataFrame], replaces: Iterable[str] = ()) -> bool:
    """Appends the tables' rows, by dataset, as one batch; False if the batch was there already.

    Tokens name batches: letters, digits, dots, dashes and underscores.
    """
    if not token or not all(c.isalnum() or c in ".-_" for c in token) or token[0] in "._":
        raise BadRequest(f"{token!r} is no name of a batch")
    unknown = [name for name in tables if name not in DATASETS]
    if unknown:
        raise BadRequest(f"unknown datasets: {', '.join(unknown)}")
    if committed(spark, base, token):
        return False
    failures: list[BaseException] = []

    def write(name: str) -> None:
        try:
            storage.write(tables[name], f"{base}/{name}", f"batch={token}", "overwrite", dataset=name)
        except BaseException as e:
            failures.append(e)

    # side by side: a dataset of many hours waits for its many small files rather than for cores
    threads = [InheritableThread(target=write, args=(name,), session=spark) for name in tables]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    if failures:
        raise failures[0]
    return _create(spark, f"{base}/{LEDGER}/{token}", json.dumps({"token": token, "datasets": sorted(tables), "replaces": sorted(replaces)}))


def _live(found: list[dict], dataset: str) -> list[str]:
    """Tokens of the batches of a dataset that no compaction replaces."""
    gone = {t for e in found for t in e["replaces"]}
    return [e["token"] for e in found if dataset in e["datasets"] and e["token"] not in gone]


def read(spark: SparkSession, base: str, dataset: str) -> DataFrame:
    """The committed rows of a dataset with event_date and event_hour; batches are listed when this is called."""
    folders = [f"{base}/{dataset}/batch={t}" for t in _live(entries(spark, base), dataset)]
    schema = DATASETS[dataset].simpleString()[7:-1].replace(":", " ") + ", event_date date, event_hour int"
    there = [f for f in folders if storage._exists(spark, f)]
    if not there:
        return storage.with_partition(spark.createDataFrame([], DATASETS[dataset]), dataset)
    return spark.read.schema(schema + ", batch string").option("basePath", f"{base}/{dataset}").parquet(*there).drop("batch")


def compact(spark: SparkSession, base: str) -> str | None:
    """Makes one batch of all committed ones, so that readers list few folders; the old folders stay until vacuum()."""
    found = entries(spark, base)
    tokens = [e["token"] for e in found]
    names = sorted({d for e in found for d in e["datasets"]})
    live = {t for d in names for t in _live(found, d)}
    if len(live) < 2:
        return None
    token = f"compact-{uuid.uuid4().hex}"
    replaced = {*tokens, *(t for e in found for t in e["replaces"])}
    commit(spark, base, token, {d: read(spark, base, d) for d in names}, replaced)
    return token


def vacuum(spark: SparkSession, base: str) -> int:
    """Deletes the folders and entries of replaced batches, once no reader uses them; their tokens stay known."""
    found = entries(spark, base)
    gone = {t for e in found for t in e["replaces"]}
    dead = [e for e in found if e["token"] in gone]
    for e in dead:
        for path in [*(f"{base}/{d}/batch={e['token']}" for d in e["datasets"]), f"{base}/{LEDGER}/{e['token']}"]:
            where, fs = _path(spark, path)
            fs.delete(where, True)
    return len(dead)
