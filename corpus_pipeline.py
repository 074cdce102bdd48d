"""The corpus pipeline: five operators of tickbasin.llm applied to documents in turn.

Each stage is written as Parquet to the shared folder and read again as the
next stage's documents, so a lost executor costs one stage at most.  All
columns of the documents, whatever their names, go through all stages but the
last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickbasin.llm import decontaminate, packing, pii, quality, simhash
from tickbasin.llm.common import delete_path, keep, workspace, written
from tickbasin.llm.queries import VOCABULARY


def quality_filter(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is trained on the documents of this stage.

    Null and empty texts are judged by their metadata and no content, null
    metadata is a value of its own, null ids and repeated rows are judged each;
    very long texts are read whole; a tie at one half stays.
    """
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document of the smallest id of each group of near copies stays: five-word shingles, similarity 0.8.

    Null and empty texts are one group; null ids stay; repeated rows of the
    kept id stay; very long texts are read whole.
    """
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go.

    Null and empty texts hold nothing; null ids and repeated rows are judged by
    their texts; very long texts are searched whole.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def pii_redaction(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind.

    Null texts stay null, with their length; overlapping spans become one; all
    rows stay.
    """
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents are packed into sequences: one row for each piece, with its text, in the order of the sequences.

    Null and empty texts are a piece of no tokens and no sequence; very long
    texts have as many pieces as they need; repeated rows are packed each.
    """
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("pii", pii_redaction),
    ("best-fit packing", best_fit_packing),
]

#: SQL expresses neither trained scores nor bit-sliced fingerprints; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the folder's documents.

    An empty table gives an empty one.  Of a stage only its output is kept, and
    that until the next stage is written; the last one's input stays, as the
    result reads it, for the workspace around run(), if there is one.
    """
    docs, before = spark.read.parquet(f"{folder}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with workspace(spark):
            docs, path = written(stage(spark, docs, folder), name.replace(" ", "-"))
            keep(path)
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, folder)
