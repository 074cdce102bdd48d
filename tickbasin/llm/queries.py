"""Queries of this subpackage over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, decontaminate, embeddings, fim, html, packing, pii, quality, simhash, tokens, urls, warc
from .oracles import oracle_sql

__all__ = ["oracle_sql", "queries"]

#: The vocabulary file of the token counts and the packing.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The file of the byte-level tokenizer.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.train(docs, table(spark, folder, "labels")))


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract_main_text(table(spark, folder, "pages"))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.filter_urls(table(spark, folder, "pages"), urls.train(urls.labelled_urls(spark)))


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), VOCABULARY)


def op5_embedding_forest(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_pii(table(spark, folder, "documents"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"), VOCABULARY)


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op11_bpe_tree(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe.encode_documents(table(spark, folder, "documents"), BYTE_BPE)
    decoded = bpe.decode_documents(encoded.withColumn("ids_sha256", F.sha2("ids", 256)), BYTE_BPE)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    rows = fim.restored(fim.fill_in_middle(table(spark, folder, "documents")))
    lengths = [F.char_length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return rows.select("doc_id", "n", "form", *lengths, F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.compress(table(spark, folder, "embeddings")).drop("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
