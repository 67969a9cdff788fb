"""The thin queries of this subpackage over the shared tables, and their SQL where it exists."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm import ngram_join, packing, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, substring_dedup, toxicity, url_filters, vector_search
from deltaweave.llm.storage import delete_quietly, use_checkpoints


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors meet; deleted when the driver ends."""
    use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete_quietly, spark, folder)
    return folder


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % folds


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return sentencepiece_codec.digests(encoded)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.fit(docs, labels.where(fold("doc_id", 4) != 2))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.dedup(table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 3) != 1))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.spans_through_ledger(table(spark, sf_dir, "documents"), shared_folder(spark, "ledger")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digests(quality_rules.judge(table(spark, sf_dir, "documents")))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.search(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_ngram_join": op4_ngram_join,
    "op5_url_filters": op5_url_filters,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_secrets": op8_secrets,
    "op9_quality_rules": op9_quality_rules,
    "op10_neighbours": op10_neighbours,
}

ORACLE_SQL: dict[str, str] = {"op4_ngram_join": ngram_join.oracle(), "op5_url_filters": url_filters.oracle(), "op6_substring_dedup": substring_dedup.oracle(), "op8_secrets": secret_scan.oracle(), "op10_neighbours": vector_search.oracle()}
