"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. ``run`` writes each stage's rows as Parquet in the shared folder and reads
them back for the next, so a stage never recomputes its predecessors and an executor may be lost
at any time. Null texts count as empty texts throughout; texts of any length are taken whole;
repeated rows are treated alike, but for near copies, of which rows with the smallest id stay; an
empty table gives an empty result; further columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm import ngram_join, packing, quality_rules, secret_scan, substring_dedup
from deltaweave.llm.kernel import fresh
from deltaweave.llm.queries import shared_folder, tokenizer_file
from deltaweave.llm.storage import delete


def _with_text(docs: DataFrame, text) -> DataFrame:
    """The documents with another text, and ``n_chars`` (where there is one) to fit it."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judge(docs, keep_columns=True, kept_only=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id; rows without id stay."""
    groups = ngram_join.join_components(docs)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias(fresh("gone", docs.columns))).distinct()
    return docs.join(gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that a document with a smaller id holds too."""
    return _with_text(substring_dedup.dedup(docs, rejoin=False, keep_columns=True, counts=None), F.col("text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each secret."""
    cleaned = secret_scan.redact(docs)
    return _with_text(cleaned, F.col("text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens: their token ids, and the CRC-32 of these."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("packing", packed),
]

#: SQL can express neither the divergence verdicts nor the packing; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    A stage's rows are deleted when the next stage has written its own; the last stage's stay
    in the shared folder for the reader, and are deleted when the session's driver ends.
    """
    folder = shared_folder(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
