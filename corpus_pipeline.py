"""The corpus pipeline: stages over documents, each written and read again before the next.

Every stage works on all rows its predecessor kept; all but the last return the columns of documents. A NULL text or an empty
table pass through every stage as its operator defines it. Every row is a document of its own to every decision, whether its identifier is NULL or shared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rondo.llm.bpe import bpe_round_trip
from rondo.llm.decontaminate import drop_contaminated
from rondo.llm.line_dedup import dedup_lines
from rondo.llm.minhash_dedup import drop_near_duplicates
from rondo.llm.quality_rules import drop_rejected
from rondo.llm.queries import byte_bpe, table
from rondo.llm.text import row_keys
from rondo.session import persist_table, release


def by_row(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage over documents whose identifiers are keys of the rows; where one is NULL or shared, ordered keys stand in for them while it runs."""
    keyed, key = row_keys(docs, ordered=True)
    if key == "doc_id":
        return stage(docs).select(*docs.columns)
    kept = f"{key}_id"
    left = stage(keyed.select(F.col(key).alias("doc_id"), F.col("doc_id").alias(kept), *[c for c in docs.columns if c != "doc_id"]))
    return left.select(*[F.col(kept).alias(c) if c == "doc_id" else c for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return drop_rejected(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one edit of an earlier line go; n_chars follows the text."""
    n_chars = F.length("text").cast("long").alias("n_chars")
    return by_row(docs, dedup_lines).select(*[n_chars if c == "n_chars" else c for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near-duplicates one document stays."""
    return by_row(docs, drop_near_duplicates)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left is encoded and decoded: doc_id, n_tokens and both digests."""
    return bpe_round_trip(docs, byte_bpe())


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near), ("benchmark decontamination", benchmark), ("byte-pair encoding", tokens)]
ORACLE_SQL = None  # SQL states neither the divergence verdict's stored references nor the encoding; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = persist_table(docs, spark)
    return docs
