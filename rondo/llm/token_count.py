"""Token counts: Arrow functions that encode batches of about equal bytes and return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import safe_cuts, vocabulary

LONG = 32_768  # characters; longer texts are split before they are counted
BATCH_BYTES = 1 << 20


def _balanced(n_bytes: list[int]) -> Iterator[list[int]]:
    """Positions of the texts in batches of about ``BATCH_BYTES`` UTF-8 bytes, longest first; a longer text is a batch of its own."""
    batch, filled = [], 0
    for i in sorted(range(len(n_bytes)), key=lambda i: -n_bytes[i]):
        if batch and filled + n_bytes[i] > BATCH_BYTES:
            yield batch
            batch, filled = [], 0
        batch.append(i)
        filled += n_bytes[i]
    if batch:
        yield batch


def _lengths(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths_of = vocabulary(path).lengths_of
        for rows in batches:
            texts = rows.column("text").to_pylist()
            sizes = pc.binary_length(rows.column("text")).to_pylist()  # of the piece, not of its document
            lengths = [0] * len(texts)
            for batch in _balanced(sizes):
                for i, n in zip(batch, lengths_of([texts[i] for i in batch]), strict=True):
                    lengths[i] = n
            yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc_id"), rows.column("n_bytes"), pa.array(lengths, pa.int64())], ["row", "doc_id", "n_bytes", "n_tokens"])

    return count


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for k, text in enumerate(rows.column("text")):
            pieces = [p.decode() for p in safe_cuts(text.as_py().encode(), LONG)]
            fixed = [pa.array([rows.column(c)[k].as_py()] * len(pieces), pa.int64()) for c in ("row", "doc_id", "n_bytes")]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(range(len(pieces)), pa.int64()), pa.array(pieces, pa.string())], ["row", "doc_id", "n_bytes", "part", "text"])


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Per row of documents: doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    Texts over ``LONG`` characters are cut where no token can cross (see ``vocabulary.SAFE``); their pieces are dealt out to
    all tasks and the counts summed, so one very long text doesn't hold up a task. A stretch without a safe place stays whole.
    NULL texts count as empty (0 bytes, 0 tokens), NULL identifiers stay, repeated rows are counted each, an empty table gives none.
    Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    result = "row long, doc_id long, n_bytes long, n_tokens long"
    short = rows.filter(F.length("text") <= LONG).mapInArrow(_lengths(path), result)
    pieces = rows.filter(F.length("text") > LONG).mapInArrow(_pieces, "row long, doc_id long, n_bytes long, part long, text string")
    dealt = pieces.repartition("row", "part")
    long = dealt.mapInArrow(_lengths(path), result).groupBy("row", "doc_id", "n_bytes").agg(F.sum("n_tokens").alias("n_tokens"))
    return short.unionByName(long).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
