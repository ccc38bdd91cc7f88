"""Best-fit packing: documents as token sequences of a set length, few of them and none cut that fits.

Sum-of-squares packing: a piece goes where the squared counts of open sequences per residual gap become smallest in sum, which keeps
gaps of all sizes at hand. Pieces come longest first, and a sequence is opened only when no open one has room.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondo.session import persist_table

from .bpe import _slices
from .vocabulary import Vocabulary, safe_cuts, vocabulary

CAPACITY, END = 1024, 2
LONG = 1 << 18  # bytes; longer texts are encoded in stretches cut at safe places
BLOCK_PIECES = 16_384  # pieces that one task packs at a time
OPEN_SHARE = 0.95  # sequences filled less than this are packed again, with those of other blocks
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def _ids(text: str, vocab: Vocabulary, end: int) -> np.ndarray:
    data = text.encode()
    parts = [text] if len(data) <= LONG else [p.decode() for p in safe_cuts(data, LONG)]
    return np.concatenate([*[vocab.encode(p) for p in parts], [end]]).astype("<u4")


def _cut(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for rows in (part for batch in batches for part in _slices(batch, "text")):
            ids = [_ids(t, vocab, end) for t in rows.column("text").to_pylist()]
            n = np.array([len(x) for x in ids], dtype=np.int64)
            first = np.where(n % capacity, n % capacity, capacity)  # only the first piece may be shorter
            pieces = (n - first) // capacity + 1
            doc = np.repeat(np.arange(len(ids)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[doc])
            flat = np.concatenate([np.empty(0, "<u4"), *ids])
            bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
            binary = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(flat)])
            columns = [rows.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), binary]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    return run


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents: doc_id, piece (from 0), start, length and ids (little-endian unsigned 32-bit numbers).

    A document is the ids of its text and ``end``. One of up to ``capacity`` ids stays whole; a longer one is cut so that only its first piece may
    be shorter. NULL and empty texts are ``end`` alone, NULL identifiers stay, repeated rows give pieces each, an empty table gives none.
    Very long texts are encoded in stretches that end where no token can cross. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_cut(path, capacity, end), PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every piece, in the order given, the number of its sequence and the place in it.

    Only the number of open sequences per gap counts for the choice, so a step looks at ``capacity`` gaps at most, however many sequences
    are open. Of equal sums the smallest gap is taken, of equal gaps the sequence that got it last.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, n in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(counts[n:capacity]) + n
        if len(gaps):
            # taking a sequence of gap g to g - n changes the sum of squares by 2 (counts[g - n] - counts[g] + 1), or by 1 - 2 counts[n] if it is full then
            change = 2 * (counts[gaps - n] - counts[gaps] + 1)
            if gaps[0] == n:
                change[0] = 1 - 2 * counts[n]
            gap = int(gaps[change.argmin()])
            counts[gap] -= 1
            sequence[k] = by_gap[gap].pop()
        else:
            gap, sequence[k], opened = capacity, opened, opened + 1
        offset[k] = capacity - gap
        if gap > n:
            counts[gap - n] += 1
            by_gap[gap - n].append(int(sequence[k]))
    return sequence, offset


PLACES = "own long, length long, sequence_id long, offset long, filled long"


def _pack(capacity: int):
    def run(rows: pa.Table) -> pa.Table:
        own, length = rows.column("own").to_numpy(), rows.column("length").to_numpy()
        order = np.lexsort((own, -length))
        own, length = own[order], length[order]
        sequence, offset = sum_of_squares(length, capacity)
        opener = own[offset == 0]  # sequences are numbered in the order they are opened; each is named after its first piece
        filled = np.bincount(sequence, weights=length, minlength=len(opener)).astype(np.int64)
        return pa.table({"own": own, "length": length, "sequence_id": opener[sequence], "offset": offset, "filled": filled[sequence]})

    return run


def _packed(sizes: DataFrame, capacity: int, round_: int) -> tuple[DataFrame, int]:
    """One round over (own, length): places as a written table, and in how many blocks."""
    blocks = -(-sizes.count() // BLOCK_PIECES)
    block = F.pmod(F.xxhash64("own", F.lit(round_)), F.lit(max(1, blocks)))
    return persist_table(sizes.withColumn("block", block).groupBy("block").applyInArrow(_pack(capacity), PLACES)), blocks


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to ``capacity``) with sequence_id and offset; the pieces of a sequence fill it from 0 without gaps.

    Full pieces are sequences of their own. The others are dealt by hash into blocks of about ``BLOCK_PIECES``, which tasks pack on their own, longest
    piece first. What a block leaves in sequences filled under ``OPEN_SHARE`` is packed again with that of the other blocks, while that makes
    fewer sequences and less than half is left each time. Only keys and lengths are shuffled for packing. A sequence's number is the
    key of its first piece. Repeated rows are pieces of their own, an empty table gives none; a NULL or other length is an error.
    """
    spark = pieces.sparkSession
    own = "own"
    while own in pieces.columns:
        own += "_"
    bad = ~F.coalesce(F.col("length").between(1, capacity), F.lit(False))
    checked = pieces.withColumn("length", F.when(bad, F.raise_error(F.lit(f"a piece is not of 1 to {capacity} tokens"))).otherwise(F.col("length")))
    keyed = persist_table(checked.withColumn(own, F.monotonically_increasing_id()), spark)
    sizes = keyed.filter(F.col("length") < capacity).select(F.col(own).alias("own"), F.col("length").cast("long").alias("length"))
    placed, blocks = _packed(sizes, capacity, 0)
    round_, done = 1, []
    while blocks > 1:
        loose = placed.filter(F.col("filled") < OPEN_SHARE * capacity)
        counts = placed.agg(F.count("*"), F.count_if(F.col("filled") < OPEN_SHARE * capacity), F.count_if((F.col("filled") < OPEN_SHARE * capacity) & (F.col("offset") == 0))).first()
        if not counts[1] or 2 * counts[1] > counts[0]:
            break
        again, blocks = _packed(loose.select("own", "length"), capacity, round_)
        if again.filter("offset = 0").count() >= counts[2]:
            break
        done.append(placed.filter(F.col("filled") >= OPEN_SHARE * capacity))
        placed, round_ = again, round_ + 1
    for part in done:
        placed = placed.unionByName(part)
    places = placed.select(F.col("own").alias("p_own"), "sequence_id", "offset")
    columns = [F.col(c) for c in pieces.columns]
    shared = keyed.join(places, F.col(own) == F.col("p_own")).select(*columns, "sequence_id", "offset")
    whole = keyed.filter(F.col("length") == capacity).select(*columns, F.col(own).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(whole)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Documents as pieces with their ids, sequence and offset: ``cut_documents``, then ``pack_pieces``."""
    return pack_pieces(cut_documents(docs, path, capacity, end), capacity)
