"""Byte-pair encoding of documents and back. Long texts are encoded in parts that a tree of joins puts together again."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import SAFE, Vocabulary, vocabulary

LONG = 32_768  # characters; longer texts are halved until no part is longer
WINDOW = 64  # bytes on each side of a join that are encoded again at first
LETTERS = re.compile(rb"[A-Za-z]+")
Part = tuple[bytes, np.ndarray]


def halves(text: str, longest: int, specials: tuple[str, ...]) -> list[str]:
    """Halves of halves down to ``longest`` characters; a special string stays whole, everything else may be cut."""
    middle = len(text) // 2
    for s in specials:
        at = text.find(s, max(0, middle - len(s) + 1), middle + len(s) - 1)
        if at >= 0:
            middle = at if at else len(s)
    if len(text) <= longest or middle >= len(text):
        return [text]
    return halves(text[:middle], longest, specials) + halves(text[middle:], longest, specials)


def _left_start(data: bytes, ends: np.ndarray, reach: int) -> tuple[int, bool] | None:
    """Where a window may start in the left part: the byte and whether all before it is settled. None: not within reach."""
    low = len(data) - reach
    if low <= 0:
        return 0, True
    if found := SAFE.search(data, low):
        return found.start(), True
    inside = ends[(ends >= low) & (ends < len(data))]
    return (int(inside[0]), False) if len(inside) and LETTERS.fullmatch(data, int(inside[0]) - 1) else None


def _right_end(data: bytes, ends: np.ndarray, reach: int) -> tuple[int, bool] | None:
    if reach >= len(data):
        return len(data), True
    found = None
    for found in SAFE.finditer(data, 0, reach + 2):
        pass
    if found:
        return found.start(), True
    inside = ends[(ends > 0) & (ends <= reach)]
    return (int(inside[-1]), False) if len(inside) and LETTERS.fullmatch(data, 0, int(inside[-1]) + 1) else None


def join_parts(left: Part, right: Part, vocab: Vocabulary) -> Part:
    """Encoding of two neighbouring parts as one text.

    The ids in a window around the join are made anew. On each side it ends either where a pre-token ends in any case, so that nothing
    outside depends on the join, or inside a run of letters, which is one pre-token. There the old and the new ids must share a
    token at one place: a sequence is the encoding of its bytes exactly if all neighbouring pairs are, so both may be spliced at that token.
    Where a side finds no such place the window doubles, up to the whole parts.
    """
    (a, a_ids), (b, b_ids) = left, right
    a_ends, b_ends = np.cumsum(vocab.lengths[a_ids]), np.cumsum(vocab.lengths[b_ids])
    reach = WINDOW
    while True:
        start, end = _left_start(a, a_ends, reach), _right_end(b, b_ends, reach)
        if start is not None and end is not None:
            window = a[start[0] :] + b[: end[0]]
            try:
                ids = vocab.encode(window.decode())
            except UnicodeDecodeError:  # the window cuts a character
                ids = None
            if ids is not None:
                ends = np.cumsum(vocab.lengths[ids]) + start[0]
                head = _settled_left(start, a_ids, a_ends, ids, ends, len(a))
                tail = _settled_right(end, b_ids, b_ends, ids, ends - len(a))
                if head and tail and head[1] <= tail[1]:
                    return a + b, np.concatenate([a_ids[: head[0]], ids[head[1] : tail[1]], b_ids[tail[0] :]])
        reach *= 2


def _settled_left(start, old, old_ends, new, new_ends, limit) -> tuple[int, int] | None:
    """How many old ids come first and from which new id on the window goes on."""
    if start[1]:
        return int(np.searchsorted(old_ends, start[0], side="right")), 0
    places, i, j = np.intersect1d(old_ends[old_ends < limit], new_ends, assume_unique=True, return_indices=True)
    for k in range(len(places)):
        if old[i[k]] == new[j[k]] and places[k] > start[0]:
            return int(i[k]) + 1, int(j[k]) + 1
    return None


def _settled_right(end, old, old_ends, new, new_ends) -> tuple[int, int] | None:
    """From which old id on the right part stays and up to which new id the window counts."""
    if end[1]:
        return int(np.searchsorted(old_ends, end[0], side="right")), len(new)
    places, i, j = np.intersect1d(old_ends[old_ends <= end[0]], new_ends, assume_unique=True, return_indices=True)
    for k in reversed(range(len(places))):
        if old[i[k]] == new[j[k]] and i[k] > 0:
            return int(i[k]), int(j[k])
    return None


def concatenate(parts: list[Part], vocab: Vocabulary) -> np.ndarray:
    """The tree over neighbouring parts; each level joins pairs."""
    while len(parts) > 1:
        pairs = [join_parts(parts[k], parts[k + 1], vocab) for k in range(0, len(parts) - 1, 2)]
        parts = pairs + parts[2 * len(pairs) :]
    return parts[0][1]


def _slices(rows: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of one column, so that what a task holds doesn't depend on the length of texts."""
    n = max(1, rows.column(column).nbytes // most)
    step = max(1, rows.num_rows // n)
    for k in range(0, rows.num_rows, step):
        yield rows.slice(k, step)


def _listed(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.int32)))


def _as_ids(ids: list[np.ndarray], vocab: Vocabulary) -> dict[str, pa.Array]:
    return {"ids": _listed(ids)}


def _as_digests(ids: list[np.ndarray], vocab: Vocabulary) -> dict[str, pa.Array]:
    """Number of tokens, digest of the ids and digest of what they decode to."""
    hexed = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in ids]
    texts = [vocab.decode(x)[0].tobytes().decode(errors="replace") for x in ids]
    return {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_sha256": pa.array(hexed), "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])}


IDS, DIGESTS = "doc_id long, ids array<int>", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _encode(path: str, keep: list[str], finish: Callable = _as_ids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for rows in _slices(batch, "text"):
                made = finish([vocab.encode(t) for t in rows.column("text").to_pylist()], vocab)
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], *made.values()], [*keep, *made])

    return run


def _cut(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials = tuple(vocabulary(path).specials)
        for rows in batches:
            for row, doc_id, text in zip(*[rows.column(c).to_pylist() for c in ("row", "doc_id", "text")], strict=True):
                parts = halves(text, LONG, specials)
                columns = [pa.array([row] * len(parts), pa.int64()), pa.array([doc_id] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "part", "text"])

    return run


def _join(path: str, finish: Callable):
    def run(rows: pa.Table) -> pa.Table:
        vocab = vocabulary(path)
        rows = rows.sort_by("part")
        parts = [(t.as_py().encode(), np.asarray(x.values)) for t, x in zip(rows.column("text"), rows.column("ids"), strict=True)]
        return pa.table({"doc_id": rows.column("doc_id").slice(0, 1), **finish([concatenate(parts, vocab)], vocab)})

    return run


def _encoded(docs: DataFrame, path: str, finish: Callable, schema: str) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = rows.filter(F.length("text") <= LONG).drop("row").mapInArrow(_encode(path, ["doc_id"], finish), schema)
    parts = rows.filter(F.length("text") > LONG).mapInArrow(_cut(path), "row long, doc_id long, part long, text string").repartition("row", "part")
    encoded = parts.mapInArrow(_encode(path, ["row", "doc_id", "part", "text"]), "row long, doc_id long, part long, text string, ids array<int>")
    return short.unionByName(encoded.groupBy("row").applyInArrow(_join(path, finish), schema))


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """Per row of documents: doc_id and ids, as the tokenizers library gives them without added special tokens.

    Texts of up to ``LONG`` characters are encoded in Arrow batches. Longer ones are halved until they fit, whatever stands at the cuts; the
    parts are dealt out to all tasks, and per text a tree of joins re-encodes windows around the cuts until both sides agree (``join_parts``).
    A task holds the parts of one text at a time. NULL texts count as empty (no ids), NULL identifiers stay, repeated rows are
    encoded each, an empty table gives none. Other columns are not read.
    """
    return _encoded(docs, path, _as_ids, IDS)


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``bpe_encode`` and ``bpe_decode`` in one pass: doc_id, n_tokens and the digests of the ids and of the decoded text."""
    return _encoded(docs, path, _as_digests, DIGESTS)


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``text``, the decoded ids with special tokens kept; bytes that are no UTF-8 become replacement characters. NULL ids give NULL."""
    kept = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for rows in (part for batch in batches for part in _slices(batch, "ids")):
            ids = rows.column("ids")
            data, ends = vocab.decode(ids.flatten().to_numpy(zero_copy_only=False))
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in ids])])]
            flat, valid = data.tobytes(), ids.is_valid().to_pylist()
            texts = [flat[bounds[k] : bounds[k + 1]].decode(errors="replace") if valid[k] else None for k in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], [*kept, "text"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{kinds}, text string")
