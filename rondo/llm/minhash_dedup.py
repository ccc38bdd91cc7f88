"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondo.session import persist_table

from .components import components
from .text import SHINGLE, small

BANDS, ROWS = 72, 5  # pairs at the threshold meet in a bucket but for about one in a million
BINS = BANDS * ROWS
PERCENT = 75
STAR_ROWS = 512  # members compared with a hub in one group of a task
BLOCK_ROWS = 384  # documents of a block when a group is compared in itself
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing generator (fixed constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_DONORS = (_mix(np.arange(4096 * BINS, dtype=_U) + _U(1)) % _U(BINS)).astype(np.int64).reshape(4096, BINS)
_BAND_SALT = _mix(np.arange(BANDS, dtype=_U) + _U(1 << 40))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles, A-Z lower-cased; fewer words make one shingle of them all, none make none."""
    words = (text or "").encode().lower().split()  # on bytes: lower-cases A-Z, splits at space, tab and line ends
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b"\0" + b" ".join(words))] if words else [], dtype=_U)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -SHINGLE] + 1]) if len(words) > SHINGLE else np.array([0])
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(whole[s:e]) for s, e in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)), _U, len(words) - SHINGLE + 1))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One bucket key per band. Each hash falls in one bin and the smallest of a bin stands for it; an empty bin takes the value of the first
    filled one in a sequence of random bins that depends on the bin alone (optimal densification)."""
    bins = (((shingles >> _U(32)) * _U(BINS)) >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))  # sorted hashes: the first of a bin is its smallest
    values, filled = np.zeros(BINS, _U), np.zeros(BINS, bool)
    values[bins[first]], filled[bins[first]] = shingles[first], True
    own, empty = values.copy(), np.flatnonzero(~filled)
    for donors in _DONORS:
        if not len(empty):
            break
        found = filled[donors[empty]]
        values[empty[found]] = own[donors[empty[found]]]
        empty = empty[~found]
    values[empty] = shingles[0]
    keys = _BAND_SALT.copy()
    for column in values.reshape(BANDS, ROWS).T:
        keys = _mix(keys * _U(0x9E3779B97F4A7C15) ^ column)
    return keys.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        sets = [shingle_set(t.as_py()) for t in rows.column("text")]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        bands = [band_keys(s) if len(s) else np.empty(0, np.int64) for s in sets]
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *bands])))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), lists], ["doc_id", "n_shingles", "set_key", "bands"])


def _similar(both: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int):
    return 100 * both >= PERCENT * (n + m - both)


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _check_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hub and salt, the hub's own first: only the hub's shingles are held."""
    group, hub = None, []
    for rows in batches:
        a, b = [], []
        for h, salt, doc, text in zip(*[rows.column(c).to_pylist() for c in ("hub", "salt", "doc", "text")], strict=True):
            if (h, salt) != group:
                group, hub = (h, salt), []
            own = shingle_set(text)
            if doc == h:
                hub.append(own)
            elif any(_similar(len(np.intersect1d(own, s, assume_unique=True)), len(own), len(s)) for s in hub):
                a.append(h)
                b.append(doc)
        yield _links(a, b)


def _pairs_of_blocks(docs: list[int], blocks: list[int], comps: list[int], sets: list[np.ndarray], across: bool) -> tuple[list[int], list[int]]:
    """Links that connect different components among the documents; counts come from the postings of shingles."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    postings, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
    row = np.concatenate([[0], np.cumsum(sizes)])
    label = np.unique(np.array(comps), return_inverse=True)[1]
    side, a, b = np.array(blocks), [], []
    for i in range(len(docs)):
        mine = code[row[i] : row[i + 1]]
        counts = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        both = np.bincount(postings[at], minlength=len(docs))
        near = _similar(both, sizes[i], sizes) & (label != label[i]) & ((side != side[i]) if across else True)
        for j in np.flatnonzero(near).tolist():
            if label[j] != label[i]:  # earlier links may have joined them meanwhile
                a.append(docs[i])
                b.append(docs[j])
                label[label == label[j]] = label[i]
    return a, b


def _check_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hub and pair of blocks; one pair of blocks is held at a time."""
    group, held = None, []

    def done() -> pa.RecordBatch:
        docs, blocks, comps, sets = zip(*held, strict=True)
        return _links(*_pairs_of_blocks(list(docs), list(blocks), list(comps), list(sets), group[1] != group[2]))

    for rows in batches:
        for h, low, high, doc, block, comp, text in zip(*[rows.column(c).to_pylist() for c in ("hub", "low", "high", "doc", "block", "comp", "text")], strict=True):
            if (h, low, high) != group:
                if held:
                    yield done()
                group, held = (h, low, high), []
            held.append((doc, block, comp, shingle_set(text)))
    if held:
        yield done()


def _with_text(need: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc"), "text").join(small(need), "doc")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more.

    1. One row per document: set size, a key of the whole set, bucket keys. Documents with the same set become one (the smallest identifier).
    2. In every bucket one hub (the document with most companions over all its buckets) gets a candidate edge to each other member.
    3. Edges are confirmed on full sets. A hub's members are salted over tasks, each of which holds the hub's set alone.
    4. Members of one hub that are still in different components are compared with one another in pairs of bounded blocks, inside the
       tasks: two documents of one bucket always share its hub, so no candidate of any bucket is left out, and no pairs are written out.
    5. Components of all confirmed links.

    NULL or blank texts have no shingles and no links. Rows with a NULL identifier stay, with a NULL component, kept and unlinked. Rows of one identifier
    are one document, linked if any of its texts is. An empty table gives an empty result. Columns: doc_id, n_shingles, component_id, kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = persist_table(docs.mapInArrow(_sketch, "doc_id long, n_shingles long, set_key binary, bands array<long>"))
    found = sketches.filter(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    reps = persist_table(found.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min_by("bands", "doc_id").alias("bands")))
    rows = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    crowded = persist_table(rows.join(shared, "bucket"))
    central = crowded.groupBy("rep").agg(F.sum(F.col("size") - 1).alias("companions"))
    placed = crowded.join(central, "rep")
    hubs = placed.groupBy("bucket").agg(F.max(F.struct("companions", (-F.col("rep")).alias("minus"), "n")).alias("h"))
    edges = placed.join(hubs, "bucket").select((-F.col("h.minus")).alias("hub"), F.col("rep").alias("doc"), F.col("h.n").alias("hub_n"), "n")
    edges = persist_table(edges.filter("hub != doc").groupBy("hub", "doc").agg(F.max(100 * F.least("hub_n", "n") >= PERCENT * F.greatest("hub_n", "n")).alias("fits")))
    star = _star_links(edges.filter("fits"), docs)
    copies = found.join(reps.select("set_key", "rep"), "set_key").filter("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = star.union(_group_links(edges, components(star), docs)).union(copies)
    belongs = components(links)
    joined = sketches.select("doc_id", "n_shingles").join(belongs, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _star_links(edges: DataFrame, docs: DataFrame) -> DataFrame:
    salts = edges.groupBy("hub").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("salts"))
    members = edges.join(salts, "hub").select("hub", F.pmod(F.xxhash64("doc"), "salts").cast("int").alias("salt"), "doc")
    own = salts.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("doc"))
    rows = _with_text(persist_table(members.union(own)), docs)
    dealt = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("doc") != F.col("hub"))
    return persist_table(dealt.select("hub", "salt", "doc", "text").mapInArrow(_check_stars, "a long, b long"))


def _group_links(edges: DataFrame, belongs: DataFrame, docs: DataFrame) -> DataFrame:
    """Links inside a hub's group between members that the star left in different components."""
    members = edges.select("hub", "doc").join(belongs, F.col("doc") == F.col("node"), "left").select("hub", "doc", F.coalesce("component", "doc").alias("comp"))
    members = persist_table(members)
    mixed = members.groupBy("hub").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).filter("low != high")
    blocked = members.join(mixed.select("hub", "blocks"), "hub").select("hub", "doc", "comp", "blocks", F.pmod(F.xxhash64("doc"), "blocks").cast("int").alias("block"))
    spread = blocked.select("hub", "doc", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    need = spread.select("hub", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "doc", "block", "comp")
    dealt = _with_text(persist_table(need), docs).repartition("hub", "low", "high").sortWithinPartitions("hub", "low", "high")
    return persist_table(dealt.select("hub", "low", "high", "doc", "block", "comp", "text").mapInArrow(_check_blocks, "a long, b long"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents without those that a component keeps another one for; all columns stay."""
    gone = persist_table(near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct())
    return docs.join(small(gone), docs["doc_id"] == gone["gone_id"], "left_anti")
