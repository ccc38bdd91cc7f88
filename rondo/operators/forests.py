"""Forests of many resamples, grown together over one table of weighted cells.

A cell is a vector of bin numbers and a label: trees see rows by their bins alone, so rows of one cell are interchangeable. What a tree needs of a cell is how many of its
rows it was dealt, and that is drawn by the law that single rows have. All trees of all resamples grow a level at a time: tasks add up weights per
(tree, node, feature, bin, label), sums meet in one shuffle, and a resample's splits are chosen from its sums, whose number follows from the shape of the trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import add
from ..session import persist_table, release

BINS = 32  # of a feature, as many as Spark's trees tell apart unless told otherwise
SAMPLE = 10_000  # rows that the cuts of a resample's bins are taken from, as many as Spark's trees take
BLOCK = 100  # resamples whose draws are made in one pass
PIECES = 16  # streams of random numbers a resample draws from

#: Shares of a row that is drawn 0, 1, 2, ... times when n of n rows are drawn and n is large.
DRAWN = [math.exp(-1.0) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def _uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that follows from its parts."""
    return F.pmod(F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts]), F.lit(1 << 53)) / float(1 << 53)


def drawn_times(key: Column, replicate: Column | int, seed: int = 0) -> Column:
    """How often a row is in a resample: a number that follows from its key, so that any task can tell it."""
    u = _uniform(key, replicate, seed)
    return add([(u >= share).cast("double") for share in DRAWN])


def _exploded(rows: DataFrame, replicates: range) -> DataFrame:
    """Every row once per resample."""
    return rows.withColumn("replicate", F.explode(F.sequence(F.lit(replicates.start), F.lit(replicates.stop - 1))))


def _value_cuts(values: np.ndarray, weights: np.ndarray, expected: float) -> list[float]:
    """Where bins of one feature begin, by the rule of Spark's trees.

    Between all values if there are at most ``BINS``, else where the weight so far is nearest to the next multiple of the ``BINS``-th part of what was expected.
    What the other values lack of the expected weight counts as zeros.
    """
    found, at = np.unique(values[values != 0], return_inverse=True)
    counts = np.bincount(at, weights[values != 0], len(found))
    lack = expected - counts.sum()
    if lack > 1e-9 * expected:
        place = np.searchsorted(found, 0.0)
        found, counts = np.insert(found, place, 0.0), np.insert(counts, place, lack)
    middles = (found[:-1] + found[1:]) / 2
    if len(found) <= BINS:
        return middles.tolist()
    part = expected / BINS
    cuts, so_far, target = [], 0.0, part
    for middle, weight, following in zip(middles, counts, counts[1:]):
        so_far += weight
        if abs(so_far - target) < abs(so_far + following - target):
            cuts.append(float(middle))
            target += part
    return cuts


def bin_cuts(rows: DataFrame, features: list[str], replicates: range, seed: int) -> list[list[list[float]]]:
    """By resample and feature, where bins begin: each resample's own, from about ``SAMPLE`` of its rows, as Spark's forests take theirs."""
    n = rows.count()  # a resample holds each of them once on average, and 1 - 1 / e of them at all
    share = min(1.0, SAMPLE / max(n * (1 - DRAWN[0]), 1.0))
    picked = _exploded(rows, replicates).filter(_uniform("_key", "replicate", seed + 1) < share)
    sample = picked.withColumn("_times", drawn_times(F.col("_key"), F.col("replicate"), seed)).filter("_times > 0").drop("_key")

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        times = part["_times"].to_numpy()
        cuts = [_value_cuts(part[f].to_numpy(), times, n * share if share < 1 else times.sum()) for f in features]
        return pd.DataFrame({"replicate": [int(part["replicate"].iloc[0])], "cuts": [[[c for c in cs if math.isfinite(c)] for cs in cuts]]})

    found = dict(map(tuple, sample.groupBy("replicate").applyInPandas(cut, "replicate int, cuts array<array<double>>").collect()))  # BINS a feature and resample
    if len(found) < len(replicates):
        raise ValueError("a resample has no rows")
    # what equals a cut belongs to the left
    return [[sorted({math.nextafter(c, math.inf) for c in cs}) for cs in found[b]] for b in replicates]


def cell_draws(rows: DataFrame, label: str, features: list[str], cuts: list[list[list[float]]], replicates: range, seed: int) -> DataFrame:
    """Per (cell, resample): how many of the cell's rows the resample holds once (``n1``), twice (``n2``), and so on.

    ``rows`` has the rows' key as ``_key``. A row is put between all resamples' cuts once; a table of a row per resample tells its bins from there. Rows are laid out by place and key
    first, so that a task meets few cells however many there are, and a hot cell spans tasks. No table of rows x resamples is shuffled.
    """
    bins, spots = [f"b{i}" for i in range(len(features))], [f"_s{i}" for i in range(len(features))]
    edges = [sorted({c for by in cuts for c in by[i]}) or [0.0] for i in range(len(features))]
    splits = [[-math.inf, *e, math.inf] for e in edges]
    bin_of = {f"_l{i}": pa.array([np.searchsorted(by[i], [-math.inf, *edges[i]], "right").astype(np.int32) for by in cuts]) for i in range(len(features))}
    lookup = F.broadcast(rows.sparkSession.createDataFrame(pa.table({"replicate": pa.array(replicates, pa.int32()), **bin_of})))  # at most BLOCK rows
    placed = Bucketizer(inputCols=features, outputCols=spots, splitsArray=splits, handleInvalid="error").transform(rows)
    whole = F.when((F.col(label) >= 0) & (F.col(label) == F.floor(label)), F.col(label)).otherwise(F.raise_error(F.lit("labels must be 0, 1, 2, ...")).cast("double"))
    laid = placed.select(*[F.col(s).cast("int").alias(s) for s in spots], whole.cast("int").alias("y"), "_key").repartitionByRange(*spots, "y", "_key")
    drawn = _exploded(laid, replicates).join(lookup, "replicate").select(
        "replicate", *[F.col(f"_l{i}")[F.col(s)].alias(b) for i, (s, b) in enumerate(zip(spots, bins))], "y", drawn_times(F.col("_key"), F.col("replicate"), seed).alias("_times"))
    times = range(1, len(DRAWN) + 1)
    return drawn.groupBy("replicate", *bins, "y").agg(*[F.count_if(F.col("_times") == k).alias(f"n{k}") for k in times]).filter(add([F.col(f"n{k}") for k in times]) > 0)


def tree_weights(draws: DataFrame, features: int, trees: int, seed: int) -> DataFrame:
    """Per (cell, resample): ``weights``, how many rows each tree was dealt.

    Bagging deals every row to a tree a Poisson(1) number of times, times the number of times that it is in the resample. Over a cell that adds up to the sum of k x Poisson(n_k).
    """
    bins = [f"b{i}" for i in range(features)]
    times = range(1, len(DRAWN) + 1)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = rng = None
        for batch in batches:
            where = np.stack([batch.column("replicate").to_numpy(), batch.column("_piece").to_numpy()], axis=1).astype(np.int64)
            n = np.stack([batch.column(f"n{k}").to_numpy() for k in times], axis=1)
            weights = np.zeros((batch.num_rows, trees), dtype=np.int64)
            begins = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1), batch.num_rows] if batch.num_rows else []
            for i, j in zip(begins, begins[1:]):
                if unit != tuple(where[i]):  # a stream goes on from batch to batch
                    unit = tuple(where[i])
                    rng = np.random.default_rng([seed & 0xFFFFFFFF, *map(int, unit)])
                dealt = rng.poisson(np.broadcast_to(n[i:j, None, :], (j - i, trees, len(times))))  # row by row, so batches may end anywhere
                weights[i:j] = dealt @ np.array(times)
            offsets = pa.array(np.arange(batch.num_rows + 1) * trees, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("replicate", *bins, "y")], pa.ListArray.from_arrays(offsets, pa.array(weights.ravel()))], names=["replicate", *bins, "y", "weights"])

    laid = draws.withColumn("_piece", F.pmod(F.xxhash64(*bins), F.lit(PIECES)).cast("int")).repartition("replicate", "_piece").sortWithinPartitions("replicate", "_piece", *bins, "y")
    schema = ", ".join([f"{c} int" for c in ("replicate", *bins, "y")])
    return laid.mapInArrow(draw, f"{schema}, weights array<bigint>")


class Forests:
    """Splits of all trees: ``feature`` (-1: none) and ``cut`` (the first bin on the right) by (resample, tree, node); node 1 is the root, 2i and 2i + 1 are the children of i."""

    def __init__(self, replicates: range, trees: int, depth: int):
        shape = (len(replicates), trees, 1 << depth)
        self.first = replicates.start
        self.feature, self.cut = np.full(shape, -1, np.int32), np.zeros(shape, np.int32)
        self.left, self.right = np.zeros(shape, np.int32), np.zeros(shape, np.int32)  # labels that a split's sides would be given
        self.gain = np.zeros(shape)  # times the rows of the node

    def add(self, splits: pd.DataFrame) -> None:
        at = (splits["replicate"].to_numpy() - self.first, splits["tree"].to_numpy(), splits["node"].to_numpy())
        for name in ("feature", "cut", "left", "right", "gain"):
            getattr(self, name)[at] = splits[name].to_numpy()

    def pruned(self) -> np.ndarray:
        """Whether a node still splits once splits into two leaves of one label are taken back, from the bottom up."""
        splits, left, right = self.feature >= 0, self.left.copy(), self.right.copy()
        for node in range(splits.shape[2] - 1, 0, -1):
            one = splits[:, :, node] & (left[:, :, node] == right[:, :, node])
            if 2 * node < splits.shape[2]:
                one &= ~splits[:, :, 2 * node] & ~splits[:, :, 2 * node + 1]
            splits[:, :, node] &= ~one
        return splits

    def importances(self, features: int) -> np.ndarray:
        """Per (resample, feature): gain in purity, weighted by rows; shares of a tree, then of the forest."""
        kept = np.where(self.pruned(), self.gain, 0.0)
        by = np.stack([np.where(self.feature == f, kept, 0.0).sum(axis=2) for f in range(features)], axis=2)
        whole = by.sum(axis=2, keepdims=True)
        by = np.divide(by, whole, out=np.zeros_like(by), where=whole > 0).sum(axis=1)
        whole = by.sum(axis=1, keepdims=True)
        return np.divide(by, whole, out=np.zeros_like(by), where=whole > 0)


def _sums(weights: DataFrame, grown: Forests, level: int, features: int, bins: int, labels: int) -> DataFrame:
    """Per (resample, slot): rows dealt; a slot numbers a (tree, node of the level, feature, bin, label)."""
    feature, cut = grown.feature[:, :, : 1 << level].copy(), grown.cut[:, :, : 1 << level].copy()
    trees, nodes, start = feature.shape[1], 1 << level, grown.first

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = None, None

        def out() -> pa.RecordBatch:
            slots = np.flatnonzero(sums)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), held, np.int32)), pa.array(slots.astype(np.int64)), pa.array(sums[slots])], names=["replicate", "slot", "rows"])

        for batch in batches:
            if not batch.num_rows:
                continue
            replicate = batch.column("replicate").to_numpy()
            vectors = np.stack([batch.column(f"b{i}").to_numpy() for i in range(features)], axis=1).astype(np.int64)
            y, w = batch.column("y").to_numpy().astype(np.int64), batch.column("weights").flatten().to_numpy().reshape(-1, trees)
            begins = [0, *(np.flatnonzero(replicate[1:] != replicate[:-1]) + 1), batch.num_rows]
            for i, j in zip(begins, begins[1:]):
                if replicate[i] != held:  # sorted by resample, so sums of one are held at a time
                    if held is not None:
                        yield out()
                    held, sums = int(replicate[i]), np.zeros(trees * nodes * features * bins * labels)
                row, tree = np.nonzero(w[i:j])
                amount, x, node = w[i:j][row, tree], vectors[i:j], np.ones(len(row), np.int64)
                for _ in range(level):
                    f = feature[held - start, tree, node]
                    on = f >= 0  # what is in a leaf stays behind
                    row, tree, amount, node, f = row[on], tree[on], amount[on], node[on], f[on]
                    node = 2 * node + (x[row, f] >= cut[held - start, tree, node])
                first = (tree * nodes + node - nodes) * features
                for f in range(features):
                    slot = ((first + f) * bins + x[row, f]) * labels + y[i:j][row]
                    np.add.at(sums, slot, amount) if 8 * len(slot) < len(sums) else np.add(sums, np.bincount(slot, amount, len(sums)), out=sums)
        if held is not None:
            yield out()

    return weights.mapInArrow(add, "replicate int, slot bigint, rows double").groupBy("replicate", "slot").agg(F.sum("rows").alias("rows"))


def _offered(rng: np.random.Generator, shape: tuple[int, int], features: int, some: int) -> np.ndarray:
    """Features that each node may split by, in the order in which they are tried: reservoir samples of ``some``."""
    chosen = np.broadcast_to(np.arange(some), (*shape, some)).copy()
    for f in range(some, features):
        place = rng.integers(0, f + 1, shape)
        at = np.nonzero(place < some)
        chosen[(*at, place[at])] = f
    return chosen


def _impurity(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    share = np.divide(counts, whole[..., None], out=np.zeros_like(counts), where=whole[..., None] > 0)
    out = np.ones(whole.shape)
    for k in range(counts.shape[-1]):
        out = out - share[..., k] * share[..., k]
    return out


def _best(sums: np.ndarray, offered: np.ndarray):
    """Per (tree, node): whether it splits, and by which feature, bin, gain, rows and labels of the sides. ``sums`` goes by (tree, node, feature, bin, label)."""
    whole = sums[:, :, 0].sum(axis=2)
    left = np.cumsum(sums, axis=3)[:, :, :, :-1]
    right = whole[:, :, None, None] - left
    n, n_left, n_right = whole.sum(axis=-1), left.sum(axis=-1), right.sum(axis=-1)
    full = np.where(n > 0, n, 1.0)[:, :, None, None]
    gain = _impurity(whole, n)[:, :, None, None] - n_left / full * _impurity(left, n_left) - n_right / full * _impurity(right, n_right)
    gain = np.where((n_left > 0) & (n_right > 0), gain, -1.0)
    bin_of = gain.argmax(axis=3)
    best = np.take_along_axis(np.take_along_axis(gain, bin_of[..., None], 3)[..., 0], offered, 2)
    tried = best.argmax(axis=2)
    feature = np.take_along_axis(offered, tried[..., None], 2)[..., 0]
    tree, node = np.nonzero(np.take_along_axis(best, tried[..., None], 2)[..., 0] > 0)
    f = feature[tree, node]
    b = bin_of[tree, node, f]
    return tree, node, f, b, gain[tree, node, f, b] * n[tree, node], left[tree, node, f, b].argmax(axis=-1), right[tree, node, f, b].argmax(axis=-1)


def grow(weights: DataFrame, replicates: range, trees: int, depth: int, features: int, bins: int, labels: int, some: int, seed: int) -> Forests:
    """All trees of all resamples over ``weights`` (replicate, b0, b1, ..., y, weights), a level of all of them at a time; a node may split by ``some`` features, drawn anew."""
    grown = Forests(replicates, trees, depth)
    for level in range(depth if bins > 1 else 0):
        nodes = 1 << level

        def choose(sums: pd.DataFrame) -> pd.DataFrame:
            replicate = int(sums["replicate"].iloc[0])
            table = np.zeros(trees * nodes * features * bins * labels)
            table[sums["slot"].to_numpy()] = sums["rows"].to_numpy()
            rng = np.random.default_rng([seed & 0xFFFFFFFF, replicate, level, 1])
            tree, node, f, b, gain, left, right = _best(table.reshape(trees, nodes, features, bins, labels), _offered(rng, (trees, nodes), features, some))
            return pd.DataFrame({"replicate": replicate, "tree": tree, "node": node + nodes, "feature": f, "cut": b + 1, "left": left, "right": right, "gain": gain})

        splits = _sums(weights, grown, level, features, bins, labels).groupBy("replicate").applyInPandas(choose, "replicate int, tree int, node int, feature int, cut int, left int, right int, gain double")
        found = splits.toPandas()  # at most one row per node of the forests
        if found.empty:
            break
        grown.add(found)
    return grown


def resampled_importances(df: DataFrame, key: str, label: str, features: list[str], replicates: int, trees: int, depth: int, seed: int) -> np.ndarray:
    """Importances by (resample, feature) of a forest per resample; rows without a feature are skipped.

    A block of resamples reads the rows for the cuts of its bins and for its draws; its trees grow over at most as many cells as there are vectors of bins and labels.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(label).cast("double").alias(label), *[F.col(f).cast("double").alias(f) for f in features]).na.drop(subset=features)
    some = len(features) if trees == 1 else math.ceil(math.sqrt(len(features)))
    out = []
    for begin in range(0, replicates, BLOCK):
        block = range(begin, min(begin + BLOCK, replicates))
        cuts = bin_cuts(rows, features, block, seed)
        weights = persist_table(tree_weights(cell_draws(rows, label, features, cuts, block, seed), len(features), trees, seed))
        labels = weights.agg(F.max("y")).first()[0] + 1
        bins = max(len(c) for by in cuts for c in by) + 1
        out.append(grow(weights, block, trees, depth, len(features), bins, labels, some, seed).importances(len(features)))
        release(weights)
    return np.concatenate(out)
