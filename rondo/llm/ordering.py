"""Positions and running totals within groups of any size, by one range sort: a group may fill many partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rondo.session import persist_table


def _running(values: np.ndarray, starts: np.ndarray, fold: np.ufunc, carried: int) -> np.ndarray:
    """Running fold that begins anew at every start (first row of a group) but goes on from ``carried`` before the first start."""
    runs = np.append(starts, len(values)) if len(starts) and starts[0] == 0 else np.concatenate([[0], starts, [len(values)]])
    total = fold.accumulate(values)
    undo = np.subtract if fold is np.add else np.bitwise_xor
    before = np.repeat([0 if a == 0 else total[a - 1] for a in runs[:-1]], np.diff(runs))
    out = undo(total, before.astype(np.int64)) if len(values) else total
    if carried and len(values) and not (len(starts) and starts[0] == 0):
        out[: runs[1]] = fold(out[: runs[1]], carried)
    return out


def _within_part(group: str, folds: dict[str, np.ufunc], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, key, first = TaskContext.get().partitionId(), 0, None, True
        carried = dict.fromkeys(folds, 0)
        for rows in batches:
            n = rows.num_rows
            if not n:
                continue
            keys = rows.column(group).to_pylist()
            earlier = [key, *keys[:-1]]
            starts = np.array([i for i in range(n) if keys[i] != earlier[i] or (seen == 0 and i == 0)], dtype=np.int64)
            in_first = np.zeros(n, dtype=bool)
            if first:
                second = [s for s in starts if seen or s > 0]
                in_first[: second[0] if second else n] = True
                first = not second
            out = [pa.array(np.full(n, part)), pa.array(np.arange(seen, seen + n)), pa.array(in_first)]
            for name, fold in folds.items():
                values = np.ones(n, dtype=np.int64) if name == "pos" else rows.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                made = _running(values, starts, fold, carried[name])
                carried[name] = int(made[-1])
                out.append(pa.array(made))
            key, seen = keys[-1], seen + n
            yield pa.RecordBatch.from_arrays([*rows.columns, *out], names)

    return run


def in_order(rows: DataFrame, group: str, order: list[str], sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``pos`` (from 1 in the order of ``order``, NULL first, within each value of ``group``) and running totals.

    Each column of ``sums`` and ``xors`` gets its running sum or exclusive or, up to and with the row, as ``run_<column>``. The rows are sorted
    once by group and order, so a group may take many partitions. Every task goes through its sorted part batch by batch; what a
    part's first group carries over from earlier parts comes from one summary row a part. Ties that ``order`` leaves open are
    broken in no stated way, so name columns until equal rows are alike. The result is a written table.
    """
    spark = rows.sparkSession
    folds = {"pos": np.add, **dict.fromkeys(sums, np.add), **dict.fromkeys(xors, np.bitwise_xor)}
    runs = [f if f == "pos" else f"run_{f}" for f in folds]
    names = [*rows.columns, "part", "seq", "in_first", *runs]
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", part long, seq long, in_first boolean, " + ", ".join(f"{r} long" for r in runs)
    local = persist_table(rows.sort(group, *order).mapInArrow(_within_part(group, folds, names), kinds), spark)
    last = F.max_by(F.struct(F.col(group).alias("key"), "in_first", *runs), "seq").alias("last")
    parts = local.groupBy("part").agg(F.min_by(F.struct(F.col(group).alias("key")), "seq").alias("first"), last).sort("part").collect()
    carry, before = [], None  # two rows of numbers a part, as many as the sort has partitions
    for p in parts:
        goes_on = before is not None and before.key == p.first.key
        given = {r: before[r] if goes_on else 0 for r in runs}
        if goes_on:
            carry.append((p.part, *given.values()))
        total = {r: f(given[r], p.last[r]) if p.last.in_first else p.last[r] for (r, f) in zip(runs, folds.values(), strict=True)}
        before = Row(key=p.last.key, **{r: int(v) for r, v in total.items()})
    if not carry:
        return local.drop("part", "seq", "in_first")
    carried = spark.createDataFrame(carry, "part long, " + ", ".join(f"c_{r} long" for r in runs))
    joined = local.join(F.broadcast(carried.withColumn("in_first", F.lit(True))), ["part", "in_first"], "left")
    added = []
    for r, f in zip(runs, folds.values(), strict=True):
        more = F.coalesce(F.col(f"c_{r}"), F.lit(0))
        added.append((F.col(r) + more if f is np.add else F.col(r).bitwiseXOR(more)).alias(r))
    return joined.select(*rows.columns, *added)
