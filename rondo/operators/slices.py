"""Ordered windows that survive hot keys.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts all rows of a key into one task. Here a key with many rows is
cut into slices of its order column and the window runs per (key, slice). Cut points are equi-depth: they come from a mergeable
quantile sketch of the key's own values, so a slice holds at most a set number of rows wherever in time they lie. Keys below that
number are one slice. What a slice needs from earlier slices is computed from small per-slice summaries, so results stay exact:

* ``with_halo``   - bounded row frames: the last n earlier rows of the key are added as halo rows;
* ``running``     - unbounded frames of sums: per-slice totals are prefix-summed and added;
* as-of joins carry the last non-null value of earlier slices in the same way (``joins.asof_wide``).

The summary tables hold at most n rows per slice of a hot key. ``unit`` says how slices are cut: a number of rows (equi-depth, the default), a
date_trunc unit ('day', 'month', ...) or any column that does not decrease in the order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import with_one_row

SLICE = "_slice"
HALO = "_halo"
MOST = 1_000_000  # rows of a key that a window task takes
BLOCK = 128  # cut points looked through at a time
Unit = str | Column | int


@dataclass
class Sliced:
    """Rows with their slice. ``hot``: the keys that have several slices, one row each; None means all keys may."""

    rows: DataFrame
    keys: list[str]
    hot: DataFrame | None = None
    whole: bool = False  # every key is one slice

    def of_hot_keys(self) -> DataFrame:
        """Rows of the keys whose slices need something from earlier ones."""
        return self.rows if self.hot is None or not self.keys else self.rows.join(F.broadcast(self.hot), _same(self.keys, "_hot_"), "left_semi")

    def small(self, summary: DataFrame) -> DataFrame:
        """Per-slice summaries with a broadcast hint if they are of hot keys: these have at most four slices for each ``unit`` rows of the table."""
        return summary if self.hot is None else F.broadcast(summary)


def _same(keys: list[str], prefix: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in keys]


def cut_points(df: DataFrame, keys: list[str], ts: str, most: int = MOST) -> DataFrame | None:
    """Per key with more than ``most`` rows (NULL is a key like any other; without keys all rows are of one) ``_cuts``, ascending values of ``ts``; None if there is no such key.

    Between two neighbouring cut points lie at most ``most`` rows, save for rows of one single value, which stay together. A slice
    is aimed at half of ``most``; the rest covers the error of the sketch.
    """
    if df.count() <= most:  # no key can have more
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).withColumnsRenamed({k: f"_hot_{k}" for k in keys})
    largest = counts.agg(F.max("_n")).first()[0]
    if largest is None:
        return None
    parts = -(-2 * largest // most)
    shares = [(i + 1) / parts for i in range(parts - 1)]
    sketch = F.percentile_approx(ts, shares, max(10_000, 4 * parts)).alias("_q")
    hot = df.join(F.broadcast(counts), _same(keys, "_hot_")) if keys else df  # at most rows / most keys
    found = hot.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), sketch)
    # a smaller hot key takes every so-manieth of the quantiles
    step = F.greatest(F.lit(1), F.floor(F.lit(parts) * most / (2 * F.col("_n"))).cast("int"))
    picked = F.filter("_q", lambda _, i: (i + 1) % step == 0)
    return found.select(*keys, F.array_distinct(picked).alias("_cuts"))


def _slice_of(cuts: Column, value: Column) -> Column:
    """Number of cut points not above the value, looked for by blocks and then inside one; NULL comes before all."""
    first = F.transform(F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / BLOCK).cast("int")), lambda b: cuts[b * BLOCK])
    block = F.greatest(F.lit(0), F.size(F.filter(first, lambda c: c <= value)) - 1)
    inside = F.transform(F.array(block), lambda b: b * BLOCK + F.size(F.filter(F.slice(cuts, b * BLOCK + 1, F.lit(BLOCK)), lambda c: c <= value)))[0]
    return F.when(F.size(cuts) > 0, inside).otherwise(0)


def add_slice(df: DataFrame, keys: list[str], ts: str, unit: Unit = MOST) -> Sliced:
    """``df`` with its slice column, cut by ``unit``."""
    if not isinstance(unit, int):
        return Sliced(df.withColumn(SLICE, unit if isinstance(unit, Column) else F.date_trunc(unit, F.col(ts))), keys)
    cuts = cut_points(df, keys, ts, unit)
    if cuts is None:
        return Sliced(df.withColumn(SLICE, F.lit(0)), keys, whole=True)
    cuts = cuts.withColumnsRenamed({k: f"_hot_{k}" for k in keys})
    rows = df.join(F.broadcast(cuts), _same(keys, "_hot_"), "left") if keys else with_one_row(df, cuts)  # at most four cut points for each ``unit`` rows
    at = F.when(F.col("_cuts").isNull(), 0).otherwise(_slice_of(F.col("_cuts"), F.col(ts)))
    return Sliced(rows.select(*df.columns, at.alias(SLICE)), keys, cuts.drop("_cuts"))


def carried_rows(sliced: Sliced, order: list[str], n: int) -> DataFrame:
    """One row per (key, slice) that has earlier rows: ``_prev`` = the last n rows of earlier slices, oldest first."""
    keys, rows = sliced.keys, sliced.of_hot_keys()
    payload = [c for c in rows.columns if c != SLICE]
    newest = Window.partitionBy(*keys, SLICE).orderBy(*[F.col(c).desc() for c in order])
    tail = rows.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n).drop("_r")
    by_key = Window.partitionBy(*keys).orderBy(SLICE, *order)
    prev = F.collect_list(F.struct(*payload)).over(by_key.rowsBetween(-n, -1))
    before = F.lag(SLICE).over(by_key)
    return (tail.withColumn("_prev", prev).withColumn("_before", before)
            .filter(F.col("_before") < F.col(SLICE)).select(*keys, SLICE, "_prev"))


def with_halo(df: DataFrame, keys: list[str], order: list[str], n: int, unit: Unit = MOST) -> DataFrame:
    """``df`` plus slice and halo rows; run row frames of at most n preceding rows over ``halo_window``, then keep ``~_halo``."""
    sliced = add_slice(df, keys, order[0], unit)
    rows = sliced.rows.withColumn(HALO, F.lit(False))
    if sliced.whole:
        return rows
    carried = carried_rows(sliced, order, n).select(SLICE, F.explode("_prev").alias("_p")).select("_p.*", SLICE, F.lit(True).alias(HALO))
    return rows.unionByName(carried)


def halo_window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(HALO, SLICE)


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], unit: Unit = MOST) -> DataFrame:
    """Add, per row, the sum of each expression over all strictly earlier rows of the key (0 when there are none).

    No row is lost: NULL is a key like any other, and rows without a time come first.
    """
    valued = df.withColumns({f"_x_{n}": e for n, e in sums.items()})
    sliced = add_slice(valued, keys, order[0], unit)
    inside = halo_window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    here = {n: F.coalesce(F.sum(f"_x_{n}").over(inside), zero) for n in sums}
    if sliced.whole:
        return sliced.rows.select(*df.columns, *[c.alias(n) for n, c in here.items()])
    totals = sliced.of_hot_keys().groupBy(*keys, SLICE).agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, SLICE, *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums])
    named = carry.withColumnsRenamed({c: f"_r_{c}" for c in [*keys, SLICE]})
    out = sliced.rows.join(sliced.small(named), _same([*keys, SLICE], "_r_"), "left")
    return out.select(*df.columns, *[(F.coalesce(F.col(f"_c_{n}"), zero) + c).alias(n) for n, c in here.items()])


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], unit: Unit = MOST) -> DataFrame:
    """Inclusive running sums: ``running`` plus the row itself."""
    out = running(df, keys, order, sums, unit)
    return out.select(*df.columns, *[(F.col(n) + F.coalesce(e, F.lit(0))).alias(n) for n, e in sums.items()])
