"""Isotonic calibration of any number of points: adjacent violators are pooled slice by slice, in parallel.

A slice is a stretch of neighbouring probabilities of bounded length. Within it one task pools violators; what is left are blocks.
While the last block of some slice lies above the first one of the next, neighbouring slices are pooled in pairs, one time with the slice
before and one time with the slice after. Pooling may be done in any order, so the result is that of the plain algorithm.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import OUTCOMES, clip
from ..session import persist_table, release
from . import scoring as S
from .slices import MOST, SLICE, add_slice, drop_halo, halo_window, with_halo

BLOCK = "lo double, hi double, weight double, total double"


def pool(lo, hi, weight, total) -> list[list[float]]:
    """Blocks of neighbouring points whose means ascend, by a stack."""
    stack: list[list[float]] = []
    for block in zip(lo, hi, weight, total):
        block = list(block)
        while stack and stack[-1][3] * block[2] >= block[3] * stack[-1][2]:
            before = stack.pop()
            block = [before[0], block[1], before[2] + block[2], before[3] + block[3]]
        stack.append(block)
    return stack


def _pool_slices(most: int):
    """Pool one slice or two neighbouring ones; two become one where few blocks are left, else the right one keeps what begins in it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lo")
        made = pd.DataFrame(pool(rows["lo"], rows["hi"], rows["weight"], rows["total"]), columns=["lo", "hi", "weight", "total"])
        fixed = {c: rows[c].iloc[0] for c in rows.columns if c not in ("lo", "hi", "weight", "total")}
        made = made.assign(**fixed)
        right = rows.loc[rows[SLICE] != rows[SLICE].iloc[0]]
        if len(right) and len(made) > most:
            made.loc[made["lo"] >= right["lo"].iloc[0], SLICE] = right[SLICE].iloc[0]
        return made[list(rows.columns)]

    return run


def fit_isotonic(df: DataFrame, keys: list[str] = (), most: int = MOST) -> DataFrame:
    """One monotone map per outcome (and per value of ``keys``) from its probability to its observed rate: keys, outcome, lo, hi, value, weight.

    Equal probabilities are one point. Rows with a NULL probability or outcome are left out. ``most`` is the number of points or blocks that a task pools at a time.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(v).alias("outcome"), F.col(p).cast("double").alias("x"), F.when(F.col("actual") == v, 1.0).otherwise(0.0).alias("y")) for v, p in OUTCOMES]))
    rows = df.filter(F.col("actual").isNotNull()).select(*keys, sides.alias("s")).select(*keys, "s.*").filter(F.col("x").isNotNull())
    by = [*keys, "outcome"]
    blocks = persist_table(rows.groupBy(*by, F.col("x").alias("lo")).agg(F.max("x").alias("hi"), F.count(F.lit(1)).cast("double").alias("weight"), F.sum("y").alias("total")))
    sliced = add_slice(blocks, by, "lo", most)
    schema = ", ".join(f"`{n}` {t}" for n, t in [*sliced.rows.dtypes, ("pair", "bigint")])
    made = persist_table(sliced.rows.withColumn("pair", F.col(SLICE).cast("bigint")).groupBy(*by, "pair").applyInPandas(_pool_slices(most), schema))
    release(blocks)
    blocks, odd = made, 0
    while not sliced.whole and _out_of_order(blocks, by).limit(1).count():
        place = F.dense_rank().over(Window.partitionBy(*by).orderBy(SLICE)) + odd  # one row per slice
        pairs = blocks.select(*by, SLICE).distinct().select(*[F.col(c).alias(f"_p_{c}") for c in [*by, SLICE]], F.floor(place / 2).alias("pair"))
        same = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in [*by, SLICE]]
        made = persist_table(blocks.drop("pair").join(sliced.small(pairs), same).select(*sliced.rows.columns, "pair").groupBy(*by, "pair").applyInPandas(_pool_slices(most), schema))
        release(blocks)
        blocks, odd = made, 1 - odd
    return blocks.select(*by, "lo", "hi", (F.col("total") / F.col("weight")).alias("value"), "weight")


def _out_of_order(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Slices whose first block does not lie above the last one of the slice before."""
    mean = F.col("total") / F.col("weight")
    ends = blocks.groupBy(*by, SLICE).agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"))
    before = F.lag("last").over(Window.partitionBy(*by).orderBy(SLICE))
    return ends.withColumn("before", before).filter(F.col("before") >= F.col("first"))


def _calibrated(df: DataFrame, name: str, blocks: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``df`` with the map's value at column ``name`` in its place: the value of the block it lies in, straight lines between blocks, the end blocks' values beyond.

    One pass: rows and blocks are united and a window keeps the last block begun, per key and slice; a slice starts from the last block of earlier ones.
    """
    whole = F.struct(*[F.col(c) for c in df.columns])
    downwards = with_halo(blocks.select(*keys, "lo", "hi", "value", (-F.col("lo")).alias("_neg")), keys, ["_neg"], 1, most)
    after = halo_window(keys, ["_neg"])
    linked = drop_halo(downwards.withColumns({"next_lo": F.lag("lo").over(after), "next_value": F.lag("value").over(after)}))
    first = blocks.groupBy(*keys).agg(F.min_by("value", "lo").alias("lowest")) if keys else blocks.agg(F.min_by("value", "lo").alias("lowest"))
    begun = linked.select(*keys, F.col("lo").alias("_x"), F.lit(0).alias("_side"), F.struct("hi", "value", "next_lo", "next_value").alias("_b"))
    rows = df.select(*keys, F.col(name).cast("double").alias("_x"), F.lit(1).alias("_side"), whole.alias("_row"))
    sliced = add_slice(rows.unionByName(begun, allowMissingColumns=True), list(keys), "_x", most)
    inside = Window.partitionBy(*keys, SLICE).orderBy("_x", "_side")
    last, out = F.last("_b", ignorenulls=True).over(inside), sliced.rows
    if not sliced.whole:
        ends = sliced.of_hot_keys().groupBy(*keys, SLICE).agg(F.max_by("_b", F.when(F.col("_b").isNotNull(), F.col("_x"))).alias("_end"))
        before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.select(*[F.col(c).alias(f"_c_{c}") for c in keys], F.col(SLICE).alias("_c_slice"), F.last("_end", ignorenulls=True).over(before).alias("_carry"))
        here = [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in keys] + [F.col(SLICE) == F.col("_c_slice")]
        out, last = out.join(sliced.small(carry), here, "left"), F.coalesce(last, F.col("_carry"))
    out = out.select(*keys, "_x", "_row", last.alias("_at")).filter(F.col("_row").isNotNull())
    at = F.col("_at")
    line = at["value"] + (F.col("_x") - at["hi"]) / (at["next_lo"] - at["hi"]) * (at["next_value"] - at["value"])
    lowest = first.withColumnsRenamed({c: f"_f_{c}" for c in keys})
    if keys:
        out = out.join(F.broadcast(lowest), [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in keys], "left")  # one row per key of the maps
    else:
        out = out.withColumn("lowest", lowest.scalar())
    value = F.when(F.col("_x").isNull(), F.lit(None)).when(at.isNull(), F.col("lowest")).when((F.col("_x") <= at["hi"]) | at["next_lo"].isNull(), at["value"]).otherwise(line)
    return out.select("_row.*", value.alias("_value")).drop(name).withColumnRenamed("_value", name)


def apply_isotonic(blocks: DataFrame, df: DataFrame, keys: list[str] = (), most: int = MOST) -> DataFrame:
    """Calibrated, renormalised probabilities. The rows are written after each outcome, so that cutting the next one's slices does not run the maps before it again."""
    columns, before = df.columns, None
    for v, p in OUTCOMES:
        df = persist_table(_calibrated(df, p, blocks.filter(F.col("outcome") == v), list(keys), most))
        if before is not None:
            release(before)
        before = df
    return S.normalise(df.withColumns({p: clip(F.col(p), 1e-6, 1.0) for _, p in OUTCOMES})).select(*columns)


def cross_fitted(df: DataFrame, fold: Column, folds: int, most: int = MOST) -> DataFrame:
    """Every row calibrated by maps fitted on the rows of all other folds; ``fold`` is a number from 0. All maps are fitted together."""
    held = df.withColumn("_fold", fold.cast("int"))
    others = held.withColumn("_out", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda i: i != F.col("_fold")))).drop("_fold").withColumnRenamed("_out", "_fold")
    return apply_isotonic(fit_isotonic(others, ["_fold"], most), held, ["_fold"], most).select(*df.columns)
