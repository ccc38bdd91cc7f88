"""Exact quantiles of unbounded groups.

The built-in exact percentile keeps every distinct value of a group in one task. Here a sketch first brackets each
quantile (its rank error is a tenth of the bracket's margin), one pass counts what lies below the brackets and keeps the nearest values outside
them, and only the values inside - about 0.2 % of a large group - are ranked, in cells of a bracket's width rather than whole brackets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import with_one_row
from .slices import running

_MARGIN = 0.001
_ACCURACY = 10_000
_CELLS = 1024


def _attach(rows: DataFrame, per_group: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The columns of a one-row-per-group frame beside the rows; NULL is a group like any other. Without keys a scalar, not a join."""
    if not keys:
        return with_one_row(rows, per_group)
    named = per_group.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    return rows.join(named, same, how).drop(*[f"_g_{k}" for k in keys])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """One row per group: keys and one linearly interpolated quantile per name. NULL values are ignored; a group of NULLs has NULL quantiles,
    and without keys there is always one row."""
    names = list(quantiles)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    ends = [p for n in names for p in (max(0.0, quantiles[n] - _MARGIN), min(1.0, quantiles[n] + _MARGIN))]
    sketch = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", ends, _ACCURACY).alias("_b"))
    tagged = _attach(rows.filter(F.col("_v").isNotNull()), sketch, keys)
    lo, hi = (lambda i: F.col("_b")[2 * i]), (lambda i: F.col("_b")[2 * i + 1])
    v = F.col("_v")
    outside = tagged.groupBy(*keys).agg(*[
        c for i in range(len(names)) for c in (
            F.count_if(v < lo(i)).alias(f"_u{i}"), F.count_if(v.between(lo(i), hi(i))).alias(f"_in{i}"),
            F.max(F.when(v < lo(i), v)).alias(f"_under{i}"), F.min(F.when(v > hi(i), v)).alias(f"_over{i}"))])
    cell = lambda i: F.coalesce(F.floor(F.try_divide(v - lo(i), hi(i) - lo(i)) * _CELLS), F.lit(0))
    hits = F.filter(F.array(*[F.when(v.between(lo(i), hi(i)), F.struct(F.lit(i).alias("q"), cell(i).alias("cell"))) for i in range(len(names))]), lambda x: x.isNotNull())
    inside = tagged.select(*keys, "_v", F.explode(hits).alias("_h")).groupBy(*keys, F.col("_h.q").alias("_q"), F.col("_h.cell").alias("_cell"), "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(inside, [*keys, "_q"], ["_v"], {"_before": F.col("_c")}, F.col("_cell"))
    groups = _attach(sketch.select(*keys, "_n"), outside, keys, "left")
    ranked = _attach(ranked, groups, keys)

    def rank(i: int, side) -> Column:
        return side((F.col("_n") - 1) * F.lit(float(quantiles[names[i]])))

    def at(i: int, side) -> Column:
        r = rank(i, side) - F.col(f"_u{i}")
        return F.max(F.when((F.col("_q") == i) & (F.col("_before") <= r) & (r < F.col("_before") + F.col("_c")), F.col("_v")))

    picked = ranked.groupBy(*keys).agg(*[c for i in range(len(names)) for c in (at(i, F.floor).alias(f"_a{i}"), at(i, F.ceil).alias(f"_z{i}"))])
    found = _attach(groups, picked, keys, "left")

    def value_at(i: int, side, inner: str) -> Column:
        r, under, held = rank(i, side), F.col(f"_u{i}"), F.col(f"_in{i}")
        missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
        return F.when(F.col("_n") == 0, None).when(r == under - 1, F.col(f"_under{i}")).when(r == under + held, F.col(f"_over{i}")).when((r < under) | (r > under + held), missed).otherwise(F.col(inner))

    def interpolated(i: int) -> Column:
        a, z = value_at(i, F.floor, f"_a{i}"), value_at(i, F.ceil, f"_z{i}")
        pos = (F.col("_n") - 1) * F.lit(float(quantiles[names[i]]))
        return a + (z - a) * (pos - F.floor(pos))

    return found.select(*keys, *[interpolated(i).alias(n) for i, n in enumerate(names)])
