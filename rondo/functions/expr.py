"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Round a double; adding zero turns -0.0 into 0.0."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))


def epoch_us(c: str | Column) -> Column:
    """Microseconds since the epoch (session time zone is UTC)."""
    return F.unix_micros(col(c).cast("timestamp"))


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return (epoch_us(end) - epoch_us(start)) / F.lit(1e6)


def add(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def share(cond: Column) -> Column:
    """Share of rows where ``cond`` holds; NULL counts as not holding."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (totals, bounds, fitted parameters) as a scalar subquery: no join."""
    row = one.select(F.struct(*one.columns).alias("_one")).scalar()
    return df.withColumn("_one", row).select(*df.columns, *[F.col("_one")[c].alias(c) for c in one.columns])


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Constant dictionary lookup as one map literal."""
    items = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*items), key)
    return found if default is None else F.coalesce(found, F.lit(default))


# ---- outcome probabilities -------------------------------------------------------------------

OUTCOMES = ((1, "p_home"), (0, "p_draw"), (-1, "p_away"))


def p_actual(prefix: str = "") -> Column:
    """Probability given to what happened."""
    return (
        F.when(F.col("actual") == 1, F.col(prefix + "p_home"))
        .when(F.col("actual") == 0, F.col(prefix + "p_draw"))
        .otherwise(F.col(prefix + "p_away"))
    )


def top_pick(home: Column, draw: Column, away: Column) -> Column:
    """Most likely outcome as 1 / 0 / -1; ties go to home, then draw."""
    top = F.greatest(home, draw, away)
    return F.when(home == top, 1).when(draw == top, 0).otherwise(-1)


def brier_row(home="p_home", draw="p_draw", away="p_away", actual="actual") -> Column:
    a = col(actual)
    return add([F.pow(col(p) - F.when(a == v, 1.0).otherwise(0.0), F.lit(2.0))
                for v, p in ((1, home), (0, draw), (-1, away))])


def logloss_row(eps: float = 1e-7, prefix: str = "") -> Column:
    return -F.ln(F.least(F.lit(1.0), F.greatest(F.lit(eps), p_actual(prefix))))


def hit(prefix: str = "") -> Column:
    pick = top_pick(*(F.col(prefix + p) for _, p in OUTCOMES))
    return F.when(pick == F.col("actual"), 1.0).otherwise(0.0)


# ---- distributions ---------------------------------------------------------------------------

#: Coefficients of a published rational approximation of the normal distribution function, absolute error under 7.5e-8 (fixed values).
NORMAL_T, NORMAL_B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(z: Column) -> Column:
    t = F.lit(1.0) / (F.lit(1.0) + F.abs(z) * NORMAL_T)
    tail = F.exp(-z * z / 2) / F.lit(2.5066282746310002) * reduce(lambda acc, b: (acc + b) * t, reversed(NORMAL_B), F.lit(0.0))
    return F.when(z >= 0, F.lit(1.0) - tail).otherwise(tail)
