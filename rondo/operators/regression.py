"""Poisson and logistic regressions by Newton steps, any number of fits side by side.

A step is one aggregate over the rows: gradient and Hessian of every fit are sums per key, so folds, feature groups or
slices are fitted in the same passes. Only these sums, a few numbers per fit, reach the driver, which solves the steps.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import add

FAMILIES = ("poisson", "logistic")


def fit_many(rows: DataFrame, features: Sequence[str], label: str, family: str, keys: Sequence[str] = (), offset: Column | None = None,
             groups: dict[str, Sequence[str]] | None = None, steps: int = 40, tolerance: float = 1e-10) -> DataFrame:
    """One maximum-likelihood fit per value of ``keys`` (and per feature group): keys, ``coefficients`` (the intercept, then the features), n, loss.

    ``groups`` maps names to subsets of the features; each group is a fit of its own, under column ``feature_group``, with 0 for the features it lacks.
    The number of keys and groups is meant to be small (folds, slices): each has a row on the driver. Rows with a NULL in a
    feature, the label or the offset are left out; a key without rows has no fit. ``loss`` is the mean negative log-likelihood up to terms of the label alone.
    A step that would raise the loss is halved; a singular Hessian takes the least-squares step.
    """
    if family not in FAMILIES:
        raise ValueError(f"family is one of {FAMILIES}")
    spark, keys, k = rows.sparkSession, list(keys), len(features) + 1
    xs = [F.lit(1.0).alias("_x0"), *[F.col(f).cast("double").alias(f"_x{i + 1}") for i, f in enumerate(features)]]
    data = rows.select(*keys, F.col(label).cast("double").alias("_y"), (F.lit(0.0) if offset is None else offset).cast("double").alias("_o"), *xs).dropna(subset=["_y", "_o", *[f"_x{i}" for i in range(k)]])
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    use = {g: np.array([True, *[f in names for f in features]]) for g, names in (groups or {"": features}).items()}
    fit_keys = [*keys, "feature_group"]
    types = {f.name: f.dataType.simpleString() for f in data.schema.fields}
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keys], "feature_group string", "b array<double>"])
    tasks = data.withColumn("feature_group", F.explode(F.array(*[F.lit(g) for g in use])))

    def sums(current: dict[tuple, np.ndarray] | None) -> dict[tuple, tuple]:
        """n, loss, gradient and Hessian of every fit at its coefficients (all 0 at first)."""
        if current is None:
            at, eta = tasks, F.col("_o")
        else:
            table = spark.createDataFrame([(*key, b.tolist()) for key, b in current.items()], schema)
            named = table.withColumnsRenamed({c: f"_k_{c}" for c in fit_keys})
            at = tasks.join(F.broadcast(named), [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in fit_keys])  # one row per fit
            eta = F.col("_o") + add([F.col("b")[i] * F.col(f"_x{i}") for i in range(k)])
        at = at.select(*fit_keys, "_y", *[f"_x{i}" for i in range(k)], eta.alias("_e"))
        if family == "poisson":
            mean, weight, loss = F.exp("_e"), F.col("_m"), F.col("_m") - F.col("_y") * F.col("_e")
        else:
            mean, weight = 1 / (1 + F.exp(-F.col("_e"))), F.col("_m") * (1 - F.col("_m"))
            loss = F.greatest(F.col("_e"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("_e"))) - F.col("_y") * F.col("_e")
        at = at.withColumn("_m", mean).withColumns({"_w": weight, "_l": loss, "_r": F.col("_y") - F.col("_m")})
        x = [F.col(f"_x{i}") for i in range(k)]
        out = at.groupBy(*fit_keys).agg(
            F.count(F.lit(1)).alias("n"), F.avg("_l").alias("loss"), F.array(*[F.sum(F.col("_r") * c) for c in x]).alias("g"),
            F.array(*[F.sum(F.col("_w") * x[i] * x[j]) for i in range(k) for j in range(k)]).alias("h"))
        return {tuple(r[c] for c in fit_keys): (r.n, r.loss, np.array(r.g), np.array(r.h).reshape(k, k)) for r in out.collect()}  # one row per fit

    try:
        best = sums(None)
        coefs = {key: np.zeros(k) for key in best}
        move = {key: np.zeros(k) for key in best}
        for key, (_, _, g, h) in best.items():
            move[key] = _step(g, h, use[key[-1]])
        for _ in range(steps):
            going = [key for key in best if np.abs(move[key]).max() > tolerance]
            if not going:
                break
            tried = sums({key: coefs[key] + move[key] for key in best})
            for key in going:
                found = tried[key]
                if np.isfinite(found[1]) and found[1] <= best[key][1] + 1e-12 * abs(best[key][1]):
                    coefs[key], best[key] = coefs[key] + move[key], found
                    move[key] = _step(found[2], found[3], use[key[-1]])
                else:
                    move[key] = move[key] / 2
    finally:
        data.unpersist()
    result = spark.createDataFrame([(*key, b.tolist(), int(best[key][0]), float(best[key][1])) for key, b in coefs.items()], f"{schema}, n long, loss double")
    result = result.withColumnRenamed("b", "coefficients")
    return result if groups else result.drop("feature_group")


def _step(g: np.ndarray, h: np.ndarray, use: np.ndarray) -> np.ndarray:
    out = np.zeros(len(g))
    out[use] = np.linalg.lstsq(h[np.ix_(use, use)], g[use], rcond=None)[0]
    return out


def linear(coefficients: str, features: Sequence[str]) -> Column:
    """Intercept and weighted features of a row that carries its fit's coefficients."""
    return add([F.col(coefficients)[0], *[F.col(coefficients)[i + 1] * F.col(f) for i, f in enumerate(features)]])
