"""Forests of resamples over weighted cells: the draws, the trees and the whole against plain ways."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from rondo.operators import forests as FO
from rondo.operators import models as MD


def rows(spark, n=3000):
    df = spark.range(n).select(F.col("id").alias("match_id"), (F.pmod(F.xxhash64("id"), F.lit(1009)) / 1009).alias("u"), (F.col("id") % 2).cast("double").alias("v"), F.lit(7.0).alias("c"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)).cast("double").alias("n"))
    return df.withColumn("label", F.when(F.col("u") + 0.1 * F.col("v") > 0.7, 0.0).otherwise(F.col("n")))


def test_draws_of_cells_are_those_of_their_rows(spark):
    """Repeated and missing keys, values on a cut, an infinite value; no more rows than cells and resamples."""
    df = rows(spark).unionByName(rows(spark, 50)).withColumn("match_id", F.when(F.col("match_id") % 100 != 5, F.col("match_id"))).withColumn("u", F.when(F.col("u") > 0.99, math.inf).otherwise(F.round("u", 1)))
    df = df.withColumnRenamed("match_id", "_key").cache()
    cuts = [[sorted(math.nextafter(c, math.inf) for c in (0.2, 0.5 + b / 10)), [math.nextafter(0.5, math.inf)], []] for b in (0, 1)]
    got = {(r.replicate, r.b0, r.b1, r.b2, r.y): [r[f"n{k}"] for k in range(1, 13)] for r in FO.cell_draws(df, "label", ["u", "v", "c"], cuts, range(4, 6), 3).collect()}
    want = {}
    for b in (4, 5):
        for r in df.withColumn("t", FO.drawn_times(F.col("_key"), b, 3)).filter("t > 0").collect():
            at = (b, (r.u > 0.2) + (r.u > 0.5 + (b - 4) / 10), int(r.v > 0.5), 0, int(r.label))
            want.setdefault(at, [0] * 12)[int(r.t) - 1] += 1
    assert got == want and len(got) <= 2 * 3 * 2 * 3


def test_a_cell_deals_as_its_rows_would(spark):
    """Sums of k x Poisson(n_k): their mean and variance, and the same numbers however batches are cut."""
    draws = spark.createDataFrame([(b, i, i % 3, *[n * (i + 1) for n in (40, 20, 5)], *[0] * 9) for b in range(2) for i in range(40)], ", ".join(["replicate int, b0 int, y int", *[f"n{k} bigint" for k in range(1, 13)]]))
    got = {(r.replicate, r.b0): r.weights for r in FO.tree_weights(draws, 1, 400, 5).collect()}
    z = np.array([(np.array(w) - (40 + 40 + 15) * (i + 1)) / math.sqrt((40 + 80 + 45) * (i + 1)) for (_, i), w in got.items()])
    assert z.shape == (80, 400) and abs(z.mean()) < 0.03 and abs(z.var() - 1) < 0.05 and len({tuple(w) for w in got.values()}) == 80
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        again = {(r.replicate, r.b0): r.weights for r in FO.tree_weights(draws.repartition(5), 1, 400, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert again == got


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_trees_are_those_of_spark(spark, depth):
    """Every tree is offered all features: the same gains, pruned alike, as one tree of Spark's fitted to the same weights."""
    rng = np.random.default_rng(depth)
    cells = [(b, int(x), int(v), int(y), [int(k) for k in rng.poisson(1 + 9 * (y == (x > 4) + (v > 1)), 2)]) for b in (7, 8) for x in range(9) for v in range(4) for y in range(3)]
    weights = spark.createDataFrame(cells, "replicate int, b0 int, b1 int, y int, weights array<bigint>").repartition(3).cache()
    got = FO.grow(weights, range(7, 9), 2, depth, 2, 9, 3, 2, 1)
    assert got.feature.shape == (2, 2, 1 << depth)
    for b in (7, 8):
        shares = []
        for t in range(2):
            one = weights.filter(F.col("replicate") == b).select("b0", "b1", F.col("y").cast("double").alias("label"), F.col("weights")[t].cast("double").alias("w")).filter("w > 0").coalesce(1)
            fit = RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy="all", maxDepth=depth, weightCol="w").fit(VectorAssembler(inputCols=["b0", "b1"], outputCol="features").transform(one))
            assert fit.trees[0].numNodes == 2 * got.pruned()[b - 7, t].sum() + 1
            shares.append(fit.featureImportances.toArray())
        assert got.importances(2)[b - 7] == pytest.approx(sum(shares) / sum(map(sum, shares)), abs=1e-9)


def test_bins_begin_where_those_of_spark_do():
    assert FO._value_cuts(np.array([2.0, 1.0, 4.0, 2.0]), np.ones(4), 4.0) == [1.5, 3.0]
    assert FO._value_cuts(np.array([0.0, 1.0, 0.0]), np.ones(3), 3.0) == [0.5] and FO._value_cuts(np.array([5.0] * 9), np.ones(9), 9.0) == []
    cuts = FO._value_cuts(np.arange(1.0, 6401.0), np.ones(6400), 6400.0)
    assert len(cuts) == 31 and cuts == pytest.approx([200 * i + 0.5 for i in range(1, 32)])


def test_offered_features_are_any_some(spark):
    got = FO._offered(np.random.default_rng(1), (200, 100), 4, 2).reshape(-1, 2)
    pairs, n = np.unique(np.sort(got, axis=1), axis=0, return_counts=True)
    assert len(pairs) == 6 and (pairs[:, 0] < pairs[:, 1]).all() and abs(n / 20_000 - 1 / 6).max() < 0.02


def test_importance_by_resamples(spark, monkeypatch):
    """Blocks of resamples give what one block gives, in a number of jobs that does not follow the resamples; rows without a feature are skipped; labels are checked."""
    df = rows(spark).withColumn("v", F.when(F.col("match_id") % 50 != 3, F.col("v"))).cache()
    features = ["u", "v", "c"]

    def jobs(replicates):
        spark.sparkContext.setJobGroup(f"forests {replicates}", "")
        out = {r.feature: tuple(r)[1:] for r in MD.bootstrap_importance(df, features, replicates=replicates, trees=4, depth=3).collect()}
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forests {replicates}"))

    few, n_few = jobs(3)
    many, n_many = jobs(9)
    assert abs(n_few - n_many) <= 6 and sum(v[0] for v in many.values()) == pytest.approx(1.0)
    assert many["c"] == (0.0, 0.0, 0.0) and many["u"][0] > 0.8 and all(low <= mean <= high for mean, low, high in many.values())
    monkeypatch.setattr(FO, "BLOCK", 2)
    assert FO.resampled_importances(df, "match_id", "label", features, 3, 4, 3, 42).mean(axis=0) == pytest.approx([few[f][0] for f in features])
    with pytest.raises(Exception, match="labels must be"):
        MD.bootstrap_importance(df.withColumn("label", F.when(F.col("u") < 0.9, F.col("label"))), features, replicates=2, trees=2, depth=2).collect()
