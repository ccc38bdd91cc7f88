import numpy as np
import pytest
from pyspark.sql import functions as F

from rondo.operators import quantiles as Q


@pytest.mark.parametrize("cells", [1, 7, 1024])
def test_exact_for_hot_and_tied_groups(spark, monkeypatch, cells):
    monkeypatch.setattr(Q, "_CELLS", cells)
    df = spark.range(40_000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))).alias("k"),
        F.when(F.col("id") % 4 == 0, F.lit(3.0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_000)) / 7.0).alias("v")).cache()
    qs = {"a": 0.05, "b": 0.5, "c": 0.975}
    got = {r.k: r for r in Q.exact_quantiles(df, ["k"], "v", qs).collect()}
    pdf = df.toPandas()
    for k, g in pdf.groupby("k"):
        for n, q in qs.items():
            assert got[k][n] == pytest.approx(np.quantile(g.v, q), abs=1e-9), (k, n)


def test_without_keys_and_with_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,), (2.0,), (10.0,)], "v double")
    assert Q.exact_quantiles(df, [], "v", {"m": 0.5}).first().m == 3.0


def test_tiny_groups_nulls_and_plans(spark):
    import random

    rng = random.Random(1)
    rows = [(g, float(rng.randint(0, 5))) for g in range(60) for _ in range(rng.randint(1, 6))] + [(None, 2.0), (None, 4.0), (99, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    qs = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 1.0}
    for r in Q.exact_quantiles(df, ["k"], "v", qs).collect():
        own = [v for k, v in rows if k == r.k and v is not None]
        for n, q in qs.items():
            assert r[n] == (pytest.approx(np.quantile(own, q)) if own else None)
    assert Q.exact_quantiles(df.filter("v is null"), [], "v", {"m": 0.5}).collect()[0].m is None
    plan = Q.exact_quantiles(df, [], "v", qs)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
