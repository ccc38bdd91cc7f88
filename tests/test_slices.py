"""Sliced windows equal plain windows on keys of any size."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rondo.operators import slices as SL


@pytest.fixture(scope="module")
def rows(spark):
    # one key holds most rows; slices differ wildly in size
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 5).alias("k"), F.col("id"),
        F.timestamp_seconds(1_700_000_000 + F.pow(F.col("id") % 997, F.lit(2)).cast("long") * 60).alias("ts"), (F.xxhash64("id") % 7).cast("double").alias("x"))
    return df.cache()


@pytest.mark.parametrize("unit", ["hour", "day", "year"])
def test_halo_equals_plain_window(rows, unit):
    order = ["ts", "id"]
    plain = rows.withColumn("a", F.avg("x").over(Window.partitionBy("k").orderBy(*order).rowsBetween(-5, -1)))
    h = SL.with_halo(rows, ["k"], order, 5, unit)
    got = SL.drop_halo(h.withColumn("b", F.avg("x").over(SL.halo_window(["k"], order).rowsBetween(-5, -1))))
    j = plain.join(got.select("id", "b"), "id")
    assert j.count() == 3000
    assert j.filter(~F.col("a").eqNullSafe(F.col("b")) & (F.abs(F.col("a") - F.col("b")) > 1e-9)).count() == 0
    assert j.filter(F.col("a").isNull() != F.col("b").isNull()).count() == 0


@pytest.mark.parametrize("unit", ["hour", "month"])
def test_running_equals_plain_window(rows, unit):
    order = ["ts", "id"]
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    plain = rows.withColumn("a", F.coalesce(F.sum("x").over(w), F.lit(0.0)))
    got = SL.running(rows, ["k"], order, {"b": F.col("x")}, unit)
    bad = plain.join(got.select("id", "b"), "id").filter(F.abs(F.col("a") - F.col("b")) > 1e-9)
    assert bad.count() == 0 and got.count() == 3000


def test_prefix_sum_is_inclusive(rows):
    got = SL.prefix_sum(rows, ["k"], ["ts", "id"], {"n": F.lit(1)}, "day")
    assert got.groupBy("k").agg((F.max("n") - F.count(F.lit(1))).alias("d"), F.min("n").alias("lo")).filter("d != 0 OR lo != 1").count() == 0


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows lies in one hour of one key; NULL is a key, and some rows have no time."""
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 1, None).otherwise(2 + F.col("id") % 40).alias("k"), F.col("id"),
        F.when(F.col("id") % 97 != 5, F.when(F.col("id") % 3 == 0, F.timestamp_millis(1_700_000_000_000 + (F.col("id") * 7919) % 3_600_000)).otherwise(F.timestamp_seconds(1_600_000_000 + F.col("id") * 86_400))).alias("ts"),
        (F.xxhash64("id") % 7).cast("double").alias("x"))
    return df.cache()


@pytest.mark.parametrize("most", [50, 300, 1000])
def test_equi_depth_slices_hold_at_most_what_is_asked(hot, most):
    sliced = SL.add_slice(hot, ["k"], "ts", most)
    sizes = sliced.rows.filter("ts is not null").groupBy("k", SL.SLICE).count()
    assert not sliced.whole and sizes.agg(F.max("count")).first()[0] <= most
    several = sizes.groupBy("k").count().filter("count > 1").select("k").collect()
    assert {r.k for r in several} <= {r[0] for r in sliced.hot.collect()} and (1,) in several
    order = sliced.rows.groupBy("k", SL.SLICE).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()
    spans = sorted(((r.k, r[1], r.a, r.b) for r in order if r.k == 1), key=lambda r: r[1])
    assert all(p[3] is None or p[3] < q[2] for p, q in zip(spans, spans[1:]))


@pytest.mark.parametrize("most", [50, 1000, 100_000])
def test_equi_depth_slices_give_the_same_results(hot, most):
    order = ["ts", "id"]
    w = Window.partitionBy("k").orderBy(*order)
    want = {r.id: (r.a, r.s) for r in hot.withColumn("a", F.avg("x").over(w.rowsBetween(-4, -1))).withColumn("s", F.coalesce(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).collect()}
    mean = SL.drop_halo(SL.with_halo(hot, ["k"], order, 4, most).withColumn("a", F.avg("x").over(SL.halo_window(["k"], order).rowsBetween(-4, -1))))
    sums = {r.id: r.s for r in SL.running(hot, ["k"], order, {"s": F.col("x")}, most).collect()}
    got = {r.id: (r.a, sums[r.id]) for r in mean.collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] is want[i][0] or abs(got[i][0] - want[i][0]) < 1e-9 for i in want) and all(abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_asof_join_of_a_hot_key(spark, hot):
    from rondo.operators.joins import asof_row

    events = hot.filter("id % 5 = 0").select(F.col("k").alias("team_id"), F.col("id").alias("match_id"), F.col("ts").cast("timestamp_ntz").alias("kickoff_ts"))
    rows = hot.filter("id % 5 != 0").select(F.col("k").alias("team_id"), F.col("ts").cast("timestamp_ntz").alias("announced_ts"), "x", "id")
    plain = {r.match_id: r.row for r in asof_row(events, rows, ["x", "id"], tie="id").collect()}
    cut = {r.match_id: r.row for r in asof_row(events, rows, ["x", "id"], tie="id", unit=60).collect()}
    assert cut == plain and len(plain) == 1200 and sum(v is not None for v in plain.values()) > 300
    by = {}
    for r in rows.collect():
        if r.team_id is not None and r.announced_ts is not None:
            by.setdefault(r.team_id, []).append((r.announced_ts, r.id, r.x))
    for r in events.collect():
        best = max((v for v in by.get(r.team_id, []) if r.kickoff_ts and v[0] < r.kickoff_ts), default=None)
        assert (plain[r.match_id] and plain[r.match_id].id) == (best and best[1])


def test_ks_of_a_skewed_feature_is_spread_evenly(spark):
    """A log-normal feature with far outliers; slices of the cumulative counts have at most what is asked, and the statistic is the plain one."""
    import numpy as np

    from rondo.operators import drift as D

    rng = np.random.default_rng(4)
    ref, cur = np.exp(rng.normal(0, 3, 4000)), np.append(np.exp(rng.normal(0.2, 3, 2500)), [1e12, 5e13])
    rows = [("f", "ref", float(v)) for v in ref] + [("f", "cur", float(v)) for v in cur] + [("g", "ref", 1.0), ("g", "cur", 2.0)]
    df = spark.createDataFrame(rows, "feature string, side string, value double")
    got = {r.feature: r.ks for r in D.ks_two_sample(df, most=200).collect()}
    grid = np.concatenate([ref, cur])
    gap = np.abs(np.searchsorted(np.sort(ref), grid, "right") / len(ref) - np.searchsorted(np.sort(cur), grid, "right") / len(cur)).max()
    assert got["f"] == pytest.approx(gap, abs=1e-12) and got["g"] == 1.0
    sizes = SL.add_slice(df.select("feature", "value").distinct(), ["feature"], "value", 200).rows.groupBy("feature", SL.SLICE).count()
    assert sizes.agg(F.max("count")).first()[0] <= 200


def test_rows_without_keys_are_cut(spark):
    """No keys: all rows are one key, which is cut like any other, with rows that have no time before all."""
    df = spark.range(2000).select("id", F.when(F.col("id") % 97 != 5, (F.col("id") * 7919) % 2003).alias("ts"), (F.col("id") % 7).cast("double").alias("x")).cache()
    sliced = SL.add_slice(df, [], "ts", 100)
    assert not sliced.whole and sliced.rows.filter("ts is not null").groupBy(SL.SLICE).count().agg(F.max("count")).first()[0] <= 100
    w = Window.orderBy("ts", "id")
    plain = df.select("id", F.coalesce(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("a"), F.sum("x").over(w.rowsBetween(-5, 0)).alias("c"))
    got = SL.running(df, [], ["ts", "id"], {"b": F.col("x")}, 100)
    halo = SL.drop_halo(SL.with_halo(df, [], ["ts", "id"], 5, 100).withColumn("d", F.sum("x").over(SL.halo_window([], ["ts", "id"]).rowsBetween(-5, 0))))
    both = plain.join(got.select("id", "b"), "id").join(halo.select("id", "d"), "id")
    assert both.count() == 2000 and both.filter("a != b or c != d").count() == 0
