from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rondo.operators import joins as J
from rondo.operators import windows as W

D0 = datetime(2026, 3, 1, 12)


def players(*names, position="Defender"):
    return [{"name": n, "position": position} for n in names]


def snaps(spark, rows):
    return spark.createDataFrame(rows, "team_id long, announced_ts timestamp, players array<struct<name:string,position:string>>")


def continuity(spark, *squads):
    df = snaps(spark, [(1, D0 + timedelta(days=i), s) for i, s in enumerate(squads)])
    return W.squad_continuity(df).orderBy("announced_ts").collect()


def test_first_squad_against_the_empty_set(spark):
    first = continuity(spark, players("A", "B"))[0]
    assert (first.continuity_index, first.squad_size_delta, first.squad_size) == (0.0, 0, 2)
    assert first.midfielders_continuity == 1.0  # empty on both sides


def test_identical_disjoint_and_empty(spark):
    same = continuity(spark, players("A", "B"), players("A", "B"))[1]
    assert same.continuity_index == 1.0 and same.squad_size_delta == 0
    assert continuity(spark, players("A"), players("B"))[1].continuity_index == 0.0
    assert continuity(spark, [], [])[1].continuity_index == 1.0


def test_positional_continuity(spark):
    old = players("A") + players("B", position="Midfielder")
    new = players("A") + players("C", position="Midfielder") + players("D")
    r = continuity(spark, old, new)[1]
    assert (r.defenders_continuity, r.midfielders_continuity, r.squad_size_delta) == (0.5, 0.0, 1)


def test_out_of_order_snapshots_give_the_same_timeline(spark):
    a, b, c = [(7, D0 + timedelta(days=i), players(*n)) for i, n in enumerate(("AB", "BC", "CD"))]
    x = W.feature_timeline(snaps(spark, [a, b, c])).orderBy("feature_ts", "feature_name").collect()
    y = W.feature_timeline(snaps(spark, [c, a, b])).orderBy("feature_ts", "feature_name").collect()
    assert x == y and len(x) == 18


def test_lead_hours_and_violation(spark):
    df = spark.createDataFrame([(D0, D0 + timedelta(hours=5)), (D0, D0 - timedelta(hours=1))], "announced_ts timestamp, kickoff_ts timestamp")
    rows = W.lead_hours(df).collect()
    assert [(r.lead_hours, r.lead_violation) for r in rows] == [(5.0, False), (-1.0, True)]


def test_asof_is_strict_and_keeps_unmatched_events(spark):
    ev = spark.createDataFrame([(1, 9, D0), (2, 9, D0 + timedelta(hours=1)), (3, 8, D0)], "match_id long, team_id long, kickoff_ts timestamp_ntz")
    ft = spark.createDataFrame([(9, "f", 1.0, D0, 1), (9, "f", 2.0, D0 - timedelta(days=40), 2), (9, "g", 5.0, D0, 3)], "team_id long, feature_name string, feature_value double, feature_ts timestamp_ntz, source_id long")
    for unit in ("hour", "day", "year"):
        got = {(r.match_id, r.feature_name): r.feature_value for r in J.asof_join(ev, ft, ["f", "g"], unit=unit).collect()}
        assert got == {(1, "f"): 2.0, (1, "g"): None, (2, "f"): 1.0, (2, "g"): 5.0, (3, "f"): None, (3, "g"): None}
    loose = {r.match_id: r.feature_value for r in J.asof_join(ev, ft, ["f"], strict=False).collect()}
    assert loose[1] == 1.0


def test_form_before_date_ignores_same_day(spark):
    m = spark.createDataFrame(
        [(1, D0, "p", 1, 2, 3, 0, False), (2, D0 + timedelta(hours=3), "p", 1, 3, 0, 2, False), (3, D0 + timedelta(days=2), "p", 1, 2, 1, 1, False)],
        "match_id long, kickoff_ts timestamp_ntz, pool string, home int, away int, home_score int, away_score int, neutral boolean")
    got = {(r.match_id, r.team): (r.form, r.gd_avg) for r in W.form_before_date(m).collect()}
    assert got[2, 1] == (0.5, 0.0) and got[3, 1] == (0.5, 0.5) and got[3, 2] == (0.0, -3.0)
    assert {(r.match_id, r.team): r.rest_days for r in W.rest_days(m).collect()}[3, 1] == 2


def test_acf_of_a_constant_series_is_zero(spark):
    df = spark.range(30).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"), F.col("id"), F.lit(2.0).alias("x"))
    assert {r.acf for r in W.autocorrelation(df, "k", "x", ["ts", "id"], 3).collect()} == {0.0}


def test_alternating_series_has_negative_first_lag(spark):
    df = spark.range(100).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"), F.col("id"), (F.col("id") % 2).cast("double").alias("x"))
    acf = {r.lag: r.acf for r in W.autocorrelation(df, "k", "x", ["ts", "id"], 2).collect()}
    assert acf[1] == pytest.approx(-1.0) and acf[2] == pytest.approx(1.0)


def test_chi_square_tail_for_even_and_odd_degrees(spark):
    import math

    from pyspark.sql import functions as F

    from rondo.operators.windows import chi2_sf

    def tail(q, k):  # numerical integral of the density
        n, top = 200_000, q + 200
        h = (top - q) / n
        f = lambda x: x ** (k / 2 - 1) * math.exp(-x / 2) / (2 ** (k / 2) * math.gamma(k / 2))
        return h * (f(q) / 2 + f(top) / 2 + sum(f(q + i * h) for i in range(1, n)))

    row = spark.createDataFrame([(4.2, 30.0)], "a double, b double").select(*[chi2_sf(F.col(c), k).alias(f"{c}{k}") for c in "ab" for k in (2, 3, 7, 10)]).first()
    for c, q in (("a", 4.2), ("b", 30.0)):
        for k in (2, 3, 7, 10):
            assert abs(row[f"{c}{k}"] - tail(q, k)) < 1e-6


def by_least_squares(x, lag, most):
    """Statistic and criterion of one unit-root regression on the rows that have ``most`` lagged changes."""
    d = np.diff(x)
    at = range(most, len(d))
    design = np.array([[1.0, x[t], *[d[t - k] for k in range(1, lag + 1)]] for t in at])
    y = np.array([d[t] for t in at])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    rss = ((y - design @ beta) ** 2).sum()
    se = np.sqrt(rss / (len(y) - lag - 2) * np.linalg.inv(design.T @ design)[1, 1])
    return beta[1] / se, len(y) * np.log(rss / len(y)) + 2 * (lag + 2)


@pytest.mark.parametrize("most_rows", [1_000_000, 40])
def test_unit_root_lags_match_least_squares(spark, most_rows):
    rng = np.random.default_rng(4)
    walk = rng.normal(size=300).cumsum()
    cyclic = np.zeros(300)
    for t in range(3, 300):  # its changes depend on three earlier ones
        cyclic[t] = 0.5 * cyclic[t - 1] - 0.3 * cyclic[t - 2] + 0.4 * cyclic[t - 3] + rng.normal()
    series = {"walk": walk, "cyclic": cyclic, "noise": rng.normal(size=120), "flat": np.ones(80), "short": rng.normal(size=7), "tiny": np.zeros(1)}
    rows = [(k, D0 + timedelta(hours=i), i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, kickoff_ts timestamp, match_id long, x double").repartition(7)
    got = {(r.k, r.lag): r for r in W.adf_lags(df, "k", "x", W.ORDER, 4, most_rows).collect()}
    for k in ("walk", "cyclic", "noise"):
        for lag in range(5):
            stat, aic = by_least_squares(series[k], lag, 4)
            assert got[k, lag].adf_stat == pytest.approx(stat, rel=1e-6) and got[k, lag].aic == pytest.approx(aic, rel=1e-6)
    assert not any(k in ("flat", "tiny") for k, _ in got)
    best = {r.k: r for r in W.adf_best_lag(df, "k", "x", W.ORDER, 4, unit=most_rows).collect()}
    for k in ("walk", "cyclic", "noise"):
        assert best[k].lag == min(range(5), key=lambda p: (by_least_squares(series[k], p, 4)[1], p))
    assert best["cyclic"].lag >= 2 and best["cyclic"].is_stationary and best["noise"].is_stationary and not best["walk"].is_stationary
    assert W.adf_best_lag(df.limit(0), "k", "x", W.ORDER).count() == 0


def test_unit_root_p_value_at_the_critical_values(spark):
    rows = spark.createDataFrame([(float(t),) for t in (-3.43, -2.86, -2.57, -20.0, 3.0)], "t double")
    got = [r.p for r in rows.select(W.adf_p_value(F.col("t")).alias("p")).collect()]
    assert got == pytest.approx([0.01, 0.05, 0.10, 0.0, 1.0], abs=0.002)
