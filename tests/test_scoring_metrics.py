import math

import pytest
from pyspark.sql import functions as F

from rondo.operators import clean as C
from rondo.operators import drift as D
from rondo.operators import isotonic as ISO
from rondo.operators import metrics as M
from rondo.operators import models as MD
from rondo.operators import regression as RG
from rondo.operators import resample as B
from rondo.operators import scoring as S

PROBS = "p_home double, p_draw double, p_away double, actual int"


def frame(spark, rows):
    return spark.createDataFrame(rows, PROBS)


def test_probabilities_sum_to_one(tables):
    for df in (tables.predictions, S.temper(tables.predictions, 1.7), S.draw_factor(tables.predictions, 1.3), S.smooth_motivation(tables.predictions)):
        assert M.prob_integrity(df).first().bad_sum == 0


def test_poisson_grid_matches_direct_sum(spark):
    df = spark.createDataFrame([(1.7, 0.9)], "lambda_home double, lambda_away double")
    r = S.poisson_probs(df).first()
    pm = lambda k, lam: math.exp(-lam) * lam**k / math.factorial(k)
    cells = {(i, j): pm(i, 1.7) * pm(j, 0.9) for i in range(12) for j in range(12)}
    total = sum(cells.values())
    assert r.p_home == pytest.approx(sum(v for (i, j), v in cells.items() if i > j) / total)
    assert r.p_draw == pytest.approx(sum(v for (i, j), v in cells.items() if i == j) / total)


def test_perfect_and_flat_predictions(spark):
    perfect = frame(spark, [(1.0, 0.0, 0.0, 1), (0.0, 1.0, 0.0, 0), (0.0, 0.0, 1.0, -1)])
    row = M.metric_set(perfect, min_bin=1).first()
    assert (row.brier, row.accuracy, row.log_loss, row.ece) == (0.0, 100.0, 0.0, 0.0)
    flat = frame(spark, [(1 / 3, 1 / 3, 1 / 3, a) for a in (1, 0, -1)])
    assert M.metric_set(flat).first().brier == pytest.approx(0.6667)


def test_upsets_and_buckets(spark):
    df = frame(spark, [(0.8, 0.12, 0.08, 1), (0.75, 0.15, 0.10, -1), (0.2, 0.1, 0.7, 1), (0.5, 0.3, 0.2, 0)])
    u = M.upset_rates(df).first()
    assert (u.n_clear, u.n_upset) == (4, 2)
    b = {r.bucket: r.n for r in M.confidence_buckets(S.temper(df, 1.0, out="cal_")).collect()}
    assert b == {"fav_70": 2, "under_25": 4}


def test_uplift_gates(spark):
    rows = [("a", "2026-01-02", "2026-01-01", "0.9", "0.5", "1.4"), ("b", "2026-01-02", "2026-01-02", "0.9", "0.5", "1.4"),
            ("c", "2026-01-02", "2026-01-01", None, "0.5", "1.4"), ("d", "2026-01-02", "2026-01-01", "x", "0.5", "1.4"), ("e", "2026-01-02", "2026-01-01", "0.9", "0.5", "?")]
    df = spark.createDataFrame(rows, "id string, kickoff_ts string, feature_ts string, continuity_index string, defenders_continuity string, lambda_base string")
    betas = {"continuity_index": 0.1, "defenders_continuity": 0.2}
    got = {r.id: r for r in S.uplift_status(df, betas).collect()}
    assert [got[k].status for k in "abcde"] == ["SHADOW", "FAILSAFE_LEAKAGE", "FAILSAFE_MISSING_DATA", "FAILSAFE_MISSING_DATA", "FAILSAFE_ERROR"]
    assert got["a"].uplifted == got["a"].baseline == 1.4 and got["a"].shadow_uplifted == pytest.approx(1.4 * math.exp(0.19))
    live = {r.id: r for r in S.uplift_status(df, betas, shadow=False).collect()}
    assert live["a"].status == "PRODUCTION" and live["a"].uplifted == pytest.approx(1.4 * math.exp(0.19))
    assert {r.status for r in S.uplift_status(df, betas, enabled=False).collect()} == {"BASELINE_ONLY", "FAILSAFE_LEAKAGE"}


def test_temperature_recovers_sharpened_probabilities(tables):
    sharp = S.temper(tables.predictions, 0.5)
    grid = [0.5, 1.0, 1.5, 2.0, 3.0]
    flat, sharpened = (MD.temperature_nll(d, grid).collect() for d in (tables.predictions, sharp))
    # tempering p^2 by T equals tempering p by T/2
    assert dict(map(tuple, sharpened))[2.0] == pytest.approx(dict(map(tuple, flat))[1.0], abs=1e-9)
    t, loss = MD.refine_temperature(tables.predictions)
    assert loss <= min(r.nll for r in flat) + 1e-6 and 0.05 <= t <= 10


def test_psi_of_equal_samples_is_zero(spark):
    one = spark.range(500).select(F.lit("f").alias("feature"), (F.col("id") % 50 / 50.0).alias("value"))
    both = one.withColumn("side", F.lit("ref")).unionByName(one.withColumn("side", F.lit("cur")))
    for mode in ("shared", "reference", "independent"):
        assert D.psi(both, 10, mode).first().psi == pytest.approx(0.0, abs=1e-12)
    k = D.skew(both).first()
    assert k.ks == 0.0 and k.js == pytest.approx(0.0, abs=1e-12) and not k.is_significant


def test_constant_feature_psi_is_zero(spark):
    df = spark.createDataFrame([("f", s, 1.0) for s in ("ref", "ref", "cur")], "feature string, side string, value double")
    assert D.psi(df).first().psi == 0.0


def test_ks_of_disjoint_samples_is_one_whatever_the_shards(spark):
    df = spark.range(200).select(F.lit("f").alias("feature"), F.when(F.col("id") < 100, "ref").otherwise("cur").alias("side"), F.col("id").cast("double").alias("value"))
    for shards in (1, 7, 1000):
        r = D.ks_two_sample(df, shards).first()
        assert r.ks == 1.0 and r.p_value < 1e-6


def test_isotonic_is_no_worse_on_its_own_sample(tables):
    p = tables.predictions
    iso = ISO.apply_isotonic(ISO.fit_isotonic(p), p)
    assert iso.columns == p.columns and iso.count() == p.count()
    assert M.brier(iso).first().brier <= M.brier(p).first().brier + 1e-9


@pytest.mark.parametrize("most", [25, 1_000_000])
def test_isotonic_in_slices_is_the_plain_fit(spark, most):
    """Pooling slice by slice gives the blocks of the plain algorithm, also where one block spans many slices, and maps points alike."""
    import random

    rng = random.Random(2)
    rows = [(k, round(rng.random(), 3)) for k in range(90)]
    shapes = [lambda x: x, lambda x: 1 - x]
    data = [(i, k, x, 1 - x, x, 1 if rng.random() < shape(x) else 0 if rng.random() < 0.5 else -1) for i, shape in enumerate(shapes) for k, x in rows]
    df = spark.createDataFrame([(i, k, p, q, h, y) for i, k, p, q, h, y in data], "g int, id int, p_home double, p_draw double, p_away double, actual int")
    maps = ISO.fit_isotonic(df, ["g"], most)
    got = {}
    for r in maps.collect():
        got.setdefault((r.g, r.outcome), []).append((r.lo, r.hi, r.weight, r.value))
    for (g, v), blocks in got.items():
        at = {1: 2, 0: 3, -1: 4}[v]
        points = {}
        for r in data:
            if r[0] == g:
                w, t = points.get(r[at], (0, 0))
                points[r[at]] = (w + 1, t + (r[5] == v))
        xs = sorted(points)
        want = [(lo, hi, w, t / w) for lo, hi, w, t in ISO.pool(xs, xs, *zip(*[points[x] for x in xs]))]
        assert [tuple(map(pytest.approx, b)) for b in want] == sorted(blocks)
        values = [b[3] for b in sorted(blocks)]
        assert values == sorted(values) and sum(b[2] * b[3] for b in blocks) == pytest.approx(sum(t for _, t in points.values()))
    if most > 1000:
        return
    few, many = (sorted(map(tuple, ISO.apply_isotonic(maps, df, ["g"], m).collect())) for m in (150, 1_000_000))
    assert all(a == pytest.approx(b) for a, b in zip(few, many)) and len(few) == len(data)


def test_cross_fitted_maps_leave_their_rows_out(tables):
    p = tables.predictions
    whole = ISO.cross_fitted(p, F.col("match_id") % 3, 3)
    apart = None
    for k in range(3):
        one = ISO.apply_isotonic(ISO.fit_isotonic(p.filter(F.col("match_id") % 3 != k)), p.filter(F.col("match_id") % 3 == k))
        apart = one if apart is None else apart.unionByName(one)
    both = whole.join(apart.select("match_id", F.col("p_home").alias("x")), "match_id")
    assert both.count() == p.count() and both.filter("abs(p_home - x) > 1e-9").count() == 0


def test_many_teams_are_fitted(spark):
    """50,000 teams: strengths of a team solve its own equations, and each team has finite ones."""
    n = 50_000
    m = spark.range(150_000).select(
        (F.xxhash64("id") % n + n).cast("int").alias("home"), (F.xxhash64("id", F.lit(1)) % n + 3 * n).cast("int").alias("away"), (F.col("id") % 4).cast("int").alias("home_score"), (F.col("id") % 3).cast("int").alias("away_score"), (F.col("id") % 5 == 0).alias("neutral"))
    model = MD.fit_attack_defence(m, sweeps=6)
    assert model.strengths.count() > 90_000 and model.strengths.filter("attack <= 0 or leak <= 0 or isnan(attack)").count() == 0 and 1.0 < model.home < 2.0


def test_strengths_are_stationary(tables):
    m = tables.matches
    model = MD.fit_attack_defence(m, tolerance=1e-10)
    s = {int(r.team): (r.attack, r.leak) for r in model.strengths.collect()}
    scored, faced = dict.fromkeys(s, 0.0), dict.fromkeys(s, 0.0)
    home, expected = 0.0, 0.0
    for r in m.collect():
        ground = 1.0 if r.neutral else model.home
        for a, b, g, f in ((r.home, r.away, r.home_score, ground), (r.away, r.home, r.away_score, 1.0)):
            scored[a] += g
            faced[a] += s[b][1] * f
        if not r.neutral:
            home += r.home_score
            expected += s[r.home][0] * s[r.away][1]
    assert model.home == pytest.approx(home / expected, rel=1e-6)
    assert sum(v[1] for v in s.values()) / len(s) == pytest.approx(1.0)
    shares = [s[t][0] * (faced[t] + 1) / (scored[t] + model.mean) for t in s]  # alike for all teams: the level of leaks is set to 1
    assert max(shares) == pytest.approx(min(shares), rel=1e-8)


def test_many_fits_at_once_are_the_single_ones(spark):
    import random

    rng = random.Random(7)
    rows = [(k % 3, rng.gauss(0, 1), rng.gauss(0, 1), rng.choice([0, 0, 1, 2, 3]), None if k % 50 == 7 else 0.5) for k in range(900)]
    df = spark.createDataFrame(rows, "fold int, u double, v double, y int, o double")
    both = {(r.fold, r.feature_group): r for r in RG.fit_many(df, ["u", "v"], "y", "poisson", ["fold"], F.col("o"), {"u": ["u"], "all": ["u", "v"]}).collect()}
    assert len(both) == 6
    for fold in range(3):
        part = df.filter(F.col("fold") == fold)
        one, two = RG.fit_many(part, ["u"], "y", "poisson", offset=F.col("o")).first(), RG.fit_many(part, ["u", "v"], "y", "poisson", offset=F.col("o")).first()
        assert both[fold, "u"].coefficients == pytest.approx([*one.coefficients, 0.0]) and both[fold, "all"].coefficients == pytest.approx(two.coefficients)
        assert both[fold, "all"].n == 294 and two.loss <= one.loss
        b = two.coefficients
        res = [(y - math.exp(o + b[0] + b[1] * u + b[2] * v), u, v) for f, u, v, y, o in rows if f == fold and o is not None]
        assert all(abs(sum(r[0] * x for r, x in zip(res, xs))) < 1e-6 for xs in ([1] * len(res), [r[1] for r in res], [r[2] for r in res]))


def test_bootstrap_repeats_and_covers_the_mean(spark):
    df = spark.range(600).select((F.col("id") % 20).alias("b"), (F.col("id") % 7).cast("double").alias("x"), F.col("id"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.lit("k").alias("k"))
    a, b = (B.block_bootstrap(df, "b", F.col("x"), iterations=200, seed=1).first() for _ in range(2))
    assert a == b and a.ci_lower <= 3.0 <= a.ci_upper
    m = B.moving_block_bootstrap(df, ["k"], ["ts", "id"], "x", 14, 50, unit="day").first()
    assert m.mean == pytest.approx(m.original, abs=0.1)


def test_permutation_keeps_rows_and_values(tables):
    df = tables.predictions.select("match_id", "p_home", "p_draw")
    out = MD.permuted(df, "p_home", "match_id")
    assert out.count() == df.count()
    assert out.select("p_home").exceptAll(df.select("p_home")).count() == 0
    assert out.join(df.withColumnRenamed("p_home", "old"), "match_id").filter("p_home != old").count() > 100


def test_importance_and_maps_of_many_rows_without_keys(spark):
    """More rows than a slice holds, and no keys: the same as in one slice."""
    df = spark.range(800).select(F.col("id").alias("match_id"), (F.col("id") % 3 - 1).cast("int").alias("actual"), ((F.col("id") * 37) % 211 / 300.0 + 0.1).alias("p_home")).withColumns({"p_draw": F.lit(0.2), "u": F.col("p_home") * F.col("actual")})
    df = df.withColumn("p_away", 1 - F.col("p_home") - F.col("p_draw")).cache()
    weights = {"p_home": {"u": 1.0}, "p_draw": {"intercept": 0.1}, "p_away": {"u": -1.0, "p_home": 0.5}}
    few, one = (sorted(map(tuple, MD.permutation_importance(weights, df.select("match_id", "actual", "u", "p_home"), ["u", "p_home"], scorer=MD.linear_scorer, most=m).collect())) for m in (70, 10_000))
    assert [r[0] for r in few] == ["p_home", "u"] and all(a[1:] == pytest.approx(b[1:]) for a, b in zip(few, one)) and few[1][3] > 0.01
    few, one = (sorted(map(tuple, ISO.apply_isotonic(ISO.fit_isotonic(df, most=m), df, most=m).collect())) for m in (70, 10_000))
    assert len(few) == 800 and all(a == pytest.approx(b) for a, b in zip(few, one))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_shuffled_numbers_are_a_bijection(spark, n):
    got = [r[0] for r in spark.range(n).select(MD.shuffled_number(F.col("id"), F.lit(n), 3)).collect()]
    assert sorted(got) == list(range(n)) and (n < 1000 or sum(a == b for a, b in enumerate(got)) < 20)


def test_verdict(spark):
    df = frame(spark, [(0.36, 0.33, 0.31, 1), (0.60, 0.25, 0.15, 1)])
    a, b = C.verdict(df).collect()
    assert (a.verdict, a.advantage) == ("balanced", False) and (b.verdict, b.advantage, b.second) == ("home", True, "draw")


def test_competition_rules(spark):
    names = ["FIFA World Cup", "FIFA World Cup qualification", "Copa America", "UEFA Euro qualification", "Olympic Games", "Friendly", None]
    got = C.classify_competition(spark.createDataFrame([(n,) for n in names], "tournament string")).collect()
    assert [r.match_class for r in got] == ["Mundial", "Eliminatoria", "CopaContinental", "Eliminatoria", "Eliminatoria", "Amistoso", "Amistoso"]


def test_draws_are_dealt_out_however_few_bytes_their_rows_have(spark):
    out = B._chunked(spark.range(3).withColumnRenamed("id", "iteration"), F.lit(10), "j", chunk=4, tasks=5)
    assert out.rdd.getNumPartitions() == 5 and sorted(map(tuple, out.collect())) == [(i, j) for i in range(3) for j in range(10)]


def test_boosting_on_cells_is_boosting_on_rows(spark):
    """Weighted cells are far fewer than rows, hold every whole row, and give the trees of the rows themselves."""
    from pyspark.ml.classification import GBTClassifier

    df = spark.range(6000).select(F.col("id").alias("match_id"), (F.pmod(F.xxhash64("id"), F.lit(1009)) / 1009).alias("u"), (F.col("id") % 2).cast("double").alias("v"), F.when(F.col("id") % 100 != 7, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3))).otherwise(0).cast("double").alias("n"))
    df = df.withColumn("label", F.when(F.col("u") + 0.1 * F.col("v") > 0.7, 0.0).otherwise(F.col("n"))).withColumn("v", F.when(F.col("match_id") % 50 != 3, F.col("v"))).cache()
    bins = MD._bins(df, ["u", "v"])
    cells = MD._cells(df, bins, "label")
    assert cells.count() <= 32 * 2 * 3 and cells.agg(F.sum("weight")).first()[0] == 5880
    model = MD.fit_gbm(df, ["u", "v"], trees=4)
    plain = GBTClassifier(maxIter=4, maxDepth=3, labelCol="_y").fit(bins.transform(df).withColumn("_y", (F.col("label") == 1).cast("double"))).setProbabilityCol("_p")
    got = {r.match_id: r.scores[1] for r in model.transform(df).select("match_id", "scores").collect()}
    want = {r.match_id: r["_p"][1] for r in plain.transform(bins.transform(df)).select("match_id", "_p").collect()}
    assert len(got) == 5880 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
