"""Window and analytic operators over team histories, snapshots and metric series.

Row order is (timestamp, id); ties on the timestamp are broken by id. Team keys are (pool, team) because
pools are independent sets of teams.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import add, normal_cdf, seconds_between
from .slices import MOST, SLICE, Unit, add_slice, carried_rows, drop_halo, halo_window, running, with_halo

TEAM = ["pool", "team"]
ORDER = ["kickoff_ts", "match_id"]


def team_long(matches: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Two rows per match, one per side; a single pass over the matches."""
    gd = F.col("home_score") - F.col("away_score")
    pts = F.when(gd > 0, 1.0).when(gd == 0, 0.5).otherwise(0.0)

    def side(team, opp, gf, ga, is_home, points):
        return F.struct(F.col(team).alias("team"), F.col(opp).alias("opp"), F.col(gf).alias("gf"), F.col(ga).alias("ga"),
                        F.lit(is_home).alias("is_home"), points.alias("pts"))

    sides = F.array(side("home", "away", "home_score", "away_score", True, pts),
                    side("away", "home", "away_score", "home_score", False, 1.0 - pts))
    keep = ["match_id", "kickoff_ts", "pool", *(extra or [])]
    return matches.select(*keep, F.explode(sides).alias("s")).select(*keep, "s.*")


def _lag_mean(value: str, n: int, window, weights: list[float] | None = None) -> Column:
    """(Weighted) mean of the n preceding values as lag columns: one window, stays in generated code."""
    w = weights or [1.0] * n
    lags = [F.lag(value, i + 1).over(window) for i in range(n)]
    num = add([F.coalesce(x * F.lit(wi), F.lit(0.0)) for x, wi in zip(lags, w)])
    den = add([F.when(x.isNotNull(), F.lit(wi)).otherwise(F.lit(0.0)) for x, wi in zip(lags, w)])
    return F.try_divide(num, den)


def form_last_n(matches: DataFrame, n: int = 5, default: float = 0.5, unit: Unit = MOST) -> DataFrame:
    """Mean points of the team's n previous matches."""
    rows = team_long(matches).select(*TEAM, *ORDER, "is_home", "pts")
    haloed = with_halo(rows, TEAM, ORDER, n, unit)
    mean = F.avg("pts").over(halo_window(TEAM, ORDER).rowsBetween(-n, -1))
    return drop_halo(haloed.withColumn("form", F.coalesce(mean, F.lit(default)))).select("match_id", "team", "is_home", "form")


def form_decayed(matches: DataFrame, n: int = 10, rate: float = 0.1, default: float = 0.5, unit: Unit = MOST) -> DataFrame:
    """Mean of the last n points with weight exp(-rate * age); age 0 is the latest match."""
    rows = team_long(matches).select(*TEAM, *ORDER, "is_home", "pts")
    haloed = with_halo(rows, TEAM, ORDER, n, unit)
    mean = _lag_mean("pts", n, halo_window(TEAM, ORDER), [math.exp(-rate * i) for i in range(n)])
    return drop_halo(haloed.withColumn("form", F.coalesce(mean, F.lit(default)))).select("match_id", "team", "is_home", "form")


def form_before_date(matches: DataFrame, n: int = 5) -> DataFrame:
    """Mean points and goal difference of the last n matches played on strictly earlier dates."""
    rows = team_long(matches).select(*TEAM, *ORDER, "is_home", "pts", (F.col("gf") - F.col("ga")).alias("gd"))
    dated = add_slice(rows, TEAM, "kickoff_ts", "day")
    carried = carried_rows(dated, ORDER, n)

    def mean(field: str) -> Column:
        values = F.col("_prev")[field]
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)

    carried = carried.select(*TEAM, SLICE, mean("pts").alias("form"), mean("gd").alias("gd_avg"))
    return dated.rows.join(carried, [*TEAM, SLICE], "left").select(
        "match_id", "team", "is_home", F.coalesce("form", F.lit(0.5)).alias("form"), F.coalesce("gd_avg", F.lit(0.0)).alias("gd_avg"))


def _pairs(matches: DataFrame) -> DataFrame:
    gd = F.col("home_score") - F.col("away_score")
    winner = F.when(gd > 0, F.col("home")).when(gd < 0, F.col("away"))
    return matches.select(*ORDER, "pool", "home", F.least("home", "away").alias("lo"), F.greatest("home", "away").alias("hi"), winner.alias("winner"))


PAIR = ["pool", "lo", "hi"]


def h2h_expanding(matches: DataFrame, default: float = 0.5, unit: Unit = MOST) -> DataFrame:
    """Home side's share of wins in all earlier meetings of the two teams, either orientation."""
    sums = {"n": F.lit(1).cast("bigint"),
            "lo_wins": F.when(F.col("winner") == F.col("lo"), 1).otherwise(0),
            "hi_wins": F.when(F.col("winner") == F.col("hi"), 1).otherwise(0)}
    out = running(_pairs(matches), PAIR, ORDER, sums, unit)
    wins = F.when(F.col("home") == F.col("lo"), F.col("lo_wins")).otherwise(F.col("hi_wins"))
    return out.select("match_id", F.when(F.col("n") > 0, wins / F.col("n")).otherwise(default).alias("h2h"), F.col("n").alias("meetings"))


def h2h_last_n(matches: DataFrame, n: int = 5, default: float = 0.5, unit: Unit = MOST) -> DataFrame:
    """Home side's share of wins in the last n meetings in true time order."""
    rows = _pairs(matches).withColumn("w", F.coalesce("winner", F.lit(-1)))
    haloed = with_halo(rows, PAIR, ORDER, n, unit)
    w = halo_window(PAIR, ORDER)
    lags = [F.lag("w", i + 1).over(w) for i in range(n)]
    wins = add([F.when(x == F.col("home"), 1.0).otherwise(0.0) for x in lags])
    seen = add([F.when(x.isNotNull(), 1.0).otherwise(0.0) for x in lags])
    return drop_halo(haloed.withColumn("h2h", F.coalesce(F.try_divide(wins, seen), F.lit(default)))).select("match_id", "h2h")


def rest_days(matches: DataFrame, default: int = 14) -> DataFrame:
    """Days since the team's previous match on an earlier date."""
    rows = team_long(matches).select(*TEAM, "match_id", "is_home", F.to_date("kickoff_ts").alias("d"))
    days = rows.groupBy(*TEAM, "d").agg(F.lit(1).alias("_one"))
    prev = F.lag("d").over(Window.partitionBy(*TEAM).orderBy("d"))  # one row per team and date
    gaps = days.select(*TEAM, "d", F.datediff("d", prev).alias("gap"))
    return rows.join(gaps, [*TEAM, "d"]).select("match_id", "team", "is_home", F.coalesce("gap", F.lit(default)).alias("rest_days"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key, as an aggregate (combined before the shuffle, no sort)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


# ---- squads --------------------------------------------------------------------------------------


def _jaccard(cur: Column, prev: Column) -> Column:
    union = F.size(F.array_union(cur, prev))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(cur, prev)) / union)


POSITIONS = {"defenders_continuity": "Defender", "midfielders_continuity": "Midfielder", "forwards_continuity": "Attacker"}


def squad_continuity(snaps: DataFrame, key: str = "team_id", ts: str = "announced_ts") -> DataFrame:
    """Overlap of each squad with the previous one, overall and by position.

    The first squad is compared with the empty set; two empty sets overlap fully. A key has one row per
    announcement, so its partition is bounded by the calendar.
    """
    names = F.array_distinct(F.transform("players", lambda p: F.struct(p["position"].alias("position"), p["name"].alias("name"))))
    s = snaps.select(key, ts, names.alias("cur"))
    w = Window.partitionBy(key).orderBy(ts)
    s = s.withColumn("_lag", F.lag("cur").over(w)).withColumn("snapshot_no", F.row_number().over(w) - 1)
    prev = F.coalesce("_lag", F.filter("cur", lambda p: F.lit(False)))
    s = s.withColumn("prev", prev)

    def at(c: str, pos: str) -> Column:
        return F.filter(c, lambda p: p["position"] == pos)

    delta = F.when(F.col("_lag").isNull(), 0).otherwise(F.size("cur") - F.size("prev"))
    return s.select(key, ts, "snapshot_no", _jaccard(F.col("cur"), F.col("prev")).alias("continuity_index"),
                    *[_jaccard(at("cur", p), at("prev", p)).alias(n) for n, p in POSITIONS.items()],
                    F.size("cur").alias("squad_size"), delta.alias("squad_size_delta"))


FEATURE_NAMES = ["continuity_index", *POSITIONS, "squad_size", "squad_size_delta"]


def feature_timeline(snaps: DataFrame, version: str = "1.0.0") -> DataFrame:
    """Squad features as long records with version and source."""
    wide = squad_continuity(snaps)
    pairs = F.array(*[F.struct(F.lit(n).alias("feature_name"), F.col(n).cast("double").alias("feature_value")) for n in FEATURE_NAMES])
    return wide.select("team_id", F.explode(pairs).alias("f"), F.col("announced_ts").alias("feature_ts"),
                       F.col("snapshot_no").alias("source_id"), F.lit(version).alias("feature_version")).select(
        "team_id", "f.*", "feature_ts", "source_id", "feature_version")


def lead_hours(df: DataFrame, announced: str = "announced_ts", kickoff: str = "kickoff_ts") -> DataFrame:
    """Hours between announcement and kickoff; a negative lead is a leakage violation."""
    return df.withColumn("lead_hours", seconds_between(announced, kickoff) / 3600.0).withColumn("lead_violation", F.col("lead_hours") < 0)


# ---- metric series -------------------------------------------------------------------------------


def rolling_uplift(df: DataFrame, w: int, key: str = "pool", order: list[str] | None = None, unit: Unit = MOST) -> DataFrame:
    """Mean of ``baseline - model`` over the last w rows, only where w rows exist. Needs columns baseline, model."""
    order = order or ORDER
    rows = df.select(key, *order, (F.col("baseline") - F.col("model")).alias("uplift"))
    haloed = with_halo(rows, [key], order, w - 1, unit)
    frame = halo_window([key], order).rowsBetween(-(w - 1), 0)
    out = haloed.withColumn("_n", F.count("uplift").over(frame)).withColumn("rolling_uplift", F.avg("uplift").over(frame))
    return drop_halo(out.filter(F.col("_n") == w)).select(key, *order, "rolling_uplift")


def sequence_audit(df: DataFrame, key: str, ts: str, arrival: str, max_gap_days: int = 30, unit: Unit = MOST) -> DataFrame:
    """Duplicate timestamps, long gaps and out-of-order arrivals, counted per key."""
    rows = df.select(key, ts, arrival)
    stamps = rows.groupBy(key, ts).agg(F.count(F.lit(1)).alias("c"))
    dup = stamps.filter(F.col("c") > 1).groupBy(key).agg(F.count(F.lit(1)).alias("duplicates"))
    by_time = with_halo(stamps.select(key, ts), [key], [ts], 1, unit)
    gap = drop_halo(by_time.withColumn("_p", F.lag(ts).over(halo_window([key], [ts]))))
    gap = gap.filter(seconds_between("_p", ts) >= (max_gap_days + 1) * 86400).groupBy(key).agg(F.count(F.lit(1)).alias("gaps"))
    by_arrival = with_halo(rows.select(arrival, key, ts), [key], [arrival], 1, unit if isinstance(unit, int) else MOST)
    late = drop_halo(by_arrival.withColumn("_p", F.lag(ts).over(halo_window([key], [arrival]))))
    late = late.filter(F.col(ts) < F.col("_p")).groupBy(key).agg(F.count(F.lit(1)).alias("out_of_order"))
    base = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    out = base.join(dup, key, "left").join(gap, key, "left").join(late, key, "left")
    return out.fillna(0, ["duplicates", "gaps", "out_of_order"])


def newest(df: DataFrame, keys: list[str], order: list[str], n: int, rank: str = "rn", oldest: bool = False) -> DataFrame:
    """The n newest (or oldest) rows per key. The rank filter is applied before the shuffle too, so hot keys stay small."""
    o = [F.col(c) if oldest else F.col(c).desc() for c in order]
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*o))).filter(F.col(rank) <= n)


def segment_drift(df: DataFrame, seg: str, metric: str, order: list[str], k: int = 10, threshold: float = 0.15) -> DataFrame:
    """Mean of the last k values of a segment against the k before; needs 2k values."""
    top = newest(df.select(seg, metric, *order), [seg], order, 2 * k)
    out = top.groupBy(seg).agg(F.avg(F.when(F.col("rn") <= k, F.col(metric))).alias("recent"),
                               F.avg(F.when(F.col("rn") > k, F.col(metric))).alias("prior"), F.count(F.lit(1)).alias("n"))
    drift = F.abs(F.col("recent") - F.col("prior"))
    return out.filter(F.col("n") >= 2 * k).select(seg, "recent", "prior", drift.alias("drift"), (drift > threshold).alias("alert"))


def cohort_divergence(df: DataFrame, cohort: Column, metric: str, order: list[str], k: int = 10, threshold: float = 0.15) -> DataFrame:
    """Last-k mean of the tournament cohort (``cohort`` true) against the friendly cohort; one row."""
    top = newest(df.select(cohort.alias("c"), metric, *order), ["c"], order, k)
    agg = top.agg(F.avg(F.when(F.col("c"), F.col(metric))).alias("tournament_mean"), F.avg(F.when(~F.col("c"), F.col(metric))).alias("friendly_mean"),
                  F.count_if(F.col("c")).alias("n_t"), F.count_if(~F.col("c")).alias("n_f"))
    div = F.abs(F.col("tournament_mean") - F.col("friendly_mean"))
    return agg.filter((F.col("n_t") >= k) & (F.col("n_f") >= k)).select(
        "tournament_mean", "friendly_mean", div.alias("divergence"), (div > threshold).alias("alert"))


def brier_degradation(df: DataFrame, tag: str, value: str, order: list[str], k: int = 10, min_n: int = 50, threshold: float = 0.01) -> DataFrame:
    """Mean of the last k squared errors minus the mean of all earlier ones, per tag."""
    rows = df.select(tag, value, *order)
    total = rows.groupBy(tag).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    last = newest(rows, [tag], order, k).groupBy(tag).agg(F.sum(value).alias("s_last"), F.count(value).alias("n_last"))
    recent = F.col("s_last") / F.col("n_last")
    rest = F.try_divide(F.col("s") - F.col("s_last"), F.col("n") - F.col("n_last"))
    out = total.filter(F.col("n") >= min_n).join(last, tag)
    return out.select(tag, recent.alias("recent"), rest.alias("historical"), (recent - rest).alias("degradation"), (recent - rest > threshold).alias("alert"))


def uplift_persistence(df: DataFrame, tag: str, value: str, order: list[str], k: int = 10, threshold: float = 0.005) -> DataFrame:
    """Is the recent uplift above the threshold, and has it fallen below 90 % of the first k values?"""
    rows = df.select(tag, value, *order)
    n = rows.groupBy(tag).agg(F.count(F.lit(1)).alias("n"))
    last = newest(rows, [tag], order, k).groupBy(tag).agg(F.avg(value).alias("mean_uplift"), F.stddev_pop(value).alias("std_uplift"))
    first = newest(rows, [tag], order, k, oldest=True).groupBy(tag).agg(F.avg(value).alias("early"))
    persistent = F.col("mean_uplift") > threshold
    degraded = F.when(F.col("n") >= 2 * k, F.col("mean_uplift") < F.col("early") * 0.9).otherwise(False)
    return n.filter(F.col("n") >= 2).join(last, tag).join(first, tag).select(
        tag, F.when(persistent, "persistent").otherwise("degraded").alias("status"), "mean_uplift", "std_uplift", degraded.alias("is_degraded"))


PCTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_percentiles(df: DataFrame, value: str, order: list[str], keys: list[str] | None = None, w: int = 1000) -> DataFrame:
    """p50 / p95 / p99 of the last w requests, overall or per key."""
    if keys:
        last = newest(df.select(*keys, value, *order), keys, order, w).groupBy(*keys)
    else:
        last = df.select(value, *order).orderBy(*[F.col(c).desc() for c in order]).limit(w).groupBy()
    return last.agg(*[F.percentile(value, p).alias(n) for n, p in PCTS.items()], F.count(value).alias("n"))


def autocorrelation(df: DataFrame, key: str, value: str, order: list[str], lags: int = 10, unit: Unit = MOST) -> DataFrame:
    """Autocorrelation per key for lags 0..L around the key's mean; mean product over n-l rows; 0 when variance is 0."""
    stats = df.groupBy(key).agg(F.avg(value).alias("mu"), F.var_pop(value).alias("var"), F.count(value).alias("n"))
    rows = df.select(key, *order, F.col(value).alias("x"))
    haloed = with_halo(rows, [key], order, lags, unit)
    w = halo_window([key], order)
    for lag in range(1, lags + 1):
        haloed = haloed.withColumn(f"_l{lag}", F.lag("x", lag).over(w))
    centred = drop_halo(haloed).join(stats.select(key, "mu"), key)
    aggs = [F.avg((F.col("x") - F.col("mu")) * (F.col(f"_l{lag}") - F.col("mu"))).alias(f"c{lag}") for lag in range(1, lags + 1)]
    cov = centred.groupBy(key).agg(*aggs)
    entries = [F.struct(F.lit(0).alias("lag"), F.when(F.col("var") == 0, 0.0).otherwise(1.0).alias("acf"))] + [
        F.struct(F.lit(lag).alias("lag"), F.when(F.col("var") == 0, 0.0).otherwise(F.coalesce(F.col(f"c{lag}") / F.col("var"), F.lit(0.0))).alias("acf"))
        for lag in range(1, lags + 1)]
    return stats.join(cov, key).select(key, "n", F.explode(F.array(*entries)).alias("e")).select(key, "n", "e.*")


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0 by the series of erf, with 200 terms; beyond 6 it is 0 to double precision."""
    step = lambda acc, n: F.struct((acc["term"] * 2 * x * x / (2 * n + 1)).alias("term"), (acc["total"] + acc["term"] * 2 * x * x / (2 * n + 1)).alias("total"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(x.alias("term"), x.alias("total")), step, lambda acc: acc["total"])
    return F.when(x > 6, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series))


def chi2_sf(q: Column, dof: int) -> Column:
    """Upper tail of chi-square: the closed forms of even and of odd degrees of freedom."""
    half = q / 2.0
    if dof % 2 == 0:
        return F.exp(-half) * add([F.pow(half, F.lit(float(k))) / math.factorial(k) for k in range(dof // 2)])
    powers = [F.pow(half, F.lit(k - 0.5)) / math.gamma(k + 0.5) for k in range(1, (dof + 1) // 2)]
    return erfc(F.sqrt(half)) + (F.exp(-half) * add(powers) if powers else F.lit(0.0))


def ljung_box(df: DataFrame, key: str, value: str, order: list[str], lags: int = 10, unit: Unit = MOST) -> DataFrame:
    """Portmanteau statistic over the biased autocorrelations, with its p-value."""
    acf = autocorrelation(df, key, value, order, lags, unit).filter(F.col("lag") > 0)
    rho = F.col("acf") * (F.col("n") - F.col("lag")) / F.col("n")
    q = F.first("n") * (F.first("n") + 2) * F.sum(rho * rho / (F.col("n") - F.col("lag")))
    out = acf.groupBy(key).agg(q.alias("q"))
    return out.select(key, "q", chi2_sf(F.col("q"), lags).alias("p_value"))


# published asymptotic critical values of the unit-root t statistic with a constant (fixed values)
ADF_CRITICAL = {"1%": -3.43, "5%": -2.86, "10%": -2.57}


def adf_stationarity(df: DataFrame, key: str, value: str, order: list[str], unit: Unit = MOST) -> DataFrame:
    """t statistic of the unit-root regression with constant and one lagged difference, per key.

    dx_t = a + b x_{t-1} + c dx_{t-1}: the normal equations are sums over lag columns, solved in closed form.
    """
    haloed = with_halo(df.select(key, *order, F.col(value).alias("x")), [key], order, 2, unit)
    w = halo_window([key], order)
    lagged = drop_halo(haloed.withColumn("l1", F.lag("x", 1).over(w)).withColumn("l2", F.lag("x", 2).over(w))).filter(F.col("l2").isNotNull())
    rows = lagged.select(key, (F.col("x") - F.col("l1")).alias("y"), F.col("l1").alias("u"), (F.col("l1") - F.col("l2")).alias("v"))
    s = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.covar_pop(a, b).alias(f"s{a}{b}") for a, b in (("u", "u"), ("v", "v"), ("y", "y"), ("u", "v"), ("u", "y"), ("v", "y"))])
    det = F.col("suu") * F.col("svv") - F.col("suv") ** 2
    b = (F.col("suy") * F.col("svv") - F.col("svy") * F.col("suv")) / det
    c = (F.col("svy") * F.col("suu") - F.col("suy") * F.col("suv")) / det
    rss = F.col("n") * (F.col("syy") - b * F.col("suy") - c * F.col("svy"))
    se = F.sqrt(rss / (F.col("n") - 3) * F.col("svv") / det / F.col("n"))
    out = s.select(key, "n", (b / se).alias("adf_stat"))
    return out.withColumn("is_stationary", F.col("adf_stat") < ADF_CRITICAL["5%"])


# published response surface of the unit-root statistic's p-value with a constant: polynomials below and above a split point, within bounds (fixed values)
ADF_BOUNDS, ADF_SPLIT = (-18.83, 2.74), -1.61
ADF_LOW, ADF_HIGH = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p_value(t: Column) -> Column:
    """p-value of the unit-root statistic with a constant; NULL stays."""
    surface = lambda c: normal_cdf(add([t**k * v if k else F.lit(v) for k, v in enumerate(c)]))
    inside = F.when(t <= ADF_SPLIT, surface(ADF_LOW)).otherwise(surface(ADF_HIGH))
    return F.when(t < ADF_BOUNDS[0], 0.0).when(t > ADF_BOUNDS[1], 1.0).when(t.isNotNull(), inside)


def adf_lags(df: DataFrame, key: str, value: str, order: list[str], max_lag: int = 8, unit: Unit = MOST) -> DataFrame:
    """Unit-root regressions with a constant and 0 to ``max_lag`` lagged differences, a row per key and lag: n, adf_stat, aic, p_value.

    dx_t = a + b x_{t-1} + sum c_k dx_{t-k}, all lags on the same rows, those with every lag, so that the criterion compares like with like. One aggregate gives the
    matrix of products of all columns per key; sweeping the lagged differences out one by one leaves what the regression with that many needs, so every lag
    comes from one pass over the rows. A lag is left out where it is above 12 (n / 100)^(1/4) rounded up, where too few rows remain, or where its columns are linearly dependent.
    """
    haloed = with_halo(df.select(key, *order, F.col(value).alias("x")), [key], order, max_lag + 1, unit)
    w = halo_window([key], order)
    names = [f"_l{k}" for k in range(1, max_lag + 2)]
    lagged = haloed.select("*", *[F.lag("x", k + 1).over(w).alias(c) for k, c in enumerate(names)])
    kept = drop_halo(lagged).filter(F.col(names[-1]).isNotNull())
    levels = [F.col("x"), *map(F.col, names)]
    columns = [levels[0] - levels[1], levels[1], *[a - b for a, b in zip(levels[1:], levels[2:], strict=False)]]  # the change, the level before, lagged changes
    rows = kept.select(key, *[c.alias(f"_c{i}") for i, c in enumerate(columns)])
    cell = lambda i, j: F.col(f"_s{min(i, j)}_{max(i, j)}")
    left = list(range(len(columns)))
    state = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(f"_c{i}", f"_c{j}").alias(f"_s{i}_{j}") for i in left for j in left if i <= j])
    first = [F.col(f"_s{i}_{i}").alias(f"_own{i}") for i in left]
    state = state.select("*", *first)
    fits = []
    for lag in range(max_lag + 1):
        b, rss = cell(0, 1) / cell(1, 1), cell(0, 0) - cell(0, 1) ** 2 / cell(1, 1)
        spare = F.col("n") - lag - 2
        free = (spare > 0) & (cell(1, 1) > 1e-10 * F.col("_own1")) & (rss > 1e-10 * F.col("_own0")) & (F.lit(lag) <= F.ceil(12 * F.pow(F.col("n") / 100, 0.25)))
        stat = F.when(free, b / F.sqrt(rss / spare / cell(1, 1)))
        aic = F.when(free, F.col("n") * F.ln(rss) + 2 * (lag + 2))
        fits.append(F.struct(F.lit(lag).alias("lag"), F.col(f"_t{lag}").alias("adf_stat"), F.col(f"_a{lag}").alias("aic")))
        state = state.select("*", stat.alias(f"_t{lag}"), aic.alias(f"_a{lag}"))
        if lag < max_lag:  # sweep the next lagged change out
            out = lag + 2
            left.remove(out)
            usable = cell(out, out) > 1e-10 * F.col(f"_own{out}")
            swept = [F.when(usable, cell(i, j) - cell(i, out) * cell(j, out) / cell(out, out)).alias(f"_s{i}_{j}") for i in left for j in left if i <= j]
            done = [c for c in state.columns if not c.startswith("_s")]
            state = state.select(*done, *swept)
    out = state.select(key, "n", F.explode(F.array(*fits)).alias("_f")).select(key, "n", "_f.*").filter(F.col("aic").isNotNull())
    return out.withColumn("p_value", adf_p_value(F.col("adf_stat")))


def adf_best_lag(df: DataFrame, key: str, value: str, order: list[str], max_lag: int = 8, level: float = 0.05, unit: Unit = MOST) -> DataFrame:
    """The regression of ``adf_lags`` with the smallest information criterion per key (ties: fewer lags), and whether its p-value is under ``level``.
    A key without any regression (too few rows, a constant series) has no row."""
    tried = adf_lags(df, key, value, order, max_lag, unit)
    best = tried.groupBy(key).agg(F.min(F.struct("aic", "lag", "n", "adf_stat", "p_value")).alias("_b")).select(key, "_b.*")
    return best.select(key, "n", "lag", "adf_stat", "aic", "p_value", (F.col("p_value") < level).alias("is_stationary"))
