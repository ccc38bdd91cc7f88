"""Temporal splits, backtests and leakage control.

Fold and window bounds are arithmetic on the first and last timestamp, so a fold table is a one-row aggregate
expanded to k rows; membership is computed per row from it and no loop of filters runs over the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import add, count_if, epoch_us, hit, brier_row, logloss_row, seconds_between, share, with_one_row
from ..session import persist_table
from . import metrics as M
from . import rating as R
from . import scoring as S
from .quantiles import exact_quantiles
from .regression import fit_many

DAY_US = 86_400_000_000


def temporal_split(df: DataFrame, ts: str, train_end: str, val_end: str) -> DataFrame:
    """Label every row train (< train_end), val (< val_end) or test: one pass, no copies."""
    kind = dict(df.dtypes)[ts]
    t1, t2 = F.lit(train_end).cast(kind), F.lit(val_end).cast(kind)
    return df.withColumn("split", F.when(F.col(ts) < t1, "train").when(F.col(ts) < t2, "val").otherwise("test"))


def _with_roles(df: DataFrame, ts: str, bounds: DataFrame, windows: Column, required: list[str]) -> DataFrame:
    """Attach (fold, role) to every row that falls in a window; folds lacking a required role are left out.

    ``bounds`` is one row; ``windows`` an array of struct(fold, role, start, end) in microseconds, computed from it.
    """
    t = epoch_us(ts)
    spec = bounds.select(windows.alias("_w"))  # one row
    rows = with_one_row(df.withColumn("_t", t), spec)
    mine = F.filter("_w", lambda w: (F.col("_t") >= w["start"]) & (F.col("_t") < w["end"]))
    out = rows.withColumn("_m", F.explode(mine)).select(*df.columns, F.col("_m.fold").alias("fold"), F.col("_m.role").alias("role"))
    full = out.filter(F.col("role").isin(required)).groupBy("fold").agg(F.count_distinct("role").alias("_r")).filter(F.col("_r") == len(required)).select("fold")
    return out.join(full, "fold", "left_semi")


_FOREVER = -(2**62)


def purged_expanding_cv(df: DataFrame, ts: str, k: int = 5, embargo_days: int = 15) -> DataFrame:
    """k folds: all rows before the fold's cut train; after an embargo the next equal stretch validates."""
    us = epoch_us(ts)
    bounds = df.agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    size = F.floor(F.floor((F.col("hi") - F.col("lo")) / DAY_US) / (k + 1)) * DAY_US

    def both(i: Column) -> Column:
        end = F.col("lo") + i * size
        start = end + embargo_days * DAY_US
        w = lambda role, a, b: F.struct(i.cast("int").alias("fold"), F.lit(role).alias("role"), a.cast("bigint").alias("start"), b.cast("bigint").alias("end"))
        return F.array(w("train", F.lit(_FOREVER), end), w("val", start, start + size))

    windows = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(k)), both))
    return _with_roles(df, ts, bounds, windows, ["val"])


def purged_rolling_windows(df: DataFrame, ts: str, n: int = 10, train_days: int = 720, val_days: int = 180, test_days: int = 180, gap_days: int = 7) -> DataFrame:
    """Disjoint train stretches, each followed by validation and test behind gaps; windows past the last row are dropped."""
    us = epoch_us(ts)
    bounds = df.agg(F.min(us).alias("lo"), F.max(us).alias("hi"))

    def three(i: Column) -> Column:
        t0 = F.col("lo") + (i - 1) * train_days * DAY_US
        t1 = t0 + train_days * DAY_US
        v0 = t1 + gap_days * DAY_US
        v1 = v0 + val_days * DAY_US
        s0 = v1 + gap_days * DAY_US
        s1 = s0 + test_days * DAY_US
        w = lambda role, a, b: F.struct(i.cast("int").alias("fold"), F.lit(role).alias("role"), a.cast("bigint").alias("start"), b.cast("bigint").alias("end"))
        return F.when(s1 <= F.col("hi"), F.array(w("train", t0, t1), w("val", v0, v1), w("test", s0, s1)))

    windows = F.flatten(F.filter(F.transform(F.sequence(F.lit(1), F.lit(n)), three), lambda a: a.isNotNull()))
    return _with_roles(df, ts, bounds, windows, ["train", "val", "test"])


def walk_forward_years(df: DataFrame, ts: str, years: list[int], min_rows: int = 50) -> DataFrame:
    """For each test year: all earlier rows train, the year tests (half-open years); years with too few rows are skipped."""
    per_year = df.groupBy(F.year(ts).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))  # one row per calendar year
    enough = per_year.filter(F.col("_y").isin(years) & (F.col("_n") >= min_rows)).agg(F.collect_set("_y").alias("_years"))
    rows = with_one_row(df.withColumn("_y", F.year(ts)), enough)
    folds = F.filter("_years", lambda v: v >= F.col("_y"))
    out = rows.withColumn("fold", F.explode(folds))
    return out.withColumn("role", F.when(F.col("fold") == F.col("_y"), "test").otherwise("train")).drop("_y", "_years")


def rolling_backtest(records: DataFrame, period: Column, min_n: int = 20) -> DataFrame:
    """Metrics per test period of prequential records, with the number of rows before it."""
    rec = records.withColumn("period", period)
    sets = M.metric_set(rec, ["period"])
    w = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)  # one row per period
    return sets.withColumn("n_train", F.coalesce(F.sum("n_matches").over(w), F.lit(0))).filter(F.col("n_matches") >= min_n)


def era_breakdown(records: DataFrame, eras: list[tuple[str, str, str]], ts: str = "kickoff_ts", min_n: int = 50) -> DataFrame:
    """Accuracy, log-loss and Brier per named era (closed date range), and each metric's spread over the eras."""
    d = F.to_date(ts)
    era = F.lit(None).cast("string")
    for name, lo, hi in reversed(eras):
        era = F.when(d.between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), name).otherwise(era)
    out = records.withColumn("era", era).filter(F.col("era").isNotNull()).groupBy("era").agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit()).alias("accuracy"), F.avg(logloss_row()).alias("log_loss"), F.avg(brier_row()).alias("brier"))
    w = Window.partitionBy()  # one row per era
    out = out.filter(F.col("n") >= min_n)
    return out.withColumns({f"{c}_drift": F.max(c).over(w) - F.min(c).over(w) for c in ("accuracy", "log_loss", "brier")})


def frozen_eval(matches: DataFrame, train_end: str, test_end: str, rules: R.Rules, rule: str = "linear", **fold) -> DataFrame:
    """Predictions of the test window from ratings frozen at the end of training."""
    kind = dict(matches.dtypes)["kickoff_ts"]
    t1, t2 = F.lit(train_end).cast(kind), F.lit(test_end).cast(kind)
    final = persist_table(R.final_ratings(R.elo_fold(matches.filter(F.col("kickoff_ts") < t1), rules, **fold)).select("pool", "team", "rating"))
    test = matches.filter((F.col("kickoff_ts") >= t1) & (F.col("kickoff_ts") < t2)).withColumn("actual", S.outcome())
    for side in ("home", "away"):
        test = test.join(final.select("pool", F.col("team").alias(side), F.col("rating").alias(f"rating_{side}")), ["pool", side], "left")
    test = test.fillna(rules.base, ["rating_home", "rating_away"])
    return S.elo_probs(test, rule, bonus=rules.home_bonus)


def elo_accuracy(matches: DataFrame, period: Column, rules: R.Rules, **fold) -> DataFrame:
    """Three-way calls from the expected score (>= .50 home, <= .35 away, else draw) and their accuracy per period."""
    folded = R.elo_fold(matches, rules, **fold).select("match_id", "pre_h", "pre_a")
    m = matches.select("match_id", "neutral", S.outcome().alias("actual"), period.alias("period")).join(folded, "match_id")
    e = R.elo_expected(F.col("pre_h") + F.when(F.col("neutral"), 0.0).otherwise(rules.home_bonus) - F.col("pre_a"))
    call = F.when(e >= 0.5, 1).when(e <= 0.35, -1).otherwise(0)
    return m.groupBy("period").agg(share(call == F.col("actual")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def calibrated_eval(records: DataFrame, train_end: str, cal_end: str, test_end: str, grid: list[float], ts: str = "kickoff_ts") -> DataFrame:
    """Fit the temperature on (train_end, cal_end], test on (cal_end, test_end]: raw and calibrated rows of metrics."""
    from .models import fit_temperature

    records = persist_table(records.select(ts, "actual", *S.P3))  # the fold behind it runs once
    kind = dict(records.dtypes)[ts]
    t1, t2, t3 = (F.lit(x).cast(kind) for x in (train_end, cal_end, test_end))
    cal = records.filter((F.col(ts) > t1) & (F.col(ts) <= t2))
    test = records.filter((F.col(ts) > t2) & (F.col(ts) <= t3))
    best = fit_temperature(cal, grid).first()["temperature"]
    both = S.temper(test.withColumn("temperature", F.lit(best)), best, out="cal_")
    sets = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), *[F.col(pre + p).alias(p) for p in S.P3]) for n, pre in (("raw", ""), ("calibrated", "cal_"))])).alias("s")
    long = both.select("actual", "temperature", sets).select("actual", "temperature", "s.*")
    m = M.metric_set(long, ["kind"])
    any_win = M.ece_outcome(long, "any_win", keys=["kind"])
    return m.drop("ece").join(any_win, "kind").withColumn("temperature", F.lit(best))


def half_split_slope(df: DataFrame, ts: str = "kickoff_ts", outcome: int = 0, bins: int = 10, keys: list[str] = ()) -> DataFrame:
    """Calibration slope before and after the median time, and whether it drifted."""
    us = epoch_us(ts)
    rows = df.withColumn("_t", us.cast("double"))
    mid = exact_quantiles(rows, list(keys), "_t", {"_mid": 0.5})
    rows = rows.join(mid, list(keys)) if keys else with_one_row(rows, mid)
    rows = rows.withColumn("half", F.when(F.col("_t") < F.col("_mid"), "first").otherwise("second"))
    k = [*keys, "half"]
    s = M.curve_slope(M.calibration_curve(rows, outcome, bins, k), k)
    out = s.groupBy(*keys).agg(F.max(F.when(F.col("half") == "first", F.col("slope"))).alias("slope_first"), F.max(F.when(F.col("half") == "second", F.col("slope"))).alias("slope_second"))
    diff = F.abs(F.col("slope_first") - F.col("slope_second"))
    return out.withColumn("drift", diff).withColumn("label", F.when(diff > 0.1, "TEMPORAL_DRIFT").when(diff < 0.05, "STABLE_INVERSION").otherwise("MODERATE_DRIFT"))


def component_ablation(variants: DataFrame, full: str = "full", keys: list[str] = ()) -> DataFrame:
    """Change of accuracy, log-loss and Brier when a component is neutralised (column ``variant``), with a label."""
    m = variants.groupBy(*keys, "variant").agg(F.avg(hit()).alias("accuracy"), F.avg(logloss_row()).alias("log_loss"), F.avg(brier_row()).alias("brier"))
    base = m.filter(F.col("variant") == full).select(*keys, *[F.col(c).alias(f"_{c}") for c in ("accuracy", "log_loss", "brier")])
    other = m.filter(F.col("variant") != full)
    out = other.join(base, list(keys)) if keys else with_one_row(other, base)
    out = out.select(*keys, "variant", *[(F.col(c) - F.col(f"_{c}")).alias(f"d_{c}") for c in ("accuracy", "log_loss", "brier")])
    return out.withColumn("label", F.when(F.col("d_accuracy") < -0.01, "DEGRADA").when(F.col("d_accuracy") > 0.01, "MEJORA").otherwise("NEUTRO"))


def go_no_go(iterations: DataFrame, threshold: float = 0.005) -> DataFrame:
    """Mean and deviation of the fold improvements and the decision; one row."""
    out = iterations.agg(F.avg("improvement").alias("mean_improvement"), F.stddev_samp("improvement").alias("std_improvement"), F.count(F.lit(1)).alias("folds"))
    return out.withColumn("decision", F.when(F.col("mean_improvement") >= threshold, "GO").otherwise("NO-GO"))


def cv_summary(windows: DataFrame) -> DataFrame:
    """Averages over CV windows (accuracy, log_loss, draw_slope), stability of the slope and a recommendation; one row."""
    inverted = count_if(F.col("draw_slope") < 0)
    out = windows.agg(F.count(F.lit(1)).alias("n_windows"), F.avg("accuracy").alias("avg_accuracy"), F.avg("log_loss").alias("avg_logloss"),
                      F.avg("draw_slope").alias("avg_draw_slope"), F.stddev_pop("draw_slope").alias("draw_slope_std"), inverted.alias("inverted_windows"))
    s, i = F.col("draw_slope_std"), F.col("inverted_windows")
    return out.withColumn("recommendation", F.when((i == 0) & (s < 0.05), "STABLE_CALIBRATION").when(i > F.col("n_windows") / 2, "SYSTEMATIC_INVERSION")
                          .when(s > 0.1, "HIGH_INSTABILITY").otherwise("MODERATE_INSTABILITY"))


def leakage_rows(df: DataFrame, feature_ts: str = "feature_ts", kickoff: str = "kickoff_ts") -> DataFrame:
    """Rows whose feature is not strictly older than the kickoff."""
    return df.filter(F.col(feature_ts) >= F.col(kickoff))


def leakage_audit(df: DataFrame, feature_ts: str = "feature_ts", kickoff: str = "kickoff_ts") -> DataFrame:
    """Violations, lead-time range in hours and the verdict; one row."""
    lead = seconds_between(feature_ts, kickoff) / 3600.0
    out = df.agg(F.count(F.lit(1)).alias("n"), count_if(F.col(feature_ts) >= F.col(kickoff)).alias("violations"),
                 F.min(lead).alias("min_lead_hours"), F.avg(lead).alias("avg_lead_hours"), F.max(lead).alias("max_lead_hours"))
    return out.withColumn("is_valid", F.col("violations") == 0)


def split_order_check(df: DataFrame, ts: str = "kickoff_ts", split: str = "split") -> DataFrame:
    """Does every training row precede every test row? One row."""
    out = df.agg(F.max(F.when(F.col(split) == "train", F.col(ts))).alias("train_max"), F.min(F.when(F.col(split) == "test", F.col(ts))).alias("test_min"))
    return out.withColumn("ok", F.col("train_max") < F.col("test_min"))


def _backtests(df: DataFrame, groups: dict[str, list[str]], target: str, base: str, ts: str, k: int, embargo_days: int) -> DataFrame:
    """Per feature group and fold the squared errors of base and adjusted expectation on val. All groups and folds are fitted in the same passes."""
    features = sorted({f for fs in groups.values() for f in fs})
    folds = persist_table(purged_expanding_cv(df.filter(F.col(base) > 0), ts, k, embargo_days).select("fold", "role", target, base, *features))
    fits = fit_many(folds.filter("role = 'train'"), features, target, "poisson", ["fold"], F.ln(F.col(base)), groups)
    fits = fits.select(F.col("fold").alias("_fold"), "feature_group", "coefficients")
    val = folds.filter("role = 'val'").join(F.broadcast(fits), F.col("fold") == F.col("_fold"))  # one row per fold and group
    used = [F.when(F.col("coefficients")[i + 1] != 0, F.col("coefficients")[i + 1] * F.col(f)).otherwise(0.0) for i, f in enumerate(features)]
    adjusted = F.col(base) * F.exp(add([F.col("coefficients")[0], *used]))
    y = F.col(target)
    out = val.groupBy("feature_group", "fold").agg(F.avg((y - F.col(base)) ** 2).alias("mse_base"), F.avg((y - adjusted) ** 2).alias("mse_adjusted"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("improvement", F.col("mse_base") - F.col("mse_adjusted"))


def backtest_uplift(df: DataFrame, features: list[str], target: str = "goals_home", base: str = "lambda_home_base", ts: str = "kickoff_ts",
                    k: int = 5, embargo_days: int = 15) -> DataFrame:
    """Per fold: fit the goal uplift on train, squared error of base and adjusted expectation on val, improvement. A fold without training rows is left out."""
    return _backtests(df, {"all": features}, target, base, ts, k, embargo_days).drop("feature_group")


def feature_group_ablation(df: DataFrame, groups: dict[str, list[str]], threshold: float = 0.005, target: str = "goals_home", base: str = "lambda_home_base",
                           ts: str = "kickoff_ts", k: int = 5, embargo_days: int = 15) -> DataFrame:
    """Mean backtest improvement per feature group; PASS at the threshold."""
    out = _backtests(df, groups, target, base, ts, k, embargo_days).groupBy("feature_group").agg(F.avg("improvement").alias("mean_improvement"), F.count(F.lit(1)).alias("folds"))
    return out.withColumn("status", F.when(F.col("mean_improvement") >= threshold, "PASS").otherwise("FAIL"))
