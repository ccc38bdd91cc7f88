"""Evaluation of three-way predictions: columns p_home, p_draw, p_away, actual in {1,0,-1}.

Every metric takes grouping keys, so one pass serves model x window x slice. Binned metrics aggregate per
(keys, bin) first - at most ``bins`` rows per group leave that step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import OUTCOMES, add, brier_row, clip, count_if, hit, logloss_row, safe_div, share, top_pick, with_one_row
from .quantiles import exact_quantiles
from .regression import fit_many
from .scoring import P3

UPSET = 0.35
NAMES = {1: "home", 0: "draw", -1: "away"}


def _is(v: int) -> Column:
    return F.when(F.col("actual") == v, 1.0).otherwise(0.0)


def brier(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Sum over classes, and the mean per class."""
    return df.groupBy(*keys).agg(F.avg(brier_row()).alias("brier"), *[F.avg((F.col(p) - _is(v)) ** 2).alias(f"brier_{NAMES[v]}") for v, p in OUTCOMES])


def logloss(df: DataFrame, keys: list[str] = (), eps: float = 1e-7) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(logloss_row(eps)).alias("log_loss"))


def accuracy(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(hit()).alias("accuracy"), F.count(F.lit(1)).alias("n"))


# ---- calibration bins ----------------------------------------------------------------------------


def bin_left(p: Column, bins: int) -> Column:
    """Equal bins [lo, hi) on [0, 1], the last one closed."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def bin_right(p: Column, bins: int) -> Column:
    """Equal bins (lo, hi]; 0 falls outside (bin -1)."""
    return (F.ceil(p * bins) - 1).cast("int")


def reliability(df: DataFrame, p: Column, y: Column, bins: int = 10, keys: list[str] = (), right: bool = False) -> DataFrame:
    """Reliability table: n, mean prediction and observed rate per (keys, bin)."""
    b = bin_right(p, bins) if right else bin_left(p, bins)
    rows = df.select(*keys, b.alias("bin"), p.alias("_p"), y.alias("_y"))
    return rows.filter(F.col("bin") >= 0).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_p").alias("pred_mean"), F.avg("_y").alias("obs_rate"))


def ece_of(table: DataFrame, keys: list[str] = (), min_n: int = 1) -> DataFrame:
    """Expected and maximum calibration error of a reliability table; small bins are skipped but still weigh in n."""
    err = F.abs(F.col("pred_mean") - F.col("obs_rate"))
    big = F.col("n") >= min_n
    return table.groupBy(*keys).agg((F.coalesce(F.sum(F.when(big, F.col("n") * err)), F.lit(0.0)) / F.sum("n")).alias("ece"),
                                    F.coalesce(F.max(F.when(big, err)), F.lit(0.0)).alias("mce"))


def ece_outcome(df: DataFrame, outcome: str = "home", bins: int = 10, min_n: int = 3, keys: list[str] = ()) -> DataFrame:
    """Calibration error of one outcome; ``any_win`` stacks home and away."""
    sets = {"home": [1], "draw": [0], "away": [-1], "any_win": [1, -1]}[outcome]
    pairs = F.explode(F.array(*[F.struct(F.col(dict(OUTCOMES)[v]).alias("p"), _is(v).alias("y")) for v in sets])).alias("s")
    rows = df.select(*keys, pairs)
    return ece_of(reliability(rows, F.col("s.p"), F.col("s.y"), bins, keys), keys, min_n)


def ece_top(df: DataFrame, bins: int = 10, keys: list[str] = ()) -> DataFrame:
    """Calibration error of the top probability against correctness, bins (lo, hi]."""
    return ece_of(reliability(df, F.greatest(*P3), hit(), bins, keys, right=True), keys)


def ece_home(df: DataFrame, bins: int = 10, keys: list[str] = ()) -> DataFrame:
    """Calibration error of the first probability, no minimum bin size."""
    return ece_of(reliability(df, F.col("p_home"), _is(1), bins, keys), keys)


def calibration_curve(df: DataFrame, outcome: int = 0, bins: int = 15, keys: list[str] = ()) -> DataFrame:
    return reliability(df, F.col(dict(OUTCOMES)[outcome]), _is(outcome), bins, keys)


def curve_slope(table: DataFrame, keys: list[str] = (), min_bins: int = 2) -> DataFrame:
    """Least-squares slope and intercept through the bin means, all bins weighing the same."""
    return table.groupBy(*keys).agg(F.regr_slope("obs_rate", "pred_mean").alias("slope"), F.regr_intercept("obs_rate", "pred_mean").alias("intercept"),
                                    F.count(F.lit(1)).alias("n_bins")).filter(F.col("n_bins") >= min_bins)


def calibration_logit(df: DataFrame, p: str = "p_home", y: Column | None = None, keys: list[str] = ()) -> DataFrame:
    """Slope and intercept of the outcome on logit(p), unregularised; one row per value of ``keys``, all fitted in the same passes."""
    q = clip(F.col(p), 1e-6, 1 - 1e-6)
    rows = df.select(*keys, F.ln(q / (1 - q)).alias("logit"), (y if y is not None else _is(1)).alias("label"))
    fits = fit_many(rows, ["logit"], "label", "logistic", keys)
    return fits.select(*keys, F.col("coefficients")[1].alias("slope"), F.col("coefficients")[0].alias("intercept"))


def rolling_calibration_slope(df: DataFrame, p: Column, y: Column, keys: list[str] = (), bins: int = 4, lo: float = 0.95, hi: float = 1.05, min_n: int = 20) -> DataFrame:
    """Slope over ``bins`` bins with at least three filled; ok when within [lo, hi]. One row per key (window)."""
    table = reliability(df, p, y, bins, keys)
    out = table.groupBy(*keys).agg(F.regr_slope("obs_rate", "pred_mean").alias("slope"), F.count(F.lit(1)).alias("n_bins"), F.sum("n").alias("n"))
    return out.filter((F.col("n_bins") >= 3) & (F.col("n") >= min_n)).withColumn("ok", F.col("slope").between(lo, hi))


# ---- upsets, buckets -----------------------------------------------------------------------------


def _upset_parts() -> dict[str, Column]:
    low = F.least("p_home", "p_away")
    clear = low < UPSET
    won = F.when(F.col("actual") == 1, F.col("p_home")).when(F.col("actual") == -1, F.col("p_away"))
    upset = clear & (F.greatest("p_home", "p_away") >= 1 - UPSET) & F.coalesce(won < UPSET, F.lit(False))
    return {"n_clear": count_if(clear), "n_upset": count_if(upset), "n_detected": count_if(upset & (low >= 0.20))}


def upset_rates(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Share of upsets among matches with a clear favourite, and of upsets the model left at 20 % or more; in percent."""
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in _upset_parts().items()])
    return out.withColumns({"upset_rate": safe_div(F.col("n_upset"), F.col("n_clear")) * 100,
                            "upset_detect_rate": F.when(F.col("n_upset") > 0, F.col("n_detected") / F.col("n_upset") * 100).when(F.col("n_clear") > 0, 0.0)})


# bucket -> (threshold, kind) (fixed values)
BUCKETS = {"fav_70": (0.70, "favorite"), "fav_80": (0.80, "favorite"), "under_25": (0.25, "underdog")}


def confidence_buckets(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Raw (p_*) and calibrated (cal_p_*) means against the actual rate for strong favourites and underdogs."""
    def entry(name, v, cond):
        p = dict(OUTCOMES)[v]
        return F.when(cond, F.struct(F.lit(name).alias("bucket"), F.col(p).alias("raw"), F.col("cal_" + p).alias("cal"), _is(v).alias("y")))

    entries = []
    for name, (t, kind) in BUCKETS.items():
        if kind == "favorite":
            entries += [entry(name, 1, F.col("p_home") > t), entry(name, -1, (F.col("p_home") <= t) & (F.col("p_away") > t))]
        else:
            entries += [entry(name, 1, F.col("p_home") < t), entry(name, -1, F.col("p_away") < t)]
    rows = df.select(*keys, F.explode(F.array_compact(F.array(*entries))).alias("e")).select(*keys, "e.*")
    out = rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("raw").alias("avg_raw"), F.avg("cal").alias("avg_cal"), F.avg("y").alias("actual_rate"))
    return out.withColumns({"raw_gap": F.col("avg_raw") - F.col("actual_rate"), "cal_gap": F.col("avg_cal") - F.col("actual_rate")})


def draw_calibration(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Draw calibration errors of raw (p_draw) and calibrated (cal_p_draw) probabilities, side by side."""
    both = df.select(*keys, "actual", F.explode(F.array(F.struct(F.lit("raw").alias("kind"), F.col("p_draw").alias("p")), F.struct(F.lit("cal").alias("kind"), F.col("cal_p_draw").alias("p")))).alias("s"))
    k = [*keys, "kind"]
    return ece_of(reliability(both.select(*keys, "s.kind", "s.p", "actual"), F.col("p"), _is(0), 10, k), k, 3)


# ---- metric sets ---------------------------------------------------------------------------------


def metric_set(df: DataFrame, keys: list[str] = (), min_n: int = 1, eps: float = 1e-7, bins: int = 10, min_bin: int = 3) -> DataFrame:
    """All metrics per key, rounded as reported. One scan: sums per (keys, home-probability bin), then per key."""
    cells = df.withColumn("_bin", bin_left(F.col("p_home"), bins)).groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(brier_row()).alias("b"), F.sum(logloss_row(eps)).alias("l"), F.sum(hit()).alias("h"),
        F.sum("p_home").alias("p"), F.sum(_is(1)).alias("y"), *[c.alias(n) for n, c in _upset_parts().items()])
    n = F.sum("n")
    err = F.abs(F.col("p") - F.col("y"))
    out = cells.groupBy(*keys).agg(
        n.alias("n_matches"), F.round(F.sum("b") / n, 4).alias("brier"), F.round(F.sum("l") / n, 4).alias("log_loss"), F.round(F.sum("h") / n * 100, 2).alias("accuracy"),
        F.round(safe_div(F.sum("n_upset"), F.sum("n_clear")) * 100, 2).alias("upset_rate"),
        F.round(F.when(F.sum("n_upset") > 0, F.sum("n_detected") / F.sum("n_upset") * 100).when(F.sum("n_clear") > 0, 0.0), 2).alias("upset_detect_rate"),
        F.round(F.coalesce(F.sum(F.when(F.col("n") >= min_bin, err)), F.lit(0.0)) / n, 4).alias("ece"))
    return out.filter(F.col("n_matches") >= min_n)


def metrics_by(df: DataFrame, keys: dict[str, Column], min_n: int = 20) -> DataFrame:
    """Metric sets by slice expressions, e.g. tournament prefix or year; small slices are left out."""
    return metric_set(df.withColumns(keys), list(keys), min_n)


def confusion_matrix(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Counts by actual (rows) and predicted (columns) outcome."""
    pred = top_pick(*[F.col(p) for p in P3])
    return df.groupBy(*keys, "actual").agg(*[count_if(pred == v).alias(f"pred_{NAMES[v]}") for v in (1, 0, -1)])


def per_class_prf(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    pred = top_pick(*[F.col(p) for p in P3])
    rows = df.select(*keys, "actual", pred.alias("pred"))
    cells = F.array(*[F.struct(F.lit(v).alias("cls"), count_if((F.col("actual") == v) & (F.col("pred") == v)).alias("tp"),
                               count_if(F.col("pred") == v).alias("np"), count_if(F.col("actual") == v).alias("support")) for v in (1, 0, -1)])
    c = rows.groupBy(*keys).agg(cells.alias("c")).select(*keys, F.explode("c").alias("c")).select(*keys, "c.*")
    p = F.coalesce(safe_div(F.col("tp"), F.col("np")), F.lit(0.0))
    r = F.coalesce(safe_div(F.col("tp"), F.col("support")), F.lit(0.0))
    return c.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", F.coalesce(safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))).drop("tp", "np")


def brier_uplift(df: DataFrame, base: str = "base_", adjusted: str = "adj_", keys: list[str] = ()) -> DataFrame:
    """Brier of the base minus Brier of the adjusted probabilities (column prefixes)."""
    b, a = (brier_row(*[x + p for p in P3]) for x in (base, adjusted))
    return df.groupBy(*keys).agg(F.avg(b).alias("brier_base"), F.avg(a).alias("brier_adjusted"), (F.avg(b) - F.avg(a)).alias("uplift"))


PERCENTS = {"p5": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95}


def draw_profile(df: DataFrame) -> DataFrame:
    """Shape of the draw probability: moments, percentiles, density bands, gap to the favourite, pattern labels; one row."""
    d, top = F.col("p_draw"), F.greatest("p_home", "p_away")
    out = df.agg(F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.min(d).alias("min"), F.max(d).alias("max"), share(F.col("actual") == 0).alias("draw_rate"),
                 share(d.between(0.10, 0.20)).alias("density_10_20"), share(d.between(0.20, 0.35)).alias("density_20_35"), share(d > 0.35).alias("density_35_plus"),
                 F.avg(top - d).alias("gap_mean"), share(d > top).alias("dominance_rate"))
    out = with_one_row(out, exact_quantiles(df, [], "p_draw", PERCENTS))
    return out.withColumns({
        "pattern": F.when(F.col("std") < 0.05, "NARROW_BELL").when(F.col("max") < 0.30, "TRUNCATED_TAIL").otherwise("NORMAL"),
        "suppression": F.when((F.col("gap_mean") > 0.15) & (F.col("dominance_rate") < 0.02), "SEVERE_SUPPRESSION").when(F.col("gap_mean") > 0.10, "MODERATE_SUPPRESSION").otherwise("ACCEPTABLE")})


def slope_pattern(slope: Column) -> Column:
    """Label of a draw calibration slope; the collapse rule is tested before the flattened one."""
    return (F.when(F.abs(slope - 1.0) < 0.2, "LINEAR_COMPRESSION").when(slope < 0.2, "COLLAPSE").when(slope < 0.5, "S_SHAPED_FLATTENED").otherwise("HIGH_VARIANCE"))


def prob_integrity(df: DataFrame, tol: float = 1e-6, keys: list[str] = ()) -> DataFrame:
    """Rows whose probabilities do not sum to one or leave [0, 1], and the spread of each class."""
    total = add([F.col(p) for p in P3])
    outside = F.lit(False)
    for p in P3:
        outside = outside | ~F.col(p).between(0, 1)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), count_if(F.abs(total - 1) >= tol).alias("bad_sum"), count_if(outside).alias("out_of_range"),
                                 *[F.stddev_pop(p).alias(f"std_{p[2:]}") for p in P3])
