"""Drift, skew and data-quality monitors over long tables (feature, side, value); side is 'ref' or 'cur'.

All features are handled together. Bounds and bins are small per-feature tables; the rows are only ever counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import add, clip, count_if, epoch_us, seconds_between
from ..session import dimension, persist_table
from .slices import MOST, prefix_sum

EPS = 1e-10


def _long(df: DataFrame) -> DataFrame:
    return df.select("feature", "side", F.col("value").cast("double").alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def _bounds(rows: DataFrame, mode: str) -> DataFrame:
    """lo / hi per feature and side under an edge mode."""
    per = rows.groupBy("feature", "side").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
    if mode == "independent":
        return per
    keep = per if mode == "shared" else per.filter(F.col("side") == "ref")
    edges = keep.groupBy("feature").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return per.drop("lo", "hi").join(edges, "feature")


def bin_of(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin of a value, the last bin closed; NULL outside [lo, hi]."""
    b = F.when(hi > lo, F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(0)
    return F.when(value.between(lo, hi), b.cast("int"))


def binned_counts(df: DataFrame, bins: int = 10, mode: str = "shared") -> DataFrame:
    """(feature, bin, ref, cur, n_ref, n_cur, lo, hi) on a full bin grid."""
    rows = _long(df)
    bounds = _bounds(rows, mode)
    counts = rows.join(bounds, ["feature", "side"]).select("feature", "side", bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin")).filter(F.col("bin").isNotNull())
    counts = counts.groupBy("feature", "side", "bin").agg(F.count(F.lit(1)).alias("c"))
    grid = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(counts, ["feature", "side", "bin"], "left").fillna(0, ["c"])
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    return full.groupBy("feature", "bin").agg(pick("ref", "c").alias("ref"), pick("cur", "c").alias("cur"), pick("ref", "n").alias("n_ref"), pick("cur", "n").alias("n_cur"),
                                              F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def psi(df: DataFrame, bins: int = 10, mode: str = "shared") -> DataFrame:
    """Population stability index per feature.

    shared: common edges, add-one smoothing. reference: edges of the reference, rows outside dropped, floor 1e-10.
    independent: own edges per side, shares kept in 1e-4..1.
    """
    g = binned_counts(df, bins, mode)
    r, c = F.col("ref"), F.col("cur")
    if mode == "shared":
        pr, pc = (r + 1) / (F.col("n_ref") + bins), (c + 1) / (F.col("n_cur") + bins)
    elif mode == "independent":
        pr, pc = clip(r / F.col("n_ref"), 1e-4, 1.0), clip(c / F.col("n_cur"), 1e-4, 1.0)
    else:
        inside = g.groupBy("feature").agg(F.sum("ref").alias("_r"), F.sum("cur").alias("_c"))
        g = g.join(inside, "feature")
        pr, pc = F.greatest(r / F.col("_r"), F.lit(EPS)), F.greatest(F.try_divide(c, F.col("_c")), F.lit(EPS))
    g = g.withColumns({"_pr": pr, "_pc": pc})
    out = g.groupBy("feature").agg(F.sum((F.col("_pc") - F.col("_pr")) * F.ln(F.col("_pc") / F.col("_pr"))).alias("psi"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
    return out.select("feature", F.when(F.col("_lo") == F.col("_hi"), 0.0).otherwise(F.col("psi")).alias("psi"))


def reference_histogram(df: DataFrame, bins: int = 10, set_at: str = "") -> DataFrame:
    """Reference distribution (feature, value) as edges and counts, so that later batches need no raw sample."""
    rows = df.select("feature", F.col("value").cast("double").alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    b = rows.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
    counts = rows.join(b, "feature").groupBy("feature", bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = b.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts, ["feature", "bin"], "left").fillna(0, ["count"])
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.select("feature", "bin", (F.col("lo") + width * F.col("bin")).alias("edge_lo"), (F.col("lo") + width * (F.col("bin") + 1)).alias("edge_hi"),
                       "count", "n", "lo", "hi", F.lit(set_at).alias("set_at"))


def psi_from_histogram(hist: DataFrame, current: DataFrame, bins: int = 10) -> DataFrame:
    """PSI of a current batch (feature, value) against a stored reference histogram (reference edges)."""
    b = hist.groupBy("feature").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    cur = current.join(b, "feature").groupBy("feature", bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("cur"))
    g = hist.join(cur, ["feature", "bin"], "left").fillna(0, ["cur"])
    tot = g.groupBy("feature").agg(F.sum("count").alias("_r"), F.sum("cur").alias("_c"))
    pr, pc = F.greatest(F.col("count") / F.col("_r"), F.lit(EPS)), F.greatest(F.try_divide(F.col("cur"), F.col("_c")), F.lit(EPS))
    return g.join(tot, "feature").groupBy("feature").agg(F.sum((pc - pr) * F.ln(pc / pr)).alias("psi"))


def psi_alerts(psis: DataFrame, critical: float = 0.20, warning: float = 0.10) -> DataFrame:
    """Alert rows for features above a threshold."""
    sev = F.when(F.col("psi") > critical, "CRITICAL").when(F.col("psi") > warning, "MEDIUM")
    out = psis.withColumn("severity", sev).filter(F.col("severity").isNotNull())
    return out.select(F.lit("PSI_TEMPORAL").alias("drift_type"), "severity", "feature", F.col("psi").alias("metric_value"),
                      F.when(F.col("severity") == "CRITICAL", critical).otherwise(warning).alias("threshold"))


def ks_two_sample(df: DataFrame, most: int = MOST) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p value per feature.

    Rows are counted per distinct value first. The cumulative counts run over slices of equal count: a feature with more than ``most`` distinct values is
    cut at quantiles of these, so neither a hot feature nor a skewed one with far outliers lands in one task.
    """
    rows = _long(df)
    b = rows.groupBy("feature").agg(count_if(F.col("side") == "ref").alias("n_ref"), count_if(F.col("side") == "cur").alias("n_cur"))
    values = persist_table(rows.groupBy("feature", "value").agg(count_if(F.col("side") == "ref").alias("r"), count_if(F.col("side") == "cur").alias("c")))
    cum = prefix_sum(values, ["feature"], ["value"], {"cr": F.col("r"), "cc": F.col("c")}, most)
    gap = F.max(F.abs(F.col("cr") / F.col("n_ref") - F.col("cc") / F.col("n_cur")))
    d = cum.join(dimension(b), "feature").groupBy("feature").agg(gap.alias("ks"), F.first("n_ref").alias("n_ref"), F.first("n_cur").alias("n_cur"))
    lam = F.sqrt(F.col("n_ref") * F.col("n_cur") / (F.col("n_ref") + F.col("n_cur"))) * F.col("ks")
    return d.withColumn("p_value", kolmogorov_sf(lam))


def kolmogorov_sf(lam: Column, terms: int = 20) -> Column:
    """Upper tail of the Kolmogorov distribution; 1 for small arguments, where the series does not converge."""
    series = 2 * add([(-1.0) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, terms + 1)])
    return F.when(lam < 0.2, 1.0).otherwise(clip(series, 0.0, 1.0))


def _moments(df: DataFrame) -> DataFrame:
    rows = _long(df)
    m = lambda s, f, n: f(F.when(F.col("side") == s, F.col("value"))).alias(n)
    return rows.groupBy("feature").agg(m("ref", F.avg, "mean_ref"), m("cur", F.avg, "mean_cur"), m("ref", F.stddev_pop, "std_ref"), m("cur", F.stddev_pop, "std_cur"))


def mean_variance_shift(df: DataFrame) -> DataFrame:
    """z of the mean and ratio of deviations against the reference; HIGH beyond 3 sigma, MEDIUM when the spread halves or doubles."""
    s = _moments(df)
    z = F.when(F.col("std_ref") > 0, F.abs(F.col("mean_cur") - F.col("mean_ref")) / F.col("std_ref"))
    ratio = F.when((F.col("std_ref") > 0) & (F.col("std_cur") > 0), F.col("std_cur") / F.col("std_ref"))
    sev = F.when(F.col("z") > 3, "HIGH").when((F.col("std_ratio") > 2) | (F.col("std_ratio") < 0.5), "MEDIUM").otherwise("NONE")
    return s.withColumns({"z": z, "std_ratio": ratio}).withColumn("severity", sev)


def variance_collapse(df: DataFrame, threshold: float = 0.1, tiny: float = 1e-6) -> DataFrame:
    """Features whose deviation vanished or whose variance fell below a share of the reference."""
    s = _moments(df)
    ratio = F.when(F.col("std_ref") > 0, F.pow(F.col("std_cur") / F.col("std_ref"), F.lit(2.0))).otherwise(0.0)
    return s.select("feature", "std_cur", ratio.alias("variance_ratio")).withColumn("is_collapsed", (F.col("std_cur") < tiny) | (F.col("variance_ratio") < threshold))


def missing_ratio(df: DataFrame, columns: list[str], threshold: float = 0.05) -> DataFrame:
    """Share of NULL or NaN per column, in one pass."""
    gone = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    n = F.count(F.lit(1))
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), n.alias("n"), count_if(gone(c)).alias("missing")) for c in columns])
    out = df.agg(entries.alias("e")).select(F.explode("e").alias("e")).select("e.*")
    ratio = F.try_divide(F.col("missing"), F.col("n"))
    return out.withColumn("ratio", F.coalesce(ratio, F.lit(0.0))).withColumn("exceeds", F.col("ratio") > threshold)


def row_sparsity(columns: list[str]) -> Column:
    """Share of missing features of a row."""
    return add([F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1.0).otherwise(0.0) for c in columns]) / len(columns)


def freshness(df: DataFrame, now: str, limit_hours: float = 24.0, ts: str = "feature_ts", name: str = "feature_name") -> DataFrame:
    """Age of the newest record per feature in hours, and whether it is stale."""
    out = df.groupBy(name).agg(F.max(ts).alias("latest_ts"))
    age = (epoch_us(F.lit(now)) - epoch_us("latest_ts")) / 3.6e9
    return out.withColumn("age_hours", age).withColumn("is_stale", F.col("age_hours") > limit_hours)


def regime(df: DataFrame, end_dates: list[str], ts: str = "kickoff_ts", window_days: int = 60) -> DataFrame:
    """Rows within the window after a tournament end: days since, confidence, severity. The first matching end counts."""
    out = df.withColumn("_end", F.lit(None).cast("timestamp"))
    t = F.col(ts).cast("timestamp")
    end = F.lit(None).cast("timestamp")
    for d in reversed(end_dates):
        e = F.lit(d).cast("timestamp")
        end = F.when((t > e) & (epoch_us(t) < epoch_us(e) + window_days * 86_400_000_000), e).otherwise(end)
    out = out.withColumn("_end", end).filter(F.col("_end").isNotNull())
    days = F.floor(seconds_between("_end", ts) / 86400).cast("int")
    out = out.withColumn("days_since", days).withColumn("confidence", 1.0 - F.col("days_since") / window_days)
    return out.withColumn("severity", F.when(F.col("days_since") < 30, "CRITICAL").otherwise("HIGH")).drop("_end")


def calendar_checks(df: DataFrame, now: str, match_ts: str = "kickoff_ts", feature_ts: str = "feature_ts", oldest: str = "2020-01-01") -> DataFrame:
    """Impossible dates: more than a year ahead, feature after the match, before 2020. Adds issue and severity."""
    m = epoch_us(match_ts)
    issue = (F.when(m > epoch_us(F.lit(now)) + 365 * 86_400_000_000, "future_match").when(epoch_us(feature_ts) > m, "feature_after_match")
             .when(m < epoch_us(F.lit(oldest)), "old_match"))
    out = df.withColumn("issue", issue).filter(F.col("issue").isNotNull())
    return out.withColumn("severity", F.when(F.col("issue") == "old_match", "HIGH").otherwise("CRITICAL"))


def kl_js(df: DataFrame, bins: int = 10) -> DataFrame:
    """KL(cur || ref) and Jensen-Shannon divergence on common bins; the mixture is of the two distributions."""
    g = binned_counts(df, bins, "shared")
    tot = F.lit(1.0) + bins * EPS
    p, q = (F.col("cur") / F.col("n_cur") + EPS) / tot, (F.col("ref") / F.col("n_ref") + EPS) / tot
    g = g.withColumns({"_p": p, "_q": q}).withColumn("_m", (F.col("_p") + F.col("_q")) / 2)
    kl = lambda a, b: F.sum(F.col(a) * F.ln(F.col(a) / F.col(b)))
    return g.groupBy("feature").agg(kl("_p", "_q").alias("kl"), (0.5 * kl("_p", "_m") + 0.5 * kl("_q", "_m")).alias("js"))


def skew(df: DataFrame, bins: int = 10, threshold: float = 0.1) -> DataFrame:
    """Online ('cur') against offline ('ref') values: KL, JS, KS; significant when JS exceeds the threshold."""
    return kl_js(df, bins).join(ks_two_sample(df), "feature").select("feature", "kl", "js", "ks", "p_value", (F.col("js") > threshold).alias("is_significant"))


def availability(df: DataFrame) -> DataFrame:
    """Online count over offline count per offline feature; 0 when absent online."""
    out = df.groupBy("feature").agg(count_if(F.col("side") == "cur").alias("online"), count_if(F.col("side") == "ref").alias("offline"))
    return out.filter(F.col("offline") > 0).withColumn("ratio", F.col("online") / F.col("offline"))


def calibration_drift(current: DataFrame, base: DataFrame, keys: list[str], threshold: float = 0.1) -> DataFrame:
    """Distance of slope and intercept from a baseline."""
    b = base.select(*keys, F.col("slope").alias("_s"), F.col("intercept").alias("_i"))
    out = current.join(b, keys)
    ds, di = F.abs(F.col("slope") - F.col("_s")), F.abs(F.col("intercept") - F.col("_i"))
    return out.select(*keys, "slope", "intercept", ds.alias("slope_drift"), di.alias("intercept_drift"), ((ds > threshold) | (di > threshold)).alias("is_drifted"))


def entropy_drift(df: DataFrame, bins: int = 10, threshold: float = 0.1) -> DataFrame:
    """Entropy of each side's own histogram and whether it moved."""
    g = binned_counts(df, bins, "independent")
    h = lambda c, n: -F.sum(F.when(F.col(c) > 0, F.col(c) / F.col(n) * F.ln(F.col(c) / F.col(n))).otherwise(0.0))
    out = g.groupBy("feature").agg(h("ref", "n_ref").alias("entropy_ref"), h("cur", "n_cur").alias("entropy_cur"))
    return out.withColumn("drift", F.abs(F.col("entropy_cur") - F.col("entropy_ref"))).withColumn("is_drifted", F.col("drift") > threshold)


ALERT = ["drift_type", "severity", "feature", "metric_value", "threshold"]


def _alert(df: DataFrame, kind: str, severity: Column, feature: Column, value: Column, threshold: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("drift_type"), severity.alias("severity"), feature.cast("string").alias("feature"), value.cast("double").alias("metric_value"), threshold.cast("double").alias("threshold"))


def comprehensive_drift(values: DataFrame, now: str, end_dates: list[str], segments: DataFrame | None = None, cohorts: DataFrame | None = None,
                        wide: DataFrame | None = None, wide_columns: list[str] = (), calendar: DataFrame | None = None) -> DataFrame:
    """Alert rows of every check over one batch.

    values: long (feature, side, value). segments / cohorts: results of ``segment_drift`` / ``cohort_divergence``.
    wide: rows checked for missing features. calendar: rows (kickoff_ts, feature_ts).
    """
    spark = values.sparkSession
    shift = mean_variance_shift(values).filter(F.col("severity") != "NONE")
    high = F.col("severity") == "HIGH"
    parts = [
        psi_alerts(psi(values)),
        _alert(shift, "FEATURE_DISTRIBUTION_SHIFT", F.col("severity"), F.col("feature"), F.when(high, F.col("z")).otherwise(F.col("std_ratio")), F.when(high, 3.0).otherwise(2.0)),
        _alert(regime(spark.range(1).select(F.lit(now).cast("timestamp").alias("kickoff_ts")), end_dates), "POST_TOURNAMENT_REGIME", F.col("severity"), F.lit(None), F.col("confidence"), F.lit(0.5)),
    ]
    if segments is not None:
        seg = segments.columns[0]
        parts.append(_alert(segments.filter("alert"), "CONFEDERATION_DRIFT", F.lit("MEDIUM"), F.col(seg), F.col("drift"), F.lit(0.15)))
    if cohorts is not None:
        parts.append(_alert(cohorts.filter("alert"), "TOURNAMENT_VS_FRIENDLY", F.lit("MEDIUM"), F.lit(None), F.col("divergence"), F.lit(0.15)))
    if wide is not None:
        miss = missing_ratio(wide, list(wide_columns), 0.30).filter("exceeds")
        parts.append(_alert(miss, "FEATURE_SPARSITY", F.lit("HIGH"), F.col("feature"), F.col("ratio"), F.lit(0.30)))
    if calendar is not None:
        bad = calendar_checks(calendar, now).groupBy("issue", "severity").agg(F.count(F.lit(1)).alias("n"))
        parts.append(_alert(bad, "CALENDAR_CORRUPTION", F.col("severity"), F.col("issue"), F.col("n"), F.lit(0.0)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
