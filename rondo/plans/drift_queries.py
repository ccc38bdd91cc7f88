"""Registered queries: drift, skew, data quality."""

from pyspark.sql import functions as F

from ..functions.expr import brier_row
from ..operators import drift as D
from ..operators import metrics as M
from ..operators import windows as W
from .metric_queries import BR, r, rel, y
from .registry import query

# features split by time: first half of the month is the reference
LONG = "lng AS (SELECT feature_name AS feature, CASE WHEN feature_ts < TIMESTAMP '2024-01-16' THEN 'ref' ELSE 'cur' END AS side, CASE WHEN feature_name = 'view' AND feature_ts >= TIMESTAMP '2024-01-16' THEN feature_value * 1.5 + 0.05 ELSE feature_value END AS value FROM features)"


def long_features(t):
    late = F.col("feature_ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    v = F.col("feature_value")
    return t.features.select(F.col("feature_name").alias("feature"), F.when(late, "cur").otherwise("ref").alias("side"),
                             F.when((F.col("feature_name") == "view") & late, v * 1.5 + 0.05).otherwise(v).alias("value"))


def grid_sql(mode, bins=10):
    """Binned counts of both sides on a full grid."""
    edges = {"shared": "SELECT feature, s.side, min(value) OVER (PARTITION BY feature) AS lo, max(value) OVER (PARTITION BY feature) AS hi, count(*) OVER (PARTITION BY feature, s.side) AS n FROM lng s",
             "reference": "SELECT feature, s.side, min(value) FILTER (s.side = 'ref') OVER (PARTITION BY feature) AS lo, max(value) FILTER (s.side = 'ref') OVER (PARTITION BY feature) AS hi, count(*) OVER (PARTITION BY feature, s.side) AS n FROM lng s",
             "independent": "SELECT feature, s.side, min(value) OVER (PARTITION BY feature, s.side) AS lo, max(value) OVER (PARTITION BY feature, s.side) AS hi, count(*) OVER (PARTITION BY feature, s.side) AS n FROM lng s"}[mode]
    return f"""bnd AS (SELECT DISTINCT * FROM ({edges})),
cnt AS (SELECT l.feature, l.side, CAST(least(floor((value - lo) / (hi - lo) * {bins}), {bins - 1}) AS INT) AS bin, count(*) AS c FROM lng l JOIN bnd USING (feature, side) WHERE value BETWEEN lo AND hi GROUP BY ALL),
grd AS (SELECT feature, bin, max(c) FILTER (side = 'ref') AS r, max(c) FILTER (side = 'cur') AS c, max(n) FILTER (side = 'ref') AS nr, max(n) FILTER (side = 'cur') AS nc, min(lo) AS lo, max(hi) AS hi
  FROM (SELECT b.*, CAST(g.bin AS INT) AS bin, coalesce(k.c, 0) AS c FROM bnd b CROSS JOIN range({bins}) g(bin) LEFT JOIN cnt k ON k.feature = b.feature AND k.side = b.side AND k.bin = g.bin) GROUP BY 1, 2)"""


_PSI = {
    "shared": "(SELECT feature, (r + 1) / (nr + 10) AS pr, (c + 1) / (nc + 10) AS pc FROM grd)",
    "reference": "(SELECT feature, greatest(r / sum(r) OVER (PARTITION BY feature), 1e-10) AS pr, greatest(c / sum(c) OVER (PARTITION BY feature), 1e-10) AS pc FROM grd)",
    "independent": "(SELECT feature, greatest(1e-4, least(1, r / nr)) AS pr, greatest(1e-4, least(1, c / nc)) AS pc FROM grd)",
}


def _register_psi(mode):
    sql = f"WITH {LONG}, {grid_sql(mode)} SELECT feature, '{mode}' AS mode, #[sum((pc - pr) * ln(pc / pr))]# AS psi FROM {_PSI[mode]} GROUP BY 1"

    @query("psi" if mode == "shared" else f"psi_{mode}", sql, "features")
    def _(t):
        return r(D.psi(long_features(t), 10, mode), "psi").withColumn("mode", F.lit(mode))


for _mode in _PSI:
    _register_psi(_mode)


@query("reference_histogram", f"""WITH {LONG}, {grid_sql('independent')}
SELECT feature, bin, r AS count, nr AS n, #[lo + (hi - lo) / 10 * bin]# AS edge_lo, #[lo + (hi - lo) / 10 * (bin + 1)]# AS edge_hi, '2024-01-16' AS set_at FROM (
  SELECT g.feature, g.bin, g.r, g.nr, b.lo, b.hi FROM grd g JOIN bnd b ON g.feature = b.feature AND b.side = 'ref')""", "features")
def _(t):
    out = D.reference_histogram(long_features(t).filter("side = 'ref'"), 10, "2024-01-16")
    return r(out.drop("lo", "hi"), "edge_lo", "edge_hi")


@query("psi_from_histogram", f"WITH {LONG}, {grid_sql('reference')} SELECT feature, #[sum((pc - pr) * ln(pc / pr))]# AS psi FROM {_PSI['reference']} GROUP BY 1", "features")
def _(t):
    lng = long_features(t)
    return r(D.psi_from_histogram(D.reference_histogram(lng.filter("side = 'ref'")), lng.filter("side = 'cur'")), "psi")


@query("psi_alert", f"""WITH {LONG}, {grid_sql('shared')}, p AS (SELECT feature, sum((pc - pr) * ln(pc / pr)) AS psi FROM {_PSI['shared']} GROUP BY 1)
SELECT 'PSI_TEMPORAL' AS drift_type, CASE WHEN psi > 0.2 THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity, feature, #[psi]# AS metric_value, CASE WHEN psi > 0.2 THEN 0.2 ELSE 0.1 END::DOUBLE AS threshold FROM p WHERE psi > 0.1""", "features")
def _(t):
    return r(D.psi_alerts(D.psi(long_features(t))), "metric_value")


_KS = """ks AS (SELECT feature, max(abs(cr / nr - cc / nc)) AS d, any_value(nr) AS nr, any_value(nc) AS nc FROM (
  SELECT feature, value, sum(sum(CAST(side = 'ref' AS INT))) OVER w AS cr, sum(sum(CAST(side = 'cur' AS INT))) OVER w AS cc, sum(sum(CAST(side = 'ref' AS INT))) OVER (PARTITION BY feature) AS nr, sum(sum(CAST(side = 'cur' AS INT))) OVER (PARTITION BY feature) AS nc
  FROM lng GROUP BY 1, 2 WINDOW w AS (PARTITION BY feature ORDER BY value)) GROUP BY 1)"""
_KSP = "CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0, least(1, 2 * (" + " + ".join(f"{'-' if k % 2 == 0 else ''}exp(-2.0 * {k * k} * lam * lam)" for k in range(1, 21)) + "))) END"


@query("ks_two_sample", f"WITH {LONG}, {_KS} SELECT feature, #[d]# AS ks, CAST(nr AS BIGINT) AS n_ref, CAST(nc AS BIGINT) AS n_cur, #[{_KSP}]# AS p_value FROM (SELECT *, sqrt(nr * nc / (nr + nc)) * d AS lam FROM ks)", "features")
def _(t):
    return r(D.ks_two_sample(long_features(t)), "ks", "p_value")


_MOM = "mom AS (SELECT feature, avg(value) FILTER (side = 'ref') AS mr, avg(value) FILTER (side = 'cur') AS mc, stddev_pop(value) FILTER (side = 'ref') AS sr, stddev_pop(value) FILTER (side = 'cur') AS sc FROM lng GROUP BY 1)"


@query("mean_variance_shift", f"""WITH {LONG}, {_MOM}
SELECT feature, #[mr]# AS mean_ref, #[mc]# AS mean_cur, #[sr]# AS std_ref, #[sc]# AS std_cur, #[abs(mc - mr) / sr]# AS z, #[sc / sr]# AS std_ratio,
  CASE WHEN abs(mc - mr) / sr > 3 THEN 'HIGH' WHEN sc / sr > 2 OR sc / sr < 0.5 THEN 'MEDIUM' ELSE 'NONE' END AS severity FROM mom""", "features")
def _(t):
    return r(D.mean_variance_shift(long_features(t)), "mean_ref", "mean_cur", "std_ref", "std_cur", "z", "std_ratio")


@query("variance_collapse", f"WITH {LONG}, {_MOM} SELECT feature, #[sc]# AS std_cur, #[pow(sc / sr, 2)]# AS variance_ratio, sc < 1e-6 OR pow(sc / sr, 2) < 0.1 AS is_collapsed FROM mom", "features")
def _(t):
    return r(D.variance_collapse(long_features(t)), "std_cur", "variance_ratio")


_GAPS = "(SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS a, CASE WHEN event_id % 29 = 0 THEN 'NaN'::DOUBLE ELSE value END AS b, value AS c FROM events)"


def gaps(t):
    i = F.col("event_id")
    return t.events.select(F.when(i % 11 != 0, F.col("value")).alias("a"), F.when(i % 29 == 0, float("nan")).otherwise(F.col("value")).alias("b"), F.col("value").alias("c"))


@query("missing_ratio", " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, count(*) FILTER ({c} IS NULL OR isnan({c})) AS missing, #[count(*) FILTER ({c} IS NULL OR isnan({c})) / count(*)]# AS ratio, count(*) FILTER ({c} IS NULL OR isnan({c})) / count(*) > 0.05 AS exceeds FROM {_GAPS}" for c in "abc"))
def _(t):
    return r(D.missing_ratio(gaps(t), ["a", "b", "c"]), "ratio")


@query("freshness", "SELECT feature_name, #[(epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(max(feature_ts))) / 3.6e9]# AS age_hours, (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(max(feature_ts))) / 3.6e9 > 24 AS is_stale FROM features GROUP BY 1", "features")
def _(t):
    return r(D.freshness(t.features, "2024-01-31 12:00:00"), "age_hours").drop("latest_ts")


@query("post_event_regime", """
SELECT o_orderkey, d AS days_since, #[1 - d / 60.0]# AS confidence, CASE WHEN d < 30 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM (
  SELECT o_orderkey, CAST(floor((epoch_us(o_orderdate) - epoch_us(e)) / 86400e6) AS INT) AS d FROM orders, (VALUES (TIMESTAMP '1998-07-12'), (TIMESTAMP '1999-11-02')) v(e) WHERE o_orderdate > e AND o_orderdate < e + INTERVAL 60 DAY)""")
def _(t):
    out = D.regime(t.orders.select("o_orderkey", "o_orderdate"), ["1998-07-12", "1999-11-02"], "o_orderdate")
    return r(out.drop("o_orderdate"), "confidence")


_CAL = "SELECT l_orderkey, l_linenumber, l_shipdate AS kickoff_ts, o_orderdate + INTERVAL 40 DAY AS feature_ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def calendar(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.col("l_shipdate").alias("kickoff_ts"), (F.col("o_orderdate") + F.expr("INTERVAL 40 DAYS")).alias("feature_ts"))


_ISSUE = "CASE WHEN kickoff_ts > TIMESTAMP '2000-01-01' + INTERVAL 365 DAY THEN 'future_match' WHEN feature_ts > kickoff_ts THEN 'feature_after_match' WHEN kickoff_ts < TIMESTAMP '1996-01-01' THEN 'old_match' END"


@query("calendar_corruption", f"SELECT issue, CASE WHEN issue = 'old_match' THEN 'HIGH' ELSE 'CRITICAL' END AS severity, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM (SELECT *, {_ISSUE} AS issue FROM ({_CAL})) WHERE issue IS NOT NULL GROUP BY 1")
def _(t):
    return D.calendar_checks(calendar(t), "2000-01-01", oldest="1996-01-01").groupBy("issue", "severity").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


_KLJS = """kj AS (SELECT feature, sum(p * ln(p / q)) AS kl, 0.5 * sum(p * ln(p / ((p + q) / 2))) + 0.5 * sum(q * ln(q / ((p + q) / 2))) AS js FROM (
  SELECT feature, (c / nc + 1e-10) / (1 + 10 * 1e-10) AS p, (r / nr + 1e-10) / (1 + 10 * 1e-10) AS q FROM grd) GROUP BY 1)"""


@query("kl_js_divergence", f"WITH {LONG}, {grid_sql('shared')}, {_KLJS} SELECT feature, #[kl]# AS kl, #[js]# AS js FROM kj", "features")
def _(t):
    return r(D.kl_js(long_features(t)), "kl", "js")


@query("online_offline_skew", f"WITH {LONG}, {grid_sql('shared')}, {_KLJS}, {_KS} SELECT feature, #[kl]# AS kl, #[js]# AS js, #[d]# AS ks, js > 0.1 AS is_significant FROM kj JOIN ks USING (feature)", "features")
def _(t):
    return r(D.skew(long_features(t)).drop("p_value"), "kl", "js", "ks")


@query("feature_availability", f"WITH {LONG} SELECT feature, count(*) FILTER (side = 'cur') AS online, count(*) FILTER (side = 'ref') AS offline, #[count(*) FILTER (side = 'cur') / count(*) FILTER (side = 'ref')]# AS ratio FROM lng GROUP BY 1", "features")
def _(t):
    return r(D.availability(long_features(t)), "ratio")


@query("calibration_drift", f"""
WITH h AS (SELECT *, kickoff_ts >= TIMESTAMP '2024-01-16' AS late FROM predictions), s AS (SELECT pool, late, regr_slope(obs, pm) AS sl, regr_intercept(obs, pm) AS ic FROM {rel('p_home', y(1), 10, 'h', 'pool, late')} GROUP BY 1, 2)
SELECT c.pool, #[c.sl]# AS slope, #[c.ic]# AS intercept, #[abs(c.sl - b.sl)]# AS slope_drift, #[abs(c.ic - b.ic)]# AS intercept_drift, abs(c.sl - b.sl) > 0.1 OR abs(c.ic - b.ic) > 0.1 AS is_drifted FROM s c JOIN s b ON c.pool = b.pool AND c.late AND NOT b.late""", "predictions")
def _(t):
    late = F.col("kickoff_ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    s = M.curve_slope(M.calibration_curve(t.predictions.withColumn("late", late), 1, 10, ["pool", "late"]), ["pool", "late"])
    return r(D.calibration_drift(s.filter("late"), s.filter(~F.col("late")), ["pool"]), "slope", "intercept", "slope_drift", "intercept_drift")


@query("shannon_entropy", f"""WITH {LONG}, {grid_sql('independent')}, e AS (SELECT feature, -sum(CASE WHEN r > 0 THEN r / nr * ln(r / nr) ELSE 0 END) AS er, -sum(CASE WHEN c > 0 THEN c / nc * ln(c / nc) ELSE 0 END) AS ec FROM grd GROUP BY 1)
SELECT feature, #[er]# AS entropy_ref, #[ec]# AS entropy_cur, #[abs(ec - er)]# AS drift, abs(ec - er) > 0.1 AS is_drifted FROM e""", "features")
def _(t):
    return r(D.entropy_drift(long_features(t)), "entropy_ref", "entropy_cur", "drift")


_SEG = f"""seg AS (SELECT pool, abs(avg(br) FILTER (r <= 10) - avg(br) FILTER (r > 10)) AS d, count(*) AS n FROM (SELECT pool, {BR} AS br, row_number() OVER (PARTITION BY pool ORDER BY kickoff_ts DESC, match_id DESC) AS r FROM predictions) WHERE r <= 20 GROUP BY 1),
coh AS (SELECT abs(avg(br) FILTER (c) - avg(br) FILTER (NOT c)) AS d FROM (SELECT c, br, row_number() OVER (PARTITION BY c ORDER BY kickoff_ts DESC, match_id DESC) AS r FROM (SELECT *, tournament <> 'Friendly' AS c, {BR} AS br FROM predictions)) WHERE r <= 10)"""


@query("comprehensive_drift", f"""WITH {LONG}, {grid_sql('shared')}, {_MOM}, {_SEG}, p AS (SELECT feature, sum((pc - pr) * ln(pc / pr)) AS psi FROM {_PSI['shared']} GROUP BY 1)
SELECT 'PSI_TEMPORAL' AS drift_type, CASE WHEN psi > 0.2 THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity, feature, #[psi]# AS metric_value, CAST(CASE WHEN psi > 0.2 THEN 0.2 ELSE 0.1 END AS DOUBLE) AS threshold FROM p WHERE psi > 0.1
UNION ALL SELECT 'FEATURE_DISTRIBUTION_SHIFT', CASE WHEN abs(mc - mr) / sr > 3 THEN 'HIGH' ELSE 'MEDIUM' END, feature, #[CASE WHEN abs(mc - mr) / sr > 3 THEN abs(mc - mr) / sr ELSE sc / sr END]#, CASE WHEN abs(mc - mr) / sr > 3 THEN 3.0 ELSE 2.0 END FROM mom WHERE abs(mc - mr) / sr > 3 OR sc / sr > 2 OR sc / sr < 0.5
UNION ALL SELECT 'POST_TOURNAMENT_REGIME', 'CRITICAL', 'none', #[1 - 13 / 60.0]#, 0.5
UNION ALL SELECT 'CONFEDERATION_DRIFT', 'MEDIUM', pool, #[d]#, 0.15 FROM seg WHERE d > 0.15 AND n >= 20
UNION ALL SELECT 'TOURNAMENT_VS_FRIENDLY', 'MEDIUM', 'none', #[d]#, 0.15 FROM coh WHERE d > 0.15
UNION ALL SELECT 'CALENDAR_CORRUPTION', CASE WHEN issue = 'old_match' THEN 'HIGH' ELSE 'CRITICAL' END, issue, count(*), 0 FROM (SELECT CASE WHEN kickoff_ts > TIMESTAMP '2000-01-01' + INTERVAL 365 DAY THEN 'future_match' WHEN feature_ts > kickoff_ts THEN 'feature_after_match' WHEN kickoff_ts < TIMESTAMP '2020-01-01' THEN 'old_match' END AS issue FROM ({_CAL})) WHERE issue IS NOT NULL GROUP BY issue""", "features predictions")
def _(t):
    p = t.predictions.withColumn("br", brier_row())
    out = D.comprehensive_drift(long_features(t), "2000-01-01", ["1999-12-18 12:00:00"], W.segment_drift(p, "pool", "br", W.ORDER),
                                W.cohort_divergence(p, F.col("tournament") != "Friendly", "br", W.ORDER), gaps(t), ["c"], calendar(t))
    return r(out.fillna("none", ["feature"]), "metric_value", "threshold")
