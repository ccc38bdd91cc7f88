"""Registered queries: evaluation metrics."""

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import metrics as M
from ..operators import scoring as S
from ..operators import windows as W
from .fit_sql import newton_sql
from .registry import query

P3 = S.P3
BR = "(pow(p_home - CAST(actual = 1 AS INT), 2) + pow(p_draw - CAST(actual = 0 AS INT), 2) + pow(p_away - CAST(actual = -1 AS INT), 2))"
PICK = "CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 1 WHEN p_draw >= p_away THEN 0 ELSE -1 END"
PA = "CASE actual WHEN 1 THEN p_home WHEN 0 THEN p_draw ELSE p_away END"


def r(df, *cols, digits=6):
    """Round the named columns, keep the rest."""
    return df.withColumns({c: rnd(c, digits) for c in cols})


@query("multiclass_brier", f"""
SELECT pool, #[avg({BR})]# AS brier, #[avg(pow(p_home - CAST(actual = 1 AS INT), 2))]# AS brier_home, #[avg(pow(p_draw - CAST(actual = 0 AS INT), 2))]# AS brier_draw, #[avg(pow(p_away - CAST(actual = -1 AS INT), 2))]# AS brier_away
FROM predictions GROUP BY 1""", "predictions")
def _(t):
    return r(M.brier(t.predictions, ["pool"]), "brier", "brier_home", "brier_draw", "brier_away")


@query("multiclass_logloss", f"SELECT pool, #[avg(-ln(greatest(1e-7, {PA})))]# AS log_loss FROM predictions GROUP BY 1", "predictions")
def _(t):
    return r(M.logloss(t.predictions, ["pool"]), "log_loss")


@query("accuracy", f"SELECT pool, #[avg(CAST(actual = {PICK} AS INT))]# AS accuracy, count(*) AS n FROM predictions GROUP BY 1", "predictions")
def _(t):
    return r(M.accuracy(t.predictions, ["pool"]), "accuracy")


def rel(p, y, bins, src="predictions", keys="", right=False):
    b = f"CAST(ceil({p} * {bins}) - 1 AS INT)" if right else f"CAST(least(floor({p} * {bins}), {bins - 1}) AS INT)"
    k = keys + ", " if keys else ""
    return f"(SELECT {k}{b} AS bin, count(*) AS n, avg({p}) AS pm, avg({y}) AS obs FROM {src} GROUP BY ALL)"


def ece_sql(table, min_n=1, keys=""):
    k = keys + ", " if keys else ""
    return f"SELECT {k}#[coalesce(sum(n * abs(pm - obs)) FILTER (n >= {min_n}), 0) / sum(n)]# AS ece, #[coalesce(max(abs(pm - obs)) FILTER (n >= {min_n}), 0)]# AS mce FROM {table}" + (f" GROUP BY {keys}" if keys else "")


def y(v):
    return f"CAST(actual = {v} AS INT)"


_STACK = "(SELECT pool, p_home AS p, CAST(actual = 1 AS INT) AS o FROM predictions UNION ALL SELECT pool, p_away, CAST(actual = -1 AS INT) FROM predictions)"


@query("ece_mce_outcome", " UNION ALL ".join(
    [f"SELECT '{n}' AS outcome, * FROM ({ece_sql(rel(p, y(v), 10, keys='pool'), 3, 'pool')})" for n, p, v in (("home", "p_home", 1), ("draw", "p_draw", 0), ("away", "p_away", -1))]
    + [f"SELECT 'any_win', * FROM ({ece_sql(rel('p', 'o', 10, _STACK, 'pool'), 3, 'pool')})"]), "predictions")
def _(t):
    from functools import reduce

    parts = [M.ece_outcome(t.predictions, o, keys=["pool"]).withColumn("outcome", F.lit(o)) for o in ("home", "draw", "away", "any_win")]
    return r(reduce(lambda a, b: a.unionByName(b), parts), "ece", "mce")


@query("ece_top_confidence", ece_sql(rel("greatest(p_home, p_draw, p_away)", f"CAST(actual = {PICK} AS INT)", 10, keys="pool", right=True), keys="pool"), "predictions")
def _(t):
    return r(M.ece_top(t.predictions, keys=["pool"]), "ece", "mce")


@query("ece_home_digitize", ece_sql(rel("p_home", y(1), 10, keys="pool"), keys="pool"), "predictions")
def _(t):
    return r(M.ece_home(t.predictions, keys=["pool"]), "ece", "mce")


@query("calibration_curve_slope", f"SELECT pool, #[regr_slope(obs, pm)]# AS slope, #[regr_intercept(obs, pm)]# AS intercept, count(*) AS n_bins FROM {rel('p_draw', y(0), 15, keys='pool')} GROUP BY 1 HAVING count(*) >= 2", "predictions")
def _(t):
    return r(M.curve_slope(M.calibration_curve(t.predictions, 0, 15, ["pool"]), ["pool"]), "slope", "intercept")


@query("reliability_table", f"SELECT pool, bin, n, #[pm]# AS pred_mean, #[obs]# AS obs_rate FROM {rel('p_draw', y(0), 15, keys='pool')}", "predictions")
def _(t):
    return r(M.calibration_curve(t.predictions, 0, 15, ["pool"]), "pred_mean", "obs_rate")


_LOGIT = newton_sql("fit", "(SELECT actual, greatest(1e-6, least(1 - 1e-6, p_home)) AS q FROM predictions)", ["ln(q / (1 - q))"], "CAST(actual = 1 AS INT)", "logistic")


@query("calibration_slope_logit", f"WITH {_LOGIT} SELECT #4[b1]# AS slope, #4[b0]# AS intercept FROM fit", "predictions", recursive=True)
def _(t):
    return r(M.calibration_logit(t.predictions), "slope", "intercept", digits=4)


@query("rolling_calibration_slope", f"""
SELECT pool, #[s]# AS slope, n_bins, n, s BETWEEN 0.95 AND 1.05 AS ok FROM (SELECT pool, regr_slope(obs, pm) AS s, count(*) AS n_bins, CAST(sum(n) AS BIGINT) AS n FROM
{rel('p_home', y(1), 4, "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY kickoff_ts DESC, match_id DESC) AS rn FROM predictions) WHERE rn <= 1000)", 'pool')} GROUP BY 1) WHERE n_bins >= 3 AND n >= 20""", "predictions")
def _(t):
    last = W.newest(t.predictions, ["pool"], W.ORDER, 1000)
    return r(M.rolling_calibration_slope(last, F.col("p_home"), M._is(1), ["pool"]), "slope")


_UPSET = "least(p_home, p_away) < 0.35 AND greatest(p_home, p_away) >= 0.65 AND coalesce(CASE actual WHEN 1 THEN p_home WHEN -1 THEN p_away END < 0.35, FALSE)"


@query("upset_rates", f"""
SELECT pool, nc AS n_clear, nu AS n_upset, nd AS n_detected, #[nu / nc * 100]# AS upset_rate, #[CASE WHEN nu > 0 THEN nd / nu * 100 ELSE 0 END]# AS upset_detect_rate FROM (
  SELECT pool, count(*) FILTER (least(p_home, p_away) < 0.35) AS nc, count(*) FILTER ({_UPSET}) AS nu, count(*) FILTER ({_UPSET} AND least(p_home, p_away) >= 0.20) AS nd FROM predictions GROUP BY 1)""", "predictions")
def _(t):
    return r(M.upset_rates(t.predictions, ["pool"]), "upset_rate", "upset_detect_rate")


CAL_SQL = "cal AS (SELECT *, " + ", ".join(f"pow({p}, 1 / 0.8) / (pow(p_home, 1 / 0.8) + pow(p_draw, 1 / 0.8) + pow(p_away, 1 / 0.8)) AS cal_{p}" for p in P3) + " FROM predictions)"


@query("confidence_buckets", f"""WITH {CAL_SQL}
SELECT bucket, count(*) AS n, #[avg(raw)]# AS avg_raw, #[avg(cal)]# AS avg_cal, #[avg(o)]# AS actual_rate, #[avg(raw) - avg(o)]# AS raw_gap, #[avg(cal) - avg(o)]# AS cal_gap FROM (
  SELECT b AS bucket, CASE WHEN p_home > t THEN p_home ELSE p_away END AS raw, CASE WHEN p_home > t THEN cal_p_home ELSE cal_p_away END AS cal, CASE WHEN p_home > t THEN {y(1)} ELSE {y(-1)} END AS o
  FROM cal, (VALUES ('fav_70', 0.7), ('fav_80', 0.8)) v(b, t) WHERE p_home > t OR p_away > t
  UNION ALL SELECT 'under_25', p_home, cal_p_home, {y(1)} FROM cal WHERE p_home < 0.25 UNION ALL SELECT 'under_25', p_away, cal_p_away, {y(-1)} FROM cal WHERE p_away < 0.25) GROUP BY 1""", "predictions")
def _(t):
    return r(M.confidence_buckets(S.temper(t.predictions, 0.8, out="cal_")), "avg_raw", "avg_cal", "actual_rate", "raw_gap", "cal_gap")


@query("draw_calibration", f"WITH {CAL_SQL} SELECT 'raw' AS kind, * FROM ({ece_sql(rel('p_draw', y(0), 10, 'cal'), 3)}) UNION ALL SELECT 'cal', * FROM ({ece_sql(rel('cal_p_draw', y(0), 10, 'cal'), 3)})", "predictions")
def _(t):
    return r(M.draw_calibration(S.temper(t.predictions, 0.8, out="cal_")), "ece", "mce")


def metric_set_sql(src, keys, min_n=1):
    k = keys + ", " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}CAST(sum(n) AS BIGINT) AS n_matches, #4[sum(b) / sum(n)]# AS brier, #4[sum(l) / sum(n)]# AS log_loss, #2[sum(h) / sum(n) * 100]# AS accuracy,
  #2[sum(nu) / nullif(sum(nc), 0) * 100]# AS upset_rate, #2[CASE WHEN sum(nu) > 0 THEN sum(nd) / sum(nu) * 100 WHEN sum(nc) > 0 THEN 0 END]# AS upset_detect_rate, #4[coalesce(sum(abs(p - o)) FILTER (n >= 3), 0) / sum(n)]# AS ece FROM (
  SELECT {k}least(floor(p_home * 10), 9) AS bin, count(*) AS n, sum({BR}) AS b, sum(-ln(greatest(1e-7, {PA}))) AS l, sum(CAST(actual = {PICK} AS INT)) AS h, sum(p_home) AS p, sum({y(1)}) AS o,
    count(*) FILTER (least(p_home, p_away) < 0.35) AS nc, count(*) FILTER ({_UPSET}) AS nu, count(*) FILTER ({_UPSET} AND least(p_home, p_away) >= 0.20) AS nd FROM {src} GROUP BY ALL) {g} HAVING sum(n) >= {min_n}"""


@query("metrics_by_slice", metric_set_sql("(SELECT *, tournament AS slice FROM predictions)", "slice", 20), "predictions")
def _(t):
    return M.metrics_by(t.predictions, {"slice": F.col("tournament")})


@query("metric_set", metric_set_sql("predictions", ""), "predictions")
def _(t):
    return M.metric_set(t.predictions)


@query("confusion_matrix", "SELECT actual, " + ", ".join(f"count(*) FILTER ({PICK} = {v}) AS pred_{n}" for v, n in M.NAMES.items()) + " FROM predictions GROUP BY 1", "predictions")
def _(t):
    return M.confusion_matrix(t.predictions)


@query("per_class_prf", f"""
SELECT cls, support, #[p]# AS precision, #[rc]# AS recall, #[coalesce(2 * p * rc / nullif(p + rc, 0), 0)]# AS f1 FROM (
  SELECT cls, count(*) FILTER (actual = cls) AS support, coalesce(count(*) FILTER (actual = cls AND pk = cls) / nullif(count(*) FILTER (pk = cls), 0), 0) AS p,
    coalesce(count(*) FILTER (actual = cls AND pk = cls) / nullif(count(*) FILTER (actual = cls), 0), 0) AS rc FROM (SELECT actual, {PICK} AS pk FROM predictions), (VALUES (1), (0), (-1)) v(cls) GROUP BY 1)""", "predictions")
def _(t):
    return r(M.per_class_prf(t.predictions), "precision", "recall", "f1")


def _br(prefix):
    return f"(pow({prefix}p_home - {y(1)}, 2) + pow({prefix}p_draw - {y(0)}, 2) + pow({prefix}p_away - {y(-1)}, 2))"


@query("brier_uplift", f"WITH {CAL_SQL} SELECT pool, #[avg({BR})]# AS brier_base, #[avg({_br('cal_')})]# AS brier_adjusted, #[avg({BR}) - avg({_br('cal_')})]# AS uplift FROM cal GROUP BY 1", "predictions")
def _(t):
    return r(M.brier_uplift(S.temper(t.predictions, 0.8, out="cal_"), "", "cal_", ["pool"]), "brier_base", "brier_adjusted", "uplift")


@query("prob_compression_profile", """
SELECT #[avg(d)]# AS mean, #[stddev_pop(d)]# AS std, #[min(d)]# AS min, #[max(d)]# AS max, #[avg(CAST(actual = 0 AS INT))]# AS draw_rate, #[avg(CAST(d BETWEEN 0.10 AND 0.20 AS INT))]# AS density_10_20, #[avg(CAST(d BETWEEN 0.20 AND 0.35 AS INT))]# AS density_20_35,
  #[avg(CAST(d > 0.35 AS INT))]# AS density_35_plus, #[avg(m - d)]# AS gap_mean, #[avg(CAST(d > m AS INT))]# AS dominance_rate,
  """ + ", ".join(f"#[quantile_cont(d, {q})]# AS {n}" for n, q in M.PERCENTS.items()) + """,
  CASE WHEN stddev_pop(d) < 0.05 THEN 'NARROW_BELL' WHEN max(d) < 0.30 THEN 'TRUNCATED_TAIL' ELSE 'NORMAL' END AS pattern,
  CASE WHEN avg(m - d) > 0.15 AND avg(CAST(d > m AS INT)) < 0.02 THEN 'SEVERE_SUPPRESSION' WHEN avg(m - d) > 0.10 THEN 'MODERATE_SUPPRESSION' ELSE 'ACCEPTABLE' END AS suppression
FROM (SELECT p_draw AS d, greatest(p_home, p_away) AS m, actual FROM predictions)""", "predictions")
def _(t):
    out = M.draw_profile(t.predictions)
    return r(out, *[c for c in out.columns if c not in ("pattern", "suppression")])


@query("draw_slope_pattern", """
SELECT pool, #[s]# AS slope, CASE WHEN abs(s - 1) < 0.2 THEN 'LINEAR_COMPRESSION' WHEN s < 0.2 THEN 'COLLAPSE' WHEN s < 0.5 THEN 'S_SHAPED_FLATTENED' ELSE 'HIGH_VARIANCE' END AS pattern
FROM (SELECT pool, regr_slope(CAST(actual = 0 AS DOUBLE), p_draw) AS s FROM predictions GROUP BY 1)""", "predictions")
def _(t):
    drawn = F.when(F.col("actual") == 0, 1.0).otherwise(0.0)
    out = t.predictions.groupBy("pool").agg(F.regr_slope(drawn, F.col("p_draw")).alias("slope"))
    return r(out.withColumn("pattern", M.slope_pattern(F.col("slope"))), "slope")


@query("prob_integrity", """
SELECT pool, count(*) AS n, count(*) FILTER (abs(p_home * f + p_draw + p_away - 1) >= 1e-6) AS bad_sum, count(*) FILTER (p_home * f > 1) AS out_of_range,
  #[stddev_pop(p_home * f)]# AS std_home, #[stddev_pop(p_draw)]# AS std_draw, #[stddev_pop(p_away)]# AS std_away
FROM (SELECT *, CASE WHEN match_id % 31 = 0 THEN 2 ELSE 1 END AS f FROM predictions) GROUP BY 1""", "predictions")
def _(t):
    df = t.predictions.withColumn("p_home", F.col("p_home") * F.when(F.col("match_id") % 31 == 0, 2).otherwise(1))
    return r(M.prob_integrity(df, keys=["pool"]), "std_home", "std_draw", "std_away")
