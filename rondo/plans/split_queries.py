"""Registered queries: temporal splits, backtests, leakage control."""

from pyspark.sql import functions as F

from ..functions.expr import brier_row, rnd
from ..operators import metrics as M
from ..operators import rating as R
from ..operators import scoring as S
from ..operators import splits as SP
from .metric_queries import BR, PA, PICK, ece_sql, metric_set_sql, r, rel, y
from .rating_queries import CAP, PRED_SQL
from .fit_sql import newton_sql
from .registry import query

P3 = S.P3
RECORDS = f"{CAP}, {PRED_SQL}"


@query("temporal_split", """
SELECT pool, CASE WHEN kickoff_ts < TIMESTAMP '2024-01-18' THEN 'train' WHEN kickoff_ts < TIMESTAMP '2024-01-24' THEN 'val' ELSE 'test' END AS split, count(*) AS n, min(match_id) AS first_id FROM matches GROUP BY 1, 2""", "matches")
def _(t):
    return SP.temporal_split(t.matches, "kickoff_ts", "2024-01-18", "2024-01-24").groupBy("pool", "split").agg(F.count(F.lit(1)).alias("n"), F.min("match_id").alias("first_id"))


_ROLE = "SELECT fold, role, count(*) AS n, min(match_id) AS first_id, max(match_id) AS last_id FROM roles GROUP BY 1, 2"
_DAY = 86400000000


def _roles(df):
    return df.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("match_id").alias("first_id"), F.max("match_id").alias("last_id"))


@query("purged_expanding_cv", f"""
WITH b AS (SELECT min(epoch_us(kickoff_ts)) AS lo, ((max(epoch_us(kickoff_ts)) - min(epoch_us(kickoff_ts))) // {_DAY}) // 6 * {_DAY} AS sz FROM matches),
w AS (SELECT CAST(i AS INT) AS fold, lo + i * sz AS te, lo + i * sz + 3 * {_DAY} AS vs, lo + i * sz + 3 * {_DAY} + sz AS ve FROM b, range(1, 6) g(i)),
roles AS (SELECT fold, 'train' AS role, match_id FROM matches, w WHERE epoch_us(kickoff_ts) < te UNION ALL SELECT fold, 'val', match_id FROM matches, w WHERE epoch_us(kickoff_ts) >= vs AND epoch_us(kickoff_ts) < ve)
{_ROLE}""", "matches")
def _(t):
    return _roles(SP.purged_expanding_cv(t.matches.select("match_id", "kickoff_ts"), "kickoff_ts", 5, 3))


@query("purged_rolling_windows", f"""
WITH b AS (SELECT min(epoch_us(kickoff_ts)) // {_DAY} AS d, min(epoch_us(kickoff_ts)) AS lo, max(epoch_us(kickoff_ts)) AS hi FROM matches),
w AS (SELECT * FROM (SELECT CAST(i AS INT) AS fold, lo + (i - 1) * 6 * {_DAY} AS t0, hi FROM b, range(1, 6) g(i)) WHERE t0 + (6 + 1 + 3 + 1 + 3) * {_DAY} <= hi),
roles AS (SELECT fold, role, match_id FROM (SELECT fold, match_id, CASE WHEN o >= 0 AND o < 6 THEN 'train' WHEN o >= 7 AND o < 10 THEN 'val' WHEN o >= 11 AND o < 14 THEN 'test' END AS role
  FROM (SELECT fold, match_id, (epoch_us(kickoff_ts) - t0) / {_DAY} AS o FROM matches, w)) WHERE role IS NOT NULL)
{_ROLE}""", "matches")
def _(t):
    return _roles(SP.purged_rolling_windows(t.matches.select("match_id", "kickoff_ts"), "kickoff_ts", 5, 6, 3, 3, 1))


@query("walk_forward_years", """
SELECT CAST(y AS INT) AS fold, CASE WHEN year(o_orderdate) = y THEN 'test' ELSE 'train' END AS role, count(*) AS n, #2[sum(o_totalprice)]# AS total FROM orders, range(1996, 2001) g(y) WHERE year(o_orderdate) <= y GROUP BY 1, 2""")
def _(t):
    df = SP.walk_forward_years(t.orders.select("o_orderdate", "o_totalprice"), "o_orderdate", list(range(1996, 2001)))
    return df.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total"))


def records(t):
    return S.prequential_records(t.matches, R.TOURNAMENT_CAP)


@query("rolling_year_backtest", f"WITH {RECORDS}, rec AS (SELECT *, strftime(kickoff_ts, '%Y-%m-%d')[:9] AS period FROM pred) SELECT *, CAST(coalesce(sum(n_matches) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_train FROM ({metric_set_sql('rec', 'period')})", "matches", recursive=True)
def _(t):
    return SP.rolling_backtest(records(t), F.substring(F.date_format("kickoff_ts", "yyyy-MM-dd"), 1, 9))


@query("prequential_records", f"WITH {RECORDS} SELECT match_id, actual, #5[p_home]# AS p_home, #5[p_draw]# AS p_draw, #5[p_away]# AS p_away, #3[elo_diff]# AS elo_diff, 'elo' AS model_tag FROM pred", "matches", recursive=True)
def _(t):
    return records(t).select("match_id", "actual", *[rnd(p, 5).alias(p) for p in P3], rnd("elo_diff", 3).alias("elo_diff"), "model_tag")


_NORM8 = "(pow(p_home, 1 / {T}) + pow(p_draw, 1 / {T}) + pow(p_away, 1 / {T}))"


@query("calibrated_three_way_eval", f"""WITH {RECORDS},
nll AS (SELECT tt, avg(-ln(pow({PA}, 1 / tt) / {_NORM8.format(T='tt')})) AS l FROM pred, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9, 2.0]::DOUBLE[]) AS tt)
  WHERE kickoff_ts > TIMESTAMP '2024-01-12' AND kickoff_ts <= TIMESTAMP '2024-01-20' GROUP BY 1),
bt AS (SELECT arg_min(tt, l) AS tt FROM nll),
test AS (SELECT *, tt FROM pred, bt WHERE kickoff_ts > TIMESTAMP '2024-01-20' AND kickoff_ts <= TIMESTAMP '2024-01-29'),
long AS (SELECT 'raw' AS kind, actual, p_home, p_draw, p_away FROM test UNION ALL SELECT 'calibrated', actual, pow(p_home, 1 / tt) / {_NORM8.format(T='tt')}, pow(p_draw, 1 / tt) / {_NORM8.format(T='tt')}, pow(p_away, 1 / tt) / {_NORM8.format(T='tt')} FROM test),
stack AS (SELECT kind, p_home AS p, {y(1)} AS o FROM long UNION ALL SELECT kind, p_away, {y(-1)} FROM long)
SELECT m.* EXCLUDE (ece), e.ece, e.mce, #[(SELECT tt FROM bt)]# AS temperature FROM ({metric_set_sql('long', 'kind')}) m JOIN ({ece_sql(rel('p', 'o', 10, 'stack', 'kind'), 3, 'kind')}) e USING (kind)""", "matches", recursive=True)
def _(t):
    out = SP.calibrated_eval(records(t), "2024-01-12", "2024-01-20", "2024-01-29", [round(0.5 + 0.1 * i, 1) for i in range(16)])
    return r(out, "ece", "mce", "temperature")


_FIN = """fin AS (SELECT pool, team, arg_max(rt, rn) AS rating FROM (SELECT pool, home AS team, post_h AS rt, rn FROM elo UNION ALL SELECT pool, away, post_a, rn FROM elo) GROUP BY 1, 2)"""
_CAP_TRAIN = CAP.replace("FROM matches)", "FROM (SELECT * FROM matches WHERE kickoff_ts < TIMESTAMP '2024-01-20'))")


@query("frozen_rating_eval", f"""WITH {_CAP_TRAIN}, {_FIN},
p0 AS (SELECT m.*, 1 / (1 + pow(10, -(coalesce(h.rating, 1500) + CASE WHEN neutral THEN 0 ELSE 100 END - coalesce(a.rating, 1500)) / 400.0)) AS e, CAST(sign(home_score - away_score) AS INT) AS actual
  FROM matches m LEFT JOIN fin h ON m.pool = h.pool AND m.home = h.team LEFT JOIN fin a ON m.pool = a.pool AND m.away = a.team WHERE kickoff_ts >= TIMESTAMP '2024-01-20' AND kickoff_ts < TIMESTAMP '2024-01-26'),
p1 AS (SELECT *, e * (1 - pd) AS p_home, pd AS p_draw, (1 - e) * (1 - pd) AS p_away FROM (SELECT *, greatest(0.08, least(0.30, 0.28 - 0.30 * abs(e - 0.5))) AS pd FROM p0))
SELECT pool, count(*) AS n, #[avg({BR})]# AS brier, #[avg(-ln({PA}))]# AS log_loss, #[avg(CAST(actual = {PICK} AS INT))]# AS accuracy FROM p1 GROUP BY 1""", "matches", recursive=True)
def _(t):
    from ..functions.expr import hit, logloss_row

    out = SP.frozen_eval(t.matches, "2024-01-20", "2024-01-26", R.TOURNAMENT_CAP)
    return out.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(brier_row())).alias("brier"), rnd(F.avg(logloss_row())).alias("log_loss"), rnd(F.avg(hit())).alias("accuracy"))


@query("elo_year_accuracy", f"""WITH {RECORDS}
SELECT period, #[avg(CAST(actual = CASE WHEN e >= 0.5 THEN 1 WHEN e <= 0.35 THEN -1 ELSE 0 END AS INT))]# AS accuracy, count(*) AS n FROM (SELECT *, strftime(kickoff_ts, '%Y-%m-%d')[:9] AS period FROM pred) GROUP BY 1""", "matches", recursive=True)
def _(t):
    return r(SP.elo_accuracy(t.matches, F.substring(F.date_format("kickoff_ts", "yyyy-MM-dd"), 1, 9), R.TOURNAMENT_CAP), "accuracy")


@query("era_breakdown", f"""
SELECT *, #[max(accuracy) OVER () - min(accuracy) OVER ()]# AS accuracy_drift, #[max(log_loss) OVER () - min(log_loss) OVER ()]# AS log_loss_drift, #[max(brier) OVER () - min(brier) OVER ()]# AS brier_drift FROM (
  SELECT era, count(*) AS n, #8[avg(CAST(actual = {PICK} AS INT))]# AS accuracy, #8[avg(-ln({PA}))]# AS log_loss, #8[avg({BR})]# AS brier FROM (
    SELECT *, CASE WHEN kickoff_ts < TIMESTAMP '2024-01-10' THEN 'early' WHEN kickoff_ts < TIMESTAMP '2024-01-20' THEN 'middle' ELSE 'late' END AS era FROM predictions) GROUP BY 1)""", "predictions")
def _(t):
    out = SP.era_breakdown(t.predictions, [("early", "2024-01-01", "2024-01-09"), ("middle", "2024-01-10", "2024-01-19"), ("late", "2024-01-20", "2024-12-31")])
    return r(r(out, "accuracy", "log_loss", "brier", digits=8), "accuracy_drift", "log_loss_drift", "brier_drift")


@query("half_split_slope", f"""
WITH h AS (SELECT *, CASE WHEN epoch_us(kickoff_ts) < (SELECT quantile_cont(CAST(epoch_us(kickoff_ts) AS DOUBLE), 0.5) FROM predictions) THEN 'first' ELSE 'second' END AS half FROM predictions),
s AS (SELECT half, regr_slope(obs, pm) AS slope FROM {rel('p_home', y(1), 10, 'h', 'half')} GROUP BY 1)
SELECT #[a]# AS slope_first, #[b]# AS slope_second, #[abs(a - b)]# AS drift, CASE WHEN abs(a - b) > 0.1 THEN 'TEMPORAL_DRIFT' WHEN abs(a - b) < 0.05 THEN 'STABLE_INVERSION' ELSE 'MODERATE_DRIFT' END AS label FROM (SELECT max(slope) FILTER (half = 'first') AS a, max(slope) FILTER (half = 'second') AS b FROM s)""", "predictions")
def _(t):
    return r(SP.half_split_slope(t.predictions, outcome=1), "slope_first", "slope_second", "drift")


def _goals(t):
    """Goals of the home side with a base expectation and two features."""
    p = t.predictions.select("match_id", "kickoff_ts", (F.col("p_home") * 2 + 0.5).alias("lambda_home_base"), (F.col("rating_diff") / 400).alias("gap"))
    return p.join(t.matches.select("match_id", F.col("home_score").alias("goals_home"), F.col("neutral").cast("double").alias("on_neutral")), "match_id")


GOALS_SQL = """goals AS (SELECT p.match_id, p.kickoff_ts, p_home * 2 + 0.5 AS base, rating_diff / 400 AS gap, m.home_score AS y, CAST(m.neutral AS DOUBLE) AS on_neutral
  FROM predictions p JOIN (SELECT match_id, home_score, neutral FROM matches) m USING (match_id))"""
_FOLDS = f"""b AS (SELECT min(epoch_us(kickoff_ts)) AS lo, ((max(epoch_us(kickoff_ts)) - min(epoch_us(kickoff_ts))) // {_DAY}) // 6 * {_DAY} AS sz FROM goals),
w AS (SELECT CAST(i AS INT) AS fold, lo + i * sz AS te, lo + i * sz + 2 * {_DAY} AS vs, lo + i * sz + 2 * {_DAY} + sz AS ve FROM b, range(1, 6) g(i)),
train AS (SELECT fold, g.* FROM goals g, w WHERE epoch_us(kickoff_ts) < te), val AS (SELECT fold, g.* FROM goals g, w WHERE epoch_us(kickoff_ts) >= vs AND epoch_us(kickoff_ts) < ve)"""


def _folds_sql(fit: str, eta: str) -> str:
    """Errors of base and adjusted expectation per fold under the coefficients of ``fit``."""
    return f"(SELECT fold, avg(pow(y - base, 2)) AS mb, avg(pow(y - base * exp({eta}), 2)) AS ma, count(*) AS n FROM val JOIN {fit} ON key = fold GROUP BY fold)"


@query("backtest_uplift", f"""WITH {GOALS_SQL}, {_FOLDS}, {newton_sql('fit', 'train', ['gap', 'on_neutral'], 'y', 'poisson', 'ln(base)', 'fold')}
SELECT fold, #4[mb]# AS mse_base, #4[ma]# AS mse_adjusted, n, #4[mb - ma]# AS improvement FROM {_folds_sql('fit', 'b0 + b1 * gap + b2 * on_neutral')}""", "predictions matches", recursive=True)
def _(t):
    return r(SP.backtest_uplift(_goals(t), ["gap", "on_neutral"], k=5, embargo_days=2), "mse_base", "mse_adjusted", "improvement", digits=4)


_GROUP_SQL = "SELECT '{g}' AS feature_group, #4[avg(mb - ma)]# AS mean_improvement, count(*) AS folds, CASE WHEN avg(mb - ma) >= 0.005 THEN 'PASS' ELSE 'FAIL' END AS status FROM {t}"


@query("feature_group_ablation", f"""WITH {GOALS_SQL}, {_FOLDS}, {newton_sql('f1', 'train', ['gap'], 'y', 'poisson', 'ln(base)', 'fold')}, {newton_sql('f2', 'train', ['on_neutral'], 'y', 'poisson', 'ln(base)', 'fold')}
{_GROUP_SQL.format(g='gap', t=_folds_sql('f1', 'b0 + b1 * gap'))} UNION ALL {_GROUP_SQL.format(g='venue', t=_folds_sql('f2', 'b0 + b1 * on_neutral'))}""", "predictions matches", recursive=True)
def _(t):
    out = SP.feature_group_ablation(_goals(t), {"gap": ["gap"], "venue": ["on_neutral"]}, k=5, embargo_days=2)
    return r(out, "mean_improvement", digits=4)


_VAR = """v AS (SELECT 'full' AS variant, actual, p_home, p_draw, p_away FROM predictions UNION ALL SELECT 'no_draw_model', actual, p_home / (p_home + p_away) * 0.75, 0.25, p_away / (p_home + p_away) * 0.75 FROM predictions
UNION ALL SELECT 'no_rating', actual, 0.45, 0.25, 0.30 FROM predictions)"""


@query("component_ablation", f"""WITH {_VAR}, m AS (SELECT variant, avg(CAST(actual = {PICK} AS INT)) AS a, avg(-ln({PA})) AS l, avg({BR}) AS b FROM v GROUP BY 1)
SELECT m.variant, #[m.a - f.a]# AS d_accuracy, #[m.l - f.l]# AS d_log_loss, #[m.b - f.b]# AS d_brier, CASE WHEN m.a - f.a < -0.01 THEN 'DEGRADA' WHEN m.a - f.a > 0.01 THEN 'MEJORA' ELSE 'NEUTRO' END AS label
FROM m, (SELECT * FROM m WHERE variant = 'full') f WHERE m.variant <> 'full'""", "predictions")
def _(t):
    h, a = F.col("p_home"), F.col("p_away")
    sets = [("full", h, F.col("p_draw"), a), ("no_draw_model", h / (h + a) * 0.75, F.lit(0.25), a / (h + a) * 0.75), ("no_rating", F.lit(0.45), F.lit(0.25), F.lit(0.30))]
    arr = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), *[c.alias(p) for p, c in zip(P3, cs)]) for n, *cs in sets])).alias("s")
    out = SP.component_ablation(t.predictions.select("actual", arr).select("actual", "s.*"))
    return r(out, "d_accuracy", "d_log_loss", "d_brier")


@query("go_no_go_summary", f"""
SELECT #[avg(i)]# AS mean_improvement, #[stddev_samp(i)]# AS std_improvement, count(*) AS folds, CASE WHEN avg(i) >= 0.005 THEN 'GO' ELSE 'NO-GO' END AS decision FROM (SELECT CAST(kickoff_ts AS DATE) AS d, avg(2.0/3 - {BR}) AS i FROM predictions GROUP BY 1)""", "predictions")
def _(t):
    it = t.predictions.groupBy(F.to_date("kickoff_ts").alias("fold")).agg(F.avg(2.0 / 3 - brier_row()).alias("improvement"))
    return r(SP.go_no_go(it), "mean_improvement", "std_improvement")


@query("cv_stability_summary", f"""
WITH p AS (SELECT *, strftime(kickoff_ts, '%Y-%m-%d') AS d FROM predictions), s AS (SELECT d, regr_slope(obs, pm) AS slope FROM {rel('p_home', y(1), 10, 'p', 'd')} GROUP BY 1 HAVING count(*) >= 2),
w AS (SELECT d, avg(CAST(actual = {PICK} AS INT)) AS a, avg(-ln({PA})) AS l, any_value(slope) AS s FROM p JOIN s USING (d) GROUP BY 1)
SELECT count(*) AS n_windows, #[avg(a)]# AS avg_accuracy, #[avg(l)]# AS avg_logloss, #[avg(s)]# AS avg_draw_slope, #[stddev_pop(s)]# AS draw_slope_std, count(*) FILTER (s < 0) AS inverted_windows,
  CASE WHEN count(*) FILTER (s < 0) = 0 AND stddev_pop(s) < 0.05 THEN 'STABLE_CALIBRATION' WHEN count(*) FILTER (s < 0) > count(*) / 2 THEN 'SYSTEMATIC_INVERSION' WHEN stddev_pop(s) > 0.1 THEN 'HIGH_INSTABILITY' ELSE 'MODERATE_INSTABILITY' END AS recommendation FROM w""", "predictions")
def _(t):
    from ..functions.expr import hit, logloss_row

    p = t.predictions.withColumn("d", F.to_date("kickoff_ts"))
    slope = M.curve_slope(M.calibration_curve(p, 1, 10, ["d"]), ["d"]).select("d", F.col("slope").alias("draw_slope"))
    w = p.groupBy("d").agg(F.avg(hit()).alias("accuracy"), F.avg(logloss_row()).alias("log_loss")).join(slope, "d")
    return r(SP.cv_summary(w), "avg_accuracy", "avg_logloss", "avg_draw_slope", "draw_slope_std")


@query("leakage_audit", """
SELECT count(*) AS n, count(*) FILTER (f >= k) AS violations, #[min(epoch_us(k) - epoch_us(f)) / 3600e6]# AS min_lead_hours, #[avg(epoch_us(k) - epoch_us(f)) / 3600e6]# AS avg_lead_hours, #[max(epoch_us(k) - epoch_us(f)) / 3600e6]# AS max_lead_hours,
  count(*) FILTER (f >= k) = 0 AS is_valid FROM (SELECT o_orderdate + INTERVAL 30 DAY AS k, l_shipdate AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def _(t):
    df = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("kickoff_ts"), F.col("l_shipdate").alias("feature_ts"))
    return r(SP.leakage_audit(df), "min_lead_hours", "avg_lead_hours", "max_lead_hours")


@query("split_order_check", "SELECT TRUE AS ok, strftime(max(kickoff_ts) FILTER (kickoff_ts < TIMESTAMP '2024-01-18'), '%Y-%m-%d %H:%M') AS train_max, strftime(min(kickoff_ts) FILTER (kickoff_ts >= TIMESTAMP '2024-01-24'), '%Y-%m-%d %H:%M') AS test_min FROM matches", "matches")
def _(t):
    out = SP.split_order_check(SP.temporal_split(t.matches, "kickoff_ts", "2024-01-18", "2024-01-24"))
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return out.select("ok", fmt("train_max"), fmt("test_min"))
