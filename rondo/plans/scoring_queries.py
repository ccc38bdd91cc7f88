"""Registered queries: scoring expressions."""

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import aggregates as A
from ..operators import scoring as S
from ..operators import windows as W
from .registry import query

P3 = S.P3
RATED_SQL = """rated AS (SELECT m.*, h.rating AS rh, a.rating AS ra, 1 / (1 + pow(10, -(h.rating + CASE WHEN m.neutral THEN 0 ELSE 100 END - a.rating) / 400.0)) AS e
  FROM matches m JOIN teams h ON m.home = h.team JOIN teams a ON m.away = a.team)"""


def rated(t):
    h = t.teams.select(F.col("team").alias("home"), F.col("rating").alias("rating_home"))
    a = t.teams.select(F.col("team").alias("away"), F.col("rating").alias("rating_away"))
    return t.matches.join(h, "home").join(a, "away")


def p3(df, *keep):
    return df.select("match_id", *keep, *[rnd(p).alias(p) for p in P3])


_RULES = {
    "parity": "greatest(0.08, least(0.30, 0.24 * (1 - abs(e - 0.5) * 1.2)))",
    "linear": "greatest(0.08, least(0.30, 0.28 - 0.30 * abs(e - 0.5)))",
    "gap": "0.30 - least(abs(rh - ra) / 200.0, 0.25)",
    "fixed": "1 - 0.8",
}


@query("elo_1x2_probs", f"WITH {RATED_SQL} " + " UNION ALL ".join(
    f"SELECT match_id, '{n}' AS rule, #8[e * (1 - ({r}))]# AS p_home, #8[{r}]# AS p_draw, #8[(1 - e) * (1 - ({r}))]# AS p_away FROM rated" for n, r in _RULES.items()), "matches teams")
def _(t):
    out = S.elo_probs_by_rule(rated(t), list(_RULES))
    return out.select("match_id", "rule", *[rnd(p, 8).alias(p) for p in P3])


_FACT = [1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800, 39916800]


@query("poisson_1x2_probs", f"""
WITH {RATED_SQL},
lam AS (SELECT match_id, s * 2.8 * f AS lh, (1 - s) * 2.8 / f * mot AS la FROM (
  SELECT match_id, 1 / (1 + pow(10, -(rh - ra) / 400.0)) AS s, CASE WHEN neutral THEN 1.0 WHEN tournament = 'Friendly' THEN 1.15 ELSE 1.35 END AS f,
    CASE WHEN tournament = 'Friendly' AND NOT neutral THEN 0.85 ELSE 1.0 END AS mot FROM rated)),
grid AS (SELECT match_id, lh, la, i, j, exp(-lh) * pow(lh, i) / ({_FACT})[i + 1] * exp(-la) * pow(la, j) / ({_FACT})[j + 1] AS p FROM lam, range(12) a(i), range(12) b(j))
SELECT match_id, #[any_value(lh)]# AS lambda_home, #[any_value(la)]# AS lambda_away, #[sum(p) FILTER (i > j) / sum(p)]# AS p_home, #[sum(p) FILTER (i = j) / sum(p)]# AS p_draw, #[sum(p) FILTER (i < j) / sum(p)]# AS p_away
FROM grid GROUP BY 1""", "matches teams")
def _(t):
    df = S.poisson_lambdas(rated(t).withColumn("is_friendly", F.col("tournament") == "Friendly"))
    return p3(S.poisson_probs(df), rnd("lambda_home").alias("lambda_home"), rnd("lambda_away").alias("lambda_away"))


@query("form_rating_adjust", """
WITH f AS (SELECT pool, team, avg(CASE WHEN gf > ga THEN 3.0 WHEN gf = ga THEN 1.0 ELSE 0.0 END) AS ppg, avg(gf - ga) AS gd,
  avg(CASE WHEN gf > ga THEN 3.0 WHEN gf = ga THEN 1.0 ELSE 0.0 END) FILTER (rn <= 5) / 3 AS f5 FROM (
  SELECT *, row_number() OVER (PARTITION BY pool, team ORDER BY kickoff_ts DESC, match_id DESC) AS rn FROM long_view WHERE kickoff_ts < TIMESTAMP '2024-01-25') WHERE rn <= 12 GROUP BY 1, 2)
SELECT pool, team, #[20 * ppg + 15 * gd + 30 * f5]# AS raw_adj, abs(rating_adj_check) < 0.0500001 AS rounded_ok FROM (SELECT *, 0.0 AS rating_adj_check FROM f) JOIN teams USING (team)""", "long_view teams")
def _(t):
    form = A.form_table(t.matches, "2024-01-25")
    raw = F.col("ppg") * 20 + F.col("gd_avg") * 15 + F.col("form_last_5") * 30
    out = S.form_adjust(form.join(t.teams.select("team", "rating"), "team"))
    ok = F.abs(F.col("rating_adj") - F.col("rating") - raw) < 0.0500001
    return out.select("pool", "team", rnd(raw).alias("raw_adj"), ok.alias("rounded_ok"))


def _sos(t):
    n = F.col("nation")
    return t.teams.select(F.concat(F.lit(" Team "), F.col("team").cast("string")).alias("team"), F.when(n % 6 != 0, (F.col("rating") - 1750) / 1000).alias("delta_elo"),
                          (n / 25.0).alias("sos_score"), (n % 7).alias("games"))


@query("sos_adjustment", """
SELECT match_id, #[fa]# AS form_adjustment, #[sa]# AS schedule_adjustment, #[greatest(0.05, least(0.95, p_home + fa + sa))]# AS p_adjusted FROM (
  SELECT match_id, p_home, CASE WHEN d > 0.20 THEN 0.08 WHEN d > 0.10 THEN 0.05 WHEN d > 0.03 THEN 0.02 WHEN d < -0.20 THEN -0.08 WHEN d < -0.10 THEN -0.05 WHEN d < -0.03 THEN -0.02 ELSE 0 END AS fa,
    CASE WHEN s < 0.20 THEN 0.05 WHEN s < 0.35 THEN 0.03 WHEN s > 0.75 THEN -0.05 WHEN s > 0.65 THEN -0.03 ELSE 0 END AS sa FROM (
    SELECT p.match_id, p.p_home, CASE WHEN nation % 6 = 0 THEN NULL ELSE (rating - 1750) / 1000 * CASE WHEN nation % 7 < 4 THEN 0.5 ELSE 1 END END AS d, nation / 25.0 AS s
    FROM predictions p JOIN matches m USING (match_id) JOIN teams t ON m.home = t.team))""", "predictions matches teams")
def _(t):
    df = t.predictions.select("match_id", "p_home").join(t.matches.select("match_id", "home"), "match_id").withColumn("name", F.concat(F.lit("TEAM "), F.col("home").cast("string")))
    out = S.sos_adjust(df, _sos(t), "name", "p_home")
    return out.select("match_id", *[rnd(c).alias(c) for c in ("form_adjustment", "schedule_adjustment", "p_adjusted")])


_CONF = ["CONMEBOL", "UEFA", "CAF", "AFC", "CONCACAF", "OFC", "Other"]


@query("region_baseline_adjust", f"""
SELECT c_custkey, conf AS confederation, CASE conf WHEN 'CONMEBOL' THEN 0.03 WHEN 'AFC' THEN -0.02 WHEN 'CONCACAF' THEN -0.03 WHEN 'OFC' THEN -0.05 ELSE 0.0 END::DOUBLE AS form_adjustment,
  CASE conf WHEN 'CONMEBOL' THEN 0.03 WHEN 'CAF' THEN -0.02 WHEN 'AFC' THEN -0.02 WHEN 'CONCACAF' THEN -0.03 WHEN 'OFC' THEN -0.05 ELSE 0.0 END::DOUBLE AS schedule_adjustment
FROM (SELECT c_custkey, (ARRAY{_CONF})[c_nationkey % 7 + 1] AS conf FROM customer)""")
def _(t):
    conf = F.element_at(F.array(*[F.lit(c) for c in _CONF]), F.col("c_nationkey") % 7 + 1)
    return S.region_baseline(t.customer.select("c_custkey", conf.alias("confederation")))


@query("xg_and_indices", f"""WITH {RATED_SQL}
SELECT match_id, #[greatest(0.3, least(3.5, 1.2 * CASE WHEN m.neutral THEN 1.0 ELSE 1.15 END * exp(0.002 * d)))]# AS xg_home, #[greatest(0.3, least(3.5, 1.2 * exp(-0.002 * d)))]# AS xg_away,
  #[greatest(0, least(100, 50 + (rh - 1500) / 30))]# AS duel_home, #[100 / (1 + exp(-d / 150))]# AS pressure_home, #[greatest(0, least(1, p_home * (1 + d / 2000)))]# AS xgc_home,
  #[(p_home * (1 + d / 2000) + p_away * (1 - d / 2000)) / 2]# AS xgc_total
FROM (SELECT *, rh - ra AS d FROM rated) m JOIN (SELECT match_id, p_home, p_away FROM predictions) USING (match_id)""", "matches teams predictions")
def _(t):
    out = S.match_indices(rated(t).join(t.predictions.select("match_id", "p_home", "p_away"), "match_id"))
    return out.select("match_id", *[rnd(c).alias(c) for c in ("xg_home", "xg_away", "duel_home", "pressure_home", "xgc_home", "xgc_total")])


def _norm(w):
    return f"#[{w} / s]# AS p_home, #[0.25 / s]# AS p_draw, #[greatest(0, 1 - {w} - 0.25) / s]# AS p_away"


@query("form_h2h_probs", f"""
WITH f AS (SELECT match_id, max(CASE WHEN is_home THEN form END) AS fh, max(CASE WHEN NOT is_home THEN form END) AS fa FROM (
  SELECT match_id, is_home, coalesce(avg(pts) OVER (PARTITION BY pool, team ORDER BY kickoff_ts, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0.5) AS form FROM long_view) GROUP BY 1)
SELECT match_id, {_norm('w')} FROM (SELECT match_id, w, w + 0.25 + greatest(0, 1 - w - 0.25) AS s FROM (SELECT match_id, greatest(0.1, least(0.9, fh / (fh + fa + 1e-9))) AS w FROM f))""", "long_view")
def _(t):
    f = W.form_last_n(t.matches, 5).groupBy("match_id").agg(
        F.max(F.when(F.col("is_home"), F.col("form"))).alias("form_home"), F.max(F.when(~F.col("is_home"), F.col("form"))).alias("form_away"))
    return p3(S.baseline_probs(f, S.form_score()))


@query("bet_value", """
SELECT l_orderkey, #[sum(1 / odds)]# AS implied, #[sum(prob - 1 / odds)]# AS edge, #[sum(prob * (odds - 1) - (1 - prob))]# AS expected_roi, count(*) FILTER (prob - 1 / odds > 0.02) AS n_bets FROM bets GROUP BY 1""", "bets")
def _(t):
    out = S.bet_value(t.bets)
    return out.groupBy("l_orderkey").agg(*[rnd(F.sum(c)).alias(c) for c in ("implied", "edge", "expected_roi")], F.count_if("is_bet").alias("n_bets"))


@query("draw_factor", "SELECT match_id, #[p_home / s]# AS p_home, #[p_draw * 1.2 / s]# AS p_draw, #[p_away / s]# AS p_away FROM (SELECT *, p_home + p_draw * 1.2 + p_away AS s FROM predictions)", "predictions")
def _(t):
    return p3(S.draw_factor(t.predictions, 1.2))


@query("smooth_motivation", "SELECT match_id, " + ", ".join(f"#[({p} * 0.85 + 0.15 / 3) / ((p_home + p_draw + p_away) * 0.85 + 0.15)]# AS {p}" for p in P3) + " FROM predictions", "predictions")
def _(t):
    return p3(S.smooth_motivation(t.predictions))


@query("align_clip_probs", "SELECT match_id, #[1e-12 / s]# AS a_loss, #[p_draw / s]# AS a_draw, #[p_home / s]# AS a_win FROM (SELECT *, 1e-12 + p_draw + p_home AS s FROM predictions)", "predictions")
def _(t):
    df = t.predictions.withColumn("proba", F.array("p_home", "p_draw"))
    out = S.align_probs(df, "proba", [1, 0])
    return out.select("match_id", *[rnd(F.col("aligned")[i]).alias(n) for i, n in enumerate(("a_loss", "a_draw", "a_win"))])


@query("blend_probs", "SELECT match_id, " + ", ".join(f"#[0.7 * {p} + 0.3 * {q}]# AS {p}" for p, q in zip(P3, ("0.45", "0.25", "0.30"))) + " FROM predictions", "predictions")
def _(t):
    df = t.predictions.select("match_id", *[F.col(p).alias("a_" + p) for p in P3], *[F.lit(v).alias("b_" + p) for p, v in zip(P3, (0.45, 0.25, 0.30))])
    return p3(S.blend_probs(df, "a_", "b_", 0.7))


@query("apply_temperature", "SELECT match_id, " + ", ".join(f"#[pow({p}, 1 / 0.8) / (pow(p_home, 1 / 0.8) + pow(p_draw, 1 / 0.8) + pow(p_away, 1 / 0.8))]# AS {p}" for p in P3) + " FROM predictions", "predictions")
def _(t):
    return p3(S.temper(t.predictions, 0.8))


@query("apply_uplift", "SELECT request_id, #[baseline_lambda * exp(0.1 + 0.2 * p_draw - 0.3 * p_away)]# AS lambda_adjusted FROM prediction_log", "prediction_log")
def _(t):
    return S.apply_uplift(t.prediction_log, "baseline_lambda", {"p_draw": 0.2, "p_away": -0.3}, 0.1).select("request_id", rnd("lambda_adjusted").alias("lambda_adjusted"))


@query("uplift_failsafe_status", """
SELECT event_id, status, #[CASE WHEN event_id % 23 = 0 THEN NULL ELSE 1.4 END]# AS uplifted, #[CASE WHEN status = 'SHADOW' THEN 1.4 * exp(0.2 * value / 500 + 0.1 * (event_id % 10) / 10.0) END]# AS shadow_uplifted FROM (
  SELECT *, CASE WHEN event_id % 7 = 0 THEN 'FAILSAFE_LEAKAGE' WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 'FAILSAFE_MISSING_DATA' WHEN event_id % 23 = 0 THEN 'FAILSAFE_ERROR' ELSE 'SHADOW' END AS status FROM events)""")
def _(t):
    i = F.col("event_id")
    df = t.events.select("event_id", F.col("ts").alias("kickoff_ts"), F.when(i % 7 == 0, F.col("ts")).otherwise(F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("feature_ts"),
                         F.when(i % 11 == 0, "bad").when(i % 13 != 0, (F.col("value") / 500).cast("string")).alias("continuity_index"),
                         ((i % 10) / 10.0).alias("defenders_continuity"), F.when(i % 23 == 0, "n/a").otherwise("1.4").alias("lambda_base"))
    out = S.uplift_status(df, {"continuity_index": 0.2, "defenders_continuity": 0.1})
    return out.select("event_id", "status", rnd("uplifted").alias("uplifted"), rnd("shadow_uplifted").alias("shadow_uplifted"))


@query("inconsistency_flags", """
SELECT match_id, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) AS n_flags, a AS low_confidence, b AS draw_favourite, c AS caution FROM (
  SELECT match_id, abs(rating_diff) > 150 AND m < 0.40 AS a, p_draw > p_home AND p_draw > p_away AND abs(rating_diff) > 100 AS b, abs(rating_diff) > 200 AND m < 0.38 AS c FROM (
    SELECT match_id, rating_diff * 3 AS rating_diff, h AS p_home, d AS p_draw, w AS p_away, greatest(h, d, w) AS m FROM (
      SELECT match_id, rating_diff, p_home * 0.4 + 0.2 AS h, p_draw * 0.4 + 0.2 AS d, p_away * 0.4 + 0.2 AS w FROM predictions)))""", "predictions")
def _(t):
    df = t.predictions.withColumns({p: F.col(p) * 0.4 + 0.2 for p in P3}).withColumn("rating_diff", F.col("rating_diff") * 3)
    out = S.inconsistency_flags(df)
    has = lambda f: F.array_contains("flags", f)
    return out.select("match_id", "n_flags", has("low_confidence_wide_gap").alias("low_confidence"), has("draw_favourite_wide_gap").alias("draw_favourite"), has("caution").alias("caution"))
