"""Registered queries: sequential ratings."""

from pyspark.sql import functions as F

from ..functions.expr import brier_row, hit, logloss_row, rnd
from ..operators import rating as R
from ..operators import scoring as S
from ..operators import windows as W
from .registry import query

_K_CASE = """CASE tournament WHEN 'FIFA World Cup' THEN 60 WHEN 'FIFA World Cup qualification' THEN 50 WHEN 'UEFA Nations League' THEN 38
 WHEN 'Copa America' THEN 45 WHEN 'Friendly' THEN 25 ELSE 35 END"""
_M = "abs(home_score - away_score)"
_FLAG = "CASE WHEN neutral THEN 0.0 ELSE {b} END"


def fold_sql(k: str, bonus: str, extra: str = "0.0", draws: str = "0.5", pool: str = "pool", init: str | None = None, source: str = "matches", name: str = "elo") -> str:
    """CTE list that folds ``source`` match by match; state is one rating per team number."""
    init = init or "list_resize([1500.0::DOUBLE], 24, 1500.0::DOUBLE)"
    return f"""
{name}_seq AS MATERIALIZED (SELECT {pool} AS pool, match_id, kickoff_ts, home, away, home_score, away_score, row_number() OVER (PARTITION BY {pool} ORDER BY kickoff_ts, match_id) AS rn,
  CAST({k} AS DOUBLE) AS k, CAST({bonus} AS DOUBLE) AS bonus, CAST({extra} AS DOUBLE) AS extra,
  CASE WHEN home_score > away_score THEN 1.0 WHEN home_score < away_score THEN 0.0 ELSE {draws} END AS s FROM {source}),
{name}_fold AS (
  SELECT pool, 0::BIGINT AS rn, {init} AS st, NULL::BIGINT AS match_id, NULL::DOUBLE AS pre_h, NULL::DOUBLE AS pre_a, NULL::DOUBLE AS post_h, NULL::DOUBLE AS post_a
  FROM (SELECT DISTINCT pool FROM {name}_seq)
  UNION ALL
  SELECT pool, rn, list_transform(st, lambda x, i: CASE WHEN i = home + 1 THEN ph + d WHEN i = away + 1 THEN pa - d ELSE x END), match_id, ph, pa, ph + d, pa - d FROM (
    SELECT f.pool, q.rn, f.st, q.match_id, q.home, q.away, f.st[q.home + 1] AS ph, f.st[q.away + 1] AS pa,
      coalesce(q.k * (q.s - 1 / (1 + pow(10, -(f.st[q.home + 1] + q.bonus - f.st[q.away + 1]) / 400.0))) * (1 + q.extra), 0) AS d
    FROM {name}_fold f JOIN {name}_seq q ON q.pool = f.pool AND q.rn = f.rn + 1)),
{name} AS (SELECT f.pool, f.match_id, q.kickoff_ts, q.home, q.away, q.home_score, q.away_score, q.bonus, f.pre_h, f.pre_a, f.post_h, f.post_a, f.rn FROM {name}_fold f JOIN {name}_seq q ON f.pool = q.pool AND f.rn = q.rn)"""


CAP = fold_sql(f"({_K_CASE}) * least(1 + {_M} * 0.1, 2.0)", _FLAG.format(b=100.0))
_OUT = "SELECT pool, match_id, #3[pre_h]# AS pre_h, #3[pre_a]# AS pre_a, #3[post_h]# AS post_h, #3[post_a]# AS post_a FROM elo"
_COLS = ("pre_h", "pre_a", "post_h", "post_a")


def _fold(t, rules, **kw):
    return R.elo_fold(t.matches, rules, **kw).select("pool", "match_id", *[rnd(c, 3).alias(c) for c in _COLS])


@query("elo_fold", f"WITH {CAP} {_OUT}", "matches", recursive=True)
def _(t):
    return _fold(t, R.TOURNAMENT_CAP)


@query("elo_variant_margin_cap", f"WITH {CAP} SELECT pool, team, #3[rating]# AS rating FROM (SELECT pool, team, arg_max(r, rn) AS rating FROM (SELECT pool, home AS team, post_h AS r, rn FROM elo UNION ALL SELECT pool, away, post_a, rn FROM elo) GROUP BY 1, 2)", "matches", recursive=True)
def _(t):
    return R.final_ratings(R.elo_fold(t.matches, R.TOURNAMENT_CAP)).select("pool", "team", rnd("rating", 3).alias("rating"))


@query("elo_variant_constant_k", f"WITH {fold_sql('30', _FLAG.format(b=100.0))}, {fold_sql('32', '0', name='elo2')} SELECT 'constant_30' AS variant, * FROM ({_OUT}) UNION ALL SELECT 'constant_32', * FROM ({_OUT.replace('FROM elo', 'FROM elo2')})", "matches", recursive=True)
def _(t):
    out = R.elo_fold(t.matches, [R.CONSTANT_30, R.CONSTANT_32])
    return out.select("variant", "pool", "match_id", *[rnd(c, 3).alias(c) for c in _COLS])


@query("elo_variant_linear_margin", f"WITH {fold_sql(f'20 + 5 * ({_M} - 1)', _FLAG.format(b=80.0))} {_OUT}", "matches", recursive=True)
def _(t):
    return _fold(t, R.LINEAR_MARGIN)


@query("elo_variant_log_margin", f"WITH {fold_sql('30', '0', f'0.1 * ln({_M} + 1)', init='(SELECT list(coalesce(rating, 1500.0) ORDER BY i) FROM range(24) g(i) LEFT JOIN teams ON team = i)')} {_OUT}", "matches teams", recursive=True)
def _(t):
    return _fold(t, R.LOG_MARGIN, seeds=_per_pool(t))


def _per_pool(t):
    """The rating dimension, once for every (pool, team) that plays."""
    sides = F.explode(F.array("home", "away")).alias("team")
    return t.matches.select("pool", sides).distinct().join(t.teams.select("team", "rating"), "team")


_GP = fold_sql("30", "0", f"0.1 * ln({_M} + 1)", draws="NULL").replace(
    "* (1 + q.extra)", "* (1 + q.extra * 2.2 / ((CASE WHEN q.s = 1 THEN 1 ELSE -1 END) * (f.st[q.home + 1] - f.st[q.away + 1]) * 0.001 + 2.2))")


@query("elo_group_update", f"WITH {_GP.replace('FROM matches)', 'FROM (SELECT grp AS pool, s0.*, m.kickoff_ts FROM standings_in s0 JOIN (SELECT match_id, kickoff_ts FROM matches) m USING (match_id)))')} {_OUT}", "standings_in", recursive=True)
def _(t):
    m = t.matches.withColumn("pool", F.concat(F.lit("Group "), F.char((65 + F.col("match_id") % 12).cast("bigint"))))
    return R.elo_fold(m, R.GROUP_PHASE).select("pool", "match_id", *[rnd(c, 3).alias(c) for c in _COLS])


@query("elo_expected", """
SELECT m.match_id, #[1 / (1 + pow(10, -(h.rating + CASE WHEN m.neutral THEN 0 ELSE 100 END - a.rating) / 400.0))]# AS expected
FROM matches m JOIN teams h ON m.home = h.team JOIN teams a ON m.away = a.team""", "matches teams")
def _(t):
    h = t.teams.select(F.col("team").alias("home"), F.col("rating").alias("rh"))
    a = t.teams.select(F.col("team").alias("away"), F.col("rating").alias("ra"))
    diff = F.col("rh") + F.when(F.col("neutral"), 0).otherwise(100) - F.col("ra")
    return t.matches.join(h, "home").join(a, "away").select("match_id", rnd(R.elo_expected(diff)).alias("expected"))


@query("live_rating_refresh", f"""WITH {CAP}
SELECT pool, team, #3[rating]# AS rating, updated FROM (SELECT pool, team, arg_max(r, rn) AS rating, max(kickoff_ts) > TIMESTAMP '2024-01-20' AS updated FROM (
  SELECT pool, home AS team, post_h AS r, rn, kickoff_ts FROM elo UNION ALL SELECT pool, away, post_a, rn, kickoff_ts FROM elo) GROUP BY 1, 2)""", "matches", recursive=True)
def _(t):
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    old = R.final_ratings(R.elo_fold(t.matches.filter(F.col("kickoff_ts") <= cut), R.TOURNAMENT_CAP)).select("pool", "team", "rating", cut.alias("updated_ts"))
    new = t.matches.filter(F.col("kickoff_ts") > cut)
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    return R.refresh_ratings(old, new, R.TOURNAMENT_CAP, now).select("pool", "team", rnd("rating", 3).alias("rating"), "updated")


_E = "1 / (1 + pow(10, -(pre_h + bonus - pre_a) / 400.0))"
PRED_SQL = f"""
pred0 AS (SELECT *, {_E} AS e FROM elo),
pred AS (SELECT pool, match_id, kickoff_ts, pre_h - pre_a AS elo_diff, e, pd AS p_draw, e * (1 - pd) AS p_home, (1 - e) * (1 - pd) AS p_away,
  CASE WHEN home_score > away_score THEN 1 WHEN home_score < away_score THEN -1 ELSE 0 END AS actual
  FROM (SELECT *, greatest(0.08, least(0.30, 0.28 - 0.30 * abs(e - 0.5))) AS pd FROM pred0))"""
METRIC_COLS_SQL = """#4[avg(pow(p_home - CAST(actual = 1 AS INT), 2) + pow(p_draw - CAST(actual = 0 AS INT), 2) + pow(p_away - CAST(actual = -1 AS INT), 2))]# AS brier,
  #4[avg(-ln(greatest(1e-7, CASE actual WHEN 1 THEN p_home WHEN 0 THEN p_draw ELSE p_away END)))]# AS log_loss,
  #4[avg(CAST(actual = CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 1 WHEN p_draw >= p_away THEN 0 ELSE -1 END AS INT))]# AS accuracy"""


@query("flagship_pool_metrics", f"""WITH {CAP}, {PRED_SQL}
SELECT pool, count(*) AS n_matches, {METRIC_COLS_SQL} FROM pred GROUP BY 1""", "matches", recursive=True)
def _(t):
    """Fold ratings, score every match before it is played and evaluate per pool."""
    rec = S.prequential_records(t.matches, R.TOURNAMENT_CAP)
    return rec.groupBy("pool").agg(F.count(F.lit(1)).alias("n_matches"), rnd(F.avg(brier_row()), 4).alias("brier"),
                                   rnd(F.avg(logloss_row()), 4).alias("log_loss"), rnd(F.avg(hit()), 4).alias("accuracy"))


_LAGS = [f"lag(pts, {i + 1}) OVER w" for i in range(10)]


@query("match_feature_table", f"""WITH {fold_sql(f'20 + 5 * ({_M} - 1)', _FLAG.format(b=80.0))},
form AS (SELECT match_id, max(f) FILTER (is_home) AS fh, max(f) FILTER (NOT is_home) AS fa FROM (
  SELECT match_id, is_home, coalesce(({' + '.join(f'coalesce({x} * exp(-0.1 * {i}), 0)' for i, x in enumerate(_LAGS))}) / nullif({' + '.join(f'CASE WHEN {x} IS NULL THEN 0 ELSE exp(-0.1 * {i}) END' for i, x in enumerate(_LAGS))}, 0), 0.5) AS f
  FROM long_view WINDOW w AS (PARTITION BY pool, team ORDER BY kickoff_ts, match_id)) GROUP BY 1),
h2h AS (SELECT match_id, coalesce((CASE WHEN home < away THEN lw ELSE hw END) / nullif(n, 0), 0.5) AS h FROM (
  SELECT match_id, home, away, count(*) OVER w AS n, coalesce(sum(CAST(win = least(home, away) AS INT)) OVER w, 0) AS lw, coalesce(sum(CAST(win = greatest(home, away) AS INT)) OVER w, 0) AS hw FROM (
    SELECT *, CASE WHEN home_score > away_score THEN home WHEN home_score < away_score THEN away ELSE -1 END AS win FROM matches)
  WINDOW w AS (PARTITION BY pool, least(home, away), greatest(home, away) ORDER BY kickoff_ts, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
SELECT m.match_id, m.pool, #3[e.pre_h + e.bonus - e.pre_a]# AS elo_diff, CAST(m.neutral AS INT) AS is_neutral, #[fh]# AS form_home, #[fa]# AS form_away, CAST(rh AS INT) AS rest_home, CAST(ra AS INT) AS rest_away, #[h]# AS h2h, CAST(sign(m.home_score - m.away_score) AS INT) AS outcome
FROM matches m JOIN elo e USING (match_id) JOIN form USING (match_id) JOIN h2h USING (match_id) JOIN (
  SELECT match_id, max(coalesce(gap, 14)) FILTER (is_home) AS rh, max(coalesce(gap, 14)) FILTER (NOT is_home) AS ra FROM long_view l
  JOIN (SELECT pool, team, d, d - lag(d) OVER (PARTITION BY pool, team ORDER BY d) AS gap FROM (SELECT DISTINCT pool, team, CAST(kickoff_ts AS DATE) AS d FROM long_view)) g
  ON l.pool = g.pool AND l.team = g.team AND CAST(l.kickoff_ts AS DATE) = g.d GROUP BY 1) USING (match_id)""", "matches long_view", recursive=True)
def _(t):
    """Point-in-time feature row per match: rating difference, decayed form of both sides, head-to-head, rest."""
    m = t.matches
    elo = R.elo_fold(m, R.LINEAR_MARGIN).select("match_id", "pre_h", "pre_a")
    sides = W.form_decayed(m).join(W.rest_days(m).drop("team"), ["match_id", "is_home"])
    at = lambda c, home: F.max(F.when(F.col("is_home") == home, F.col(c)))
    form = sides.groupBy("match_id").agg(at("form", True).alias("form_home"), at("form", False).alias("form_away"), at("rest_days", True).alias("rest_home"), at("rest_days", False).alias("rest_away"))
    h2h = W.h2h_expanding(m).select("match_id", "h2h")
    return (m.select("match_id", "pool", "neutral", S.outcome().alias("outcome")).join(elo, "match_id").join(form, "match_id").join(h2h, "match_id")
            .select("match_id", "pool", rnd(F.col("pre_h") + F.when(F.col("neutral"), 0).otherwise(80) - F.col("pre_a"), 3).alias("elo_diff"),
                    F.col("neutral").cast("int").alias("is_neutral"), rnd("form_home").alias("form_home"), rnd("form_away").alias("form_away"), "rest_home", "rest_away",
                    rnd("h2h").alias("h2h"), "outcome"))
