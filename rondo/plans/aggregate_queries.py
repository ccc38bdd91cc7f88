"""Registered queries: aggregations, pivots, top-k."""

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import aggregates as A
from .clean_queries import _ROSTER, roster
from .registry import query

_LAST = "(SELECT *, row_number() OVER (PARTITION BY pool, team ORDER BY kickoff_ts DESC, match_id DESC) AS rn FROM long_view{w})"
_P3 = "CASE WHEN gf > ga THEN 3.0 WHEN gf = ga THEN 1.0 ELSE 0.0 END"


@query("recent_form_summary", f"""
SELECT pool, team, #[avg({_P3}) / 3]# AS points, #[avg(gf)]# AS gf_avg, #[avg(ga)]# AS ga_avg, #[avg(CAST(gf > ga AS INT))]# AS win_rate, count(*) AS n
FROM {_LAST.format(w='')} WHERE rn <= 5 GROUP BY 1, 2""", "long_view")
def _(t):
    out = A.recent_form(t.matches)
    return out.select("pool", "team", *[rnd(c).alias(c) for c in ("points", "gf_avg", "ga_avg", "win_rate")], "n")


@query("h2h_summary", """
SELECT lo, hi, #[avg(CAST(g > 0 AS INT))]# AS lo_win_rate, #[avg(CAST(g < 0 AS INT))]# AS hi_win_rate, #[avg(CAST(g = 0 AS INT))]# AS draw_rate, #[avg(lg)]# AS lo_goals_avg, #[avg(hg)]# AS hi_goals_avg, count(*) AS n FROM (
  SELECT home AS lo, away AS hi, home_score AS lg, away_score AS hg, home_score - away_score AS g FROM matches WHERE home < away
  UNION ALL SELECT away, home, away_score, home_score, away_score - home_score FROM matches WHERE home > away) GROUP BY 1, 2""", "matches")
def _(t):
    return A.h2h_summary(t.matches).select("lo", "hi", *[rnd(c).alias(c) for c in ("lo_win_rate", "hi_win_rate", "draw_rate", "lo_goals_avg", "hi_goals_avg")], "n")


@query("rating_report", f"""
WITH form AS (SELECT team, avg({_P3}) / 3 AS points, avg(CAST(gf > ga AS INT)) AS win_rate FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY kickoff_ts DESC, match_id DESC) AS rn FROM long_view) WHERE rn <= 5 GROUP BY 1)
SELECT team, #[rating]# AS rating, #[points]# AS points, #[win_rate]# AS win_rate FROM (SELECT * FROM teams ORDER BY rating DESC, team LIMIT 10) LEFT JOIN form USING (team)""", "long_view teams")
def _(t):
    form = A.recent_form(t.matches.withColumn("pool", F.lit("all"))).select("team", "points", "win_rate")
    out = A.rating_report(t.teams.select("team", "rating"), form, 10)
    return out.select("team", *[rnd(c).alias(c) for c in ("rating", "points", "win_rate")])


@query("form_table_12", f"""
SELECT pool, team, count(*) FILTER (gf > ga) AS wins, count(*) FILTER (gf = ga) AS draws, count(*) FILTER (gf < ga) AS losses, #[avg({_P3})]# AS ppg, #[avg(gf - ga)]# AS gd_avg,
  #[avg({_P3}) FILTER (rn <= 5) / 3]# AS form_last_5, #[avg({_P3}) FILTER (rn <= 10) / 3]# AS form_last_10, count(*) AS n
FROM {_LAST.format(w=" WHERE kickoff_ts < TIMESTAMP '2024-01-25' AND kickoff_ts >= TIMESTAMP '2023-01-25'")} WHERE rn <= 12 GROUP BY 1, 2""", "long_view")
def _(t):
    out = A.form_table(t.matches, "2024-01-25")
    return out.select("pool", "team", "wins", "draws", "losses", *[rnd(c).alias(c) for c in ("ppg", "gd_avg", "form_last_5", "form_last_10")], "n")


@query("weighted_form_table", f"""
SELECT pool, l.team, count(*) AS n_total, count(*) FILTER (rating >= 1900) AS n_elite, #[sum(pts * rating) / sum(rating)]# AS f_exig, count(*) FILTER (rating >= 1900) < 4 AS is_low_conf
FROM {_LAST.format(w='')} l JOIN teams o ON l.opp = o.team WHERE rn <= 12 GROUP BY 1, 2""", "long_view teams")
def _(t):
    return A.weighted_form(t.matches, t.teams, 1900).withColumn("f_exig", rnd("f_exig"))


@query("team_strength_agg", """
SELECT n_nationkey AS nation, #[coalesce(avg(s_acctbal), 0)]# AS s_acctbal, #[coalesce(avg(s_suppkey), 0)]# AS s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1""")
def _(t):
    players = t.supplier.withColumnRenamed("s_nationkey", "nation")
    out = A.team_strength(players, "nation", ["s_acctbal", "s_suppkey"], t.nation.withColumnRenamed("n_nationkey", "nation"))
    return out.select("nation", rnd("s_acctbal").alias("s_acctbal"), rnd("s_suppkey").alias("s_suppkey"))


_POS = ["Portero", "Defensa", "Mediocampista", "Delantero"]


@query("pivot_counts", f"WITH {_ROSTER} SELECT \"group\", " + ", ".join(f"count(*) FILTER (position = '{p}') AS \"{p}\"" for p in _POS) + " FROM roster GROUP BY 1", "roster_raw")
def _(t):
    return A.pivot_counts(roster(t), "group", "position", _POS)


@query("group_stats", """
SELECT l_suppkey, #4[avg(l_extendedprice)]# AS mean, #4[quantile_cont(l_extendedprice, 0.5)]# AS median, #4[min(l_extendedprice)]# AS min, #4[max(l_extendedprice)]# AS max, #4[stddev_samp(l_extendedprice)]# AS std
FROM lineitem GROUP BY 1""")
def _(t):
    return A.group_stats(t.lineitem, "l_suppkey", "l_extendedprice", 4)


@query("dataset_profile", "SELECT * FROM (" + " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, count(*) AS n, CAST(count(DISTINCT {c}) AS DOUBLE) AS n_distinct, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std FROM lineitem" for c in ("l_returnflag", "l_linestatus", "l_suppkey")]
    + [f"SELECT '{c}', count(*), NULL, #[min({c})]#, #[max({c})]#, #4[avg({c})]#, #4[stddev_samp({c})]# FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")]) + ")")
def _(t):
    out = A.dataset_profile(t.lineitem, ["l_returnflag", "l_linestatus", "l_suppkey"], ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("feature", "n", F.col("n_distinct").cast("double").alias("n_distinct"), rnd("min").alias("min"), rnd("max").alias("max"), rnd("mean", 4).alias("mean"), rnd("std", 4).alias("std"))


@query("value_counts", "SELECT tournament, count(*) AS n FROM matches GROUP BY 1", "matches")
def _(t):
    return A.value_counts(t.matches, "tournament")


STAND_SQL = """stand AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY points DESC, gd DESC, gf DESC, team) AS rank FROM (
  SELECT grp, team, CAST(sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS BIGINT) AS points, CAST(sum(gf - ga) AS BIGINT) AS gd, CAST(sum(gf) AS BIGINT) AS gf, count(*) AS played FROM (
    SELECT grp, home AS team, home_score AS gf, away_score AS ga FROM standings_in UNION ALL SELECT grp, away, away_score, home_score FROM standings_in) GROUP BY 1, 2))"""


@query("group_standings", f"WITH {STAND_SQL} SELECT grp, team, points, gd, gf, played, CAST(rank AS INT) AS rank FROM stand", "standings_in")
def _(t):
    return A.standings(t.standings_in)


@query("best_thirds_topk", f"WITH {STAND_SQL} SELECT grp, team, points, gd, gf FROM stand WHERE rank = 3 ORDER BY points DESC, gd DESC, gf DESC, grp LIMIT 8", "standings_in")
def _(t):
    return A.best_thirds(A.standings(t.standings_in)).select("grp", "team", "points", "gd", "gf")


@query("batch_store_metrics", """
SELECT count(*) AS total_records, count(DISTINCT team_id) AS unique_teams, count(*) FILTER (v IS NULL) AS null_values, count(*) FILTER (feature_ts > TIMESTAMP '2024-01-28') AS future_rows
FROM (SELECT *, CASE WHEN source_id % 29 = 0 THEN NULL ELSE feature_value END AS v FROM features)""", "features")
def _(t):
    f = t.features.withColumn("feature_value", F.when(F.col("source_id") % 29 != 0, F.col("feature_value")))
    return A.store_metrics(f, "2024-01-28")


@query("betting_yield", """
SELECT #2[st]# AS total_stake, #2[r]# AS total_return, #2[r - st]# AS profit, #4[(r - st) / st * 100]# AS yield_pct, wins, n_bets FROM (
  SELECT sum(stake) AS st, sum(CASE WHEN result = 'ganada' THEN stake * odds ELSE 0 END) AS r, count(*) FILTER (result = 'ganada') AS wins, count(*) AS n_bets FROM bets)""", "bets")
def _(t):
    out = A.betting_yield(t.bets)
    return out.select(*[rnd(c, 2).alias(c) for c in ("total_stake", "total_return", "profit")], rnd("yield_pct", 4).alias("yield_pct"), "wins", "n_bets")


@query("class_distribution", "SELECT actual, count(*) AS n, #[count(*) / (SELECT count(*) FROM predictions)]# AS share FROM predictions GROUP BY 1", "predictions")
def _(t):
    return A.class_distribution(t.predictions).withColumn("share", rnd("share"))


@query("naive_baselines", "SELECT #[h]# AS always_home, #[a]# AS always_away, #[greatest(h, d, a)]# AS majority, #[h * h + d * d + a * a]# AS random FROM (SELECT avg(CAST(actual = 1 AS INT)) AS h, avg(CAST(actual = 0 AS INT)) AS d, avg(CAST(actual = -1 AS INT)) AS a FROM predictions)", "predictions")
def _(t):
    out = A.naive_baselines(t.predictions)
    return out.select(*[rnd(c).alias(c) for c in out.columns])
