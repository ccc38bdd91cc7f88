"""Registered queries: cleaning, projections, predicates."""

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import clean as C
from .registry import query

# ---- raw results: text columns with defects ------------------------------------------------------
_RAW = """raw AS (SELECT match_id, CASE WHEN match_id % 37 = 0 THEN 'n/a' ELSE strftime(kickoff_ts, '%Y-%m-%d') END AS date,
  CASE WHEN match_id % 53 = 0 THEN NULL ELSE home END AS home_team, away AS away_team,
  CASE WHEN match_id % 41 = 0 THEN NULL ELSE CAST(home_score AS VARCHAR) END AS home_score, CAST(away_score AS VARCHAR) AS away_score,
  CASE WHEN match_id % 5 = 0 THEN NULL ELSE neutral END AS neutral FROM matches)"""


def _raw(t):
    mid = F.col("match_id")
    return t.matches.select(
        "match_id", F.when(mid % 37 == 0, "n/a").otherwise(F.date_format("kickoff_ts", "yyyy-MM-dd")).alias("date"),
        F.when(mid % 53 != 0, F.col("home")).alias("home_team"), F.col("away").alias("away_team"),
        F.when(mid % 41 != 0, F.col("home_score").cast("string")).alias("home_score"), F.col("away_score").cast("string").alias("away_score"),
        F.when(mid % 5 != 0, F.col("neutral")).alias("neutral"))


@query("clean_matches", f"""WITH {_RAW}
SELECT match_id, date, home_team, away_team, CAST(home_score AS INT) AS home_score, CAST(away_score AS INT) AS away_score, coalesce(neutral, FALSE) AS neutral
FROM raw WHERE date <> 'n/a' AND home_team IS NOT NULL AND home_score IS NOT NULL""", "matches")
def _(t):
    return C.clean_matches(_raw(t)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


_NAMES = ["United States", "Korea Republic", "Brazil", "IR Iran", "Czech Republic", "Japan", "Congo DR", "Mexico"]
_NAME_SQL = "(ARRAY[" + ", ".join(f"'{n}'" for n in _NAMES) + "])[{c} % 8 + 1]"


def _name(c):
    return F.element_at(F.array(*[F.lit(n) for n in _NAMES]), F.col(c) % 8 + 1)


def _canon(e):
    return f"CASE {e} WHEN 'United States' THEN 'USA' WHEN 'Korea Republic' THEN 'South Korea' WHEN 'IR Iran' THEN 'Iran' WHEN 'Czech Republic' THEN 'Czechia' WHEN 'Congo DR' THEN 'DR Congo' ELSE {e} END"


@query("normalize_entity_names", f"SELECT match_id, {_canon(_NAME_SQL.format(c='home'))} AS home_team, {_canon(_NAME_SQL.format(c='away'))} AS away_team FROM matches", "matches")
def _(t):
    df = t.matches.select("match_id", _name("home").alias("home_team"), _name("away").alias("away_team"))
    return C.normalize_names(df, ["home_team", "away_team"], C.TEAM_ALIASES)


@query("classify_competition", """
SELECT match_id, c AS match_class, CASE c WHEN 'Mundial' THEN 60 WHEN 'CopaContinental' THEN 45 WHEN 'Eliminatoria' THEN 50 ELSE 30 END AS k_base FROM (
  SELECT match_id, CASE tournament WHEN 'FIFA World Cup' THEN 'Mundial' WHEN 'FIFA World Cup qualification' THEN 'Eliminatoria'
    WHEN 'UEFA Nations League' THEN 'CopaContinental' WHEN 'Copa America' THEN 'CopaContinental' ELSE 'Amistoso' END AS c FROM matches)""", "matches")
def _(t):
    return C.classify_competition(t.matches).select("match_id", "match_class", "k_base")


@query("assign_region", f"""
SELECT match_id, CASE WHEN c IN ('Mexico', 'United States') THEN 'CONCACAF' WHEN c = 'Brazil' THEN 'CONMEBOL' WHEN c = 'Czech Republic' THEN 'UEFA' WHEN c = 'Japan' THEN 'AFC'
  WHEN tournament LIKE '%UEFA%' THEN 'UEFA' ELSE 'Unknown' END AS confederation, '2026' AS cycle
FROM (SELECT *, {_NAME_SQL.format(c='home')} AS c FROM matches)""", "matches")
def _(t):
    df = t.matches.withColumn("country", _name("home"))
    return C.assign_region(df, date="kickoff_ts").select("match_id", "confederation", "cycle")


@query("filter_date_range", "SELECT o_orderkey, o_custkey, #2[o_totalprice]# AS o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31'")
def _(t):
    return C.filter_date_range(t.orders, "o_orderdate", "1996-01-01", "1997-12-31", ["o_orderkey", "o_custkey", "o_totalprice"]).withColumn("o_totalprice", rnd("o_totalprice", 2))


@query("derive_match_columns", """
SELECT match_id, CAST(sign(home_score - away_score) AS INT) AS outcome, CASE WHEN home_score > away_score THEN 'H' WHEN home_score = away_score THEN 'D' ELSE 'A' END AS result,
  CAST(1 - sign(home_score - away_score) AS INT) AS label, home_score + away_score AS total_goals, home_score - away_score AS goal_diff,
  CAST(home_score > away_score AS INT) AS is_home_win, CAST(home_score = away_score AS INT) AS is_draw, CAST(home_score < away_score AS INT) AS is_away_win FROM matches""", "matches")
def _(t):
    return C.derive_match_columns(t.matches).select("match_id", "outcome", "result", "label", "total_goals", "goal_diff", "is_home_win", "is_draw", "is_away_win")


_DEFECT = """d AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS a, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value / 500 END AS b,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE value * 2 END AS c, CASE WHEN event_id % 101 = 0 THEN 'Infinity'::DOUBLE WHEN event_id % 103 = 0 THEN 'NaN'::DOUBLE ELSE 1.0 END AS f FROM events)"""


@query("impute_features", f"""WITH {_DEFECT}, ok AS (SELECT * FROM d WHERE f = 1.0)
SELECT event_id, #[coalesce(a, 0)]# AS a, #[coalesce(b, 0.5)]# AS b, #[coalesce(c, (SELECT quantile_cont(c, 0.5) FROM ok))]# AS c FROM ok""")
def _(t):
    i, v = F.col("event_id"), F.col("value")
    df = t.events.select("event_id", F.when(i % 11 != 0, v).alias("a"), F.when(i % 13 != 0, v / 500).alias("b"), F.when(i % 17 != 0, v * 2).alias("c"),
                         F.when(i % 101 == 0, float("inf")).when(i % 103 == 0, float("nan")).otherwise(1.0).alias("f"))
    out = C.impute(df, {"a": 0.0, "b": 0.5}, ["c"], ["f"])
    return out.select("event_id", *[rnd(c).alias(c) for c in "abc"])


_CAP1 = "upper({x}[1]) || {x}[2:]"
_ROSTER = f"""roster AS (SELECT country, {_CAP1.format(x="replace(replace(player_raw,'[',''),']','')")} AS player,
  CASE c_custkey % 5 WHEN 0 THEN 'Portero' WHEN 1 THEN 'Defensa' WHEN 2 THEN 'Delantero' ELSE 'Mediocampista' END AS position,
  {_CAP1.format(x="replace(replace(club_raw,'(',''),')','')")} AS club,
  CASE WHEN CAST(age_raw AS INT) BETWEEN 16 AND 45 THEN CAST(age_raw AS INT) ELSE 26 END AS age, 0 AS jersey_number, 'Final' AS squad_status,
  'Group ' || CAST(n_regionkey AS VARCHAR) AS "group", r_name AS confederation
  FROM (SELECT * FROM roster_raw) LEFT JOIN nation ON country = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""


def countries(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_nationkey").alias("country"), F.concat(F.lit("Group "), F.col("n_regionkey").cast("string")).alias("group"), F.col("r_name").alias("confederation"))


def roster(t):
    raw = t.roster_raw
    return C.clean_roster(raw.unionByName(raw), countries(t), "c_custkey")


@query("clean_roster", f"WITH {_ROSTER} SELECT * FROM roster", "roster_raw")
def _(t):
    return roster(t)


@query("roster_to_ml", f"WITH {_ROSTER} SELECT country, player, 1 AS is_final_squad, CAST(age AS DOUBLE) AS age, CAST(0 AS DOUBLE) AS jersey_number FROM roster", "roster_raw")
def _(t):
    return C.roster_features(roster(t)).select("country", "player", "is_final_squad", "age", "jersey_number")


_PAGE = "html || CASE page_id % 4 WHEN 0 THEN ' The FINAL Squad' WHEN 1 THEN ' Preliminary list' WHEN 2 THEN ' convocatoria definitiva, preliminar' ELSE '' END"


@query("classify_page_status", f"""
SELECT page_id, CASE WHEN regexp_matches(h, 'final squad|lista final|convocatoria definitiva') THEN 'Final' WHEN contains(h, 'preliminar') THEN 'Preliminar' ELSE 'Final' END AS status
FROM (SELECT page_id, lower({_PAGE}) AS h FROM pages)""")
def _(t):
    k = F.col("page_id") % 4
    tail = F.when(k == 0, " The FINAL Squad").when(k == 1, " Preliminary list").when(k == 2, " convocatoria definitiva, preliminar").otherwise("")
    return t.pages.select("page_id", C.page_status(F.concat("html", tail)).alias("status"))


@query("feature_contracts", """
SELECT source_id, feature_name, CASE feature_name WHEN 'click' THEN feature_value BETWEEN 0 AND 0.05 WHEN 'view' THEN feature_value BETWEEN 0.01 AND 0.1 ELSE TRUE END AS is_valid FROM features""", "features")
def _(t):
    rules = {"click": (0.0, 0.05, False), "view": (0.01, 0.1, True)}
    return C.apply_contracts(t.features, rules).select("source_id", "feature_name", "is_valid")


@query("snapshot_integrity", """
SELECT team_id, strftime(announced_ts, '%Y-%m-%d') AS day, team_id > 0 AND len(players) > 0 AND len(list_filter(players, lambda p: p.name IS NULL OR p.name = '7')) = 0 AS is_valid FROM snapshots""", "snapshots")
def _(t):
    blank = t.snapshots.withColumn("players", F.transform("players", lambda p: F.struct(F.when(p["name"] == "7", " ").otherwise(p["name"]).alias("name"), p["position"].alias("position"))))
    return C.snapshot_valid(blank).select("team_id", F.date_format("announced_ts", "yyyy-MM-dd").alias("day"), "is_valid")


@query("prediction_verdict", """
SELECT match_id, CASE WHEN gap < 0.05 THEN 'balanced' ELSE r[1].l END AS verdict, #[r[1].p]# AS confidence, gap >= 0.12 AND r[1].p >= 0.45 AS advantage, r[2].l AS second, r[3].l AS third FROM (
  SELECT *, r[1].p - r[2].p AS gap FROM (SELECT match_id, list_reverse_sort([{'p': p_home, 'o': 0, 'l': 'home'}, {'p': p_draw, 'o': -1, 'l': 'draw'}, {'p': p_away, 'o': -2, 'l': 'away'}]) AS r FROM predictions))""", "predictions")
def _(t):
    return C.verdict(t.predictions).select("match_id", "verdict", rnd("confidence").alias("confidence"), "advantage", "second", "third")


@query("pick_from_probs", """
SELECT match_id, CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 1 WHEN p_draw >= p_away THEN 0 ELSE -1 END AS pick, #[greatest(p_home, p_draw, p_away)]# AS confidence FROM predictions""", "predictions")
def _(t):
    return C.pick(t.predictions).select("match_id", "pick", rnd("confidence").alias("confidence"))
