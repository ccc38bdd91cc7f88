"""Registered queries: joins and set operations."""

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import clean as C
from ..operators import joins as J
from ..operators import windows as W
from ..session import persist_table
from .registry import query
from .window_queries import CONT_SQL

NAMES = ["click", "view"]


def _asof(n):
    return f"(SELECT k.match_id, f.feature_value, f.source_id FROM gappy_kickoffs k ASOF LEFT JOIN (SELECT * FROM features WHERE feature_name = '{n}') f ON k.team_id = f.team_id AND k.kickoff_ts > f.feature_ts)"


@query("asof_join_features", " UNION ALL ".join(f"SELECT match_id, '{n}' AS feature_name, #[feature_value]# AS feature_value, coalesce(source_id, -1) AS source_id FROM {_asof(n)}" for n in NAMES), "gappy_kickoffs features")
def _(t):
    return J.asof_join(t.gappy_kickoffs, t.features, NAMES).select("match_id", "feature_name", rnd("feature_value").alias("feature_value"), F.coalesce("source_id", F.lit(-1)).alias("source_id"))


@query("asof_wide", f"SELECT c.match_id, #[c.feature_value]# AS click, #[v.feature_value]# AS view FROM {_asof('click')} c JOIN {_asof('view')} v USING (match_id)", "gappy_kickoffs features")
def _(t):
    return J.asof_wide(t.gappy_kickoffs, t.features, NAMES).select("match_id", *[rnd(f"f_{n}.value").alias(n) for n in NAMES])


@query("latest_before", """
SELECT team_id, feature_name, #[arg_max(feature_value, feature_ts)]# AS feature_value, arg_max(source_id, feature_ts) AS source_id FROM features WHERE feature_ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2""", "features")
def _(t):
    out = J.latest_before(t.features, ["team_id", "feature_name"], ["feature_ts", "source_id"], "2024-01-15")
    return out.select("team_id", "feature_name", rnd("feature_value").alias("feature_value"), "source_id")


_SNAP = "(SELECT team_id, announced_ts, len(players) AS value FROM snapshots)"


@query("two_sided_asof", f"""
SELECT m.match_id, strftime(h.announced_ts, '%Y-%m-%d') AS home_day, strftime(a.announced_ts, '%Y-%m-%d') AS away_day, CAST(h.value AS DOUBLE) AS home_value, CAST(a.value AS DOUBLE) AS away_value, TRUE AS home_valid, TRUE AS away_valid
FROM matches m ASOF JOIN {_SNAP} h ON m.home = h.team_id AND m.kickoff_ts > h.announced_ts ASOF JOIN {_SNAP} a ON m.away = a.team_id AND m.kickoff_ts > a.announced_ts""", "matches snapshots")
def _(t):
    snaps = t.snapshots.select("team_id", "announced_ts", F.size("players").cast("double").alias("value"))
    out = J.two_sided_asof(t.matches, snaps)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.select("match_id", day("home_snapshot_ts").alias("home_day"), day("away_snapshot_ts").alias("away_day"), "home_value", "away_value", "home_valid", "away_valid")


def _side(s, c, d):
    return f"#[CASE WHEN h.team_id IS NULL OR a.team_id IS NULL THEN {d} ELSE {s}.{c} END]#"


@query("enrich_match_features", f"""WITH {CONT_SQL}
SELECT m.match_id, {_side('h', 'squad_size', 23)} AS home_squad_size, {_side('a', 'squad_size', 23)} AS away_squad_size,
  {_side('h', 'continuity_index', 1.0)} AS home_continuity_index, {_side('a', 'continuity_index', 1.0)} AS away_continuity_index,
  {_side('h', 'defenders_continuity', 1.0)} AS home_defenders_continuity, {_side('a', 'defenders_continuity', 1.0)} AS away_defenders_continuity,
  #[CASE WHEN h.team_id IS NULL OR a.team_id IS NULL THEN 0 ELSE h.continuity_index - a.continuity_index END]# AS continuity_diff,
  #[CASE WHEN h.team_id IS NULL OR a.team_id IS NULL THEN 0 ELSE h.squad_size - a.squad_size END]# AS squad_size_diff
FROM (SELECT * REPLACE (home * 3 AS home, away * 7 AS away) FROM matches) m ASOF LEFT JOIN cont h ON m.home = h.team_id AND m.kickoff_ts > h.announced_ts ASOF LEFT JOIN cont a ON m.away = a.team_id AND m.kickoff_ts > a.announced_ts""", "matches snapshots")
def _(t):
    m = t.matches.withColumns({"home": F.col("home") * 3, "away": F.col("away") * 7})
    squads = persist_table(W.squad_continuity(t.snapshots))  # the join reads its right side twice
    out = J.enrich_matches(m, squads)
    cols = ["squad_size", "continuity_index", "defenders_continuity"]
    return out.select("match_id", *[rnd(f"{s}_{c}").alias(f"{s}_{c}") for c in cols for s in ("home", "away")], rnd("continuity_diff").alias("continuity_diff"), rnd("squad_size_diff").alias("squad_size_diff"))


@query("validated_features_view", """
SELECT o_orderkey AS match_id, l_suppkey AS snapshot_id, #2[l_extendedprice]# AS value, s_name AS source, TRUE AS anti_leakage_valid
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate < o_orderdate + INTERVAL 30 DAY""")
def _(t):
    m = t.orders.select(F.col("o_orderkey").alias("match_id"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("kickoff_ts"))
    f = t.lineitem.select(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("snapshot_id"), F.col("l_shipdate").alias("computed_ts"), F.col("l_extendedprice").alias("value"))
    s = t.supplier.select(F.col("s_suppkey").alias("snapshot_id"), F.col("s_name").alias("source"))
    return J.validated_view(m, f, s).select("match_id", "snapshot_id", rnd("value", 2).alias("value"), "source", "anti_leakage_valid")


@query("master_dataset_join", """
WITH m AS (SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS date, CAST(o_custkey % 16 AS INT) AS city_id, CAST(o_custkey % 24 AS INT) AS home, CAST((o_custkey + 5) % 24 AS INT) AS away FROM orders),
rk AS (SELECT CAST(o_custkey % 24 AS INT) AS team, CAST(o_orderdate AS DATE) AS date, CAST(floor(min(o_totalprice) / 1000) AS DOUBLE) AS rank FROM orders GROUP BY 1, 2)
SELECT match_id, #9[temp_max]# AS temp_avg, CAST(coalesce(temp_max > 30, FALSE) OR coalesce(precip > 10, FALSE) AS INT) AS adverse, rh.rank - ra.rank AS rank_diff,
  #[coalesce(sh.rating, 0) - coalesce(sa.rating, 0)]# AS xg_diff
FROM m LEFT JOIN weather w ON m.date = w.date AND m.city_id = w.city_id LEFT JOIN rk rh ON rh.team = home AND rh.date = m.date LEFT JOIN rk ra ON ra.team = away AND ra.date = m.date
LEFT JOIN teams sh ON sh.team = home LEFT JOIN teams sa ON sa.team = away""", "weather teams")
def _(t):
    day = F.col("o_orderdate").cast("date")
    m = t.orders.select(F.col("o_orderkey").alias("match_id"), day.alias("date"), (F.col("o_custkey") % 16).cast("int").alias("city_id"),
                        (F.col("o_custkey") % 24).cast("int").alias("home"), ((F.col("o_custkey") + 5) % 24).cast("int").alias("away"))
    rk = t.orders.groupBy((F.col("o_custkey") % 24).cast("int").alias("team"), day.alias("date")).agg(F.floor(F.min("o_totalprice") / 1000).cast("double").alias("rank"))
    out = J.master_dataset(m, t.weather, rk, t.teams.select("team", F.col("rating").alias("xg")))
    return out.select("match_id", rnd("temp_avg", 9).alias("temp_avg"), "adverse", "rank_diff", rnd("xg_diff").alias("xg_diff"))


_FEW = "(SELECT * FROM teams WHERE team < 20)"


@query("semi_filter_known", f"SELECT match_id, home, away FROM matches WHERE home IN (SELECT team FROM {_FEW}) AND away IN (SELECT team FROM {_FEW})", "matches teams")
def _(t):
    return J.semi_known(t.matches, t.teams.filter("team < 20")).select("match_id", "home", "away")


@query("anti_missing_entities", f"SELECT team, count(*) AS n_fixtures FROM (SELECT home AS team FROM matches UNION ALL SELECT away FROM matches) WHERE team NOT IN (SELECT team FROM {_FEW}) GROUP BY 1", "matches teams")
def _(t):
    return J.missing_entities(t.matches, t.teams.filter("team < 20"))


@query("entity_coverage", f"SELECT count(*) AS entities, count(*) FILTER (team IN (SELECT team FROM {_FEW})) AS known, #[count(*) FILTER (team IN (SELECT team FROM {_FEW})) / count(*)]# AS coverage FROM (SELECT home AS team FROM matches UNION SELECT away FROM matches)", "matches teams")
def _(t):
    return J.coverage(t.matches, t.teams.filter("team < 20")).withColumn("coverage", rnd("coverage"))


@query("upsert_ratings", """
SELECT coalesce(b.team, u.team) AS team, #[coalesce(u.rating, b.rating)]# AS rating FROM (SELECT * FROM teams WHERE team < 16) b
FULL JOIN (SELECT home AS team, avg(home_score) * 100 + 1400 AS rating FROM matches WHERE home >= 8 GROUP BY 1) u ON b.team = u.team""", "matches teams")
def _(t):
    upd = t.matches.filter("home >= 8").groupBy(F.col("home").alias("team")).agg((F.avg("home_score") * 100 + 1400).alias("rating"))
    return J.upsert_ratings(t.teams.filter("team < 16").select("team", "rating"), upd, "team").withColumn("rating", rnd("rating"))


_COUNTRY = [c for cs in C.REGION_COUNTRIES.values() for c in cs][:25]
_TYPO = "CASE c_custkey % 6 WHEN 0 THEN n WHEN 1 THEN replace(n, 'a', 'o') WHEN 2 THEN n || 's' WHEN 3 THEN substr(n, 2) WHEN 4 THEN upper(n) ELSE replace(n, 'i', 'ii') END"


@query("fuzzy_entity_match", f"""
WITH dim AS (SELECT (ARRAY{_COUNTRY})[n_nationkey + 1] AS name, 1400.0 + n_nationkey * 10 AS rating FROM nation),
lhs AS (SELECT DISTINCT {_TYPO} AS name FROM (SELECT c_custkey, (ARRAY{_COUNTRY})[c_nationkey + 1] AS n FROM customer)),
cand AS (SELECT l.name, d.name AS b, d.rating, 1 - levenshtein(l.name, d.name) / greatest(length(l.name), length(d.name)) AS sim FROM lhs l, dim d),
best AS (SELECT name, b, rating, sim FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sim DESC, b) AS r FROM cand WHERE sim >= 0.75) WHERE r = 1)
SELECT l.name, b.b AS matched, CASE WHEN b.sim = 1 THEN 'exact' WHEN b.b IS NULL THEN 'default' ELSE 'fuzzy' END AS method, CAST(coalesce(b.rating, 1200.0) AS DOUBLE) AS rating
FROM lhs l LEFT JOIN best b USING (name)""")
def _(t):
    arr = F.array(*[F.lit(c) for c in _COUNTRY])
    dim = t.nation.select(F.element_at(arr, F.col("n_nationkey") + 1).alias("name"), (1400.0 + F.col("n_nationkey") * 10).alias("rating"))
    n, k = F.col("n"), F.col("c_custkey") % 6
    typo = (F.when(k == 0, n).when(k == 1, F.replace(n, F.lit("a"), F.lit("o"))).when(k == 2, F.concat(n, F.lit("s"))).when(k == 3, F.expr("substr(n, 2)"))
            .when(k == 4, F.upper(n)).otherwise(F.replace(n, F.lit("i"), F.lit("ii"))))
    lhs = t.customer.select("c_custkey", F.element_at(arr, F.col("c_nationkey") + 1).alias("n")).select(typo.alias("name"))
    return J.fuzzy_match(lhs, dim)


@query("rating_diff_lookup", f"""
SELECT match_id, #[coalesce(h.rating, 1200) - coalesce(a.rating, 1200) + CASE WHEN neutral THEN 0 ELSE 100 END]# AS rating_diff
FROM matches m LEFT JOIN {_FEW} h ON m.home = h.team LEFT JOIN {_FEW} a ON m.away = a.team""", "matches teams")
def _(t):
    return J.rating_diff(t.matches, t.teams.filter("team < 20")).select("match_id", rnd("rating_diff").alias("rating_diff"))


@query("union_dedupe", """
SELECT day, home, away, arg_min(match_id, b * 1000000000 + match_id) AS match_id, min(b) AS batch FROM (
  SELECT strftime(kickoff_ts, '%Y-%m-%d') AS day, home, away, match_id, CASE WHEN pool IN ('click', 'view') THEN 0 ELSE 1 END AS b FROM matches) GROUP BY 1, 2, 3""", "matches")
def _(t):
    m = t.matches.select(F.date_format("kickoff_ts", "yyyy-MM-dd").alias("day"), "home", "away", "match_id", "pool")
    early = F.col("pool").isin("click", "view")
    a = m.filter(early).drop("pool").withColumn("batch", F.lit(0))
    b = m.filter(~early).drop("pool").withColumn("batch", F.lit(1))
    return J.union_dedupe([a, b], ["day", "home", "away"], ["match_id"])


@query("set_difference_entities", """
SELECT k AS user_id, bool_or(a) AS in_a, bool_or(NOT a) AS in_b, CASE WHEN bool_or(a) AND bool_or(NOT a) THEN 'both' WHEN bool_or(a) THEN 'only_a' ELSE 'only_b' END AS side
FROM (SELECT user_id AS k, TRUE AS a FROM events WHERE user_id % 3 <> 0 UNION ALL SELECT o_custkey % 400, FALSE FROM orders) GROUP BY 1""")
def _(t):
    return J.entity_sets(t.events.filter("user_id % 3 <> 0"), t.orders.select((F.col("o_custkey") % 400).alias("user_id")), "user_id")


def _fixtures(t):
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("match_id"), F.col("o_orderstatus").alias("phase"), F.concat(F.lit("Group "), F.substring("o_orderpriority", 1, 1)).alias("group"),
                           (F.col("o_custkey") % 3).cast("int").alias("matchday"), (k + 1).alias("chrono_order"), F.when(k % 4 != 0, k * 2).alias("next_match"))


@query("fixture_views", "SELECT o_orderkey AS match_id, o_orderkey + 1 AS chrono_order, 'Group ' || o_orderpriority[1] AS \"group\" FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority[1] = '2' AND o_custkey % 3 = 1")
def _(t):
    return J.fixture_view(_fixtures(t), "F", "Group 2", 1).select("match_id", "chrono_order", "group")


@query("fixture_validate", """
SELECT 'phase_' || p AS "check", count(*) FILTER (o_orderstatus = p) AS value, count(*) FILTER (o_orderstatus = p) = count(*) // 3 AS ok FROM orders, (VALUES ('F'), ('O'), ('P')) v(p) GROUP BY p
UNION ALL SELECT 'total', count(*), count(*) = 3 * (count(*) // 3) FROM orders
UNION ALL SELECT 'order_gap_free', count(DISTINCT o_orderkey), min(o_orderkey) = 0 AND max(o_orderkey) = count(*) - 1 AND count(DISTINCT o_orderkey) = count(*) FROM orders
UNION ALL SELECT 'next_match_orphans', count(*), count(*) = 0 FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey * 2 NOT IN (SELECT o_orderkey FROM orders)""")
def _(t):
    third = t.orders.count() // 3
    return J.fixture_checks(_fixtures(t), {"F": third, "O": third, "P": third})
