"""Domain tables derived from the given tables: match results, ratings, squads, predictions, logs.

``VIEWS`` holds the SQL form of each table for the checks, ``Tables`` the Spark form.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import persist_table, small

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "matches": ((), """
SELECT event_id AS match_id, ts AS kickoff_ts, event_type AS pool,
  CAST(user_id % 24 AS INT) AS home, CAST((user_id % 24 + 1 + k % 23) % 24 AS INT) AS away,
  CAST(floor(value) AS INT) % 5 AS home_score, k % 4 AS away_score, (k % 2 = 0) AS neutral,
  CASE k % 6 WHEN 0 THEN 'FIFA World Cup' WHEN 1 THEN 'FIFA World Cup qualification' WHEN 2 THEN 'UEFA Nations League'
    WHEN 3 THEN 'Copa America' WHEN 4 THEN 'Kirin Cup' ELSE 'Friendly' END AS tournament
FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events)"""),
    "teams": ((), """
SELECT CAST(s_suppkey % 24 AS INT) AS team, max(1500 + s_acctbal/20) AS rating, min(s_nationkey) AS nation
FROM supplier GROUP BY 1"""),
    "snapshots": ((), """
SELECT user_id AS team_id, date_trunc('week', ts) AS announced_ts,
  list(DISTINCT {'name': json_extract_string(props,'$.k'),
   'position': CASE event_type WHEN 'click' THEN 'Defender' WHEN 'view' THEN 'Midfielder'
     WHEN 'purchase' THEN 'Attacker' ELSE 'Goalkeeper' END}) AS players
FROM events GROUP BY 1,2"""),
    "features": ((), """
SELECT user_id AS team_id, event_type AS feature_name, value / 1000.0 AS feature_value, ts AS feature_ts, event_id AS source_id
FROM events WHERE event_type <> 'purchase'"""),
    "kickoffs": ((), """
SELECT event_id AS match_id, user_id AS team_id, ts AS kickoff_ts FROM events WHERE event_type = 'purchase'"""),
    "gappy_kickoffs": (("kickoffs",), """
SELECT match_id, CASE WHEN match_id % 50 <> 0 THEN team_id END AS team_id, CASE WHEN match_id % 50 <> 1 THEN kickoff_ts END AS kickoff_ts FROM kickoffs"""),
    "predictions": (("matches", "teams"), """
SELECT m.match_id, m.kickoff_ts, m.pool, m.tournament,
  e * (1 - pd) AS p_home, pd AS p_draw, (1 - e) * (1 - pd) AS p_away,
  CASE WHEN home_score > away_score THEN 1 WHEN home_score < away_score THEN -1 ELSE 0 END AS actual, d AS rating_diff
FROM (SELECT *, greatest(0.08, least(0.30, 0.28 - 0.30 * abs(e - 0.5))) AS pd FROM
  (SELECT m.*, h.rating - a.rating AS d, 1 / (1 + pow(10, -(h.rating + CASE WHEN m.neutral THEN 0 ELSE 100 END - a.rating) / 400.0)) AS e
   FROM matches m LEFT JOIN teams h ON m.home = h.team LEFT JOIN teams a ON m.away = a.team WHERE h.team IS NOT NULL AND a.team IS NOT NULL)) m"""),
    "prediction_log": (("predictions",), """
SELECT match_id AS request_id, kickoff_ts, pool, 1.0 + p_home AS baseline_lambda,
  (1.0 + p_home) * exp(0.2 * (p_home - 0.4)) AS shadow_lambda, 10 + match_id % 190 AS latency_ms,
  CASE WHEN match_id % 19 = 0 THEN 'FAILSAFE_MISSING_DATA' WHEN match_id % 41 = 0 THEN 'FAILSAFE_LEAKAGE' ELSE 'SHADOW' END AS status,
  CASE WHEN match_id % 53 = 0 THEN NULL ELSE p_home END AS p_home, p_draw, p_away, actual FROM predictions"""),
    "triggers": ((), """
SELECT event_id AS trigger_id, ts, CASE user_id % 4 WHEN 0 THEN 'psi_drift_continuity_index' WHEN 1 THEN 'fallback_rate'
  WHEN 2 THEN 'brier_degradation' ELSE 'nan_probabilities' END AS metric, value AS metric_value, 'FAIL' AS status
FROM events WHERE event_type = 'error'"""),
    "standings_in": (("matches",), """
SELECT match_id, 'Group ' || chr(CAST(65 + match_id % 12 AS INT)) AS grp, home, away, home_score, away_score FROM matches"""),
    "bets": ((), """
SELECT l_orderkey, l_linenumber, 1.2 + l_discount * 20 AS odds, l_quantity AS stake,
  CASE WHEN l_returnflag = 'A' THEN 'ganada' ELSE 'perdida' END AS result, 0.3 + l_tax * 5 AS prob FROM lineitem"""),
    "roster_raw": ((), """
SELECT c_custkey, '[' || lower(c_name) || ']' AS player_raw, CASE c_custkey % 5 WHEN 0 THEN 'GK' WHEN 1 THEN ' df.'
    WHEN 2 THEN 'LW' WHEN 3 THEN 'mid' ELSE '??' END AS position_raw,
  '(' || lower(c_mktsegment) || ')' AS club_raw, CAST(CAST(trunc(c_acctbal) AS INT) % 60 AS VARCHAR) AS age_raw, c_nationkey AS country
FROM customer"""),
    "weather": ((), """
SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_custkey % 16 AS INT) AS city_id, avg(o_totalprice) / 10000 AS temp_max,
  min(o_totalprice) / 20000 AS precip FROM orders GROUP BY 1,2"""),
    # team-match long view used by many checks
    "long_view": (("matches",), """
SELECT match_id, kickoff_ts, pool, tournament, home AS team, away AS opp, home_score AS gf, away_score AS ga, TRUE AS is_home,
  CASE WHEN home_score > away_score THEN 1.0 WHEN home_score = away_score THEN 0.5 ELSE 0.0 END AS pts FROM matches
UNION ALL
SELECT match_id, kickoff_ts, pool, tournament, away, home, away_score, home_score, FALSE,
  CASE WHEN away_score > home_score THEN 1.0 WHEN home_score = away_score THEN 0.5 ELSE 0.0 END FROM matches"""),
}


def with_views(names, body: str, recursive: bool = False) -> str:
    """Prefix ``body`` (a SELECT, possibly starting with its own CTE list) with the views it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        deps, _ = VIEWS[name]
        for dep in deps:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    ctes = [f"{n} AS ({VIEWS[n][1].strip()})" for n in order]
    body = body.strip()
    own = ""
    if body.upper().startswith("WITH "):
        own = body[5:]
    if not ctes and not own:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    if own:
        return head + ",\n".join(ctes + [own])
    return head + ",\n".join(ctes) + "\n" + body


class Tables:
    """Lazily built DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._read: dict[str, DataFrame] = {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            if name not in self._read:
                self._read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return self._read[name]
        raise AttributeError(name)

    @cached_property
    def matches(self) -> DataFrame:
        e = self.events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        names = ["FIFA World Cup", "FIFA World Cup qualification", "UEFA Nations League", "Copa America", "Kirin Cup", "Friendly"]
        tournament = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("k") % 6 + 1).cast("int"))
        home = F.col("user_id") % 24
        return e.select(
            F.col("event_id").alias("match_id"),
            F.col("ts").alias("kickoff_ts"),
            F.col("event_type").alias("pool"),
            home.cast("int").alias("home"),
            ((home + 1 + F.col("k") % 23) % 24).cast("int").alias("away"),
            (F.floor("value").cast("int") % 5).alias("home_score"),
            (F.col("k") % 4).alias("away_score"),
            (F.col("k") % 2 == 0).alias("neutral"),
            tournament.alias("tournament"),
        )

    @cached_property
    def teams(self) -> DataFrame:
        return self.supplier.groupBy((F.col("s_suppkey") % 24).cast("int").alias("team")).agg(
            F.max(1500 + F.col("s_acctbal") / 20).alias("rating"), F.min("s_nationkey").alias("nation"))

    @cached_property
    def snapshots(self) -> DataFrame:
        position = (F.when(F.col("event_type") == "click", "Defender").when(F.col("event_type") == "view", "Midfielder")
                    .when(F.col("event_type") == "purchase", "Attacker").otherwise("Goalkeeper"))
        player = F.struct(F.get_json_object("props", "$.k").alias("name"), position.alias("position"))
        return self.events.groupBy(
            F.col("user_id").alias("team_id"), F.date_trunc("week", "ts").cast("timestamp_ntz").alias("announced_ts")
        ).agg(F.collect_set(player).alias("players"))

    @cached_property
    def features(self) -> DataFrame:
        return self.events.filter(F.col("event_type") != "purchase").select(
            F.col("user_id").alias("team_id"), F.col("event_type").alias("feature_name"),
            (F.col("value") / 1000.0).alias("feature_value"), F.col("ts").alias("feature_ts"), F.col("event_id").alias("source_id"))

    @cached_property
    def kickoffs(self) -> DataFrame:
        return self.events.filter(F.col("event_type") == "purchase").select(
            F.col("event_id").alias("match_id"), F.col("user_id").alias("team_id"), F.col("ts").alias("kickoff_ts"))

    @cached_property
    def gappy_kickoffs(self) -> DataFrame:
        """Kickoffs of which some lack the team and some the time."""
        i = F.col("match_id") % 50
        return self.kickoffs.select("match_id", F.when(i != 0, F.col("team_id")).alias("team_id"), F.when(i != 1, F.col("kickoff_ts")).alias("kickoff_ts"))

    @cached_property
    def predictions(self) -> DataFrame:
        teams = persist_table(self.teams)
        h = small(teams.select(F.col("team").alias("home"), F.col("rating").alias("rh")), teams)
        a = small(teams.select(F.col("team").alias("away"), F.col("rating").alias("ra")), teams)
        m = self.matches.join(h, "home").join(a, "away")
        bonus = F.when(F.col("neutral"), 0).otherwise(100)
        e = 1 / (1 + F.pow(F.lit(10.0), -(F.col("rh") + bonus - F.col("ra")) / 400.0))
        m = m.withColumn("e", e).withColumn(
            "p_draw", F.greatest(F.lit(0.08), F.least(F.lit(0.30), 0.28 - 0.30 * F.abs(F.col("e") - 0.5))))
        return m.select(
            "match_id", "kickoff_ts", "pool", "tournament",
            (F.col("e") * (1 - F.col("p_draw"))).alias("p_home"), "p_draw",
            ((1 - F.col("e")) * (1 - F.col("p_draw"))).alias("p_away"),
            F.signum((F.col("home_score") - F.col("away_score")).cast("double")).cast("int").alias("actual"),
            (F.col("rh") - F.col("ra")).alias("rating_diff"))

    @cached_property
    def prediction_log(self) -> DataFrame:
        p, mid = F.col("p_home"), F.col("match_id")
        return self.predictions.select(
            mid.alias("request_id"), "kickoff_ts", "pool", (1.0 + p).alias("baseline_lambda"),
            ((1.0 + p) * F.exp(0.2 * (p - 0.4))).alias("shadow_lambda"), (10 + mid % 190).alias("latency_ms"),
            F.when(mid % 19 == 0, "FAILSAFE_MISSING_DATA").when(mid % 41 == 0, "FAILSAFE_LEAKAGE").otherwise("SHADOW").alias("status"),
            F.when(mid % 53 == 0, F.lit(None).cast("double")).otherwise(p).alias("p_home"), "p_draw", "p_away", "actual")

    @cached_property
    def triggers(self) -> DataFrame:
        u = F.col("user_id") % 4
        return self.events.filter(F.col("event_type") == "error").select(
            F.col("event_id").alias("trigger_id"), "ts",
            F.when(u == 0, "psi_drift_continuity_index").when(u == 1, "fallback_rate").when(u == 2, "brier_degradation")
            .otherwise("nan_probabilities").alias("metric"),
            F.col("value").alias("metric_value"), F.lit("FAIL").alias("status"))

    @cached_property
    def standings_in(self) -> DataFrame:
        letter = F.char((65 + F.col("match_id") % 12).cast("bigint"))
        return self.matches.select("match_id", F.concat(F.lit("Group "), letter).alias("grp"), "home", "away", "home_score", "away_score")

    @cached_property
    def bets(self) -> DataFrame:
        return self.lineitem.select(
            "l_orderkey", "l_linenumber", (1.2 + F.col("l_discount") * 20).alias("odds"), F.col("l_quantity").alias("stake"),
            F.when(F.col("l_returnflag") == "A", "ganada").otherwise("perdida").alias("result"),
            (0.3 + F.col("l_tax") * 5).alias("prob"))

    @cached_property
    def roster_raw(self) -> DataFrame:
        k = F.col("c_custkey") % 5
        return self.customer.select(
            "c_custkey", F.concat(F.lit("["), F.lower("c_name"), F.lit("]")).alias("player_raw"),
            F.when(k == 0, "GK").when(k == 1, " df.").when(k == 2, "LW").when(k == 3, "mid").otherwise("??").alias("position_raw"),
            F.concat(F.lit("("), F.lower("c_mktsegment"), F.lit(")")).alias("club_raw"),
            (F.col("c_acctbal").cast("int") % 60).cast("string").alias("age_raw"), F.col("c_nationkey").alias("country"))

    @cached_property
    def weather(self) -> DataFrame:
        return self.orders.groupBy(F.col("o_orderdate").cast("date").alias("date"), (F.col("o_custkey") % 16).cast("int").alias("city_id")).agg(
            (F.avg("o_totalprice") / 10000).alias("temp_max"), (F.min("o_totalprice") / 20000).alias("precip"))
