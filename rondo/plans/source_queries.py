"""Registered queries: sources and sinks. Tables are written to the shared folder and read back."""

from pyspark.sql import functions as F

from .. import schemas as SC
from ..functions.expr import rnd, with_one_row
from ..operators import rating as R
from ..session import shared_dir
from ..sources import readers as RD
from ..sources import sinks as SK
from .clean_queries import _ROSTER, roster
from .metric_queries import r
from .rating_queries import CAP
from .registry import query


@query("read_matches_csv", """
SELECT match_id, day, home_team, away_team, home_score, away_score, neutral FROM (SELECT match_id, CASE WHEN match_id % 37 = 0 THEN NULL ELSE strftime(kickoff_ts, '%Y-%m-%d') END AS day, 'T' || home AS home_team, CAST(match_id AS VARCHAR) AS away_team, CAST(home_score AS DOUBLE) AS home_score, CAST(away_score AS DOUBLE) AS away_score, neutral FROM matches)""", "matches")
def _(t):
    mid = F.col("match_id")
    raw = t.matches.select(F.when(mid % 37 == 0, "n/a").otherwise(F.date_format("kickoff_ts", "yyyy-MM-dd")).alias("date"), F.concat(F.lit("T"), F.col("home").cast("string")).alias("home_team"),
                           mid.cast("string").alias("away_team"), F.col("home_score").cast("string").alias("home_score"), F.col("away_score").cast("string").alias("away_score"), "tournament", F.col("neutral").cast("string").alias("neutral"))
    path = shared_dir(t.spark)
    raw.write.csv(path, header=True)
    m = RD.read_matches(t.spark, path, "results")
    return m.select(F.col("away_team").cast("bigint").alias("match_id"), F.date_format("date", "yyyy-MM-dd").alias("day"), "home_team", "away_team",
                    F.col("home_score").cast("double").alias("home_score"), F.col("away_score").cast("double").alias("away_score"), "neutral")


@query("read_league_csv", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_custkey % 7 AS INT) AS home_score, CAST(o_orderkey % 5 AS INT) AS away_score FROM orders")
def _(t):
    a, b = F.col("o_custkey") % 7, F.col("o_orderkey") % 5
    raw = t.orders.select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date"), F.col("o_orderkey").cast("string").alias("HomeTeam"), F.col("o_custkey").cast("string").alias("AwayTeam"),
                          a.alias("FTHG"), b.alias("FTAG"), F.when(a > b, "H").when(a == b, "D").otherwise("A").alias("FTR"))
    path = shared_dir(t.spark)
    raw.write.csv(path, header=True)
    m = RD.read_matches(t.spark, path, "league")
    return m.select(F.col("home_team").cast("bigint").alias("o_orderkey"), F.date_format("date", "yyyy-MM-dd").alias("day"), "home_score", "away_score")


def _csv(t, raw, layout):
    path = shared_dir(t.spark)
    raw.write.csv(path, header=True)
    return RD.read_matches(t.spark, path, layout)


@query("read_results_full_csv", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_custkey % 7 AS INT) AS home_score, CAST(o_orderkey % 5 AS INT) AS away_score, 'C' || o_custkey % 11 AS city, 'K' || o_custkey % 3 AS country, o_orderkey % 2 = 0 AS neutral FROM orders""")
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = t.orders.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), k.cast("string").alias("home_team"), c.cast("string").alias("away_team"), (c % 7).alias("home_score"), (k % 5).alias("away_score"),
        F.lit("Cup").alias("tournament"), F.concat(F.lit("C"), c % 11).alias("city"), F.concat(F.lit("K"), c % 3).alias("country"), (k % 2 == 0).alias("neutral"))
    m = _csv(t, raw, "results_full")
    return m.select(F.col("home_team").cast("bigint").alias("o_orderkey"), F.date_format("date", "yyyy-MM-dd").alias("day"), "home_score", "away_score", "city", "country", "neutral")


@query("read_league_round_csv", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_custkey % 7 AS INT) AS home_score, CAST(o_orderkey % 5 AS INT) AS away_score, o_orderpriority AS tournament, 'R' || o_orderkey % 38 AS round FROM orders")
def _(t):
    a, b = F.col("o_custkey") % 7, F.col("o_orderkey") % 5
    raw = t.orders.select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date"), F.col("o_orderkey").cast("string").alias("HomeTeam"), F.col("o_custkey").cast("string").alias("AwayTeam"), a.alias("FTHG"), b.alias("FTAG"),
        F.when(a > b, "H").when(a == b, "D").otherwise("A").alias("FTR"), F.col("o_orderpriority").alias("Competition"), F.concat(F.lit("R"), F.col("o_orderkey") % 38).alias("Round"))
    m = _csv(t, raw, "league_round")
    return m.select(F.col("home_team").cast("bigint").alias("o_orderkey"), F.date_format("date", "yyyy-MM-dd").alias("day"), "home_score", "away_score", "tournament", "round")


@query("read_json_records", "SELECT CAST(s_suppkey AS VARCHAR) AS entity, s_name AS name, #2[s_acctbal]# AS rating FROM supplier")
def _(t):
    """Arrays of records, one array a file part."""
    s = t.supplier.select(F.col("s_suppkey").cast("string").alias("entity"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("rating"))
    path = shared_dir(t.spark)
    arrays = s.groupBy(F.floor(F.col("entity").cast("bigint") / 100).alias("_file")).agg(F.to_json(F.collect_list(F.struct("entity", "name", "rating"))).alias("value"))
    arrays.write.partitionBy("_file").text(path)
    return r(RD.read_records(t.spark, f"{path}/*", SC.struct(entity=SC._s, name=SC._s, rating=SC._d)), "rating", digits=2)


@query("read_events_parquet", "SELECT event_id, user_id, #[value]# AS value FROM events WHERE event_type = 'purchase'")
def _(t):
    return r(RD.read_events(t.spark, f"{t.sf_dir}/events.parquet", ["event_id", "user_id", "value", "event_type"]).filter("event_type = 'purchase'").drop("event_type"), "value")


@query("read_json_entity_map", "SELECT CAST(s_suppkey AS VARCHAR) AS entity, s_name AS name, #2[s_acctbal]# AS rating FROM supplier")
def _(t):
    s = t.supplier.select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("rating"))
    path = shared_dir(t.spark)
    SK.to_entity_map(s, "entity", F.floor(F.col("entity") / 100)).write.text(path)
    return r(RD.read_entity_map(t.spark, path, SC.struct(name=SC._s, rating=SC._d), per_line=True), "rating", digits=2)


@query("write_feature_store", "SELECT team_id % 24 AS team_id, feature_name, #[feature_value]# AS feature_value, source_id, strftime(feature_ts, '%Y-%m') AS year_month FROM features", "features")
def _(t):
    path = shared_dir(t.spark)
    SK.save_features(t.features.withColumn("team_id", F.col("team_id") % 24), path)
    return r(RD.read_feature_store(t.spark, path).select(F.col("team_id").cast("bigint").alias("team_id"), "feature_name", "feature_value", "source_id", "year_month"), "feature_value")


def squads(t):
    """Snapshots of 24 clubs with several squads each: partition directories stay few at every scale."""
    return t.snapshots.withColumns({"squad_id": F.col("team_id"), "team_id": F.col("team_id") % 24})


@query("write_partitioned_layouts", """
SELECT 'matches' AS layout, CAST(year(kickoff_ts) AS INT) AS year, CAST(day(kickoff_ts) AS INT) AS part, count(*) AS n, CAST(sum(match_id) AS BIGINT) AS ids FROM matches WHERE month(kickoff_ts) = 1 GROUP BY 1, 2, 3
UNION ALL SELECT 'features', CAST(year(feature_ts) AS INT), length(feature_name)::INT, count(*), CAST(sum(source_id) AS BIGINT) FROM features GROUP BY feature_name, 2, 3
UNION ALL SELECT 'snapshots', CAST(year(announced_ts) AS INT), CAST(team_id % 24 AS INT), count(*), CAST(sum(len(players)) AS BIGINT) FROM snapshots GROUP BY 2, 3""", "matches features snapshots")
def _(t):
    base = shared_dir(t.spark)
    SK.write_layout(t.matches.select("match_id", "kickoff_ts", "pool"), "matches", f"{base}/m", "kickoff_ts")
    SK.write_layout(t.features, "features", f"{base}/f", "feature_ts")
    SK.write_layout(squads(t), "snapshots", f"{base}/s", "announced_ts")
    n = F.count(F.lit(1)).alias("n")
    read = t.spark.read.parquet
    m = read(f"{base}/m").filter("month = 1").groupBy("year", F.col("day").alias("part")).agg(n, F.sum("match_id").alias("ids")).withColumn("layout", F.lit("matches"))
    f = read(f"{base}/f").groupBy("feature_name", "year", F.length("feature_name").alias("part")).agg(n, F.sum("source_id").alias("ids")).drop("feature_name").withColumn("layout", F.lit("features"))
    s = read(f"{base}/s").groupBy("year", F.col("team_id").cast("int").alias("part")).agg(n, F.sum(F.size("players")).alias("ids")).withColumn("layout", F.lit("snapshots"))
    return m.unionByName(f).unionByName(s)


@query("append_snapshots", "SELECT team_id, strftime(announced_ts, '%Y-%m-%d') AS day, len(players)::INT AS n_players, 2::BIGINT AS copies, TRUE AS same_id FROM snapshots", "snapshots")
def _(t):
    path = shared_dir(t.spark)
    s = t.snapshots.withColumn("source", F.lit("events"))
    SK.append_snapshots(s, path)
    SK.append_snapshots(s, path)  # a retry repeats the ids
    log = t.spark.read.parquet(path)
    return log.groupBy("team_id", F.date_format("announced_ts", "yyyy-MM-dd").alias("day")).agg(
        F.max(F.size("players")).alias("n_players"), F.count(F.lit(1)).alias("copies"), (F.min("snapshot_id") == F.max("snapshot_id")).alias("same_id"))


@query("export_ratings", f"WITH {CAP} SELECT pool, team, #3[arg_max(rt, rn)]# AS rating, 'tournament_cap' AS rules, '1.0' AS version FROM (SELECT pool, home AS team, post_h AS rt, rn FROM elo UNION ALL SELECT pool, away, post_a, rn FROM elo) GROUP BY 1, 2", "matches", recursive=True)
def _(t):
    path = shared_dir(t.spark)
    SK.export_ratings(R.final_ratings(R.elo_fold(t.matches, R.TOURNAMENT_CAP)).select("pool", "team", "rating"), path, {"rules": "tournament_cap", "version": "1.0"})
    return RD.load_ratings(t.spark, path).withColumn("rating", rnd("rating", 3))


@query("export_report_tables", f"""WITH {_ROSTER}
SELECT 'squads' AS report, count(*) AS n_rows, CAST(sum(age) AS BIGINT) AS total FROM roster UNION ALL SELECT 'players', count(*), CAST(sum(age) AS BIGINT) FROM roster
UNION ALL SELECT 'group_summary', count(DISTINCT "group"), count(*) FILTER (position = 'Portero') FROM roster UNION ALL SELECT 'confederation_summary', count(DISTINCT confederation), count(*) FILTER (position = 'Defensa') FROM roster
UNION ALL SELECT 'age_distribution', count(DISTINCT "group"), CAST(sum(mx) AS BIGINT) FROM (SELECT "group", max(age) OVER (PARTITION BY "group") / count(*) OVER (PARTITION BY "group") AS mx FROM roster)
UNION ALL SELECT 'metadata', 1, count(*) FROM roster""", "roster_raw")
def _(t):
    base = shared_dir(t.spark)
    SK.export_reports(roster(t), base, ["Portero", "Defensa", "Mediocampista", "Delantero"])
    totals = {"squads": "age", "players": "age", "group_summary": "Portero", "confederation_summary": "Defensa", "age_distribution": "max", "metadata": "players"}
    out = None
    for name, c in totals.items():
        one = t.spark.read.parquet(f"{base}/{name}").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(c).cast("bigint").alias("total")).withColumn("report", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("write_eval_records", "SELECT match_id, pool, actual, #[p_home]# AS p_home FROM predictions", "predictions")
def _(t):
    path = shared_dir(t.spark)
    SK.write_records(t.predictions.select("match_id", "pool", "actual", "p_home"), path, ["pool"])
    return r(t.spark.read.parquet(path), "p_home")


@query("compact_snapshots", "SELECT team_id % 24 AS team_id, team_id AS squad_id, strftime(announced_ts, '%Y-%m-%d') AS day, len(players)::INT AS n_players FROM snapshots WHERE announced_ts < TIMESTAMP '2024-02-10' - INTERVAL 25 DAY", "snapshots")
def _(t):
    base = shared_dir(t.spark)
    SK.write_layout(squads(t), "snapshots", f"{base}/raw", "announced_ts")
    SK.compact_snapshots(t.spark, f"{base}/raw", f"{base}/compact", 25, "2024-02-10")
    return t.spark.read.parquet(f"{base}/compact").select(F.col("team_id").cast("bigint").alias("team_id"), "squad_id", F.date_format("announced_ts", "yyyy-MM-dd").alias("day"), F.size("players").alias("n_players"))


@query("dataset_fingerprint", "SELECT count(*) AS n_rows, TRUE AS same_when_reordered, TRUE AS differs_when_changed FROM lineitem")
def _(t):
    """The fingerprint beside those of the same rows in another order and of rows of which one differs."""
    rows = t.lineitem
    first = rows.agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("_k"))
    hit = (F.col("l_orderkey") == F.col("_k.l_orderkey")) & (F.col("l_linenumber") == F.col("_k.l_linenumber"))
    changed = with_one_row(rows, first).withColumn("l_quantity", F.when(hit, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))).select(*rows.columns)
    named = lambda df, n: SK.fingerprint(df).select(F.struct("n_rows", "hash_xor", "hash_sum").alias(n))
    out = with_one_row(with_one_row(named(rows, "a"), named(rows.repartition("l_partkey"), "b")), named(changed, "c"))
    return out.select("a.n_rows", (F.col("a") == F.col("b")).alias("same_when_reordered"), (F.col("a") != F.col("c")).alias("differs_when_changed"))
