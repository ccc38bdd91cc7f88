"""Aggregations, pivots and top-k tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import add, count_if, share
from .quantiles import exact_quantiles
from .windows import ORDER, TEAM, newest, team_long

# values of a team without matches (fixed values)
NO_FORM = {"points": 0.5, "gf_avg": 1.0, "ga_avg": 1.0, "win_rate": 0.33}


def recent_form(matches: DataFrame, n: int = 5, teams: DataFrame | None = None) -> DataFrame:
    """Points per match scaled to 0..1, goal averages and win rate over each team's last n matches.

    ``teams`` (pool, team) adds neutral rows for teams without matches. The rank filter runs before the shuffle too.
    """
    last = newest(team_long(matches), TEAM, ORDER, n)
    pts3 = F.when(F.col("gf") > F.col("ga"), 3.0).when(F.col("gf") == F.col("ga"), 1.0).otherwise(0.0)
    out = last.groupBy(*TEAM).agg((F.avg(pts3) / 3).alias("points"), F.avg("gf").alias("gf_avg"), F.avg("ga").alias("ga_avg"),
                                  share(F.col("gf") > F.col("ga")).alias("win_rate"), F.count(F.lit(1)).alias("n"))
    if teams is not None:
        out = teams.join(out, TEAM, "left").fillna(NO_FORM | {"n": 0})
    return out


def h2h_summary(matches: DataFrame) -> DataFrame:
    """Record of every pair of teams regardless of who hosts; ``lo`` is the smaller id."""
    gd = F.col("home_score") - F.col("away_score")
    flip = F.col("home") > F.col("away")
    lo_gd = F.when(flip, -gd).otherwise(gd)
    rows = matches.select(F.least("home", "away").alias("lo"), F.greatest("home", "away").alias("hi"), lo_gd.alias("gd"),
                          F.when(flip, F.col("away_score")).otherwise(F.col("home_score")).alias("lo_goals"),
                          F.when(flip, F.col("home_score")).otherwise(F.col("away_score")).alias("hi_goals"))
    return rows.groupBy("lo", "hi").agg(share(F.col("gd") > 0).alias("lo_win_rate"), share(F.col("gd") < 0).alias("hi_win_rate"), share(F.col("gd") == 0).alias("draw_rate"),
                                        F.avg("lo_goals").alias("lo_goals_avg"), F.avg("hi_goals").alias("hi_goals_avg"), F.count(F.lit(1)).alias("n"))


def rating_report(ratings: DataFrame, form: DataFrame, n: int = 20, keys: tuple[str, ...] = ("team",)) -> DataFrame:
    """Top n by rating (ties by key) with their form."""
    top = ratings.orderBy(F.col("rating").desc(), *keys).limit(n)
    return top.join(form, list(keys), "left")


def form_table(matches: DataFrame, as_of: str, n: int = 12, months: int = 12) -> DataFrame:
    """Wins, draws, losses, points per game (3/1/0), goals and form of the last n matches within the last months.

    form_k is points of the last k matches over 3k; fewer matches lower it only through the matches played.
    """
    kind = dict(matches.dtypes)["kickoff_ts"]
    end = F.lit(as_of).cast(kind)
    rows = team_long(matches.filter((F.col("kickoff_ts") < end) & (F.col("kickoff_ts") >= end - F.make_interval(months=F.lit(months)))))
    last = newest(rows, TEAM, ORDER, n)
    p3 = F.when(F.col("gf") > F.col("ga"), 3.0).when(F.col("gf") == F.col("ga"), 1.0).otherwise(0.0)

    def form(k: int) -> Column:
        return F.avg(F.when(F.col("rn") <= k, p3)) / 3

    return last.groupBy(*TEAM).agg(
        count_if(F.col("gf") > F.col("ga")).alias("wins"), count_if(F.col("gf") == F.col("ga")).alias("draws"), count_if(F.col("gf") < F.col("ga")).alias("losses"),
        F.avg(p3).alias("ppg"), F.avg("gf").alias("gf_avg"), F.avg("ga").alias("ga_avg"), F.avg(F.col("gf") - F.col("ga")).alias("gd_avg"),
        form(5).alias("form_last_5"), form(10).alias("form_last_10"), F.count(F.lit(1)).alias("n"))


def weighted_form(matches: DataFrame, ratings: DataFrame, elite: float, n: int = 12, min_elite: int = 4) -> DataFrame:
    """Form weighted by opponent rating over the last n matches: sum(points x rating) / sum(rating).

    Few matches against elite opponents (rating >= ``elite``) mark the figure as low confidence.
    """
    last = newest(team_long(matches), TEAM, ORDER, n)
    opp = ratings.select(F.col("team").alias("opp"), F.col("rating").alias("opp_rating"))
    rows = last.join(opp, "opp")
    elite_n = count_if(F.col("opp_rating") >= elite)
    return rows.groupBy(*TEAM).agg(F.count(F.lit(1)).alias("n_total"), elite_n.alias("n_elite"),
                                   (F.sum(F.col("pts") * F.col("opp_rating")) / F.sum("opp_rating")).alias("f_exig"), (elite_n < min_elite).alias("is_low_conf"))


def team_strength(players: DataFrame, nationality: str, stats: list[str], teams: DataFrame | None = None) -> DataFrame:
    """Mean of player statistics per nationality; 0 for teams without players."""
    out = players.groupBy(nationality).agg(*[F.avg(s).alias(s) for s in stats])
    return out if teams is None else teams.select(nationality).distinct().join(out, nationality, "left").fillna(0.0, stats)


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and column value, one column per value, 0 where absent. Values are given: no extra pass."""
    return df.groupBy(row).pivot(column, values).count().fillna(0)


def group_stats(df: DataFrame, key: str, value: str, digits: int = 1) -> DataFrame:
    """mean / median / min / max / sample std per group, rounded."""
    basic = df.groupBy(key).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_samp(value).alias("std"))
    out = basic.join(exact_quantiles(df, [key], value, {"median": 0.5}), key)
    return out.select(key, *[F.round(F.col(c).cast("double"), digits).alias(c) for c in ("mean", "median", "min", "max", "std")])


def dataset_profile(df: DataFrame, categories: list[str], numbers: list[str]) -> DataFrame:
    """(feature, n, n_distinct, min, max, mean, std): counts for categories, moments for numbers. Two passes, no sort."""
    null = F.lit(None).cast("double")
    cats = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in categories])
    distinct = df.select(F.explode(cats).alias("e")).select("e.*").groupBy("feature", "v").agg(F.count(F.lit(1)).alias("c"))
    top = distinct.groupBy("feature").agg(F.sum("c").alias("n"), F.count("v").alias("n_distinct")).select(
        "feature", "n", "n_distinct", *[null.alias(c) for c in ("min", "max", "mean", "std")])
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("bigint").alias("n_distinct"), F.min(c).cast("double").alias("min"),
                                 F.max(c).cast("double").alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")) for c in numbers])
    return top.unionByName(df.agg(entries.alias("e")).select(F.explode("e").alias("e")).select("e.*"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def standings(results: DataFrame) -> DataFrame:
    """Group table: points, goal difference, goals for, rank by those (ties by team)."""
    sides = F.explode(F.array(
        F.struct(F.col("home").alias("team"), F.col("home_score").alias("gf"), F.col("away_score").alias("ga")),
        F.struct(F.col("away").alias("team"), F.col("away_score").alias("gf"), F.col("home_score").alias("ga")))).alias("s")
    rows = results.select("grp", sides).select("grp", "s.*")
    p3 = F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)
    table = rows.groupBy("grp", "team").agg(F.sum(p3).alias("points"), F.sum(F.col("gf") - F.col("ga")).alias("gd"), F.sum("gf").alias("gf"), F.count(F.lit(1)).alias("played"))
    w = Window.partitionBy("grp").orderBy(F.col("points").desc(), F.col("gd").desc(), F.col("gf").desc(), "team")  # one row per team
    return table.withColumn("rank", F.row_number().over(w))


def best_thirds(table: DataFrame, k: int = 8, rank: int = 3) -> DataFrame:
    """The k best teams placed ``rank``-th in their groups."""
    return table.filter(F.col("rank") == rank).orderBy(F.col("points").desc(), F.col("gd").desc(), F.col("gf").desc(), "grp").limit(k)


def store_metrics(features: DataFrame, now: str, key: str = "team_id", value: str = "feature_value", ts: str = "feature_ts") -> DataFrame:
    """Audit of a feature store: rows, distinct teams, NULL values, rows dated in the future. Per-team counts first, so the distinct count has no expand."""
    future = F.col(ts) > F.lit(now).cast(dict(features.dtypes)[ts])
    per = features.groupBy(key).agg(F.count(F.lit(1)).alias("n"), count_if(F.col(value).isNull()).alias("nulls"), count_if(future).alias("future"))
    return per.agg(F.sum("n").alias("total_records"), F.count(key).alias("unique_teams"), F.sum("nulls").alias("null_values"), F.sum("future").alias("future_rows"))


def betting_yield(bets: DataFrame) -> DataFrame:
    """Stake, return, profit, yield in percent and wins of a betting history; one row."""
    won = F.col("result") == "ganada"
    out = bets.agg(F.sum("stake").alias("total_stake"), F.sum(F.when(won, F.col("stake") * F.col("odds")).otherwise(0.0)).alias("total_return"),
                   count_if(won).alias("wins"), F.count(F.lit(1)).alias("n_bets"))
    profit = F.col("total_return") - F.col("total_stake")
    return out.withColumn("profit", profit).withColumn("yield_pct", F.when(F.col("total_stake") > 0, F.col("profit") / F.col("total_stake") * 100).otherwise(0.0))


def class_distribution(df: DataFrame, label: str = "actual") -> DataFrame:
    """Outcome counts and shares."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # at most three rows
    return counts.withColumn("share", F.col("n") / total)


def naive_baselines(df: DataFrame, label: str = "actual") -> DataFrame:
    """Accuracy of always-home, always-away, majority and proportional guessing (expected value); one row."""
    p = {v: F.avg(F.when(F.col(label) == v, 1.0).otherwise(0.0)) for v in (1, 0, -1)}
    return df.agg(p[1].alias("always_home"), p[-1].alias("always_away"), F.greatest(*p.values()).alias("majority"), add([x * x for x in p.values()]).alias("random"))
