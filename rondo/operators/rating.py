"""Sequential ratings: every match reads two ratings that earlier matches of the pool wrote.

Within a pool this is a chain, so no window or aggregate expresses it. The fold is a stream over rows that
Spark has partitioned by (pool, variant, group of teams) and sorted by (time, id); a task keeps one Arrow batch and one
rating per team of the group, never its matches. A pool with many matches is cut into slices that are folded one after
the other, each of them once, by as many tasks as it has groups of teams that don't meet (``elo_fold``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import epoch_us
from ..session import dimension, persist_table, shared_dir
from .slices import SLICE, add_slice

# K by keyword, matched longest keyword first (fixed values)
K_BY_TOURNAMENT = {
    "FIFA World Cup": 60,
    "UEFA European Championship": 45,
    "Copa America": 45,
    "Africa Cup of Nations": 45,
    "AFC Asian Cup": 45,
    "CONCACAF Gold Cup": 45,
    "FIFA World Cup qualification": 50,
    "UEFA Euro qualification": 40,
    "UEFA Nations League": 38,
    "CONCACAF Nations League": 35,
    "Friendly": 25,
}
K_OTHER = 35


def tournament_k(tournament: str | Column = "tournament", longest_first: bool = True) -> Column:
    """K of a tournament; ``longest_first=False`` keeps the listing order, where a short name hides a longer one."""
    text = F.lower(F.col(tournament) if isinstance(tournament, str) else tournament)
    names = sorted(K_BY_TOURNAMENT, key=len, reverse=True) if longest_first else list(K_BY_TOURNAMENT)
    out = None
    for name in names:
        cond = F.contains(text, F.lit(name.lower()))
        out = F.when(cond, float(K_BY_TOURNAMENT[name])) if out is None else out.when(cond, float(K_BY_TOURNAMENT[name]))
    return out.otherwise(float(K_OTHER))


@dataclass(frozen=True)
class Rules:
    """One rating variant.

    k: constant, or 'tournament'. margin: 'cap' x min(1+.1m, 2); 'linear' K+5(m-1); 'log' x (1+.1 ln(1+m)); 'none'.
    neutral: 'flag' drops the home bonus on neutral ground, 'ignore' keeps it. draws: 'half' or 'skip'.
    dampen: scale the margin bonus of the winner by 2.2 / (lead/1000 + 2.2).
    """

    name: str
    base: float = 1500.0
    home_bonus: float = 100.0
    k: float | str = 30.0
    margin: str = "none"
    neutral: str = "flag"
    draws: str = "half"
    dampen: bool = False


TOURNAMENT_CAP = Rules("tournament_cap", k="tournament", margin="cap")
CONSTANT_30 = Rules("constant_30", k=30.0)
CONSTANT_32 = Rules("constant_32", k=32.0, home_bonus=0.0)
LINEAR_MARGIN = Rules("linear_margin", k=20.0, home_bonus=80.0, margin="linear")
LOG_MARGIN = Rules("log_margin", k=30.0, home_bonus=0.0, margin="log")
GROUP_PHASE = Rules("group_phase", k=30.0, home_bonus=0.0, margin="log", draws="skip", dampen=True)


def elo_expected(diff: Column) -> Column:
    """Expected score of the side that leads by ``diff`` rating points, bonus included."""
    return 1 / (1 + F.pow(F.lit(10.0), -diff / 400.0))


def _inputs(matches: DataFrame, rules: Rules) -> list[Column]:
    margin = F.abs(F.col("home_score") - F.col("away_score"))
    k = tournament_k() if rules.k == "tournament" else F.lit(float(rules.k))
    extra = F.lit(0.0)
    if rules.margin == "cap":
        k = k * F.least(1 + margin * 0.1, F.lit(2.0))
    elif rules.margin == "linear":
        k = k + (margin - 1) * 5
    elif rules.margin == "log":
        extra = 0.1 * F.ln(margin + 1.0)
    bonus = F.lit(rules.home_bonus)
    if rules.neutral == "flag":
        bonus = F.when(F.col("neutral"), 0.0).otherwise(bonus)
    gd = F.col("home_score") - F.col("away_score")
    score = F.when(gd > 0, 1.0).when(gd < 0, 0.0)
    if rules.draws == "half":
        score = score.otherwise(0.5)
    return [F.lit(rules.name).alias("variant"), k.cast("double").alias("k"), extra.cast("double").alias("extra"),
            bonus.cast("double").alias("bonus"), score.alias("score"), F.lit(rules.base).alias("base"), F.lit(rules.dampen).alias("dampen")]


_GROUP = ["pool", "variant", "grp"]
_FOLD_IN = ["pool", "variant", "grp", "kind", "t", "match_id", "home", "away", "k", "extra", "bonus", "score", "base", "dampen", "seed"]
#: kind 1: a match; kind 2: what a team of a group ends with (home: the team, post_h: its rating)
_OUT = "kind int, pool string, variant string, match_id long, home int, away int, t long, pre_h double, pre_a double, post_h double, post_a double"
_MATCH_OUT = ["pool", "variant", "match_id", "home", "away", "t", "pre_h", "pre_a", "post_h", "post_a"]
MOST_ROWS = 1_000_000  # matches of a pool in one slice


def _spans(pdf: pd.DataFrame, group: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Row ranges of one group in a sorted batch."""
    n = len(pdf)
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for c in group:
        v = pdf[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(change).tolist() + [n]
    for lo, hi in zip(starts, starts[1:]):
        yield tuple(pdf[c].iat[lo] for c in group), lo, hi


def _walk(cols: dict[str, list], lo: int, hi: int, ratings: dict, played: dict, out: list[list[float]]) -> None:
    """Apply rows lo..hi in order to the ratings of one group."""
    pre_h, pre_a, post_h, post_a = out
    for i in range(lo, hi):
        h, base = cols["home"][i], cols["base"][i]
        if cols["kind"][i] == 0:  # a start rating
            ratings[h] = cols["seed"][i]
            continue
        a = cols["away"][i]
        rh, ra = ratings.get(h, base), ratings.get(a, base)
        s = cols["score"][i]
        nh, na = rh, ra
        if s == s:  # NaN marks a skipped draw
            gain = s - 1.0 / (1.0 + 10.0 ** (-(rh + cols["bonus"][i] - ra) / 400.0))
            extra = cols["extra"][i]
            if cols["dampen"][i]:
                lead = rh - ra if s == 1.0 else ra - rh
                extra *= 2.2 / (lead * 0.001 + 2.2)
            step = cols["k"][i] * gain * (1.0 + extra)
            nh, na = rh + step, ra - step
            ratings[h], ratings[a] = nh, na
        played[h] = played[a] = base
        pre_h.append(rh)
        pre_a.append(ra)
        post_h.append(nh)
        post_a.append(na)


def _lists(pdf: pd.DataFrame) -> dict[str, list]:
    return {c: pdf[c].tolist() for c in ("kind", "home", "away", "k", "extra", "bonus", "score", "base", "dampen", "seed")}


def _fold_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ratings around every match, and at the end of each group what its teams end with."""
    key, ratings, played = None, {}, {}

    def ends() -> pd.DataFrame:
        teams = sorted(played)  # after skipped draws only, a team still stands at its base
        rows = pd.DataFrame({"home": teams, "post_h": [ratings.get(x, played[x]) for x in teams]})
        rows[["kind", "pool", "variant", "match_id", "away", "t"]] = 2, key[0], key[1], 0, 0, 0
        return rows.assign(pre_h=0.0, pre_a=0.0, post_a=0.0)[columns]

    columns = ["kind", *_MATCH_OUT]
    for pdf in batches:
        if not len(pdf):
            continue
        cols, out = _lists(pdf), [[], [], [], []]
        for k, lo, hi in _spans(pdf, _GROUP):
            if k != key:
                if played:
                    yield ends()
                key, ratings, played = k, {}, {}
            _walk(cols, lo, hi, ratings, played, out)
        rows = pdf.loc[pdf["kind"].to_numpy() == 1, ["kind", "pool", "variant", "match_id", "home", "away", "t"]]
        yield rows.assign(pre_h=out[0], pre_a=out[1], post_h=out[2], post_a=out[3])[columns]
    if played:
        yield ends()


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per (pool, slice) the connected groups of teams, each named after its smallest team; one number per team is held."""
    key, parent = None, {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def groups() -> pd.DataFrame:
        teams = sorted(parent)
        return pd.DataFrame({"pool": key[0], "slice": key[1], "team": teams, "grp": [find(x) for x in teams]})

    for pdf in batches:
        if not len(pdf):
            continue
        home, away = pdf["home"].tolist(), pdf["away"].tolist()
        for k, lo, hi in _spans(pdf, ["pool", "slice"]):
            if k != key:
                if parent:
                    yield groups()
                key, parent = k, {}
            for h, a in zip(home[lo:hi], away[lo:hi]):
                x, y = find(h), find(a)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    if parent:
        yield groups()


def _fold(rows: DataFrame) -> DataFrame:
    return rows.select(*_FOLD_IN).repartition(*_GROUP).sortWithinPartitions(*_GROUP, "kind", "t", "match_id").mapInPandas(_fold_groups, _OUT)


def _match_rows(matches: DataFrame, rules: list[Rules]) -> DataFrame:
    """One row per match and variant with everything that does not depend on ratings."""
    per_rule = F.explode(F.array(*[F.struct(*_inputs(matches, r)) for r in rules]))
    return matches.select(
        F.col("pool").cast("string").alias("pool"), F.col("slice").cast("long").alias("slice"), F.lit(1).alias("kind"), epoch_us("kickoff_ts").alias("t"), F.col("match_id").cast("bigint").alias("match_id"),
        F.col("home").cast("int").alias("home"), F.col("away").cast("int").alias("away"), F.lit(None).cast("double").alias("seed"), per_rule.alias("r")).select(
        "pool", "slice", "r.variant", "kind", "t", "match_id", "home", "away", "r.k", "r.extra", "r.bonus", "r.score", "r.base", "r.dampen", "seed")


def _seed_rows(seeds: DataFrame) -> DataFrame:
    """Seeds (pool, variant, grp, team, rating) as rows that sort before the matches."""
    null = F.lit(None).cast("double")
    return seeds.select("pool", "variant", "grp", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("t"), F.lit(0).cast("bigint").alias("match_id"),
                        F.col("team").cast("int").alias("home"), F.lit(0).alias("away"), null.alias("k"), null.alias("extra"), null.alias("bonus"),
                        null.alias("score"), null.alias("base"), F.lit(False).alias("dampen"), F.col("rating").alias("seed"))


def _slices(matches: DataFrame, unit: str | None, most: int) -> tuple[DataFrame, bool]:
    """Matches with the number of their slice in the pool (in time order), and whether there is more than one slice."""
    if unit is None:
        sliced = add_slice(matches, ["pool"], "kickoff_ts", most)
        return sliced.rows.withColumnRenamed(SLICE, "slice"), not sliced.whole
    if matches.count() <= most:
        return matches.withColumn("slice", F.lit(0)), False
    day = F.date_trunc(unit, "kickoff_ts")
    units = matches.groupBy("pool", day.alias("_unit")).agg(F.count(F.lit(1)).alias("_n"))
    ended = F.sum("_n").over(Window.partitionBy("pool").orderBy("_unit").rowsBetween(Window.unboundedPreceding, 0))  # one row per calendar unit
    ranks = units.select(F.col("pool").alias("_pool"), "_unit", F.floor((ended - 1) / most).alias("slice"))
    here = F.col("pool").eqNullSafe(F.col("_pool")) & day.eqNullSafe(F.col("_unit"))
    return matches.join(dimension(ranks), here).drop("_pool", "_unit"), True


def elo_fold(matches: DataFrame, rules: Rules | list[Rules], seeds: DataFrame | None = None, unit: str | None = None, most: int = MOST_ROWS) -> DataFrame:
    """Ratings of both sides before and after every match: (pool, variant, match_id, home, away, t, pre_*, post_*).

    ``seeds`` (pool, team, rating) are ratings to start from; other teams start at the variant's base.

    Pools of up to ``most`` matches are folded by one task each. A larger one is cut into slices of about that many matches, at equi-depth points of its
    kickoffs (or where a calendar ``unit`` begins, units being joined up to ``most``). All pools' first slices are folded, then all second ones,
    and so on: every slice is folded once, when the ratings its teams start with are final. Teams that do not meet in a slice, even through
    others, are groups of their own and folded side by side. Between slices one rating per team is kept, and a round reads its own slice only.
    """
    rules = [rules] if isinstance(rules, Rules) else rules
    spark = matches.sparkSession
    sliced, several = _slices(matches, unit, most)
    rows = _match_rows(sliced, rules)
    first = None
    if seeds is not None:
        variants = F.explode(F.array(*[F.lit(r.name) for r in rules])).alias("variant")
        first = seeds.select(F.col("pool").cast("string").alias("pool"), variants, F.col("team").cast("int").alias("team"), F.col("rating").cast("double").alias("rating"))
    if not several:
        rows = rows.withColumn("grp", F.lit(0))
        whole = rows if first is None else rows.select(*_FOLD_IN).unionByName(_seed_rows(first.withColumn("grp", F.lit(0))))
        return _fold(whole).filter("kind = 1").select(*_MATCH_OUT)
    path = shared_dir(spark)
    rows.hint("rebalance", "slice").write.partitionBy("slice").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    teams = rows.filter(F.col("variant") == rules[0].name).select("pool", "slice", "home", "away").distinct()
    teams = persist_table(teams.repartition("pool", "slice").sortWithinPartitions("pool", "slice").mapInPandas(_meet, "pool string, slice long, team int, grp int"))
    state = persist_table(first if first is not None else spark.createDataFrame([], "pool string, variant string, team int, rating double"))
    folded = []
    team = lambda side: F.col("pool").eqNullSafe(F.col("_pool")) & (F.col(side) == F.col("_team"))
    for number in [r.slice for r in teams.select("slice").distinct().sort("slice").collect()]:  # as many as the largest pool has slices
        groups = teams.filter(F.col("slice") == number).select(F.col("pool").alias("_pool"), F.col("team").alias("_team"), "grp")
        now = rows.filter(F.col("slice") == number).join(groups, team("home")).select(*_FOLD_IN)
        known = state.join(groups, team("team")).select("pool", "variant", "grp", "team", "rating")
        done = persist_table(_fold(now.unionByName(_seed_rows(known))))
        folded.append(done.filter("kind = 1").select(*_MATCH_OUT))
        ends = done.filter("kind = 2").select("pool", "variant", F.col("home").alias("team"), F.col("post_h").alias("rating"))
        other = ends.select(F.col("pool").alias("_pool"), F.col("variant").alias("_variant"), F.col("team").alias("_team"))
        state = persist_table(state.join(other, team("team") & (F.col("variant") == F.col("_variant")), "left_anti").unionByName(ends))
    out = folded[0]
    for part in folded[1:]:
        out = out.unionByName(part)
    return out


def final_ratings(folded: DataFrame) -> DataFrame:
    """Last rating of every team: an aggregate with map-side combine."""
    sides = F.array(F.struct(F.col("home").alias("team"), F.col("post_h").alias("rating")), F.struct(F.col("away").alias("team"), F.col("post_a").alias("rating")))
    return (folded.select("pool", "variant", "t", "match_id", F.explode(sides).alias("s"))
            .groupBy("pool", "variant", F.col("s.team").alias("team"))
            .agg(F.max_by("s.rating", F.struct("t", "match_id")).alias("rating"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n")))


def refresh_ratings(stored: DataFrame, new_matches: DataFrame, rules: Rules, now: Column, min_age_hours: float = 6.0) -> DataFrame:
    """Fold only new matches onto stored ratings (pool, team, rating, updated_ts); pools refreshed lately stay as they are."""
    age = (epoch_us(now) - epoch_us("updated_ts")) / 3.6e9
    due = stored.groupBy("pool").agg(F.max("updated_ts").alias("updated_ts")).filter(age >= min_age_hours)
    fresh = new_matches.join(due.select("pool", F.col("updated_ts").alias("_since")), "pool").filter(F.col("kickoff_ts") > F.col("_since")).drop("_since")
    moved = final_ratings(elo_fold(fresh, rules, stored.select("pool", "team", "rating"))).select("pool", "team", F.col("rating").alias("new_rating"))
    return stored.join(moved, ["pool", "team"], "full").select(
        "pool", "team", F.coalesce("new_rating", "rating").alias("rating"), F.col("new_rating").isNotNull().alias("updated"))


def join_match(folded: DataFrame, matches: DataFrame, columns: list[str]) -> DataFrame:
    """Attach match columns to folded rows."""
    return folded.join(matches.select("match_id", *columns), "match_id")
