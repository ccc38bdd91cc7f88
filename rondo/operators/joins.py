"""Point-in-time joins, enrichment, membership and fixture checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import lookup
from .slices import MOST, SLICE, Unit, add_slice


def _asof(events: DataFrame, right: DataFrame, values: list[str], key: str, left_ts: str, event_id: str, strict: bool, unit: Unit) -> DataFrame:
    """``events`` plus, per struct column in ``values``, its last non-null value among the ``right`` rows of the key before the event.

    ``right`` has columns _k, _ts, _id and the values. One pass: both sides are united and a window keeps the last value
    seen, per (key, slice); a slice of a hot key starts from the last values of earlier slices. Events are never multiplied and
    no range join is built. Events without a key or a time know nothing: they keep NULL values and take no part in the windows.
    """
    placed = F.col(key).isNotNull() & F.col(left_ts).isNotNull()
    unplaced = events.filter(~placed).select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    events, right = events.filter(placed), right.filter(F.col("_k").isNotNull() & F.col("_ts").isNotNull())
    before_event, after_event = (0, 1) if strict else (1, 0)
    types = {v: right.schema[v].dataType for v in values}
    payload = F.struct(*[F.col(c) for c in events.columns])
    left = events.select(F.col(key).cast(right.schema["_k"].dataType).alias("_k"), F.col(left_ts).cast("timestamp_ntz").alias("_ts"), F.lit(before_event).alias("_side"),
                         F.col(event_id).cast("bigint").alias("_id"), payload.alias("_e"), *[F.lit(None).cast(types[v]).alias(v) for v in values])
    right = right.select("_k", "_ts", F.lit(after_event).alias("_side"), "_id", F.lit(None).cast(left.schema["_e"].dataType).alias("_e"), *values)
    sliced = add_slice(left.unionByName(right), ["_k"], "_ts", unit)
    inside = Window.partitionBy("_k", SLICE).orderBy("_ts", "_side", "_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = {v: F.last(v, ignorenulls=True).over(inside) for v in values}
    out = sliced.rows
    if not sliced.whole:
        # what each slice ends with; events have no values of their own but their slices get a carry too
        ends = sliced.of_hot_keys().groupBy("_k", SLICE).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.struct("_ts", "_id"))).alias(f"_v_{v}") for v in values])
        before = Window.partitionBy("_k").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.select("_k", SLICE, *[F.last(f"_v_{v}", ignorenulls=True).over(before).alias(f"_c_{v}") for v in values])
        out = out.join(sliced.small(carry), ["_k", SLICE], "left")
        seen = {v: F.coalesce(c, F.col(f"_c_{v}")) for v, c in seen.items()}
    out = out.select("_e", *[c.alias(v) for v, c in seen.items()])
    return out.filter(F.col("_e").isNotNull()).select("_e.*", *values).unionByName(unplaced)


def asof_row(events: DataFrame, rows: DataFrame, columns: list[str], name: str = "row", key: str = "team_id", left_ts: str = "kickoff_ts", right_ts: str = "announced_ts",
             event_id: str = "match_id", tie: str | None = None, strict: bool = True, unit: Unit = MOST) -> DataFrame:
    """Each event with the latest row of its key before it, as one struct of ``columns``. ``tie`` orders rows of one instant."""
    right = rows.select(F.col(key).alias("_k"), F.col(right_ts).cast("timestamp_ntz").alias("_ts"), (F.col(tie) if tie else F.lit(0)).cast("bigint").alias("_id"), F.struct(*columns).alias(name))
    return _asof(events, right, [name], key, left_ts, event_id, strict, unit)


def asof_wide(events: DataFrame, features: DataFrame, names: list[str], key: str = "team_id", left_ts: str = "kickoff_ts", right_ts: str = "feature_ts",
              event_id: str = "match_id", source_id: str = "source_id", strict: bool = True, unit: Unit = MOST) -> DataFrame:
    """Each event with, per requested feature, the latest (value, ts, id) of its key before the event, as structs ``f_<name>``."""
    ts, sid = F.col(right_ts).cast("timestamp_ntz"), F.col(source_id).cast("bigint")
    value = F.struct(F.col("feature_value").cast("double").alias("value"), ts.alias("ts"), sid.alias("id"))
    right = features.filter(F.col("feature_name").isin(names)).select(
        F.col(key).alias("_k"), ts.alias("_ts"), sid.alias("_id"), *[F.when(F.col("feature_name") == n, value).alias(f"f_{n}") for n in names])
    return _asof(events, right, [f"f_{n}" for n in names], key, left_ts, event_id, strict, unit)


def asof_join(events: DataFrame, features: DataFrame, names: list[str], **options) -> DataFrame:
    """As ``asof_wide`` in long form: one row per event and requested feature, NULL value when there is none yet."""
    wide = asof_wide(events, features, names, **options)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("feature_name"), F.col(f"f_{n}").alias("f")) for n in names]))
    return wide.select(*events.columns, rows.alias("r")).select(
        *events.columns, "r.feature_name", F.col("r.f.value").alias("feature_value"), F.col("r.f.ts").alias("feature_ts"), F.col("r.f.id").alias("source_id"))


def latest_before(df: DataFrame, keys: list[str], order: list[str], cutoff: str | Column) -> DataFrame:
    """Newest row per key strictly before a cut-off, as an aggregate."""
    ts = order[0]
    kind = dict(df.dtypes)[ts]
    limit = cutoff if isinstance(cutoff, Column) else F.lit(cutoff).cast(kind)
    rest = [c for c in df.columns if c not in keys]
    return df.filter(F.col(ts) < limit).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def _match_sides(matches: DataFrame, extra: list[str]) -> DataFrame:
    sides = F.explode(F.array(F.struct(F.col("home").cast("bigint").alias("team_id"), F.lit("h").alias("side")),
                              F.struct(F.col("away").cast("bigint").alias("team_id"), F.lit("a").alias("side")))).alias("_s")
    return matches.select("match_id", "kickoff_ts", *extra, sides).select("match_id", "kickoff_ts", *extra, "_s.*")


def _pivot_sides(long: DataFrame, cols: list[str]) -> DataFrame:
    """Home and away rows back to one row per match."""
    def side(s: str) -> list[Column]:
        return [F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{'home' if s == 'h' else 'away'}_{c}") for c in cols]

    return long.groupBy("match_id").agg(*side("h"), *side("a"))


def two_sided_asof(matches: DataFrame, snaps: DataFrame, unit: Unit = MOST) -> DataFrame:
    """Latest snapshot (team_id, announced_ts, value) before kickoff for home and away; matches lacking either side are dropped."""
    long = asof_row(_match_sides(matches, []), snaps, ["announced_ts", "value"], "snap", unit=unit)
    long = long.select("match_id", "side", "kickoff_ts", F.col("snap.announced_ts").alias("snapshot_ts"), F.col("snap.value").alias("value"))
    long = long.withColumn("valid", F.col("snapshot_ts") < F.col("kickoff_ts"))
    out = _pivot_sides(long, ["snapshot_ts", "value", "valid"])
    return out.filter(F.col("home_snapshot_ts").isNotNull() & F.col("away_snapshot_ts").isNotNull())


# neutral values of a team without squad data (fixed values)
NEUTRAL = {"squad_size": 23.0, "continuity_index": 1.0, "defenders_continuity": 1.0, "midfielders_continuity": 1.0, "forwards_continuity": 1.0, "squad_size_delta": 0.0}


def enrich_matches(matches: DataFrame, squads: DataFrame, unit: Unit = MOST) -> DataFrame:
    """home_/away_ squad features (wide, as of ``squad_continuity``) as known at kickoff; all neutral when either side has none; and their differences."""
    names = list(NEUTRAL)
    long = asof_row(_match_sides(matches, []), squads, names, "squad", unit=unit)
    long = long.select("match_id", "side", F.col("squad").isNotNull().alias("known"), *[F.col(f"squad.{n}").cast("double").alias(n) for n in names])
    wide = _pivot_sides(long, ["known", *names])
    both = F.col("home_known") & F.col("away_known")
    filled = {f"{s}_{n}": F.when(both, F.col(f"{s}_{n}")).otherwise(F.lit(v)) for s in ("home", "away") for n, v in NEUTRAL.items()}
    wide = wide.withColumns(filled)
    return wide.withColumns({"continuity_diff": F.col("home_continuity_index") - F.col("away_continuity_index"),
                             "squad_size_diff": F.col("home_squad_size") - F.col("away_squad_size")}).drop("home_known", "away_known")


def validated_view(matches: DataFrame, features: DataFrame, snaps: DataFrame) -> DataFrame:
    """Features of a match with their snapshot, computed before kickoff. Keys: match_id, snapshot_id."""
    return (features.join(matches.select("match_id", "kickoff_ts"), "match_id").filter(F.col("computed_ts") < F.col("kickoff_ts"))
            .join(snaps, "snapshot_id").withColumn("anti_leakage_valid", F.lit(True)))


def master_dataset(matches: DataFrame, weather: DataFrame, ranking: DataFrame, strength: DataFrame) -> DataFrame:
    """Matches with weather of (date, city), ranking of both sides at the date and team strength, plus derived columns."""
    out = matches.join(weather, ["date", "city_id"], "left")
    for side in ("home", "away"):
        r = ranking.select(F.col("team").alias(side), "date", F.col("rank").alias(f"rank_{side}"))
        s = strength.select(F.col("team").alias(side), F.col("xg").alias(f"xg_{side}"))
        out = out.join(r, [side, "date"], "left").join(s, side, "left")
    xg = {f"xg_{s}": F.coalesce(f"xg_{s}", F.lit(0.0)) for s in ("home", "away")}
    out = out.withColumns(xg)
    low = F.col("temp_min") if "temp_min" in weather.columns else F.col("temp_max")
    return out.withColumns({
        "temp_avg": (F.col("temp_max") + low) / 2, "adverse": (F.coalesce(F.col("temp_max") > 30, F.lit(False)) | F.coalesce(F.col("precip") > 10, F.lit(False))).cast("int"),
        "rank_diff": F.col("rank_home") - F.col("rank_away"), "xg_diff": F.col("xg_home") - F.col("xg_away")})


def semi_known(matches: DataFrame, teams: DataFrame, key: str = "team") -> DataFrame:
    """Matches whose both sides are known."""
    t = teams.select(F.col(key).alias("_t"))
    return matches.join(t, F.col("home") == F.col("_t"), "left_semi").join(t, F.col("away") == F.col("_t"), "left_semi")


def missing_entities(fixtures: DataFrame, teams: DataFrame, key: str = "team") -> DataFrame:
    """Sides of the fixtures that the dimension lacks, with the number of fixtures they play."""
    sides = fixtures.select(F.explode(F.array("home", "away")).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n_fixtures"))
    return sides.join(teams.select(key), key, "left_anti")


def coverage(fixtures: DataFrame, teams: DataFrame, key: str = "team") -> DataFrame:
    """Share of distinct sides that the dimension knows; one row."""
    sides = fixtures.select(F.explode(F.array("home", "away")).alias(key)).distinct()
    known = teams.select(key, F.lit(1).alias("_k")).dropDuplicates([key])
    return sides.join(known, key, "left").agg(F.count(F.lit(1)).alias("entities"), F.count("_k").alias("known"), (F.count("_k") / F.count(F.lit(1))).alias("coverage"))


def upsert_ratings(base: DataFrame, updates: DataFrame, key: str, value: str = "rating") -> DataFrame:
    """Updated values win, missing keys are inserted, the rest stays."""
    u = updates.select(key, F.col(value).alias("_new"))
    return base.join(u, key, "full").withColumn(value, F.coalesce("_new", value)).drop("_new")


def _grams(name: str) -> Column:
    """Numbered 2-grams, so that a repeated gram counts as often as it occurs."""
    g = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substring(F.col(name), i, F.lit(2)))
    return F.transform(g, lambda x, i: F.concat_ws("~", x, F.size(F.filter(F.slice(g, 1, i), lambda y: y == x)).cast("string")))


def fuzzy_match(left: DataFrame, right: DataFrame, name: str = "name", value: str = "rating", aliases: dict[str, str] | None = None,
                cutoff: float = 0.75, default: float = 1200.0) -> DataFrame:
    """Exact name, else alias, else the most similar name with 1 - levenshtein / longer length >= cutoff, else the default.

    Only distinct names without exact hit are compared. A pair within the cutoff differs by at most d edits, so of its
    2-grams the 2d+1 rarest of either side must share one (prefix filter): common grams are never joined on unless
    a name has nothing rarer. Candidates are checked exactly.
    """
    names = left.select(name).distinct()
    canon = F.coalesce(lookup(aliases, F.col(name)), F.col(name)) if aliases else F.col(name)
    names = names.withColumn("_n", canon)
    dim = right.select(F.col(name).alias("_n"), F.col(value).alias("_v"))
    hit = names.join(dim, "_n", "left").withColumn("method", F.when(F.col("_v").isNotNull(), F.when(F.col("_n") == F.col(name), "exact").otherwise("alias")))
    rest = hit.filter(F.col("method").isNull()).select(name, F.col("_n").alias("a"))
    freq = dim.select(F.explode(_grams("_n")).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("f"))

    def prefix(df: DataFrame, text: str) -> DataFrame:
        edits = F.floor(F.length(text) * ((1 - cutoff) / cutoff))  # the partner may be longer
        g = df.select(text, F.explode(_grams(text)).alias("g")).join(freq, "g", "left")
        ranked = g.withColumn("_r", F.row_number().over(Window.partitionBy(text).orderBy(F.coalesce("f", F.lit(0)), "g")))  # one row per gram of a name
        return ranked.filter(F.col("_r") <= 2 * edits + 1).select(text, "g")

    pairs = prefix(rest, "a").join(prefix(dim.withColumnRenamed("_n", "b"), "b"), "g").select("a", "b").distinct()
    longer = F.greatest(F.length("a"), F.length("b"))
    scored = pairs.withColumn("similarity", 1 - F.levenshtein("a", "b") / longer).filter(F.col("similarity") >= cutoff)
    best = scored.groupBy("a").agg(F.max("similarity").alias("similarity"), F.min_by("b", F.struct(-F.col("similarity"), F.col("b"))).alias("b"))
    best = best.join(dim.withColumnRenamed("_n", "b"), "b").select("a", "b", F.col("_v").alias("_fv"), "similarity")
    out = hit.join(best, hit["_n"] == best["a"], "left")
    return out.select(
        name, F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(F.col("b")).alias("matched"),
        F.coalesce("method", F.when(F.col("b").isNotNull(), "fuzzy"), F.lit("default")).alias("method"),
        F.coalesce("_v", "_fv", F.lit(default)).alias(value))


def rating_diff(matches: DataFrame, ratings: DataFrame, default: float = 1200.0, bonus: float = 100.0) -> DataFrame:
    """Home minus away rating, plus the home bonus unless neutral; unknown teams get the default."""
    h = ratings.select(F.col("team").alias("home"), F.col("rating").alias("_h"))
    a = ratings.select(F.col("team").alias("away"), F.col("rating").alias("_a"))
    diff = F.coalesce("_h", F.lit(default)) - F.coalesce("_a", F.lit(default)) + F.when(F.col("neutral"), 0.0).otherwise(bonus)
    return matches.join(h, "home", "left").join(a, "away", "left").withColumn("rating_diff", diff).drop("_h", "_a")


def union_dedupe(batches: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Concatenate batches; per natural key the row of the earliest batch wins. Combined before the shuffle."""
    tagged = None
    for i, b in enumerate(batches):
        b = b.withColumn("_batch", F.lit(i))
        tagged = b if tagged is None else tagged.unionByName(b)
    rest = [c for c in batches[0].columns if c not in keys]
    return tagged.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_batch", *order)).alias("_r")).select(*keys, "_r.*")


def entity_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every distinct entity of two tables with membership flags and the set it belongs to."""
    x = a.select(key, F.lit(True).alias("in_a"), F.lit(False).alias("in_b"))
    y = b.select(key, F.lit(False).alias("in_a"), F.lit(True).alias("in_b"))
    out = x.unionByName(y).groupBy(key).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return out.withColumn("side", F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "only_a").otherwise("only_b"))


def fixture_view(df: DataFrame, phase: str | None = None, group: str | None = None, matchday: int | None = None) -> DataFrame:
    """Fixtures of a phase / group / matchday in kickoff order."""
    for c, v in (("phase", phase), ("group", group), ("matchday", matchday)):
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df.orderBy("chrono_order")


def fixture_checks(df: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Rows (check, value, ok): matches per phase, gap-free order 1..N, and next matches that do not exist."""
    entries = [F.struct(F.concat(F.lit("phase_"), F.lit(p)).alias("check"), F.count_if(F.col("phase") == p).alias("value"),
                        (F.count_if(F.col("phase") == p) == n).alias("ok")) for p, n in expected.items()]
    n = F.count(F.lit(1))
    gap_free = (F.min("chrono_order") == 1) & (F.max("chrono_order") == n) & (F.count_distinct("chrono_order") == n)
    entries += [F.struct(F.lit("total").alias("check"), n.alias("value"), (n == sum(expected.values())).alias("ok")),
                F.struct(F.lit("order_gap_free").alias("check"), F.count_distinct("chrono_order").alias("value"), gap_free.alias("ok"))]
    counts = df.agg(F.array(*entries).alias("e")).select(F.explode("e").alias("e")).select("e.*")
    orphans = df.filter(F.col("next_match").isNotNull()).select(F.col("next_match").alias("_id")).join(df.select(F.col("match_id").alias("_id")), "_id", "left_anti")
    fk = orphans.agg(F.count(F.lit(1)).alias("value")).select(F.lit("next_match_orphans").alias("check"), "value", (F.col("value") == 0).alias("ok"))
    return counts.unionByName(fk)
