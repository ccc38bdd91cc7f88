"""Cleaning, projections, predicates and scalar derivations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col, lookup, top_pick, with_one_row
from .quantiles import exact_quantiles

CRITICAL = ["date", "home_team", "away_team", "home_score", "away_score"]

# alias -> canonical team name (fixed values)
TEAM_ALIASES = {
    "United States": "USA",
    "IR Iran": "Iran",
    "Korea Republic": "South Korea",
    "Korea DPR": "North Korea",
    "Côte d'Ivoire": "Ivory Coast",
    "Congo DR": "DR Congo",
    "Cape Verde Islands": "Cape Verde",
    "China PR": "China",
    "Kyrgyz Republic": "Kyrgyzstan",
    "North Macedonia": "Macedonia",
    "Czech Republic": "Czechia",
    "Slovak Republic": "Slovakia",
    "Bosnia-Herzegovina": "Bosnia and Herzegovina",
    "Trinidad and Tobago": "Trinidad & Tobago",
    "Saint Kitts and Nevis": "St. Kitts and Nevis",
    "São Tomé and Príncipe": "Sao Tome and Principe",
}


def clean_matches(raw: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Parse, drop rows lacking a critical value, type the scores, default ``neutral`` to false.

    Order is left to the sinks: a global sort here would only be thrown away by the next shuffle.
    """
    date = F.try_to_timestamp(col("date").cast("string"), F.lit(date_format)).cast("date")
    out = raw.withColumn("date", date).dropna(subset=CRITICAL)
    score = lambda c: F.expr(f"try_cast({c} AS double)").cast("int")
    out = out.withColumns({"home_score": score("home_score"), "away_score": score("away_score")}).dropna(subset=CRITICAL)
    return out.withColumn("neutral", F.coalesce(F.expr("try_cast(neutral AS boolean)"), F.lit(False)))


def normalize_names(df: DataFrame, cols: list[str], aliases: DataFrame | dict[str, str]) -> DataFrame:
    """Replace aliases by canonical names. A dict becomes a map literal; an alias table is joined per column."""
    if isinstance(aliases, dict):
        return df.withColumns({c: F.coalesce(lookup(aliases, F.col(c)), F.col(c)) for c in cols})
    for c in cols:
        a = aliases.select(F.col("alias").alias(c), F.col("canonical").alias("_to"))
        df = df.join(a, c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return df


# ---- competitions ----------------------------------------------------------------------------------

# class -> K weight (fixed values)
CLASS_K = {"Mundial": 60, "CopaContinental": 45, "Eliminatoria": 50, "Amistoso": 30}

# keywords of continental finals (fixed values)
CONTINENTAL = [
    "uefa european championship", "copa america", "africa cup of nations", "afc asian cup",
    "concacaf gold cup", "ofc nations cup", "arab cup", "nations league",
]

# keywords of qualifiers (fixed values)
QUALIFIER = ["qualification", "qualifying", "world cup", "euro", "olympic", "confederations cup", "nations league", "copa america"]


def _any_in(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def classify_competition(df: DataFrame, name: str = "tournament") -> DataFrame:
    """Competition class by ordered keyword rules, and its K weight; NULL is a friendly."""
    t = F.lower(F.col(name))
    qualifying = F.contains(t, F.lit("qualification")) | F.contains(t, F.lit("qualifying"))
    cls = (F.when(t.isNull(), "Amistoso").when(F.contains(t, F.lit("fifa world cup")) & ~qualifying, "Mundial")
           .when(_any_in(t, CONTINENTAL) & ~qualifying, "CopaContinental").when(_any_in(t, QUALIFIER), "Eliminatoria").otherwise("Amistoso"))
    return df.withColumn("match_class", cls).withColumn("k_base", lookup(CLASS_K, F.col("match_class")))


# confederation -> countries (fixed values)
REGION_COUNTRIES = {
    "CONMEBOL": ["Argentina", "Brazil", "Uruguay", "Chile", "Paraguay", "Bolivia", "Peru", "Ecuador", "Colombia", "Venezuela"],
    "UEFA": ["Germany", "France", "Spain", "Italy", "England", "Netherlands", "Portugal", "Belgium", "Croatia", "Switzerland",
             "Austria", "Poland", "Ukraine", "Russia", "Turkey", "Czech Republic"],
    "CONCACAF": ["Mexico", "United States", "Canada", "Costa Rica", "Panama", "Jamaica", "Honduras", "El Salvador", "Guatemala"],
    "AFC": ["Japan", "South Korea", "Australia", "Iran", "Saudi Arabia", "UAE", "Qatar", "China", "Iraq", "Oman"],
    "CAF": ["Egypt", "Nigeria", "South Africa", "Morocco", "Algeria", "Ivory Coast", "Ghana", "Senegal", "Tunisia", "Cameroon"],
    "OFC": ["New Zealand", "Fiji", "Papua New Guinea", "Solomon Islands"],
}

# confederation -> tournament patterns, in order (fixed values)
REGION_PATTERNS = {
    "CONMEBOL": ["Copa América", "CONMEBOL"],
    "UEFA": ["UEFA", "Euro"],
    "CONCACAF": ["CONCACAF", "Gold Cup"],
    "AFC": ["AFC", "Asian Cup"],
    "CAF": ["CAF", "Africa Cup"],
}


def assign_region(df: DataFrame, country: str = "country", tournament: str = "tournament", date: str = "date") -> DataFrame:
    """Confederation by country list, else by tournament text, else Unknown; and the four-year cycle of the date."""
    by_country = lookup({c: r for r, cs in REGION_COUNTRIES.items() for c in cs}, F.col(country))
    by_text = F.lit(None).cast("string")
    for region, words in reversed(REGION_PATTERNS.items()):
        by_text = F.when(_any_in(F.col(tournament), words), region).otherwise(by_text)
    cycle = F.when(F.year(date).between(2023, 2026), "2026").otherwise("unknown")
    return df.withColumn("confederation", F.coalesce(by_country, by_text, F.lit("Unknown"))).withColumn("cycle", cycle)


def filter_date_range(df: DataFrame, ts: str, start: str, end: str, columns: list[str], inclusive: bool = True) -> DataFrame:
    """Rows of a date window and a fixed projection; both reach the scan."""
    kind = dict(df.dtypes)[ts]
    lo, hi = F.lit(start).cast(kind), F.lit(end).cast(kind)
    cond = F.col(ts) >= lo
    return df.filter(cond & ((F.col(ts) <= hi) if inclusive else (F.col(ts) < hi))).select(*columns)


def derive_match_columns(df: DataFrame) -> DataFrame:
    """Outcome in {1,0,-1}, letter, class label {0 home, 1 draw, 2 away}, goals, difference and one-hot columns."""
    gd = F.col("home_score") - F.col("away_score")
    o = F.signum(gd.cast("double")).cast("int")
    return df.withColumns({
        "outcome": o, "result": F.when(gd > 0, "H").when(gd == 0, "D").otherwise("A"), "label": 1 - o,
        "total_goals": F.col("home_score") + F.col("away_score"), "goal_diff": gd,
        "is_home_win": (gd > 0).cast("int"), "is_draw": (gd == 0).cast("int"), "is_away_win": (gd < 0).cast("int")})


def impute(df: DataFrame, constants: dict[str, float] | None = None, medians: list[str] | None = None, finite: list[str] | None = None) -> DataFrame:
    """Drop rows with infinite or NaN values in ``finite``; fill the rest with constants or column medians."""
    for c in finite or []:
        x = F.col(c)
        df = df.filter(x.isNull() | ~(F.isnan(x) | x.isin(float("inf"), float("-inf"))))
    if constants:
        df = df.fillna(constants)
    for c in medians or []:
        med = exact_quantiles(df, [], c, {"_median": 0.5})  # always one row
        df = with_one_row(df, med).withColumn(c, F.coalesce(c, "_median")).drop("_median")
    return df


# ---- rosters ---------------------------------------------------------------------------------------

# position code -> class (fixed values)
POSITION_CLASS = {
    "GK": "Portero", "GOALKEEPER": "Portero", "PORTERO": "Portero", "PORT": "Portero",
    "DF": "Defensa", "DEFENDER": "Defensa", "DEFENSA": "Defensa", "DEF": "Defensa",
    "CB": "Defensa", "LB": "Defensa", "RB": "Defensa", "LWB": "Defensa", "RWB": "Defensa",
    "MF": "Mediocampista", "MIDFIELDER": "Mediocampista", "MEDIOCAMPISTA": "Mediocampista", "MID": "Mediocampista",
    "AM": "Mediocampista", "CM": "Mediocampista", "DM": "Mediocampista",
    "FW": "Delantero", "FORWARD": "Delantero", "DELANTERO": "Delantero", "FWD": "Delantero",
    "ST": "Delantero", "LW": "Delantero", "RW": "Delantero", "CF": "Delantero",
}
DEFAULT_POSITION = "Mediocampista"
DEFAULT_AGE = 26


def clean_roster(df: DataFrame, countries: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Normalise raw roster rows and keep one row per (country, player): the first in ``order``.

    ``countries`` (country, group, confederation) fills the lookups; unknown countries get 'X' and 'UEFA'.
    """
    name = F.initcap(F.trim(F.translate("player_raw", "[]", "")))
    club = F.initcap(F.trim(F.translate("club_raw", "()[]", "")))
    position = lookup(POSITION_CLASS, F.upper(F.regexp_replace("position_raw", "[^A-Za-z]", "")), DEFAULT_POSITION)
    age = F.expr("try_cast(age_raw AS int)")
    age = F.when(age.between(16, 45), age).otherwise(DEFAULT_AGE)
    jersey = F.coalesce(F.col("jersey_number_raw").cast("int"), F.lit(0)) if "jersey_number_raw" in df.columns else F.lit(0)
    status = F.col("squad_status") if "squad_status" in df.columns else F.lit("Final")
    first = F.col(order) if order else F.struct("position_raw", "club_raw", "age_raw")
    out = df.select("country", name.alias("player"), position.alias("position"), club.alias("club"), age.alias("age"),
                    jersey.alias("jersey_number"), status.alias("squad_status"), first.alias("_o"))
    rest = ["position", "club", "age", "jersey_number", "squad_status"]
    out = out.groupBy("country", "player").agg(F.min_by(F.struct(*rest), "_o").alias("r")).select("country", "player", "r.*")
    if countries is not None:
        out = out.join(countries, "country", "left").withColumns(
            {"group": F.coalesce("group", F.lit("X")), "confederation": F.coalesce("confederation", F.lit("UEFA"))})
    return out


def roster_features(df: DataFrame) -> DataFrame:
    """Model-ready roster: final-squad flag and numeric columns with defaults."""
    return df.withColumns({
        "is_final_squad": (F.col("squad_status") == "Final").cast("int"),
        "age": F.coalesce(F.expr("try_cast(age AS double)"), F.lit(float(DEFAULT_AGE))),
        "jersey_number": F.coalesce(F.expr("try_cast(jersey_number AS double)"), F.lit(0.0))})


# page keywords (fixed values)
FINAL_WORDS = ["final squad", "lista final", "convocatoria definitiva"]
PRELIMINARY_WORDS = ["preliminary", "preliminar", "lista preliminar"]


def page_status(text: str | Column) -> Column:
    """Final / Preliminar by keyword over the whole text; Final when neither is mentioned."""
    t = F.lower(col(text))
    return F.when(_any_in(t, FINAL_WORDS), "Final").when(_any_in(t, PRELIMINARY_WORDS), "Preliminar").otherwise("Final")


# ---- contracts and integrity -----------------------------------------------------------------------

# feature -> (min, max, nullable) (fixed values)
FEATURE_CONTRACTS = {
    "continuity_index": (0.0, 1.0, False),
    "continuity_defense": (0.0, 1.0, False),
    "continuity_midfield": (0.0, 1.0, False),
    "continuity_forward": (0.0, 1.0, False),
    "squad_size": (0.0, 50.0, False),
    "squad_size_delta": (-50.0, 50.0, False),
}


def apply_contracts(df: DataFrame, contracts: dict[str, tuple[float, float, bool]], name: str = "feature_name", value: str = "feature_value") -> DataFrame:
    """Add ``is_valid``: value within the contract of its feature; a feature without contract passes."""
    bounds = {f: F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.lit(n).alias("nullable")) for f, (lo, hi, n) in contracts.items()}
    found = F.try_element_at(F.create_map(*[x for f, s in bounds.items() for x in (F.lit(f), s)]), F.col(name))
    v = F.col(value)
    ok = F.when(v.isNull() | F.isnan(v), v.isNull() & found["nullable"]).otherwise(v.between(found["lo"], found["hi"]))
    return df.withColumn("is_valid", F.when(found.isNull(), True).otherwise(ok))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that meet their contract, and the quarantine."""
    return df.filter("is_valid"), df.filter(~F.col("is_valid"))


def snapshot_valid(df: DataFrame, key: str = "team_id", name: str | None = None, source: str | None = None) -> DataFrame:
    """Add ``is_valid``: positive id, non-blank name and source, at least one player, every player named and placed."""
    filled = lambda c: c.isNotNull() & (F.trim(c) != "")
    ok = (F.col(key) > 0) & (F.size("players") > 0) & F.forall("players", lambda p: filled(p["name"]) & filled(p["position"]))
    for c in (name, source):
        if c:
            ok = ok & filled(F.col(c))
    return df.withColumn("is_valid", F.coalesce(ok, F.lit(False)))


# ---- verdicts --------------------------------------------------------------------------------------


def verdict(df: DataFrame, labels: tuple[str, str, str] = ("home", "draw", "away"), probs: tuple[str, str, str] = ("p_home", "p_draw", "p_away")) -> DataFrame:
    """Headline pick: balanced when the top two are within .05, advantage when .12 apart and the top is .45 or more."""
    # ties keep the order of the labels
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(F.col(p).alias("p"), F.lit(-i).alias("o"), F.lit(n).alias("label")) for i, (p, n) in enumerate(zip(probs, labels))])))
    df = df.withColumn("_r", ranked)
    r = [F.col("_r")[i] for i in range(3)]
    gap = r[0]["p"] - r[1]["p"]
    return df.withColumns({
        "verdict": F.when(gap < 0.05, "balanced").otherwise(r[0]["label"]), "confidence": r[0]["p"],
        "advantage": (gap >= 0.12) & (r[0]["p"] >= 0.45), "second": r[1]["label"], "third": r[2]["label"]}).drop("_r")


def pick(df: DataFrame) -> DataFrame:
    """Most likely outcome (1 / 0 / -1) and its probability."""
    p = [F.col(c) for c in ("p_home", "p_draw", "p_away")]
    return df.withColumns({"pick": top_pick(*p), "confidence": F.greatest(*p)})
