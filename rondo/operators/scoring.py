"""Batch scoring: outcome probabilities, adjustments and flags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import add, clip, col, lookup
from . import rating as R


def outcome(home: str = "home_score", away: str = "away_score") -> Column:
    return F.signum((F.col(home) - F.col(away)).cast("double")).cast("int")


# ---- rating to probabilities ---------------------------------------------------------------------


def draw_probability(e: Column, rating_gap: Column, rule: str) -> Column:
    """Draw probability from the expected score (or rating gap) under one of the published rules."""
    edge = F.abs(e - 0.5)
    if rule == "parity":
        return clip(0.24 * (1 - edge * 1.2), 0.08, 0.30)
    if rule == "linear":
        return clip(0.28 - 0.30 * edge, 0.08, 0.30)
    if rule == "gap":
        return 0.30 - F.least(F.abs(rating_gap) / 200.0, F.lit(0.25))
    raise ValueError(rule)


def three_way(e: Column, gap: Column, rule: str) -> tuple[Column, Column, Column]:
    """(home, draw, away) from the expected score; ``rule='fixed'`` gives both sides 80 % of their expectation."""
    pd = F.lit(1.0) - 0.8 if rule == "fixed" else draw_probability(e, gap, rule)
    return e * (1 - pd), pd, (1 - e) * (1 - pd)


def elo_probs(df: DataFrame, rule: str = "linear", home: str = "rating_home", away: str = "rating_away", bonus: Column | float = 100.0) -> DataFrame:
    """Add p_home, p_draw, p_away from two ratings."""
    lift = bonus if isinstance(bonus, Column) else F.when(F.col("neutral"), 0.0).otherwise(float(bonus))
    gap = col(home) - col(away)
    df = df.withColumn("_e", R.elo_expected(gap + lift))
    return normalise(df.withColumns(dict(zip(("p_home", "p_draw", "p_away"), three_way(F.col("_e"), gap, rule)))).drop("_e"))


def elo_probs_by_rule(df: DataFrame, rules: list[str], home: str = "rating_home", away: str = "rating_away", bonus: float = 100.0) -> DataFrame:
    """All draw rules side by side in long form (column ``rule``), in one pass."""
    gap = col(home) - col(away)
    df = df.withColumn("_e", R.elo_expected(gap + F.when(F.col("neutral"), 0.0).otherwise(bonus)))
    sets = [F.struct(F.lit(r).alias("rule"), *[c.alias(n) for n, c in zip(("p_home", "p_draw", "p_away"), three_way(F.col("_e"), gap, r))]) for r in rules]
    keep = [c for c in df.columns if c != "_e"]
    return normalise(df.select(*keep, F.explode(F.array(*sets)).alias("_s")).select(*keep, "_s.*"))


def normalise(df: DataFrame, cols: tuple[str, str, str] = ("p_home", "p_draw", "p_away")) -> DataFrame:
    total = add([F.col(c) for c in cols])
    return df.withColumns({c: F.col(c) / total for c in cols})


def prequential_records(matches: DataFrame, rules: R.Rules, rule: str = "linear", tag: str = "elo", **fold) -> DataFrame:
    """Prediction of every match from the ratings before it, with its outcome: free of leakage by construction."""
    folded = R.elo_fold(matches, rules, **fold).select("match_id", F.col("pre_h").alias("rating_home"), F.col("pre_a").alias("rating_away"))
    m = matches.select("match_id", "kickoff_ts", "pool", "home", "away", "tournament", "neutral", outcome().alias("actual"))
    scored = elo_probs(m.join(folded, "match_id"), rule, bonus=rules.home_bonus)
    return scored.withColumns({"elo_diff": F.col("rating_home") - F.col("rating_away"), "model_tag": F.lit(tag)})


# ---- goals model ---------------------------------------------------------------------------------

GOALS_PER_MATCH = 2.8
MAX_GOALS = 12


def poisson_lambdas(df: DataFrame, home: str = "rating_home", away: str = "rating_away") -> DataFrame:
    """Expected goals of both sides from rating strengths, home factor and motivation. Needs neutral, is_friendly."""
    share = R.elo_expected(col(home) - col(away))
    factor = F.when(F.col("neutral"), 1.0).when(F.col("is_friendly"), 1.15).otherwise(1.35)
    motivation = F.when(F.col("is_friendly") & ~F.col("neutral"), 0.85).otherwise(1.0)
    return df.withColumns({"lambda_home": share * GOALS_PER_MATCH * factor, "lambda_away": (1 - share) * GOALS_PER_MATCH / factor * motivation})


def poisson_probs(df: DataFrame, lam_home: str = "lambda_home", lam_away: str = "lambda_away") -> DataFrame:
    """Outcome probabilities over the goal grid 0..11 x 0..11.

    A chain of small projections walks the goals k of both sides and carries the running sums: a win adds h_k times
    the away sum below k, and so on. The 144 cells are never formed and the chain compiles to straight-line code.
    """
    keep = [f"`{c}`" for c in df.columns if c not in P3]
    out = df.selectExpr(*keep, f"`{lam_home}` AS _x", f"`{lam_away}` AS _y", f"exp(-`{lam_home}`) AS _h", f"exp(-`{lam_away}`) AS _a")
    out = out.selectExpr(*keep, "_x", "_y", "_h", "_a", "_h AS _ch", "_a AS _ca", "0D AS p_home", "_h * _a AS p_draw", "0D AS p_away")
    for k in range(1, MAX_GOALS):
        out = out.selectExpr(*keep, "_x", "_y", f"_h * _x / {k} AS _h", f"_a * _y / {k} AS _a", "_ch", "_ca", *P3)
        out = out.selectExpr(*keep, "_x", "_y", "_h", "_a", "_ch + _h AS _ch", "_ca + _a AS _ca",
                             "p_home + _h * _ca AS p_home", "p_draw + _h * _a AS p_draw", "p_away + _a * _ch AS p_away")
    return normalise(out.selectExpr(*keep, *P3))


def form_adjust(df: DataFrame) -> DataFrame:
    """Rating points from form: consistency (ppg), goal difference and momentum; 0 without form."""
    adj = F.round(F.col("ppg") * 20.0 + F.col("gd_avg") * 15.0 + F.col("form_last_5") * 30.0, 1)
    return df.withColumn("form_adj", F.coalesce(adj, F.lit(0.0))).withColumn("rating_adj", F.col("rating") + F.col("form_adj"))


# ---- schedule adjustments ------------------------------------------------------------------------

# form steps (above, adjustment) for gains and losses of rating (fixed values)
FORM_STEPS = [(0.20, 0.08), (0.10, 0.05), (0.03, 0.02)]

# confederation -> (form, schedule) adjustment of teams without schedule data (fixed values)
REGION_BASELINE = {
    "CONMEBOL": (0.03, 0.03),
    "UEFA": (0.00, 0.00),
    "CAF": (0.00, -0.02),
    "AFC": (-0.02, -0.02),
    "CONCACAF": (-0.03, -0.03),
    "OFC": (-0.05, -0.05),
}


def sos_adjust(df: DataFrame, sos: DataFrame, name: str = "team", prob: str = "p") -> DataFrame:
    """Probability adjusted for rating trend and schedule difficulty of the team, kept in .05-.95.

    ``sos``: team, delta_elo, sos_score, games. Names match regardless of case and blanks; NULL adjusts by 0.
    """
    s = sos.select(F.lower(F.trim("team")).alias("_k"), "delta_elo", "sos_score", "games")
    out = df.join(s, F.lower(F.trim(F.col(name))) == F.col("_k"), "left")
    d = F.col("delta_elo") * F.when(F.col("games") < 4, 0.5).otherwise(1.0)
    form = F.lit(0.0)
    for above, adj in reversed(FORM_STEPS):
        form = F.when(d > above, adj).when(d < -above, -adj).otherwise(form)
    x = F.col("sos_score")
    sched = F.when(x < 0.20, 0.05).when(x < 0.35, 0.03).when(x > 0.75, -0.05).when(x > 0.65, -0.03).otherwise(0.0)
    out = out.withColumns({"form_adjustment": F.coalesce(form, F.lit(0.0)), "schedule_adjustment": sched})
    adjusted = clip(F.col(prob) + F.col("form_adjustment") + F.col("schedule_adjustment"), 0.05, 0.95)
    return out.withColumn("p_adjusted", adjusted).drop("_k", "delta_elo", "sos_score", "games")


def region_baseline(df: DataFrame, region: str = "confederation") -> DataFrame:
    """Default adjustments per confederation; 0 elsewhere."""
    return df.withColumns({
        "form_adjustment": lookup({k: v[0] for k, v in REGION_BASELINE.items()}, F.col(region), 0.0),
        "schedule_adjustment": lookup({k: v[1] for k, v in REGION_BASELINE.items()}, F.col(region), 0.0)})


# ---- indices and baselines -----------------------------------------------------------------------


def match_indices(df: DataFrame, home: str = "rating_home", away: str = "rating_away") -> DataFrame:
    """Expected-goal proxies, duel power, pressure index and goal contributions of a match."""
    gap = col(home) - col(away)
    local = F.when(F.col("neutral"), 1.0).otherwise(1.15)
    xg = lambda g, lift: clip(1.2 * lift * F.exp(0.002 * g), 0.3, 3.5)
    xgc_h, xgc_a = F.col("p_home") * (1 + gap / 2000), F.col("p_away") * (1 - gap / 2000)
    return df.withColumns({
        "xg_home": xg(gap, local), "xg_away": xg(-gap, F.lit(1.0)),
        "duel_home": clip(50 + (col(home) - 1500) / 30, 0, 100), "duel_away": clip(50 + (col(away) - 1500) / 30, 0, 100),
        "pressure_home": 100 / (1 + F.exp(-gap / 150)), "pressure_away": 100 / (1 + F.exp(gap / 150)),
        "xgc_home": clip(xgc_h, 0, 1), "xgc_away": clip(xgc_a, 0, 1), "xgc_total": (xgc_h + xgc_a) / 2})


def baseline_probs(df: DataFrame, p_win: Column) -> DataFrame:
    """Three-way probabilities from one win score: draw .25, the rest lost, renormalised."""
    w = df.withColumn("_w", p_win)
    lose = F.greatest(F.lit(0.0), 1 - F.col("_w") - 0.25)
    return normalise(w.withColumns({"p_home": F.col("_w"), "p_draw": F.lit(0.25), "p_away": lose}).drop("_w"))


def form_score(home: str = "form_home", away: str = "form_away") -> Column:
    return clip(F.col(home) / (F.col(home) + F.col(away) + 1e-9), 0.1, 0.9)


def h2h_score(h2h: str = "h2h") -> Column:
    return clip(F.col(h2h), 0.1, 0.9)


def bet_value(df: DataFrame, prob: str = "prob", odds: str = "odds", edge: float = 0.02) -> DataFrame:
    """Implied probability, edge, expected return and whether the edge is worth a bet."""
    implied = 1 / F.col(odds)
    return df.withColumns({"implied": implied, "edge": F.col(prob) - implied,
                           "expected_roi": F.col(prob) * (F.col(odds) - 1) - (1 - F.col(prob)), "is_bet": F.col(prob) - implied > edge})


# ---- probability transforms ----------------------------------------------------------------------

P3 = ("p_home", "p_draw", "p_away")


def draw_factor(df: DataFrame, factor: float | Column) -> DataFrame:
    """Scale the draw probability and renormalise."""
    f = factor if isinstance(factor, Column) else F.lit(factor)
    return normalise(df.withColumn("p_draw", F.col("p_draw") * f))


def smooth_motivation(df: DataFrame, motivation: float = 0.85) -> DataFrame:
    """Pull probabilities towards one third, as for friendlies."""
    return normalise(df.withColumns({p: F.col(p) * motivation + (1 - motivation) / 3 for p in P3}))


def align_probs(df: DataFrame, array: str, classes: list[int], target: tuple[int, ...] = (-1, 0, 1), eps: float = 1e-12) -> DataFrame:
    """Reorder a class-probability array to ``target``, fill missing classes, clip and renormalise."""
    picked = [clip(F.col(array)[classes.index(c)] if c in classes else F.lit(eps), eps, 1 - eps) for c in target]
    df = df.withColumn("_p", F.array(*picked))
    total = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("aligned", F.transform("_p", lambda x: x / total)).drop("_p")


def blend_probs(df: DataFrame, a: str, b: str, alpha: float | Column) -> DataFrame:
    """alpha x first + (1 - alpha) x second set of probabilities (column prefixes), normalised."""
    w = alpha if isinstance(alpha, Column) else F.lit(alpha)
    return normalise(df.withColumns({p: w * F.col(a + p) + (1 - w) * F.col(b + p) for p in P3}))


def temper(df: DataFrame, temperature: float | Column, eps: float = 1e-12, out: str = "") -> DataFrame:
    """softmax(ln p / T)."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    raised = {f"_t_{p}": F.exp(F.ln(clip(F.col(p), eps, 1 - eps)) / t) for p in P3}
    df = df.withColumns(raised)
    total = add([F.col(f"_t_{p}") for p in P3])
    return df.withColumns({out + p: F.col(f"_t_{p}") / total for p in P3}).drop(*raised)


def apply_uplift(df: DataFrame, lam: str, betas: dict[str, float], intercept: float = 0.0) -> DataFrame:
    """Expected goals times exp(intercept + sum of beta x feature)."""
    return df.withColumn("lambda_adjusted", F.col(lam) * F.exp(add([F.lit(intercept), *[F.lit(b) * F.col(f) for f, b in betas.items()]])))


def uplift_status(df: DataFrame, betas: dict[str, float], enabled: bool = True, shadow: bool = True, lam: str = "lambda_base",
                  kickoff: str = "kickoff_ts", feature_ts: str = "feature_ts") -> DataFrame:
    """Failsafe gates in order: leakage, flag off, missing or non-numeric approved feature, bad lambda; then the uplift.

    ``betas`` holds the approved features. Features and lambda may be text. Adds status, baseline, uplifted, shadow_uplifted.
    """
    nums = {f"_f_{f}": F.expr(f"try_cast(`{f}` AS double)") for f in betas}
    df = df.withColumns(nums).withColumn("_l", F.expr(f"try_cast(`{lam}` AS double)"))
    missing = [F.col(c).isNull() for c in nums]
    any_missing = missing[0]
    for m in missing[1:]:
        any_missing = any_missing | m
    status = (F.when(F.col(feature_ts) >= F.col(kickoff), "FAILSAFE_LEAKAGE").when(F.lit(not enabled), "BASELINE_ONLY")
              .when(any_missing, "FAILSAFE_MISSING_DATA").when(F.col("_l").isNull(), "FAILSAFE_ERROR").otherwise("SHADOW" if shadow else "PRODUCTION"))
    lifted = F.col("_l") * F.exp(add([F.lit(b) * F.col(f"_f_{f}") for f, b in betas.items()]))
    df = df.withColumns({"status": status, "baseline": F.col("_l")})
    live = F.col("status").isin("SHADOW", "PRODUCTION")
    return df.withColumns({
        "uplifted": F.when(F.col("status") == "PRODUCTION", lifted).otherwise(F.col("_l")),
        "shadow_uplifted": F.when(live, lifted)}).drop("_l", *nums)


def inconsistency_flags(df: DataFrame, gap: str = "rating_diff") -> DataFrame:
    """Where probabilities contradict the rating gap: array of flags, and its size."""
    top = F.greatest(*[F.col(p) for p in P3])
    g = F.abs(F.col(gap))
    flags = F.array_compact(F.array(
        F.when((g > 150) & (top < 0.40), "low_confidence_wide_gap"),
        F.when((F.col("p_draw") > F.col("p_home")) & (F.col("p_draw") > F.col("p_away")) & (g > 100), "draw_favourite_wide_gap"),
        F.when((g > 200) & (top < 0.38), "caution")))
    return df.withColumn("flags", flags).withColumn("n_flags", F.size("flags"))
