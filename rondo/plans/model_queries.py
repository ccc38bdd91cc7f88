"""Registered queries: model fitting, calibration and search grids."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import logloss_row, rnd, with_one_row
from ..session import persist_table
from ..operators import isotonic as ISO
from ..operators import models as MD
from ..operators import scoring as S
from ..operators import splits as SP
from .fit_sql import newton_sql
from .metric_queries import BR, PA, PICK, r
from .registry import query
from .scoring_queries import _FACT
from .split_queries import GOALS_SQL, _goals

P3 = S.P3
FEATURES = ["rating_diff", "is_neutral", "p_home", "p_draw"]


def training(t):
    """Label 0 / 1 / 2 (home / draw / away) with a few features, split by time."""
    m = t.matches.select("match_id", F.col("neutral").cast("double").alias("is_neutral"))
    df = t.predictions.select("match_id", "kickoff_ts", "actual", (1 - F.col("actual")).cast("double").alias("label"), "rating_diff", "p_home", "p_draw").join(m, "match_id")
    return persist_table(SP.temporal_split(df, "kickoff_ts", "2024-01-21", "2024-01-25"))


_FITTED = """SELECT count(*) FILTER (kickoff_ts < TIMESTAMP '2024-01-21') AS n_train, count(*) FILTER (kickoff_ts >= TIMESTAMP '2024-01-25') AS n_test, TRUE AS sums_to_one, TRUE AS beats_chance FROM predictions"""


def _fit_eval(t, fit):
    """What any fit must fulfil: every row scored, probabilities that add up, and less loss on the training rows than even odds have."""
    df = training(t)
    scored = MD.score(fit(df.filter("split = 'train'")), df.select("match_id", "actual", "split", *FEATURES))
    train = F.when(F.col("split") == "train", logloss_row())
    return scored.agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"),
        (F.max(F.abs(F.col("p_home") + F.col("p_draw") + F.col("p_away") - 1)) < 1e-6).alias("sums_to_one"), (F.avg(train) < math.log(3)).alias("beats_chance"))


@query("fit_poisson_uplift", f"""WITH {GOALS_SQL}, {newton_sql('fit', 'goals', ['gap', 'on_neutral'], 'y', 'poisson', 'ln(base)')}
SELECT unnest(['intercept', 'gap', 'on_neutral', 'loss']) AS term, unnest([#4[b0]#, #4[b1]#, #4[b2]#, #4[loss]#]) AS coefficient FROM fit""", "predictions matches", recursive=True)
def _(t):
    coef = MD.fit_uplift(_goals(t), ["gap", "on_neutral"])
    return r(t.spark.createDataFrame(sorted(coef.items()), "term string, coefficient double"), "coefficient", digits=4)


@query("fit_gbm_multiclass", _FITTED, "predictions")
def _(t):
    return _fit_eval(t, lambda d: MD.fit_gbm(d, FEATURES))


@query("fit_random_forest", _FITTED, "predictions")
def _(t):
    return _fit_eval(t, lambda d: MD.fit_random_forest(d, FEATURES, trees=100, depth=10))


@query("fit_logistic", _FITTED, "predictions")
def _(t):
    return _fit_eval(t, lambda d: MD.fit_logistic(d, FEATURES))


@query("class_weights", "SELECT CAST(1 - actual AS DOUBLE) AS label, count(*) AS n, #[(SELECT count(*) FROM predictions) / (3 * count(*))]# AS weight FROM predictions GROUP BY 1", "predictions")
def _(t):
    return r(MD.class_weights(t.predictions.withColumn("label", (1 - F.col("actual")).cast("double"))), "weight")


@query("standard_scale", """
WITH s AS (SELECT avg(rating_diff) AS m, stddev_pop(rating_diff) AS d, avg(p_home) AS mp, stddev_pop(p_home) AS dp FROM predictions WHERE kickoff_ts < TIMESTAMP '2024-01-21')
SELECT match_id, #[(rating_diff - m) / d]# AS rating_diff, #[(p_home - mp) / dp]# AS p_home FROM predictions, s""", "predictions")
def _(t):
    p = t.predictions.select("match_id", "kickoff_ts", "rating_diff", "p_home")
    out = MD.standard_scale(p.filter(F.col("kickoff_ts") < F.lit("2024-01-21").cast("timestamp_ntz")), p, ["rating_diff", "p_home"])
    return r(out, "rating_diff", "p_home").drop("kickoff_ts")


def isotonic_sql(name: str, rows: str, key: str = "0") -> str:
    """CTE list ending in ``name``: (key, v, x, f), the fitted value at every distinct probability, by the max-min formula over all stretches of points."""
    return f"""
{name}_pt AS MATERIALIZED (SELECT key, v, x, sum(y) AS s, count(*) AS w, row_number() OVER (PARTITION BY key, v ORDER BY x) AS i FROM (
  SELECT {key} AS key, v, CASE v WHEN 1 THEN p_home WHEN 0 THEN p_draw ELSE p_away END AS x, CAST(actual = v AS INT) AS y FROM {rows}, (SELECT unnest([1, 0, -1]) AS v)) GROUP BY 1, 2, 3),
{name}_cum AS (SELECT *, sum(s) OVER z AS cs, sum(w) OVER z AS cw FROM {name}_pt WINDOW z AS (PARTITION BY key, v ORDER BY i)),
{name}_low AS (SELECT key, v, b, min(m) OVER (PARTITION BY key, v, a ORDER BY b DESC) AS m FROM (
  SELECT a.key, a.v, a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM {name}_cum a JOIN {name}_cum b ON a.key = b.key AND a.v = b.v AND b.i >= a.i)),
{name} AS (SELECT p.key, p.v, p.x, p.w, p.s, f FROM {name}_pt p JOIN (SELECT key, v, b AS i, max(m) AS f FROM {name}_low GROUP BY 1, 2, 3) USING (key, v, i))"""


def applied_sql(name: str, fit: str, rows: str, key: str = "0") -> str:
    """CTE list ending in ``name``: the rows with calibrated, renormalised probabilities; straight lines between points."""
    return f"""
{name}_next AS (SELECT *, lead(x) OVER z AS nx, lead(f) OVER z AS nf, first_value(f) OVER z AS f0 FROM {fit} WINDOW z AS (PARTITION BY key, v ORDER BY x)),
{name}_at AS (SELECT q.match_id, q.actual, q.v, greatest(1e-6, least(1.0, coalesce(CASE WHEN q.x = p.x OR p.nx IS NULL THEN p.f ELSE p.f + (q.x - p.x) / (p.nx - p.x) * (p.nf - p.f) END, l.f0))) AS c FROM (
  SELECT {key} AS key, match_id, actual, v, CASE v WHEN 1 THEN p_home WHEN 0 THEN p_draw ELSE p_away END AS x FROM {rows}, (SELECT unnest([1, 0, -1]) AS v)) q
  ASOF LEFT JOIN {name}_next p ON p.key = q.key AND p.v = q.v AND p.x <= q.x LEFT JOIN (SELECT key, v, any_value(f0) AS f0 FROM {name}_next GROUP BY 1, 2) l ON l.key = q.key AND l.v = q.v),
{name} AS (SELECT match_id, any_value(actual) AS actual, max(c) FILTER (v = 1) / sum(c) AS p_home, max(c) FILTER (v = 0) / sum(c) AS p_draw, max(c) FILTER (v = -1) / sum(c) AS p_away FROM {name}_at GROUP BY 1)"""


_VAL, _TEST = (f"(SELECT * FROM predictions WHERE kickoff_ts {c})" for c in (">= TIMESTAMP '2024-01-21' AND kickoff_ts < TIMESTAMP '2024-01-25'", ">= TIMESTAMP '2024-01-25'"))


@query("fit_isotonic_calibrator", f"""WITH {isotonic_sql('fit', _VAL)}, {applied_sql('done', 'fit', _TEST)}
SELECT match_id, #[p_home]# AS p_home, #[p_draw]# AS p_draw, #[p_away]# AS p_away FROM done""", "predictions")
def _(t):
    """Test rows calibrated by maps of the validation rows."""
    df = SP.temporal_split(t.predictions, "kickoff_ts", "2024-01-21", "2024-01-25")
    out = ISO.apply_isotonic(ISO.fit_isotonic(df.filter("split = 'val'")), df.filter("split = 'test'").select("match_id", "actual", *P3))
    return r(out.drop("actual"), *P3)


@query("isotonic_maps", f"""WITH {isotonic_sql('fit', _VAL)}
SELECT v AS outcome, count(DISTINCT #8[f]#) AS n_blocks, TRUE AS monotone, CAST(sum(w) AS BIGINT) AS n, #[sum(w * f)]# AS fitted, #[min(f)]# AS lowest, #[max(f)]# AS highest FROM fit GROUP BY 1""", "predictions")
def _(t):
    """The maps themselves: monotone, and their fitted values add up to what was observed."""
    df = SP.temporal_split(t.predictions, "kickoff_ts", "2024-01-21", "2024-01-25").filter("split = 'val'")
    blocks = ISO.fit_isotonic(df)
    late = F.lag("value").over(Window.partitionBy("outcome").orderBy("lo"))  # few blocks are left
    out = blocks.withColumn("ok", F.coalesce(late < F.col("value"), F.lit(True))).groupBy("outcome").agg(
        F.count_distinct(F.round("value", 8)).alias("n_blocks"), F.bool_and("ok").alias("monotone"), F.sum("weight").cast("bigint").alias("n"), F.sum(F.col("weight") * F.col("value")).alias("fitted"),
        F.min("value").alias("lowest"), F.max("value").alias("highest"))
    return r(out, "fitted", "lowest", "highest")


_FOLDS3 = "(SELECT p.*, o FROM predictions p, range(3) g(o) WHERE match_id % 3 <> o AND kickoff_ts >= TIMESTAMP '2024-01-25')"


@query("isotonic_cross_fitted", f"""WITH {isotonic_sql('fit', _FOLDS3, 'o')}, {applied_sql('done', 'fit', _TEST, 'match_id % 3')}
SELECT match_id, #[p_home]# AS p_home, #[p_draw]# AS p_draw, #[p_away]# AS p_away FROM done""", "predictions")
def _(t):
    """Rows calibrated by maps of the other two of three folds."""
    df = SP.temporal_split(t.predictions, "kickoff_ts", "2024-01-21", "2024-01-25").filter("split = 'test'").select("match_id", "actual", *P3)
    return r(ISO.cross_fitted(df, F.col("match_id") % 3, 3).drop("actual"), *P3)


_T = "(pow(p_home, 1 / tt) + pow(p_draw, 1 / tt) + pow(p_away, 1 / tt))"


@query("fit_temperature", f"""
SELECT #[arg_min(tt, l)]# AS temperature, #[min(l)]# AS nll FROM (SELECT tt, avg(-ln(pow({PA}, 1 / tt) / {_T})) AS l FROM predictions, (SELECT unnest({MD.TEMPERATURES}::DOUBLE[]) AS tt) GROUP BY 1)""", "predictions")
def _(t):
    return r(MD.fit_temperature(t.predictions), "temperature", "nll")


@query("refine_temperature", "SELECT TRUE AS inside_range, TRUE AS no_worse_than_grid")
def _(t):
    best, grid = MD.refine_temperature(t.predictions), MD.fit_temperature(t.predictions).first()
    return t.spark.createDataFrame([(0.05 <= best[0] <= 10.0, best[1] <= grid.nll + 1e-9)], "inside_range boolean, no_worse_than_grid boolean")


_RHO = [round(-0.2 + 0.02 * i, 2) for i in range(21)]
_DOT = "list_dot_product({m}[x + 1], {v})"
_SWEEP = f"""
sides AS (SELECT home AS team, away AS opp, NOT neutral AS own, home_score AS y FROM matches WHERE kickoff_ts < TIMESTAMP '2024-01-21' UNION ALL
  SELECT away, home, FALSE, away_score FROM matches WHERE kickoff_ts < TIMESTAMP '2024-01-21'),
sums AS (SELECT team, opp, count(*) FILTER (NOT own) AS n, count(*) FILTER (own) AS nh, sum(y) AS y FROM sides GROUP BY 1, 2),
cells AS (SELECT i AS team, j AS opp, coalesce(n, 0)::DOUBLE AS n, coalesce(nh, 0)::DOUBLE AS nh, coalesce(y, 0)::DOUBLE AS y FROM range(24) a(i), range(24) b(j) LEFT JOIN sums ON team = i AND opp = j),
by_team AS (SELECT team, list(n ORDER BY opp) AS n, list(nh ORDER BY opp) AS nh, sum(y) AS y FROM cells GROUP BY 1),
by_opp AS (SELECT opp, list(n ORDER BY team) AS n, list(nh ORDER BY team) AS nh, sum(y) AS y FROM cells GROUP BY 1),
const AS MATERIALIZED (SELECT list(t.n ORDER BY team) AS tn, list(t.nh ORDER BY team) AS th, list(t.y ORDER BY team) AS scored, list(o.n ORDER BY opp) AS opn, list(o.nh ORDER BY opp) AS oph, list(o.y ORDER BY opp) AS conceded,
  (SELECT avg(y) FROM sides) AS mu, (SELECT sum(y)::DOUBLE FROM sides WHERE own) AS yh FROM by_team t JOIN by_opp o ON t.team = o.opp),
sweep AS (
  SELECT 0 AS step, list_resize([mu], 24, mu) AS a, list_resize([1.0::DOUBLE], 24, 1.0::DOUBLE) AS d, 1.0::DOUBLE AS h FROM const
  UNION ALL
  SELECT step + 1, a, d, yh / list_sum(list_transform(range(24), lambda x: a[x + 1] * {_DOT.format(m='th', v='d')})) FROM (
    SELECT step, tn, th, yh, list_transform(a, lambda v: v * lvl) AS a, list_transform(d, lambda v: v / lvl) AS d FROM (
      SELECT *, list_avg(d) AS lvl FROM (
        SELECT step, tn, th, yh, a, list_transform(range(24), lambda x: (conceded[x + 1] + 1) / ({_DOT.format(m='opn', v='a')} + h * {_DOT.format(m='oph', v='a')} + 1)) AS d FROM (
          SELECT s.step, s.h, c.*, list_transform(range(24), lambda x: (scored[x + 1] + mu) / ({_DOT.format(m='tn', v='s.d')} + s.h * {_DOT.format(m='th', v='s.d')} + 1)) AS a
          FROM sweep s, const c WHERE s.step < 100))))),
goal_model AS (SELECT a, d, h FROM sweep WHERE step = 100)"""
_GRID = f"exp(-lh) * pow(lh, i) / ({_FACT})[i + 1] * exp(-la) * pow(la, j) / ({_FACT})[j + 1]"
_TAU = "CASE WHEN x = 0 AND y = 0 THEN 1 - lh * la * rr WHEN x = 0 AND y = 1 THEN 1 + lh * rr WHEN x = 1 AND y = 0 THEN 1 + la * rr WHEN x = 1 AND y = 1 THEN 1 - rr ELSE 1 END"


@query("fit_attack_defence", f"""WITH {_SWEEP},
lam AS (SELECT match_id, home_score AS x, away_score AS y, sign(home_score - away_score) AS actual, a[home + 1] * d[away + 1] * CASE WHEN neutral THEN 1 ELSE h END AS lh, a[away + 1] * d[home + 1] AS la FROM matches, goal_model WHERE kickoff_ts >= TIMESTAMP '2024-01-25'),
grid AS (SELECT match_id, any_value(actual) AS actual, sum(p) FILTER (i > j) / sum(p) AS p_home, sum(p) FILTER (i = j) / sum(p) AS p_draw, sum(p) FILTER (i < j) / sum(p) AS p_away FROM (SELECT *, {_GRID} AS p FROM lam, range(12) a(i), range(12) b(j)) GROUP BY 1),
ll AS (SELECT rr, sum(ln(greatest({_TAU}, 1e-10))) AS l FROM lam, (SELECT unnest({_RHO}::DOUBLE[]) AS rr) GROUP BY 1)
SELECT CAST(t AS VARCHAR) AS team, #3[a[t + 1]]# AS attack, #3[d[t + 1]]# AS leak, #3[h]# AS home_factor, (SELECT arg_max(rr, l) FROM ll) AS rho, e.* FROM goal_model, range(24) g(t),
  (SELECT count(*) AS n, #4[avg({BR})]# AS brier, #4[avg(-ln({PA}))]# AS log_loss FROM grid) e""", "matches", recursive=True)
def _(t):
    """Strengths of all teams with the home factor, and how the model does on later matches."""
    from ..functions.expr import brier_row, logloss_row

    df = SP.temporal_split(t.matches, "kickoff_ts", "2024-01-21", "2024-01-25")
    model = MD.fit_attack_defence(df.filter("split = 'train'"))
    scored = persist_table(MD.score_goals(model, df.filter("split = 'test'")).withColumn("actual", S.outcome()))
    rho = MD.fit_low_score_rho(scored, _RHO)
    ev = scored.agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(brier_row()), 4).alias("brier"), rnd(F.avg(logloss_row()), 4).alias("log_loss"))
    out = r(model.strengths.withColumn("home_factor", F.lit(model.home)), "attack", "leak", "home_factor", digits=3)
    return with_one_row(with_one_row(out, ev), rho.select("rho"))


@query("ensemble_alpha_search", f"""
WITH c AS (SELECT quantile_cont(CAST(epoch_us(kickoff_ts) AS DOUBLE), 0.8) AS cut FROM predictions),
l AS (SELECT al, avg(-ln(CASE actual WHEN 1 THEN al * p_home + (1 - al) * 0.45 WHEN 0 THEN al * p_draw + (1 - al) * 0.25 ELSE al * p_away + (1 - al) * 0.30 END)) AS ll
  FROM predictions, c, (SELECT unnest({MD.ALPHAS}::DOUBLE[]) AS al) WHERE epoch_us(kickoff_ts) >= cut GROUP BY 1)
SELECT #[arg_min(al, ll)]# AS alpha, #[min(ll)]# AS log_loss FROM l""", "predictions")
def _(t):
    df = t.predictions.select("kickoff_ts", "actual", *[F.col(p).alias("a_" + p) for p in P3], *[F.lit(v).alias("b_" + p) for p, v in zip(P3, (0.45, 0.25, 0.30))])
    return r(MD.alpha_search(df), "alpha", "log_loss")


@query("draw_factor_sweep", f"""
SELECT #[f]# AS factor, #[avg(CAST(actual = {PICK} AS INT))]# AS accuracy, #[avg(-ln({PA}))]# AS log_loss, #[avg({BR})]# AS brier FROM (
  SELECT f, actual, p_home / (p_home + p_draw * f + p_away) AS p_home, p_draw * f / (p_home + p_draw * f + p_away) AS p_draw, p_away / (p_home + p_draw * f + p_away) AS p_away FROM predictions, (SELECT unnest([1.2, 1.25, 1.3, 1.35, 1.4]::DOUBLE[]) AS f)) GROUP BY 1""", "predictions")
def _(t):
    return r(MD.factor_sweep(t.predictions, [1.2, 1.25, 1.3, 1.35, 1.4]), "factor", "accuracy", "log_loss", "brier")


def _blend(w):
    a, b = w
    return ", ".join(f"({a} * {p} + {b} * {v}) / ({a} + {b}) AS {p}" for p, v in zip(P3, (0.45, 0.25, 0.30)))


def _moves():
    w = {"elo_": 0.7, "flat_": 0.3}
    yield "base", 0.0, (0.7, 0.3)
    for i, c in enumerate(w):
        for d in (-0.2, -0.1, 0.1, 0.2):
            v = [0.7, 0.3]
            v[i] = max(0.05, v[i] * (1 + d))
            yield c, d, tuple(v)


@query("weight_sensitivity", "WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS component, CAST({d} AS DOUBLE) AS delta, actual, {_blend(w)} FROM predictions" for c, d, w in _moves()) + f"""),
m AS (SELECT component, delta, avg(CAST(actual = {PICK} AS INT)) AS a, avg({BR}) AS b FROM v GROUP BY 1, 2)
SELECT m.component, m.delta, #[m.a]# AS accuracy, #[m.b]# AS brier, #[m.a - f.a]# AS d_accuracy, #[m.b - f.b]# AS d_brier FROM m, (SELECT * FROM m WHERE component = 'base') f WHERE m.component <> 'base'""", "predictions")
def _(t):
    df = t.predictions.select("actual", *[F.col(p).alias("elo_" + p) for p in P3], *[F.lit(v).alias("flat_" + p) for p, v in zip(P3, (0.45, 0.25, 0.30))])
    return r(MD.weight_sensitivity(df, {"elo_": 0.7, "flat_": 0.3}), "accuracy", "brier", "d_accuracy", "d_brier")


#: Given coefficients of a linear scorer (parameters of this query).
_GIVEN = {"p_home": {"intercept": 0.2, "rating_diff": 0.004, "is_neutral": -0.1}, "p_draw": {"intercept": -0.1, "is_neutral": 0.2}, "p_away": {"intercept": 0.0, "rating_diff": -0.004}}


def shuffled_sql(x: str, n: str, seed: int) -> str:
    """The bijection of ``shuffled_number`` as a recursive walk over all rows: (i, source)."""
    side = f"CAST(ceil(sqrt({n})) AS BIGINT)"
    left, right, inner = "l0", "r0", f"SELECT *, x // side AS l0, x % side AS r0 FROM (SELECT *, {side} AS side FROM cur)"
    for k, m in enumerate(MD.ROUNDS):
        mixed = f"(((r{k} * {m} + {(seed + 1) * (k + 1) * 31337}) % 2147483647) * 48271 + r{k}) % 2147483647"
        inner = f"SELECT *, r{k} AS l{k + 1}, (l{k} + {mixed}) % side AS r{k + 1} FROM ({inner})"
    last = len(MD.ROUNDS)
    return inner.replace("FROM cur", f"FROM (SELECT i, n, step, x FROM {x})"), f"l{last} * side + r{last}"


_NET, _NEXT = shuffled_sql("walk WHERE step = 0 OR x >= n", "n", 0)
_GIVEN_E = {p: " + ".join(f"{w} * {'1' if f == 'intercept' else f}" for f, w in ws.items()) for p, ws in _GIVEN.items()}
_GIVEN_LOSS = "avg(-ln(greatest(1e-12, CASE actual WHEN 1 THEN {p_home} WHEN 0 THEN {p_draw} ELSE {p_away} END / ({p_home} + {p_draw} + {p_away}))))".format(**{p: f"exp({e})" for p, e in _GIVEN_E.items()})
_TESTED = "t AS (SELECT p.match_id, p.actual, p.rating_diff, CAST(m.neutral AS DOUBLE) AS is_neutral, row_number() OVER (ORDER BY p.match_id) - 1 AS i, count(*) OVER () AS n FROM predictions p JOIN (SELECT match_id, neutral FROM matches) m USING (match_id) WHERE p.kickoff_ts >= TIMESTAMP '2024-01-25')"


@query("permutation_importance", f"""WITH {_TESTED},
walk AS (SELECT i, n, 0 AS step, i AS x FROM t UNION ALL SELECT i, n, step + 1, {_NEXT} FROM ({_NET})),
src AS (SELECT i, arg_max(x, step) AS j FROM walk GROUP BY i),
base AS (SELECT {_GIVEN_LOSS} AS b FROM t),
moved AS (SELECT 'rating_diff' AS feature, {_GIVEN_LOSS} AS l FROM (SELECT t.actual, o.rating_diff, t.is_neutral FROM t JOIN src USING (i) JOIN t o ON o.i = src.j)
  UNION ALL SELECT 'is_neutral', {_GIVEN_LOSS} FROM (SELECT t.actual, t.rating_diff, o.is_neutral FROM t JOIN src USING (i) JOIN t o ON o.i = src.j))
SELECT feature, #[b]# AS base_loss, #[l]# AS loss, #[l - b]# AS importance FROM moved, base""", "predictions matches", recursive=True)
def _(t):
    """Importance under given coefficients, so that the check can replay the shuffle."""
    df = training(t).filter("split = 'test'").select("match_id", "actual", "rating_diff", "is_neutral")
    return r(MD.permutation_importance(_GIVEN, df, ["rating_diff", "is_neutral"], scorer=MD.linear_scorer), "base_loss", "loss", "importance")


@query("permutation_importance_fitted")
def _(t):
    """Importance under a fitted model."""
    df = training(t)
    model = MD.fit_logistic(df.filter("split = 'train'"), FEATURES, balanced=False)
    out = MD.permutation_importance(model, df.filter("split = 'test'").select("match_id", "actual", *FEATURES), FEATURES)
    return r(out, "base_loss", "loss", "importance", digits=4)


@query("bootstrap_importance")
def _(t):
    out = MD.bootstrap_importance(training(t).filter("split = 'train'"), FEATURES)
    return r(out, "mean", "ci_low", "ci_high", digits=3)


_MODELS = {"elo": P3, "flat": ("0.45", "0.25", "0.30"), "sharp": ("p_home * p_home / q", "p_draw * p_draw / q", "p_away * p_away / q")}
_MSQL = "m AS (SELECT model, avg(CAST(actual = {0} AS INT)) AS a, avg(-ln(greatest(1e-7, {1}))) AS l, avg({2}) AS b, count(*) AS n FROM (".format(PICK, PA, BR) + " UNION ALL ".join(
    f"SELECT '{n}' AS model, actual, {a} AS p_home, {b} AS p_draw, {c} AS p_away FROM (SELECT *, p_home * p_home + p_draw * p_draw + p_away * p_away AS q FROM predictions)" for n, (a, b, c) in _MODELS.items()) + ") GROUP BY 1)"


def _models(t):
    h, d, a = (F.col(p) for p in P3)
    q = h * h + d * d + a * a
    sets = [("elo", h, d, a), ("flat", F.lit(0.45), F.lit(0.25), F.lit(0.30)), ("sharp", h * h / q, d * d / q, a * a / q)]
    arr = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), *[c.alias(p) for p, c in zip(P3, cs)]) for n, *cs in sets])).alias("s")
    return t.predictions.select("actual", arr).select("actual", "s.*")


@query("model_comparison", f"""WITH {_MSQL}
SELECT m.model, #[m.a]# AS accuracy, #[m.l]# AS log_loss, #[m.b]# AS brier, m.n, CAST(m.a > f.a AS INT) + CAST(m.l < f.l AS INT) + CAST(m.b < f.b AS INT) AS wins FROM m, (SELECT * FROM m WHERE model = 'flat') f""", "predictions")
def _(t):
    return r(MD.compare_models(_models(t), "flat"), "accuracy", "log_loss", "brier")


@query("score_model_batch", "SELECT match_id, TRUE AS sums_to_one, TRUE AS confidence_is_highest, TRUE AS pick_is_most_likely FROM predictions", "predictions")
def _(t):
    df = training(t)
    model = MD.fit_logistic(df.filter("split = 'train'"), FEATURES)
    top = F.greatest(*P3)
    chosen = F.when(F.col("pick") == 1, F.col("p_home")).when(F.col("pick") == 0, F.col("p_draw")).otherwise(F.col("p_away"))
    return MD.score(model, df.select("match_id", *FEATURES)).select(
        "match_id", (F.abs(F.col("p_home") + F.col("p_draw") + F.col("p_away") - 1) < 1e-6).alias("sums_to_one"), (F.abs(F.col("confidence") - top) < 1e-9).alias("confidence_is_highest"), (chosen == top).alias("pick_is_most_likely"))


@query("pairwise_model_average", f"""WITH {_MSQL}
SELECT 'elo+flat' AS pair, #[avg(a)]# AS accuracy, #[avg(l)]# AS log_loss, #[avg(b)]# AS brier FROM m WHERE model IN ('elo', 'flat') UNION ALL SELECT 'elo+sharp', #[avg(a)]#, #[avg(l)]#, #[avg(b)]# FROM m WHERE model IN ('elo', 'sharp')""", "predictions")
def _(t):
    out = MD.pairwise_average(MD.compare_models(_models(t), "flat"), {"elo+flat": ("elo", "flat"), "elo+sharp": ("elo", "sharp")})
    return r(out, "accuracy", "log_loss", "brier")
