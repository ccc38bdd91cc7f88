"""Model fitting with Spark ML; calibration and search grids as aggregations."""

from __future__ import annotations

import math
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import add, brier_row, clip, hit, logloss_row, p_actual, with_one_row
from ..session import persist_table, release, shared_dir, small
from . import metrics as M
from . import scoring as S
from .forests import resampled_importances
from .regression import fit_many
from .slices import MOST, running

P3 = S.P3


def _grid(df: DataFrame, values: list[float], name: str) -> DataFrame:
    """Every row with every value of a small literal grid: an explode, not a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


# ---- goal models ---------------------------------------------------------------------------------


def fit_uplift(df: DataFrame, features: list[str], target: str = "goals_home", base: str = "lambda_home_base") -> dict[str, float]:
    """Poisson regression of goals on features with offset ln(base): coefficients by name, and the loss."""
    fit = fit_many(df.filter(F.col(base) > 0), features, target, "poisson", offset=F.ln(F.col(base))).first()
    return dict(zip(["intercept", *features], fit.coefficients)) | {"loss": fit.loss}


CHECKED = 4  # sweeps between looks at how much strengths still move


@dataclass(frozen=True)
class GoalModel:
    """Expected goals of a side: attack of the team x leak of its opponent x the home factor on its own ground."""

    strengths: DataFrame  # team, attack, leak; one row per team
    home: float
    mean: float  # attack of a team without matches; its leak is 1
    sweeps: int


def fit_attack_defence(matches: DataFrame, sweeps: int = 100, tolerance: float = 1e-6, prior: float = 1.0) -> GoalModel:
    """Attack and leak of every team and the home factor of a Poisson model of goals, by alternating group sums (iterative proportional fitting).

    A sweep sets each attack to goals scored over goals expected from the opponents' leaks, each leak to goals conceded over goals expected from the
    opponents' attacks, and the home factor likewise, until no strength moves by more than ``tolerance``. ``prior`` matches at the
    mean damp both, so that teams with few matches stay finite. Leaks have mean 1. Matches are summed per (team, opponent, ground)
    first; a sweep joins these sums with one number per team, so teams may be any number. Rows with a NULL team or score are left out.
    """
    def side(team: str, opp: str, goals: str, ground: Column) -> Column:
        return F.struct(F.col(team).cast("string").alias("team"), F.col(opp).cast("string").alias("opp"), ground.alias("at_home"), F.col(goals).cast("double").alias("goals"))

    at_home = ~F.coalesce("neutral", F.lit(False))
    sides = F.explode(F.array(side("home", "away", "home_score", at_home), side("away", "home", "away_score", F.lit(False)))).alias("s")
    rows = matches.select(sides).select("s.*").dropna()
    pairs = persist_table(rows.groupBy("team", "opp", "at_home").agg(F.count(F.lit(1)).alias("n"), F.sum("goals").alias("goals")))
    total = pairs.agg(F.sum("n").alias("n"), F.sum("goals").alias("goals"), F.sum(F.when(F.col("at_home"), F.col("goals"))).alias("home")).first()
    if not total.n:
        raise ValueError("no matches to fit")
    spark, mean, home, old = matches.sparkSession, total.goals / total.n, 1.0, []
    scored = pairs.groupBy("team").agg(F.sum("goals").alias("scored")).withColumnRenamed("team", "t")
    conceded = pairs.groupBy("opp").agg(F.sum("goals").alias("conceded")).withColumnRenamed("opp", "t")
    both = scored.join(conceded, "t", "full")  # a team has a row on each side of every match
    state = persist_table(both.select("t", F.coalesce("scored", F.lit(0.0)).alias("scored"), F.coalesce("conceded", F.lit(0.0)).alias("conceded"), F.lit(mean).alias("attack"), F.lit(1.0).alias("leak")))
    home_row = spark.createDataFrame([(1.0,)], "home double")
    level = lambda now: now.agg(F.avg("leak").alias("level"))
    ground = F.col("n") * F.when(F.col("at_home"), F.col("home")).otherwise(1.0)
    for done in range(1, sweeps + 1):  # one job a sweep; the home factor and the level of the last one are scalars of its plan
        now = with_one_row(state, level(state)).select("t", "scored", "conceded", (F.col("attack") * F.col("level")).alias("attack"), (F.col("leak") / F.col("level")).alias("leak"))
        met_on = with_one_row(pairs, home_row)
        faced = met_on.join(small(now.select(F.col("t").alias("opp"), "leak"), state), "opp").groupBy(F.col("team").alias("f")).agg(F.sum(ground * F.col("leak")).alias("faced"))
        attacks = now.join(small(faced, state), F.col("t") == F.col("f")).select("t", "scored", "conceded", F.col("attack").alias("old_attack"), F.col("leak").alias("old_leak"),
                           ((F.col("scored") + prior * mean) / (F.col("faced") + prior)).alias("attack"))
        met = met_on.join(small(attacks.select(F.col("t").alias("team"), "attack"), state), "team").groupBy(F.col("opp").alias("f")).agg(F.sum(ground * F.col("attack")).alias("met"))
        after = persist_table(attacks.join(small(met, state), F.col("t") == F.col("f")).select("t", "scored", "conceded", "old_attack", "old_leak", "attack", ((F.col("conceded") + prior) / (F.col("met") + prior)).alias("leak")))
        own, their = small(after.select(F.col("t").alias("team"), "attack"), after), small(after.select(F.col("t").alias("opp"), "leak"), after)
        at_home = pairs.filter("at_home").join(own, "team").join(their, "opp").agg(F.sum(F.col("n") * F.col("attack") * F.col("leak")).alias("expected"))
        home_row = at_home.select(F.coalesce(F.lit(total.home) / F.col("expected"), F.lit(1.0)).alias("home"))
        release(*old)
        old, state = [state], after
        if done % CHECKED == 0 or done == sweeps:
            moved = F.greatest(F.abs(F.col("attack") * F.col("level") - F.col("old_attack")), F.abs(F.col("leak") / F.col("level") - F.col("old_leak")))
            change = with_one_row(after, level(after)).agg(F.max(moved).alias("change"))
            seen = with_one_row(change, home_row).first()
            before, home = home, seen.home
            if max(seen.change, abs(home - before) / CHECKED) <= tolerance:
                break
    state = with_one_row(state, level(state)).select("t", (F.col("attack") * F.col("level")).alias("attack"), (F.col("leak") / F.col("level")).alias("leak"))
    release(pairs)
    return GoalModel(persist_table(state.withColumnRenamed("t", "team")), home, mean, done)


def score_goals(model: GoalModel, matches: DataFrame) -> DataFrame:
    """Expected goals of both sides and the outcome probabilities of the goal grid. A team the model does not know is a mean one."""
    out = matches
    for name in ("home", "away"):
        own = model.strengths.select(F.col("team").alias(f"_t_{name}"), F.col("attack").alias(f"_a_{name}"), F.col("leak").alias(f"_l_{name}"))
        out = out.join(small(own, model.strengths), F.col(name).cast("string") == F.col(f"_t_{name}"), "left")
    attack, leak = (lambda n: F.coalesce(f"_a_{n}", F.lit(model.mean))), (lambda n: F.coalesce(f"_l_{n}", F.lit(1.0)))
    ground = F.when(F.col("neutral"), 1.0).otherwise(F.lit(model.home))
    return S.poisson_probs(out.select(*matches.columns, (attack("home") * leak("away") * ground).alias("lambda_home"), (attack("away") * leak("home")).alias("lambda_away")))


def fit_low_score_rho(scored: DataFrame, grid: list[float]) -> DataFrame:
    """Low-score dependence of the published goal model: rho maximising the likelihood over a grid; one row."""
    x, y, r = F.col("home_score"), F.col("away_score"), F.col("rho")
    lh, la = F.col("lambda_home"), F.col("lambda_away")
    tau = (F.when((x == 0) & (y == 0), 1 - lh * la * r).when((x == 0) & (y == 1), 1 + lh * r).when((x == 1) & (y == 0), 1 + la * r).when((x == 1) & (y == 1), 1 - r).otherwise(1.0))
    ll = _grid(scored, grid, "rho").groupBy("rho").agg(F.sum(F.ln(F.greatest(tau, F.lit(1e-10)))).alias("log_likelihood"))
    return ll.orderBy(F.col("log_likelihood").desc(), "rho").limit(1)


# ---- classifiers ---------------------------------------------------------------------------------


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (k n_c) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # one row per class
    return counts.withColumn("weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    """``df`` with the balanced weight of its class, looked up in one map of all classes: no join."""
    entries = F.collect_list(F.struct(F.col(label).alias("k"), "weight"))  # one entry per class
    weights = class_weights(df.filter(F.col(label).isNotNull()), label).agg(F.map_from_entries(entries).alias("_weights"))
    return with_one_row(df, weights).withColumn("weight", F.try_element_at("_weights", F.col(label))).drop("_weights")


@contextmanager
def _kept(df: DataFrame):
    """Keep training rows for the passes of a solver, on disk where memory is short."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def _assembled(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")


class OneAgainstRest:
    """Binary models, one per label; ``transform`` adds their scores as one array, all in column expressions."""

    def __init__(self, assembler: VectorAssembler | PipelineModel, models: list):
        self.assembler, self.models = assembler, models

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.assembler.transform(df)
        for i, m in enumerate(self.models):
            m = m.copy().setPredictionCol(f"_c{i}").setRawPredictionCol(f"_r{i}").setProbabilityCol(f"_s{i}")
            out = m.transform(out).drop(f"_c{i}", f"_r{i}")
        scores = F.array(*[vector_to_array(f"_s{i}")[1] for i in range(len(self.models))])
        return out.withColumn("scores", scores).select(*df.columns, "features", "scores")


def _side_by_side(spark, jobs: list, at_once: int) -> list:
    """Results of functions that start Spark jobs of their own, ``at_once`` at a time; the jobs share the cluster."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def _checkpoints(spark) -> None:
    """Let solvers of many rounds cut their lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


BINS = 32  # of a feature, as many as the trees tell apart
PART_CELLS = 20_000  # cells that a task of a round reads


def _bins(df: DataFrame, features: list[str]) -> PipelineModel:
    """Stages that turn features into one vector of bin numbers, equi-depth over all rows; rows without a feature are skipped."""
    found = df.approxQuantile(features, [i / BINS for i in range(1, BINS)], 0.001)
    cuts = [sorted({c for c in cut if math.isfinite(c)}) or [0.0] for cut in found]
    splits = [[-math.inf, *c, math.inf] for c in cuts]
    names = [f"_b_{f}" for f in features]
    return PipelineModel([Bucketizer(inputCols=features, outputCols=names, splitsArray=splits, handleInvalid="skip"), VectorAssembler(inputCols=names, outputCol="features")])


def _cells(df: DataFrame, bins: PipelineModel, label: str) -> DataFrame:
    """One row per vector of bins and label, weighted by its rows: trees that see rows by their bins alone grow alike on it, and it has at most the product of bins and labels in rows."""
    return bins.transform(df).groupBy(label, "features").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def fit_gbm(df: DataFrame, features: list[str], label: str = "label", trees: int = 200, depth: int = 3, seed: int = 42) -> OneAgainstRest:
    """Gradient-boosted trees, one against the rest for the three classes, which are fitted side by side over one kept table of weighted cells.

    Rows are read twice, for the cuts of the bins and for the cells; the rounds run over the cells.
    """
    rows = df.select(label, *features)
    bins = _bins(rows, features)
    _checkpoints(df.sparkSession)
    written = persist_table(_cells(rows, bins, label))
    with _kept(written.coalesce(-(-written.count() // PART_CELLS) or 1)) as cells:
        gbt = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=BINS, seed=seed, labelCol="_y", weightCol="weight")
        fits = [lambda c=c: gbt.fit(cells.withColumn("_y", (F.col(label) == c).cast("double"))) for c in range(3)]
        models = _side_by_side(df.sparkSession, fits, 3)
    release(written)
    return OneAgainstRest(bins, models)


def fit_random_forest(df: DataFrame, features: list[str], label: str = "label", trees: int = 100, depth: int = 8, balanced: bool = True, seed: int = 42):
    rf = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="prob", rawPredictionCol="raw", predictionCol="cls", **({"weightCol": "weight"} if balanced else {}))
    with _kept((weighted(df, label) if balanced else df).select(label, *features, *(["weight"] if balanced else []))) as rows:
        return Pipeline(stages=[_assembled(features), rf]).fit(rows)


def fit_logistic(df: DataFrame, features: list[str], label: str = "label", balanced: bool = True, reg: float = 0.0):
    lr = LogisticRegression(labelCol=label, family="multinomial", maxIter=100, regParam=reg, probabilityCol="prob", rawPredictionCol="raw", predictionCol="cls", **({"weightCol": "weight"} if balanced else {}))
    with _kept((weighted(df, label) if balanced else df).select(label, *features, *(["weight"] if balanced else []))) as rows:
        return Pipeline(stages=[_assembled(features), lr]).fit(rows)


def score(model, df: DataFrame, classes: tuple[int, int, int] = (1, 0, -1)) -> DataFrame:
    """Probabilities, pick and confidence for a table; label i stands for outcome classes[i]."""
    out = model.transform(df)
    if "prob" in out.columns:
        p = [vector_to_array("prob")[i] for i in range(3)]
    else:
        p = [F.col("scores")[i] for i in range(3)]
    order = {c: i for i, c in enumerate(classes)}
    out = S.normalise(out.withColumns({n: clip(p[order[v]], 1e-12, 1.0) for v, n in ((1, "p_home"), (0, "p_draw"), (-1, "p_away"))}))
    from .clean import pick

    return pick(out.drop("features", "prob", "raw", "cls", "scores"))


def standard_scale(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation of the training rows; constant columns are only centred."""
    stats = train.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])  # one row
    out = with_one_row(df, stats)
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return out.withColumns(scaled).select(*df.columns)


# ---- calibration and searches --------------------------------------------------------------------


TEMPERATURES = [round(0.5 + 0.1 * i, 1) for i in range(16)]


def temperature_nll(df: DataFrame, grid: list[float]) -> DataFrame:
    """Mean negative log-likelihood per temperature of a literal grid: one scan, combined before the shuffle."""
    g = S.temper(_grid(df.select("actual", *P3), grid, "temperature"), F.col("temperature"))
    return g.groupBy("temperature").agg(F.avg(-F.ln(clip(p_actual(), 1e-12, 1 - 1e-12))).alias("nll"))


def fit_temperature(df: DataFrame, grid: list[float] = TEMPERATURES) -> DataFrame:
    """Temperature with the least loss on the grid (the smallest on ties); one row."""
    return temperature_nll(df, grid).agg(F.min_by("temperature", F.struct("nll", "temperature")).alias("temperature"), F.min("nll").alias("nll"))


def refine_temperature(df: DataFrame, lo: float = 0.05, hi: float = 10.0, points: int = 25, passes: int = 3) -> tuple[float, float]:
    """Continuous temperature: a log-spaced grid, narrowed around its best point in each pass (the loss is unimodal in T)."""
    from math import exp, log

    best = (1.0, float("inf"))
    for _ in range(passes):
        step = (log(hi) - log(lo)) / (points - 1)
        grid = [exp(log(lo) + i * step) for i in range(points)]
        row = fit_temperature(df, grid).first()
        best = (row["temperature"], row["nll"])
        lo, hi = max(lo, best[0] * exp(-step)), min(hi, best[0] * exp(step))
    return best


ALPHAS = [round(0.5 + 0.05 * i, 2) for i in range(9)]


def _loss(prefix: str = "") -> Column:
    return F.avg(-F.ln(clip(p_actual(prefix), 1e-12, 1.0)))


def alpha_search(df: DataFrame, a: str = "a_", b: str = "b_", grid: list[float] = ALPHAS, ts: str = "kickoff_ts", tail: float = 0.2) -> DataFrame:
    """Blend weight with the least log-loss on the last share of the rows by time; one row."""
    from .quantiles import exact_quantiles
    from ..functions.expr import epoch_us

    rows = df.withColumn("_t", epoch_us(ts).cast("double"))
    cut = exact_quantiles(rows, [], "_t", {"_cut": 1 - tail})  # one row
    last = with_one_row(rows, cut).filter(F.col("_t") >= F.col("_cut")).select("actual", *[pre + p for pre in (a, b) for p in P3])
    g = S.blend_probs(_grid(last, grid, "alpha"), a, b, F.col("alpha"))
    losses = g.groupBy("alpha").agg(_loss().alias("log_loss"))
    return losses.agg(F.min_by("alpha", F.struct("log_loss", "alpha")).alias("alpha"), F.min("log_loss").alias("log_loss"))


def factor_sweep(df: DataFrame, factors: list[float]) -> DataFrame:
    """Metrics for every draw factor in one pass."""
    g = S.draw_factor(_grid(df.select("actual", *P3), factors, "factor"), F.col("factor"))
    return g.groupBy("factor").agg(F.avg(hit()).alias("accuracy"), F.avg(logloss_row()).alias("log_loss"), F.avg(brier_row()).alias("brier"))


def weight_sensitivity(df: DataFrame, weights: dict[str, float], deltas: list[float] = [-0.2, -0.1, 0.1, 0.2], floor: float = 0.05) -> DataFrame:
    """Accuracy and Brier of a weighted ensemble when each weight moves by a relative delta, against the unchanged weights.

    ``weights`` maps column prefixes of the component probabilities to weights. One row per (component, delta).
    """
    moves = [("base", 0.0, weights)] + [(c, d, weights | {c: max(floor, w * (1 + d))}) for c, w in weights.items() for d in deltas]
    sets = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(float(d)).alias("delta"),
                              *[add([F.lit(float(w)) * F.col(pre + p) for pre, w in ws.items()]).alias(p) for p in P3]) for c, d, ws in moves])
    rows = S.normalise(df.select("actual", F.explode(sets).alias("s")).select("actual", "s.*"))
    m = rows.groupBy("component", "delta").agg(F.avg(hit()).alias("accuracy"), F.avg(brier_row()).alias("brier"))
    base = m.filter(F.col("component") == "base").select(F.col("accuracy").alias("_a"), F.col("brier").alias("_b"))  # one row
    return with_one_row(m.filter(F.col("component") != "base"), base).select(
        "component", "delta", "accuracy", "brier", (F.col("accuracy") - F.col("_a")).alias("d_accuracy"), (F.col("brier") - F.col("_b")).alias("d_brier"))


# ---- importance and comparison -------------------------------------------------------------------


ROUNDS = (7919, 104729, 1299709, 15485863)  # multipliers of the network's rounds
WALKS = 64


def shuffled_number(number: Column, n: Column, seed: int) -> Column:
    """A bijection on 0..n-1 that can be replayed anywhere: a four-round network on pairs of digits.

    A number is a pair (left, right) in base ``side``, the least whole number whose square reaches n. Each round adds a mix of one digit to the other, modulo ``side``, and
    swaps them. A result beyond n goes through the network again until it falls inside; chances against ``WALKS`` times are
    beyond reckoning save for tiny n, where no orbit is that long; anything else is an error.
    """
    def one(value: Column, f) -> Column:
        return F.transform(F.array(value), f)[0]  # the value is worked out once, however often f names it

    def network(x: Column, side: Column) -> Column:
        digits = F.struct(F.floor(x / side).alias("left"), (x % side).alias("right"))
        for k, m in enumerate(ROUNDS):
            mixed = lambda right: ((right * m + (seed + 1) * (k + 1) * 31337) % 2147483647 * 48271 + right) % 2147483647  # noqa: E731, B023
            digits = one(digits, lambda d: F.struct(d["right"].alias("left"), ((d["left"] + mixed(d["right"])) % side).alias("right")))  # noqa: B023
        return one(digits, lambda d: (d["left"] * side + d["right"]).cast("bigint"))

    def walk(args: Column) -> Column:
        step = lambda acc, _: F.when(acc < args["n"], acc).otherwise(network(acc, args["side"]))
        further = lambda x: one(F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), x, step), lambda found: F.when(found < args["n"], found).otherwise(F.raise_error(F.lit("a number left its range")).cast("bigint")))
        return one(network(args["x"], args["side"]), lambda x: F.when(x < args["n"], x).otherwise(further(x)))

    args = F.struct(number.cast("bigint").alias("x"), n.cast("bigint").alias("n"), F.ceil(F.sqrt(n.cast("double"))).cast("bigint").alias("side"))
    return one(args, walk)


def _dealt(df: DataFrame, features: list[str], key: str, seed: int, most: int) -> DataFrame:
    """``df`` with ``_other``, the features of the row whose values a row gets. Rows are numbered once, in a written table that both sides of the join read."""
    n = df.agg(F.count(F.lit(1)).alias("_size"))
    numbered = with_one_row(running(df, [], [key], {"_i": F.lit(1).cast("bigint")}, most), n)
    rows = persist_table(numbered.withColumn("_from", shuffled_number(F.col("_i"), F.col("_size"), seed)).drop("_size"))
    return rows.drop("_i").join(rows.select(F.col("_i").alias("_from"), F.struct(*features).alias("_other")), "_from")


def permuted(df: DataFrame, feature: str, key: str, seed: int = 0, most: int = MOST) -> DataFrame:
    """``df`` with the values of one feature dealt out again: row i in the order of ``key`` gets the value of row ``shuffled_number(i)``.

    Rows are numbered over equi-depth slices of the key, so no window runs over more than ``most`` rows. ``key`` is unique.
    """
    return _dealt(df, [feature], key, seed, most).withColumn(feature, F.col("_other")[feature]).select(*df.columns)


def permutation_importance(model, df: DataFrame, features: list[str], key: str = "match_id", seed: int = 0, scorer=score, most: int = MOST) -> DataFrame:
    """Log-loss after permuting a feature minus the loss before; one row per feature. All features are dealt out by one join; ``scorer(model, rows)`` gives probabilities."""
    base = scorer(model, df).agg(_loss().alias("base_loss"))
    dealt = persist_table(_dealt(df, features, key, seed, most))
    out = None
    for f in features:
        moved = dealt.withColumn(f, F.col("_other")[f]).select(*df.columns)
        one = scorer(model, moved).agg(_loss().alias("loss")).withColumn("feature", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return with_one_row(out, base).select("feature", "base_loss", "loss", (F.col("loss") - F.col("base_loss")).alias("importance"))


def linear_scorer(weights: dict[str, dict[str, float]], df: DataFrame) -> DataFrame:
    """Outcome probabilities of given coefficients: the softmax of one linear score per probability column (``intercept`` is its constant)."""
    scores = {p: F.exp(add([F.lit(float(w)) * (F.lit(1.0) if f == "intercept" else F.col(f)) for f, w in ws.items()])) for p, ws in weights.items()}
    out = df.withColumns({f"_e_{p}": e for p, e in scores.items()})
    whole = add([F.col(f"_e_{p}") for p in weights])
    return out.withColumns({p: F.col(f"_e_{p}") / whole for p in weights}).drop(*[f"_e_{p}" for p in weights])


def bootstrap_importance(df: DataFrame, features: list[str], label: str = "label", replicates: int = 100, trees: int = 20, depth: int = 5, seed: int = 42, key: str = "match_id") -> DataFrame:
    """Mean and interval of forest importances over resamples of the rows.

    A resample is a weight per row (``drawn_times``); the forests of all resamples grow together, over cells of bins and label (``forests``).
    """
    found = resampled_importances(df, key, label, features, replicates, trees, depth, seed)
    rows = [(b, f, float(v)) for b, values in enumerate(found) for f, v in zip(features, values)]
    table = df.sparkSession.createDataFrame(rows, "replicate int, feature string, importance double")  # replicates x features
    return table.groupBy("feature").agg(F.avg("importance").alias("mean"), F.percentile("importance", 0.025).alias("ci_low"), F.percentile("importance", 0.975).alias("ci_high"))


def compare_models(preds: DataFrame, baseline: str) -> DataFrame:
    """Metric table per ``model`` over the same rows, with wins against the baseline."""
    m = preds.groupBy("model").agg(F.avg(hit()).alias("accuracy"), F.avg(logloss_row()).alias("log_loss"), F.avg(brier_row()).alias("brier"), F.count(F.lit(1)).alias("n"))
    base = m.filter(F.col("model") == baseline).select(*[F.col(c).alias(f"_{c}") for c in ("accuracy", "log_loss", "brier")])
    out = with_one_row(m, base)
    wins = (F.col("accuracy") > F.col("_accuracy")).cast("int") + (F.col("log_loss") < F.col("_log_loss")).cast("int") + (F.col("brier") < F.col("_brier")).cast("int")
    return out.withColumn("wins", wins).select("model", "accuracy", "log_loss", "brier", "n", "wins")


def pairwise_average(metrics: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Mean of two models' metrics per named pair."""
    entries = F.array(*[F.struct(F.lit(n).alias("pair"), F.lit(m).alias("member")) for n, ab in pairs.items() for m in ab])
    rows = metrics.withColumn("e", F.explode(entries)).filter(F.col("model") == F.col("e.member"))
    return rows.groupBy(F.col("e.pair").alias("pair")).agg(*[F.avg(c).alias(c) for c in ("accuracy", "log_loss", "brier")])
