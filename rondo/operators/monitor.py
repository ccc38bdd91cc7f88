"""Production monitoring over prediction logs: health checks, guardrails, incidents, shadow analysis."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import add, count_if, epoch_us, lookup, share, with_one_row
from ..session import persist_table
from . import drift as D
from . import metrics as M
from .windows import brier_degradation, latency_percentiles, newest

P3 = ("p_home", "p_draw", "p_away")
CHECK = ["component", "metric", "value", "status", "threshold"]


def _check(component: str, metric: str | Column, value: Column, status: str | Column, threshold: float | None = None) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(component).alias("component"), as_col(metric).alias("metric"), value.cast("double").alias("value"), as_col(status).alias("status"),
                    F.lit(threshold).cast("double").alias("threshold"))


def _bad(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf"))


# ---- health --------------------------------------------------------------------------------------


def prediction_health(log: DataFrame, keys: list[str], lam: str = "baseline_lambda") -> DataFrame:
    """Check rows per prediction: missing or infinite probabilities, invalid lambda, probabilities off one. Healthy rows emit nothing."""
    nan = add([F.when(_bad(F.col(p)), 1).otherwise(0) for p in P3])
    total = add([F.when(F.col(p).isNull() | F.isnan(p), 0.0).otherwise(F.col(p)) for p in P3])
    dev = F.abs(total - 1.0)
    lamv = F.col(lam)
    checks = F.array_compact(F.array(
        F.when(nan > 0, _check("prediction", "nan_probabilities", nan, "FAIL")),
        F.when(_bad(lamv) | (lamv < 0), _check("prediction", "invalid_lambda", F.coalesce(lamv, F.lit(-999.0)), "FAIL")),
        F.when(dev > 0.01, _check("prediction", "probability_sum_deviation", dev, F.when(dev < 0.05, "WARN").otherwise("FAIL"), 0.01))))
    return log.select(*keys, F.explode(checks).alias("c")).select(*keys, "c.*")


def feature_health(log: DataFrame, keys: list[str], approved: list[str]) -> DataFrame:
    """Check rows per request for text-typed approved features: missing, not a number, outside [0, 1]."""
    checks = []
    for f in approved:
        v = F.expr(f"try_cast(`{f}` AS double)")
        checks += [F.when(F.col(f).isNull(), _check("feature", f"missing_{f}", F.lit(1.0), "WARN")),
                   F.when(F.col(f).isNotNull() & v.isNull(), _check("feature", f"dtype_corruption_{f}", F.lit(1.0), "FAIL")),
                   F.when((v < 0) | (v > 1), _check("feature", f"out_of_range_{f}", v, "WARN", 1.0))]
    return log.select(*keys, F.explode(F.array_compact(F.array(*checks))).alias("c")).select(*keys, "c.*")


def feature_drift_checks(values: DataFrame, threshold: float = 0.20) -> DataFrame:
    """PSI check rows of a batch of feature values against its reference."""
    p = D.psi(values).filter(F.col("psi") > threshold)
    return p.select(_check("feature", F.concat(F.lit("psi_drift_"), F.col("feature")), F.col("psi"), "FAIL", threshold).alias("c")).select("c.*")


def operational_health(log: DataFrame, order: list[str], window: int = 1000) -> DataFrame:
    """Fallback and leakage rates over all requests, latency percentiles of the last ones, shadow/live divergence; one row."""
    base, shadow = F.col("baseline_lambda"), F.col("shadow_lambda")
    live = F.col("live_lambda") if "live_lambda" in log.columns else base
    div = F.abs(F.abs(shadow - base) / base - F.abs(live - base) / base)
    rates = log.agg(F.count(F.lit(1)).alias("total_requests"), share(F.col("status").contains("FAILSAFE")).alias("fallback_rate"), share(F.col("status") == "FAILSAFE_LEAKAGE").alias("leakage_rejection_rate"),
                    F.avg(F.when(base > 0, div)).alias("mean_divergence"), F.max(F.when(base > 0, div)).alias("max_divergence"))
    pct = latency_percentiles(log, "latency_ms", order, w=window).drop("n")
    return with_one_row(rates, pct)


def operational_checks(health: DataFrame, fallback: float = 0.05, divergence: float = 0.10) -> DataFrame:
    checks = F.array_compact(F.array(
        F.when(F.col("fallback_rate") > fallback, _check("operational", "fallback_rate", F.col("fallback_rate"), "FAIL", fallback)),
        F.when(F.col("max_divergence") > divergence, _check("operational", "shadow_live_divergence", F.col("max_divergence"), "WARN", divergence))))
    return health.select(F.explode(checks).alias("c")).select("c.*")


def calibration_health(log: DataFrame, key: str, order: list[str], window: int = 1000) -> DataFrame:
    """Over each key's last rows: Brier of the home probability, its degradation and the calibration slope."""
    y = F.when(F.col("actual") == 1, 1.0).otherwise(0.0)
    rows = log.filter(F.col("p_home").isNotNull() & F.col("actual").isNotNull()).select(key, *order, "p_home", "actual", F.pow(F.col("p_home") - y, F.lit(2.0)).alias("sq"))
    last = newest(rows, [key], order, window)
    base = last.groupBy(key).agg(F.count(F.lit(1)).alias("sample_size"), F.avg("sq").alias("rolling_brier"))
    deg = brier_degradation(last, key, "sq", order).select(key, "degradation", F.col("alert").alias("degraded"))
    slope = M.rolling_calibration_slope(last, F.col("p_home"), y, [key]).select(key, "slope", F.col("ok").alias("slope_ok"))
    return base.join(deg, key, "left").join(slope, key, "left")


def calibration_checks(health: DataFrame, key: str) -> DataFrame:
    checks = F.array_compact(F.array(
        F.when(F.col("degraded"), _check("calibration", "brier_degradation", F.col("degradation"), "FAIL", 0.01)),
        F.when(~F.col("slope_ok"), _check("calibration", "calibration_slope", F.col("slope"), "FAIL"))))
    return health.select(key, F.explode(checks).alias("c")).select(key, "c.*")


def health_summary(checks: DataFrame) -> DataFrame:
    """Counts of checks by component and status, and of the prediction failures by metric; one row."""
    at = lambda comp, st: count_if((F.col("component") == comp) & (F.col("status") == st))
    cols = [at(c, s).alias(f"{c}_{s.lower()}") for c in ("prediction", "feature", "operational", "calibration") for s in ("FAIL", "WARN")]
    val = lambda m: F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0))
    return checks.agg(F.count(F.lit(1)).alias("n_checks"), val("nan_probabilities").alias("nan_probabilities"), count_if(F.col("metric") == "invalid_lambda").alias("invalid_lambdas"), *cols)


# ---- guardrails ----------------------------------------------------------------------------------

# guardrail -> (threshold, action, severity, cooldown seconds, auto rollback, incident type) (fixed values)
GUARDRAILS = {
    "psi_drift": (0.20, "DISABLE_FEATURE", "CRITICAL", 600, True, "PSI_DRIFT"),
    "fallback_rate": (0.05, "DISABLE_UPLIFT", "CRITICAL", 300, True, "HIGH_FALLBACK_RATE"),
    "calibration_slope": (0.05, "DISABLE_UPLIFT", "CRITICAL", 600, True, "CALIBRATION_DRIFT"),
    "brier_degradation": (0.01, "DISABLE_UPLIFT", "CRITICAL", 600, True, "BRIER_DEGRADATION"),
    "nan_predictions": (0.0, "DISABLE_UPLIFT", "EMERGENCY", 60, True, "NAN_PREDICTIONS"),
    "feature_corruption": (0.0, "DISABLE_FEATURE", "EMERGENCY", 120, True, "FEATURE_CORRUPTION"),
    "temporal_leakage": (0.0, "REGISTER_INCIDENT", "CRITICAL", 0, False, "TEMPORAL_LEAKAGE"),
}
_FIELDS = ("threshold", "action", "severity", "cooldown_s", "auto_rollback", "incident_type")


def guardrail_key(metric: str | Column = "metric") -> Column:
    """Guardrail a metric name belongs to; NULL when none."""
    m = F.lower(F.col(metric) if isinstance(metric, str) else metric)
    has = lambda w: F.contains(m, F.lit(w))
    return (F.when(has("psi") & has("drift"), "psi_drift").when(has("fallback"), "fallback_rate").when(has("calibration") & has("slope"), "calibration_slope")
            .when(has("brier") & has("degradation"), "brier_degradation").when(has("nan"), "nan_predictions").when(has("corruption"), "feature_corruption").when(has("leakage"), "temporal_leakage"))


def guardrails(checks: DataFrame, config: dict[str, tuple] = GUARDRAILS) -> DataFrame:
    """FAIL checks with their guardrail, action, severity, cooldown and the feature they concern; checks without guardrail drop out."""
    out = checks.filter(F.col("status") == "FAIL").withColumn("guardrail", guardrail_key()).filter(F.col("guardrail").isin(list(config)))
    out = out.withColumns({f: lookup({k: v[i] for k, v in config.items()}, F.col("guardrail")) for i, f in enumerate(_FIELDS)})
    feature = F.regexp_extract("metric", r"^(?:psi_drift|dtype_corruption)_(.+)$", 1)
    return out.withColumn("affected_feature", F.when(feature != "", feature))


def cooldown(triggers: DataFrame, ts: str = "ts", trigger_id: str = "trigger_id", unit: str = "day") -> DataFrame:
    """Mark triggers accepted or suppressed: one within the cooldown of the last accepted trigger is suppressed.

    Pointers lead from every trigger to the first one after its cooldown and are doubled until the chain is covered. Every round joins on
    (guardrail, time), which spreads a hot guardrail over all tasks; after round i the first 2^i accepted triggers of each
    guardrail are known, so the rounds are logarithmic in the accepted triggers.
    """
    from .joins import asof_row

    rows = triggers.select("guardrail", epoch_us(ts).alias("t"), F.col(trigger_id).cast("bigint").alias("id"), (F.col("cooldown_s").cast("bigint") * 1_000_000).alias("cool"))
    mirror = lambda c: F.timestamp_micros(F.lit(4_102_444_800_000_000) - c).cast("timestamp_ntz")  # noqa: E731  time reversed: 'next' becomes 'latest before'
    nodes = persist_table(rows.filter(F.col("cool") > 0).groupBy("guardrail", "t").agg(F.min("id").alias("id"), F.max("cool").alias("cool")))
    probes = nodes.select("guardrail", "t", "id", mirror(F.col("t") + F.col("cool")).alias("at"))
    marks = nodes.select("guardrail", "t", mirror(F.col("t")).alias("at"))
    jump = asof_row(probes, marks, ["t"], "n", "guardrail", "at", "at", "id", strict=False, unit=unit)
    jump = persist_table(jump.select("guardrail", "t", F.col("n.t").alias("to")).filter(F.col("to").isNotNull()))
    reached = persist_table(nodes.groupBy("guardrail").agg(F.min("t").alias("t")))
    known = reached.count()
    while True:
        ahead = reached.join(jump, ["guardrail", "t"]).select("guardrail", F.col("to").alias("t"))
        reached = persist_table(reached.unionByName(ahead).distinct())
        before, known = known, reached.count()
        if known == before:
            break
        twice = jump.select("guardrail", F.col("t").alias("from"), F.col("to").alias("t")).join(jump, ["guardrail", "t"])
        jump = persist_table(twice.select("guardrail", F.col("from").alias("t"), "to"))
    first = nodes.select("guardrail", "t", "id").join(reached, ["guardrail", "t"]).select("guardrail", "t", "id", F.lit(True).alias("hit"))
    out = rows.join(first, ["guardrail", "t", "id"], "left").select("guardrail", "id", F.coalesce("hit", F.col("cool") == 0).alias("accepted"))
    return out.select(F.col("id").alias(trigger_id), "guardrail", "accepted")


def guardrail_state(actions: DataFrame, ts: str = "ts", order: str = "trigger_id") -> DataFrame:
    """Current state per target: the uplift, or a feature. Columns: target, action, ts; enable actions undo disable ones."""
    target = F.when(F.col("action").isin("DISABLE_FEATURE", "ENABLE_FEATURE"), F.concat(F.lit("feature:"), F.col("affected_feature"))).when(
        F.col("action").isin("DISABLE_UPLIFT", "FALLBACK_BASELINE", "ENABLE_UPLIFT"), F.lit("uplift"))
    rows = actions.withColumn("target", target).filter(F.col("target").isNotNull())
    last = F.struct(ts, order)
    return rows.groupBy("target").agg(F.max_by(~F.col("action").startswith("ENABLE"), last).alias("disabled"), F.max_by(ts, last).alias("since"), F.count(F.lit(1)).alias("n_actions"))


# ---- incidents -----------------------------------------------------------------------------------

# incident types and severities, as full enumerations (fixed values)
INCIDENT_TYPES = ["PSI_DRIFT", "HIGH_FALLBACK_RATE", "CALIBRATION_DRIFT", "BRIER_DEGRADATION", "NAN_PREDICTIONS", "FEATURE_CORRUPTION",
                  "TEMPORAL_LEAKAGE", "LATENCY_SPIKE", "API_FAILURE", "REGIME_CHANGE"]
SEVERITIES = ["INFO", "WARNING", "CRITICAL", "EMERGENCY"]


def incidents(triggers: DataFrame, ts: str = "ts", trigger_id: str = "trigger_id") -> DataFrame:
    """Incident rows of accepted guardrail triggers, ready to append."""
    return triggers.select(
        F.concat(F.lit("INC-"), F.lpad(F.col(trigger_id).cast("string"), 12, "0")).alias("incident_id"), F.col(ts).alias("ts"), "incident_type", "severity", "guardrail",
        F.col("value").cast("double").alias("metric_value"), F.col("threshold").cast("double").alias("threshold"), "affected_feature",
        F.col("auto_rollback").alias("fallback_triggered"), F.when(F.col("auto_rollback"), "TRIGGERED").otherwise("NOT_TRIGGERED").alias("rollback_status"), F.lit(False).alias("resolved"))


def incident_state(events: DataFrame, key: str = "incident_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Fold register / resolve / rollback / complete / fail events to the current state of each incident."""
    o = F.struct(*order)
    is_ = lambda *v: F.col("event").isin(*v)
    status = lookup({"register": "NOT_TRIGGERED", "rollback": "TRIGGERED", "complete": "COMPLETED", "fail": "FAILED"}, F.col("event"))
    rb = is_("rollback", "complete", "fail")
    return events.groupBy(key).agg(
        F.min(F.when(is_("register"), F.col(order[0]))).alias("registered_at"), F.max(is_("resolve")).alias("resolved"),
        F.max(F.when(is_("resolve"), F.col(order[0]))).alias("resolved_at"),
        F.coalesce(F.max_by(F.when(rb, status), F.when(rb, o)), F.lit("NOT_TRIGGERED")).alias("rollback_status"), F.max(is_("rollback")).alias("fallback_triggered"))


def incident_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts over a full enumeration; absent values count 0."""
    all_ = F.array(*[F.struct(F.lit(v).alias(column), count_if(F.col(column) == v).alias("n")) for v in values])
    return df.agg(all_.alias("e")).select(F.explode("e").alias("e")).select("e.*")


def incident_filter(df: DataFrame, incident_type: str | None = None, severity: str | None = None, feature: str | None = None, active: bool | None = None,
                    start: str | None = None, end: str | None = None) -> DataFrame:
    """Incidents by type, severity, feature, open state and closed time window."""
    for c, v in (("incident_type", incident_type), ("severity", severity), ("affected_feature", feature)):
        if v is not None:
            df = df.filter(F.col(c) == v)
    if active is not None:
        df = df.filter(F.col("resolved") != active)
    kind = dict(df.dtypes)["ts"]
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast(kind))
    if end is not None:
        df = df.filter(F.col("ts") <= F.lit(end).cast(kind))
    return df


def latest_incidents(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(F.col("ts").desc(), F.col("incident_id").desc()).limit(n)


def retain_incidents(df: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Incidents younger than the retention."""
    return df.filter(epoch_us("ts") > epoch_us(F.lit(now)) - days * 86_400_000_000)


def rollback_rate(df: DataFrame, now: str, window_hours: int = 24) -> DataFrame:
    """Share of incidents of the window that were rolled back; 0 without incidents; one row."""
    t, end = epoch_us("ts"), epoch_us(F.lit(now))
    inside = df.filter(t.between(end - window_hours * 3_600_000_000, end))
    return inside.agg(F.count(F.lit(1)).alias("n"), F.coalesce(share(F.col("rollback_status") != "NOT_TRIGGERED"), F.lit(0.0)).alias("rollback_rate"))


def rollback_criteria(df: DataFrame) -> DataFrame:
    """Rollback decision and its reasons. Needs slope, brier_degradation, availability, skew_significant, uplift."""
    reasons = F.array_compact(F.array(
        F.when(~F.col("slope").between(0.9, 1.1), "calibration_slope"), F.when(F.col("brier_degradation") > 0.01, "brier_degradation"),
        F.when(F.col("availability") < 0.8, "feature_availability"), F.when(F.col("skew_significant"), "online_offline_skew"), F.when(F.col("uplift") < 0, "negative_uplift")))
    return df.withColumn("reasons", reasons).withColumn("should_rollback", F.size("reasons") > 0)


# ---- shadow, registry, sources -------------------------------------------------------------------


def _rel_diff() -> Column:
    return F.abs(F.col("shadow_lambda") - F.col("baseline_lambda")) / F.col("baseline_lambda")


def shadow_disagreement(log: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Disagreement of shadow and baseline expectations; one row."""
    d = _rel_diff()
    return log.agg(F.count(F.lit(1)).alias("total_matches"), F.avg(d).alias("mean_disagreement"), F.max(d).alias("max_disagreement"), count_if(d > threshold).alias("high_count"),
                   share(d > threshold).alias("high_ratio"), F.stddev_samp("shadow_lambda").alias("shadow_volatility"))


def top_disagreements(log: DataFrame, key: str = "request_id", threshold: float = 0.15, n: int = 5) -> DataFrame:
    return log.withColumn("rel_diff", _rel_diff()).filter(F.col("rel_diff") > threshold).orderBy(F.col("rel_diff").desc(), key).limit(n).select(key, "baseline_lambda", "shadow_lambda", "rel_diff")


# feature -> (status, impact on calibration, drift risk, interval low, interval high, version) (fixed values)
FEATURE_REGISTRY = {
    "continuity_index": ("APPROVED", 0.0057, "LOW", 0.0051, 0.0063, "1.0.0"),
    "defenders_continuity": ("APPROVED", 0.0021, "MEDIUM", 0.0015, 0.0028, "1.0.0"),
    "midfielders_continuity": ("EXPERIMENTAL", 0.0004, "HIGH", -0.0001, 0.0010, "1.0.0"),
    "forwards_continuity": ("REJECTED", -0.0001, "HIGH", -0.0005, 0.0002, "1.0.0"),
}


def with_registry(df: DataFrame, registry: dict[str, tuple] = FEATURE_REGISTRY, name: str = "feature_name") -> DataFrame:
    """Registry status of each feature record; unregistered features have none."""
    return df.withColumn("registry_status", lookup({k: v[0] for k, v in registry.items()}, F.col(name)))


def approved_only(df: DataFrame, registry: dict[str, tuple] = FEATURE_REGISTRY, name: str = "feature_name") -> DataFrame:
    """Records of approved features; the list reaches the scan as a filter."""
    return df.filter(F.col(name).isin([k for k, v in registry.items() if v[0] == "APPROVED"]))


def version_lineage(df: DataFrame, key: str = "feature_name", version: str = "feature_version", ts: str = "created_ts") -> tuple[DataFrame, DataFrame]:
    """History rows per (feature, version) with first and last use and the version before; and the latest version per feature."""
    hist = df.groupBy(key, version).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_records"))
    w = Window.partitionBy(key).orderBy("first_ts", version)  # one row per version
    hist = hist.withColumn("parent_version", F.lag(version).over(w))
    latest = hist.groupBy(key).agg(F.max_by(version, F.struct("first_ts", version)).alias("latest_version"), F.count(F.lit(1)).alias("n_versions"))
    return hist, latest


def fallback_merge(primary: DataFrame, fallback: DataFrame, keys: list[str], ts: str, cutoff: str) -> DataFrame:
    """Per key: the primary feed's rows if it has any, else the fallback's rows since the cut-off."""
    kind = dict(fallback.dtypes)[ts]
    recent = fallback.filter(F.col(ts) >= F.lit(cutoff).cast(kind)).withColumn("feed", F.lit("fallback"))
    served = primary.select(*keys).distinct()
    return primary.withColumn("feed", F.lit("primary")).unionByName(recent.join(served, keys, "left_anti"))
