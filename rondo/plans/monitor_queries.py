"""Registered queries: health checks, guardrails, incidents, shadow analysis."""

from pyspark.sql import functions as F

from ..operators import monitor as MO
from .drift_queries import _PSI, LONG, grid_sql, long_features
from .metric_queries import r, rel, y
from .registry import query

# ---- the log with planted faults -------------------------------------------------------------------
_LOG = """lg AS (SELECT * REPLACE (CASE WHEN request_id % 59 = 0 THEN -1.0 ELSE baseline_lambda END AS baseline_lambda,
  CASE WHEN request_id % 61 = 0 THEN p_draw + 0.03 WHEN request_id % 67 = 0 THEN p_draw + 0.2 ELSE p_draw END AS p_draw) FROM prediction_log)"""
_CHK = f"""{_LOG},
base AS (SELECT *, CASE WHEN p_home IS NULL THEN 1 ELSE 0 END AS nan, abs(coalesce(p_home, 0) + p_draw + p_away - 1) AS dev FROM lg),
chk AS (SELECT request_id, kickoff_ts, 'prediction' AS component, 'nan_probabilities' AS metric, CAST(nan AS DOUBLE) AS value, 'FAIL' AS status, NULL::DOUBLE AS threshold FROM base WHERE nan > 0
UNION ALL SELECT request_id, kickoff_ts, 'prediction', 'invalid_lambda', baseline_lambda, 'FAIL', NULL FROM base WHERE baseline_lambda < 0
UNION ALL SELECT request_id, kickoff_ts, 'prediction', 'probability_sum_deviation', dev, CASE WHEN dev < 0.05 THEN 'WARN' ELSE 'FAIL' END, 0.01 FROM base WHERE dev > 0.01)"""


def faulty_log(t):
    i = F.col("request_id")
    return t.prediction_log.withColumns({
        "baseline_lambda": F.when(i % 59 == 0, -1.0).otherwise(F.col("baseline_lambda")),
        "p_draw": F.when(i % 61 == 0, F.col("p_draw") + 0.03).when(i % 67 == 0, F.col("p_draw") + 0.2).otherwise(F.col("p_draw"))})


@query("prediction_health", f"WITH {_CHK} SELECT request_id, component, metric, #[value]# AS value, status FROM chk", "prediction_log")
def _(t):
    return r(MO.prediction_health(faulty_log(t), ["request_id"]).drop("threshold"), "value")


_FEAT = """ft AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'bad' WHEN event_id % 13 = 0 THEN NULL ELSE CAST(value / 400 AS VARCHAR) END AS continuity_index, CASE WHEN event_id % 17 = 0 THEN NULL ELSE '0.5' END AS defenders_continuity FROM events)"""


def text_features(t):
    i = F.col("event_id")
    return t.events.select("event_id", F.when(i % 11 == 0, "bad").when(i % 13 != 0, (F.col("value") / 400).cast("string")).alias("continuity_index"), F.when(i % 17 != 0, "0.5").alias("defenders_continuity"))


_FCHK = """SELECT 'missing_continuity_index' AS metric, 'WARN' AS status, count(*) AS n FROM ft WHERE continuity_index IS NULL
UNION ALL SELECT 'missing_defenders_continuity', 'WARN', count(*) FROM ft WHERE defenders_continuity IS NULL
UNION ALL SELECT 'dtype_corruption_continuity_index', 'FAIL', count(*) FROM ft WHERE continuity_index = 'bad'
UNION ALL SELECT 'out_of_range_continuity_index', 'WARN', count(*) FROM ft WHERE TRY_CAST(continuity_index AS DOUBLE) > 1"""


@query("feature_health", f"WITH {_FEAT} SELECT * FROM ({_FCHK}) WHERE n > 0")
def _(t):
    checks = MO.feature_health(text_features(t), ["event_id"], ["continuity_index", "defenders_continuity"])
    return checks.groupBy("metric", "status").agg(F.count(F.lit(1)).alias("n"))


@query("feature_psi_checks", f"WITH {LONG}, {grid_sql('shared')}, p AS (SELECT feature, sum((pc - pr) * ln(pc / pr)) AS psi FROM {_PSI['shared']} GROUP BY 1) SELECT 'feature' AS component, 'psi_drift_' || feature AS metric, #[psi]# AS value, 'FAIL' AS status FROM p WHERE psi > 0.2", "features")
def _(t):
    return r(MO.feature_drift_checks(long_features(t)).drop("threshold"), "value")


@query("operational_health", """
SELECT a.*, #[quantile_cont(latency_ms, 0.5)]# AS p50, #[quantile_cont(latency_ms, 0.95)]# AS p95, #[quantile_cont(latency_ms, 0.99)]# AS p99 FROM (
  SELECT count(*) AS total_requests, #[avg(CAST(status LIKE '%FAILSAFE%' AS INT))]# AS fallback_rate, #[avg(CAST(status = 'FAILSAFE_LEAKAGE' AS INT))]# AS leakage_rejection_rate,
    #[avg(abs(shadow_lambda - baseline_lambda) / baseline_lambda)]# AS mean_divergence, #[max(abs(shadow_lambda - baseline_lambda) / baseline_lambda)]# AS max_divergence FROM prediction_log) a,
  (SELECT latency_ms FROM prediction_log ORDER BY kickoff_ts DESC, request_id DESC LIMIT 1000) GROUP BY ALL""", "prediction_log")
def _(t):
    out = MO.operational_health(t.prediction_log, ["kickoff_ts", "request_id"])
    return r(out, *[c for c in out.columns if c != "total_requests"])


_CALH = f"""lw AS (SELECT * FROM (SELECT pool, p_home, actual, pow(p_home - {y(1)}, 2) AS sq, row_number() OVER (PARTITION BY pool ORDER BY kickoff_ts DESC, request_id DESC) AS rn FROM prediction_log WHERE p_home IS NOT NULL) WHERE rn <= 1000)"""


@query("calibration_health", f"""WITH {_CALH},
s AS (SELECT pool, regr_slope(obs, pm) AS slope, count(*) AS nb FROM {rel('p_home', y(1), 4, 'lw', 'pool')} GROUP BY 1)
SELECT pool, count(*) AS sample_size, #[avg(sq)]# AS rolling_brier, #[CASE WHEN count(*) >= 50 THEN avg(sq) FILTER (rn <= 10) - avg(sq) FILTER (rn > 10) END]# AS degradation, CASE WHEN count(*) >= 50 THEN avg(sq) FILTER (rn <= 10) - avg(sq) FILTER (rn > 10) > 0.01 END AS degraded,
  #[any_value(CASE WHEN nb >= 3 THEN slope END)]# AS slope, any_value(CASE WHEN nb >= 3 THEN slope BETWEEN 0.95 AND 1.05 END) AS slope_ok FROM lw LEFT JOIN s USING (pool) GROUP BY 1""", "prediction_log")
def _(t):
    return r(MO.calibration_health(t.prediction_log, "pool", ["kickoff_ts", "request_id"]), "rolling_brier", "degradation", "slope")


_OPS = """op AS (SELECT CAST(avg(CAST(status LIKE '%FAILSAFE%' AS INT)) > 0.05 AS BIGINT) AS fail, CAST(max(abs(shadow_lambda - baseline_lambda) / baseline_lambda) > 0.10 AS BIGINT) AS warn FROM prediction_log)"""
_CALC = f"""{_CALH}, cs AS (SELECT pool, regr_slope(obs, pm) AS slope, count(*) AS nb FROM {rel('p_home', y(1), 4, 'lw', 'pool')} GROUP BY 1),
cal AS (SELECT pool, count(*) >= 50 AND avg(sq) FILTER (rn <= 10) - avg(sq) FILTER (rn > 10) > 0.01 AS degraded, any_value(nb >= 3 AND slope NOT BETWEEN 0.95 AND 1.05) AS off_slope FROM lw LEFT JOIN cs USING (pool) GROUP BY 1),
cc AS (SELECT coalesce(count(*) FILTER (degraded), 0)::BIGINT + coalesce(count(*) FILTER (off_slope), 0)::BIGINT AS fail FROM cal)"""


@query("health_summary", f"""WITH {_CHK}, {_FEAT}, f AS ({_FCHK}), {_OPS}, {_CALC}
SELECT n + (SELECT sum(n) FROM f)::BIGINT + (SELECT op.fail + op.warn + cc.fail FROM op, cc) AS n_checks, #[nanv]# AS nan_probabilities, il AS invalid_lambdas, pf AS prediction_fail, pw AS prediction_warn, (SELECT sum(n) FROM f WHERE status = 'FAIL')::BIGINT AS feature_fail,
  (SELECT sum(n) FROM f WHERE status = 'WARN')::BIGINT AS feature_warn, (SELECT fail FROM op) AS operational_fail, (SELECT warn FROM op) AS operational_warn, (SELECT fail FROM cc) AS calibration_fail, 0::BIGINT AS calibration_warn FROM (
  SELECT count(*) AS n, sum(value) FILTER (metric = 'nan_probabilities') AS nanv, count(*) FILTER (metric = 'invalid_lambda') AS il, count(*) FILTER (status = 'FAIL') AS pf, count(*) FILTER (status = 'WARN') AS pw FROM chk)""", "prediction_log")
def _(t):
    a = MO.prediction_health(faulty_log(t), [])
    b = MO.feature_health(text_features(t), [], ["continuity_index", "defenders_continuity"])
    order = ["kickoff_ts", "request_id"]
    c = MO.operational_checks(MO.operational_health(t.prediction_log, order))
    d = MO.calibration_checks(MO.calibration_health(t.prediction_log, "pool", order), "pool").drop("pool")
    return r(MO.health_summary(a.unionByName(b).unionByName(c).unionByName(d)), "nan_probabilities")


_GK = "CASE metric WHEN 'psi_drift_continuity_index' THEN 'psi_drift' WHEN 'nan_probabilities' THEN 'nan_predictions' ELSE metric END"
_GR = f"""gr AS (SELECT *, {_GK} AS guardrail, CASE {_GK} WHEN 'psi_drift' THEN 600 WHEN 'fallback_rate' THEN 300 WHEN 'brier_degradation' THEN 600 ELSE 60 END AS cooldown_s FROM triggers)"""


def triggered(t, scale=1):
    config = {k: (*v[:3], v[3] * scale, *v[4:]) for k, v in MO.GUARDRAILS.items()}
    return MO.guardrails(t.triggers.withColumnRenamed("metric_value", "value"), config)


@query("guardrail_evaluate", f"""WITH {_GR}
SELECT trigger_id, guardrail, CASE WHEN guardrail = 'psi_drift' THEN 'DISABLE_FEATURE' ELSE 'DISABLE_UPLIFT' END AS action, CASE WHEN guardrail = 'nan_predictions' THEN 'EMERGENCY' ELSE 'CRITICAL' END AS severity,
  CAST(cooldown_s AS INT) AS cooldown_s, TRUE AS auto_rollback, CASE WHEN guardrail = 'psi_drift' THEN 'continuity_index' END AS affected_feature FROM gr""", "triggers")
def _(t):
    return triggered(t).select("trigger_id", "guardrail", "action", "severity", "cooldown_s", "auto_rollback", "affected_feature")


_ACC = """nx AS (SELECT guardrail, trigger_id, ts, row_number() OVER (PARTITION BY guardrail ORDER BY ts) AS i, (SELECT min(b.ts) FROM gr b WHERE b.guardrail = a.guardrail AND epoch_us(b.ts) >= epoch_us(a.ts) + a.cooldown_s::BIGINT * {scale} * 1000000) AS nt FROM gr a),
acc AS (SELECT guardrail, trigger_id, ts, nt FROM nx WHERE i = 1 UNION ALL SELECT n.guardrail, n.trigger_id, n.ts, n.nt FROM acc a JOIN nx n ON n.guardrail = a.guardrail AND n.ts = a.nt)"""


@query("guardrail_cooldown", f"WITH {_GR}, {_ACC.format(scale=20)} SELECT g.trigger_id, g.guardrail, a.trigger_id IS NOT NULL AS accepted FROM gr g LEFT JOIN acc a USING (trigger_id)", "triggers", recursive=True)
def _(t):
    return MO.cooldown(triggered(t, 20))


_ACTIONS = f"""{_GR}, act AS (SELECT trigger_id, ts, CASE WHEN guardrail = 'psi_drift' THEN 'feature:continuity_index' ELSE 'uplift' END AS target, trigger_id % 3 <> 0 AS disabled FROM gr)"""


@query("guardrail_state", f"WITH {_ACTIONS} SELECT target, arg_max(disabled, ts) AS disabled, epoch_us(max(ts)) AS since_us, count(*) AS n_actions FROM act GROUP BY 1", "triggers")
def _(t):
    from ..functions.expr import epoch_us

    a = triggered(t)
    undo = F.when(F.col("trigger_id") % 3 != 0, F.col("action")).otherwise(F.replace(F.col("action"), F.lit("DISABLE"), F.lit("ENABLE")))
    return MO.guardrail_state(a.withColumn("action", undo)).select("target", "disabled", epoch_us("since").alias("since_us"), "n_actions")


_INC = f"""{_GR}, inc AS (SELECT 'INC-' || lpad(CAST(trigger_id AS VARCHAR), 12, '0') AS incident_id, ts, CASE guardrail WHEN 'psi_drift' THEN 'PSI_DRIFT' WHEN 'fallback_rate' THEN 'HIGH_FALLBACK_RATE' WHEN 'brier_degradation' THEN 'BRIER_DEGRADATION' ELSE 'NAN_PREDICTIONS' END AS incident_type,
  CASE WHEN guardrail = 'nan_predictions' THEN 'EMERGENCY' ELSE 'CRITICAL' END AS severity, metric_value, CASE guardrail WHEN 'psi_drift' THEN 0.2 WHEN 'fallback_rate' THEN 0.05 WHEN 'brier_degradation' THEN 0.01 ELSE 0 END AS threshold FROM gr)"""


@query("incident_log", f"WITH {_INC} SELECT incident_id, incident_type, severity, #[metric_value]# AS metric_value, CAST(threshold AS DOUBLE) AS threshold, 'TRIGGERED' AS rollback_status FROM inc", "triggers")
def _(t):
    return r(MO.incidents(triggered(t)).select("incident_id", "incident_type", "severity", "metric_value", "threshold", "rollback_status"), "metric_value")


_EV = "ev AS (SELECT event_id, ts, event_id // 5 AS incident_id, CASE WHEN event_id % 5 = 0 THEN 'register' WHEN event_type = 'view' THEN 'resolve' WHEN event_type = 'purchase' THEN 'rollback' WHEN event_type = 'error' THEN 'complete' WHEN event_type = 'click' THEN 'fail' ELSE 'note' END AS event FROM events)"


@query("incident_lifecycle", f"""WITH {_EV}
SELECT incident_id, bool_or(event = 'resolve') AS resolved, coalesce(arg_max(CASE event WHEN 'rollback' THEN 'TRIGGERED' WHEN 'complete' THEN 'COMPLETED' ELSE 'FAILED' END, ts) FILTER (event IN ('rollback', 'complete', 'fail')), 'NOT_TRIGGERED') AS rollback_status,
  bool_or(event = 'rollback') AS fallback_triggered FROM ev GROUP BY 1""")
def _(t):
    i, e = F.col("event_id"), F.col("event_type")
    ev = t.events.select("event_id", "ts", F.floor(i / 5).alias("incident_id"), F.when(i % 5 == 0, "register").when(e == "view", "resolve").when(e == "purchase", "rollback")
                         .when(e == "error", "complete").when(e == "click", "fail").otherwise("note").alias("event"))
    return MO.incident_state(ev).select("incident_id", "resolved", "rollback_status", "fallback_triggered")


@query("incident_queries", f"""WITH {_INC}
SELECT 'type' AS kind, v AS name, count(incident_id) AS n FROM (SELECT unnest({MO.INCIDENT_TYPES}) AS v) LEFT JOIN inc ON incident_type = v GROUP BY 2
UNION ALL SELECT 'severity', v, count(incident_id) FROM (SELECT unnest({MO.SEVERITIES}) AS v) LEFT JOIN inc ON severity = v GROUP BY 2
UNION ALL SELECT 'window', 'critical', count(*) FROM inc WHERE severity = 'CRITICAL' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'
UNION ALL SELECT 'retained', 'all', count(*) FROM inc WHERE ts > TIMESTAMP '2024-02-10' - INTERVAL 30 DAY
UNION ALL SELECT 'latest', incident_id, 1 FROM (SELECT incident_id FROM inc ORDER BY ts DESC, incident_id DESC LIMIT 10)""", "triggers")
def _(t):
    inc = MO.incidents(triggered(t))
    one = lambda df, kind, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n")
    parts = [MO.incident_counts(inc, "severity", MO.SEVERITIES).select(F.lit("severity").alias("kind"), F.col("severity").alias("name"), "n"),
             one(MO.incident_filter(inc, severity="CRITICAL", start="2024-01-10", end="2024-01-20"), "window", "critical"), one(MO.retain_incidents(inc, "2024-02-10"), "retained", "all"),
             MO.latest_incidents(inc).select(F.lit("latest").alias("kind"), F.col("incident_id").alias("name"), F.lit(1).cast("bigint").alias("n"))]
    out = MO.incident_counts(inc, "incident_type", MO.INCIDENT_TYPES).select(F.lit("type").alias("kind"), F.col("incident_type").alias("name"), "n")
    for p in parts:
        out = out.unionByName(p)
    return out


@query("rollback_rate", "SELECT count(*) AS n, #[coalesce(avg(CAST(trigger_id % 3 <> 0 AS INT)), 0)]# AS rollback_rate FROM triggers WHERE ts BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-20'", "triggers")
def _(t):
    inc = t.triggers.withColumn("rollback_status", F.when(F.col("trigger_id") % 3 != 0, "TRIGGERED").otherwise("NOT_TRIGGERED"))
    return r(MO.rollback_rate(inc, "2024-01-20"), "rollback_rate")


@query("rollback_criteria", """
SELECT pool, day, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) AS n_reasons, a OR b OR c OR d OR e AS should_rollback FROM (
  SELECT pool, day, NOT (1 + h - w BETWEEN 0.9 AND 1.1) AS a, h - 0.42 > 0.01 AS b, pd * 3.3 < 0.8 AS c, w > 0.38 AS d, pd - 0.24 < 0 AS e FROM (
    SELECT pool, strftime(kickoff_ts, '%Y-%m-%d') AS day, avg(p_home) AS h, avg(p_draw) AS pd, avg(p_away) AS w FROM predictions GROUP BY 1, 2))""", "predictions")
def _(t):
    d = t.predictions.groupBy("pool", F.date_format("kickoff_ts", "yyyy-MM-dd").alias("day")).agg(F.avg("p_home").alias("h"), F.avg("p_draw").alias("pd"), F.avg("p_away").alias("w"))
    d = d.select("pool", "day", (1 + F.col("h") - F.col("w")).alias("slope"), (F.col("h") - 0.42).alias("brier_degradation"), (F.col("pd") * 3.3).alias("availability"),
                 (F.col("w") > 0.38).alias("skew_significant"), (F.col("pd") - 0.24).alias("uplift"))
    return MO.rollback_criteria(d).select("pool", "day", F.size("reasons").alias("n_reasons"), "should_rollback")


@query("shadow_disagreement", """
SELECT count(*) AS total_matches, #[avg(d)]# AS mean_disagreement, #[max(d)]# AS max_disagreement, count(*) FILTER (d > 0.02) AS high_count, #[avg(CAST(d > 0.02 AS INT))]# AS high_ratio, #[stddev_samp(shadow_lambda)]# AS shadow_volatility
FROM (SELECT *, abs(shadow_lambda - baseline_lambda) / baseline_lambda AS d FROM prediction_log)""", "prediction_log")
def _(t):
    return r(MO.shadow_disagreement(t.prediction_log, 0.02), "mean_disagreement", "max_disagreement", "high_ratio", "shadow_volatility")


@query("shadow_top_disagreements", """
SELECT request_id, #[baseline_lambda]# AS baseline_lambda, #[shadow_lambda]# AS shadow_lambda, #[d]# AS rel_diff FROM (SELECT *, round(abs(shadow_lambda - baseline_lambda) / baseline_lambda, 9) AS d FROM prediction_log) WHERE d > 0.02 ORDER BY d DESC, request_id LIMIT 5""", "prediction_log")
def _(t):
    return r(MO.top_disagreements(t.prediction_log, threshold=0.02), "baseline_lambda", "shadow_lambda", "rel_diff")


@query("feature_registry_join", """
SELECT source_id, CASE feature_name WHEN 'click' THEN 'APPROVED' WHEN 'view' THEN 'EXPERIMENTAL' WHEN 'error' THEN 'REJECTED' END AS registry_status FROM features""", "features")
def _(t):
    reg = {"click": ("APPROVED",), "view": ("EXPERIMENTAL",), "error": ("REJECTED",)}
    return MO.with_registry(t.features, reg).select("source_id", "registry_status")


@query("approved_features", "SELECT source_id, #[feature_value]# AS feature_value FROM features WHERE feature_name = 'click'", "features")
def _(t):
    return r(MO.approved_only(t.features, {"click": ("APPROVED",), "view": ("EXPERIMENTAL",)}).select("source_id", "feature_value"), "feature_value")


@query("feature_version_lineage", """
WITH v AS (SELECT feature_name, strftime(feature_ts, '%W') AS feature_version, feature_ts FROM features),
h AS (SELECT feature_name, feature_version, min(feature_ts) AS f, count(*) AS n_records FROM v GROUP BY 1, 2)
SELECT feature_name, feature_version, n_records, lag(feature_version) OVER (PARTITION BY feature_name ORDER BY f) AS parent_version, arg_max(feature_version, f) OVER (PARTITION BY feature_name) AS latest_version FROM h""".replace("strftime(feature_ts, '%W')", "CAST((epoch_us(feature_ts) // 604800000000) AS VARCHAR)"), "features")
def _(t):
    from ..functions.expr import epoch_us

    v = t.features.select("feature_name", F.floor(epoch_us("feature_ts") / 604800000000).cast("string").alias("feature_version"), F.col("feature_ts").alias("created_ts"))
    hist, latest = MO.version_lineage(v)
    return hist.join(latest.select("feature_name", "latest_version"), "feature_name").select("feature_name", "feature_version", "n_records", "parent_version", "latest_version")


@query("source_fallback_merge", """
SELECT user_id, event_id, feed FROM (SELECT user_id, event_id, 'primary' AS feed FROM events WHERE event_type = 'error' AND user_id % 3 <> 0
UNION ALL SELECT user_id, event_id, 'fallback' FROM events WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-20' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id % 3 <> 0))""")
def _(t):
    e = t.events.select("user_id", "event_id", "ts", "event_type")
    a = e.filter("event_type = 'error' AND user_id % 3 <> 0").drop("event_type")
    b = e.filter("event_type <> 'error'").drop("event_type")
    return MO.fallback_merge(a, b, ["user_id"], "ts", "2024-01-20").select("user_id", "event_id", "feed")
