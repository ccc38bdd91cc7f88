from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rondo.operators import monitor as MO

T0 = datetime(2026, 1, 1)


def test_health_checks_of_a_request(spark):
    log = spark.createDataFrame([(1, 0.5, 0.3, 0.2, 1.2), (2, None, 0.3, 0.2, 1.2), (3, 0.5, 0.3, 0.2, -1.0), (4, 0.5, 0.33, 0.2, 1.0), (5, float("nan"), float("inf"), 0.2, 1.0)],
                                "id int, p_home double, p_draw double, p_away double, baseline_lambda double")
    got = {(r.id, r.metric): (r.status, r.value) for r in MO.prediction_health(log, ["id"]).collect()}
    assert (1, "nan_probabilities") not in got
    assert got[2, "nan_probabilities"] == ("FAIL", 1.0) and got[2, "probability_sum_deviation"][0] == "FAIL"
    assert got[3, "invalid_lambda"] == ("FAIL", -1.0) and got[4, "probability_sum_deviation"][0] == "WARN" and got[5, "nan_probabilities"][1] == 2.0


def test_guardrail_mapping(spark):
    names = {"psi_drift_x": "psi_drift", "fallback_rate": "fallback_rate", "calibration_slope": "calibration_slope", "brier_degradation": "brier_degradation",
             "nan_probabilities": "nan_predictions", "dtype_corruption_x": "feature_corruption", "leakage": "temporal_leakage", "other": None}
    df = spark.createDataFrame([(n,) for n in names], "metric string")
    assert {r.metric: r.g for r in df.select("metric", MO.guardrail_key().alias("g")).collect()} == names


def brute_cooldown(rows):
    last, out = {}, {}
    for g, t, i, cool in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        ok = g not in last or (t - last[g]).total_seconds() >= cool
        if ok:
            last[g] = t
        out[i] = ok
    return out


def test_cooldown_equals_the_sequential_rule(spark):
    rows = [("a" if i % 3 else "b", T0 + timedelta(seconds=(i * i * 37) % 90_000), i, 600 if i % 3 else 60) for i in range(800)]
    df = spark.createDataFrame(rows, "guardrail string, ts timestamp, trigger_id long, cooldown_s int")
    for options in ({"unit": "hour"}, {"unit": "day"}):
        got = {r.trigger_id: r.accepted for r in MO.cooldown(df, **options).collect()}
        assert got == brute_cooldown(rows), options


def test_dense_triggers_with_ties_and_zero_cooldown(spark):
    rows = [("a", T0 + timedelta(seconds=i // 3), i, 10) for i in range(300)] + [("z", T0 + timedelta(seconds=i // 2), 1000 + i, 0) for i in range(20)]
    df = spark.createDataFrame(rows, "guardrail string, ts timestamp, trigger_id long, cooldown_s int")
    want = brute_cooldown(rows)
    for unit in ("hour", "month"):
        assert {r.trigger_id: r.accepted for r in MO.cooldown(df, unit=unit).collect()} == want
    assert sum(want[i] for i in range(300)) == 10


def test_incident_lifecycle(spark):
    ev = spark.createDataFrame([("i1", T0, 1, "register"), ("i1", T0 + timedelta(hours=1), 2, "rollback"), ("i1", T0 + timedelta(hours=2), 3, "complete"), ("i1", T0 + timedelta(hours=3), 4, "resolve"), ("i2", T0, 5, "register")],
                               "incident_id string, ts timestamp, event_id int, event string")
    got = {r.incident_id: r for r in MO.incident_state(ev).collect()}
    assert (got["i1"].rollback_status, got["i1"].resolved, got["i1"].fallback_triggered) == ("COMPLETED", True, True)
    assert (got["i2"].rollback_status, got["i2"].resolved) == ("NOT_TRIGGERED", False)


def test_rollback_reasons(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0, False, 0.1), (1.2, 0.02, 0.5, True, -0.1)], "slope double, brier_degradation double, availability double, skew_significant boolean, uplift double")
    a, b = MO.rollback_criteria(df).collect()
    assert not a.should_rollback and len(b.reasons) == 5


def test_counts_keep_absent_types(spark):
    df = spark.createDataFrame([("PSI_DRIFT",)], "incident_type string")
    got = {r.incident_type: r.n for r in MO.incident_counts(df, "incident_type", MO.INCIDENT_TYPES).collect()}
    assert len(got) == len(MO.INCIDENT_TYPES) and sum(got.values()) == 1


def test_registry_keeps_approved(spark):
    df = spark.createDataFrame([("continuity_index",), ("forwards_continuity",), ("unknown",)], "feature_name string")
    assert [r[0] for r in MO.approved_only(df).collect()] == ["continuity_index"]
    assert {r[1] for r in MO.with_registry(df).collect()} == {"APPROVED", "REJECTED", None}
