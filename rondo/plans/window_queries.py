"""Registered queries: windows and analytic functions."""

from pyspark.sql import functions as F

from ..functions.expr import brier_row, rnd
from ..operators import windows as W
from .registry import query


_W_TEAM = "OVER (PARTITION BY pool, team ORDER BY kickoff_ts, match_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@query("form_last_n", f"""
SELECT match_id, team, is_home, #[coalesce(avg(pts) {_W_TEAM.format(n=5)}, 0.5)]# AS form FROM long_view""", "long_view")
def _(t):
    return W.form_last_n(t.matches, 5).withColumn("form", rnd("form"))


@query("form_strict_date", """
SELECT l.match_id, l.team, l.is_home, #[coalesce(f.form, 0.5)]# AS form, #[coalesce(f.gd, 0)]# AS gd_avg
FROM long_view l LEFT JOIN (
  SELECT pool, team, d, avg(pts) AS form, avg(gf - ga) AS gd FROM (
    SELECT a.pool, a.team, a.d, b.pts, b.gf, b.ga, row_number() OVER (PARTITION BY a.pool, a.team, a.d ORDER BY b.kickoff_ts DESC, b.match_id DESC) AS r
    FROM (SELECT DISTINCT pool, team, CAST(kickoff_ts AS DATE) AS d FROM long_view) a
    JOIN long_view b ON a.pool = b.pool AND a.team = b.team AND CAST(b.kickoff_ts AS DATE) < a.d) WHERE r <= 5 GROUP BY 1, 2, 3) f
ON l.pool = f.pool AND l.team = f.team AND CAST(l.kickoff_ts AS DATE) = f.d""", "long_view")
def _(t):
    return W.form_before_date(t.matches, 5).withColumn("form", rnd("form")).withColumn("gd_avg", rnd("gd_avg"))


_LAGS = [f"lag(pts, {i + 1}) OVER w" for i in range(10)]


@query("form_decayed", f"""
SELECT match_id, team, is_home, #[coalesce(({' + '.join(f'coalesce({x} * exp(-0.1 * {i}), 0)' for i, x in enumerate(_LAGS))})
  / nullif({' + '.join(f'CASE WHEN {x} IS NULL THEN 0 ELSE exp(-0.1 * {i}) END' for i, x in enumerate(_LAGS))}, 0), 0.5)]# AS form
FROM long_view WINDOW w AS (PARTITION BY pool, team ORDER BY kickoff_ts, match_id)""", "long_view")
def _(t):
    return W.form_decayed(t.matches).withColumn("form", rnd("form"))


_PAIRS = """SELECT *, least(home, away) AS lo, greatest(home, away) AS hi,
  CASE WHEN home_score > away_score THEN home WHEN home_score < away_score THEN away ELSE -1 END AS winner FROM matches"""


@query("h2h_expanding", f"""
SELECT match_id, #[coalesce((CASE WHEN home = lo THEN lw ELSE hw END) / nullif(n, 0), 0.5)]# AS h2h, CAST(n AS BIGINT) AS meetings FROM (
  SELECT *, count(*) OVER w AS n, coalesce(sum(CAST(winner = lo AS INT)) OVER w, 0) AS lw, coalesce(sum(CAST(winner = hi AS INT)) OVER w, 0) AS hw
  FROM ({_PAIRS}) WINDOW w AS (PARTITION BY pool, lo, hi ORDER BY kickoff_ts, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", "matches")
def _(t):
    return W.h2h_expanding(t.matches).withColumn("h2h", rnd("h2h"))


@query("h2h_last_n", f"""
SELECT match_id, #[coalesce(len(list_filter(ws, lambda x: x = home)) / nullif(len(ws), 0), 0.5)]# AS h2h FROM (
  SELECT match_id, home, list(winner) OVER (PARTITION BY pool, lo, hi ORDER BY kickoff_ts, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ws
  FROM ({_PAIRS}))""", "matches")
def _(t):
    return W.h2h_last_n(t.matches).withColumn("h2h", rnd("h2h"))


@query("days_since_last", """
SELECT l.match_id, l.team, l.is_home, CAST(coalesce(g.gap, 14) AS INT) AS rest_days FROM long_view l
JOIN (SELECT pool, team, d, d - lag(d) OVER (PARTITION BY pool, team ORDER BY d) AS gap
      FROM (SELECT DISTINCT pool, team, CAST(kickoff_ts AS DATE) AS d FROM long_view)) g
ON l.pool = g.pool AND l.team = g.team AND CAST(l.kickoff_ts AS DATE) = g.d""", "long_view")
def _(t):
    return W.rest_days(t.matches)


@query("latest_per_key", """
SELECT team_id, source_id, feature_name, #[feature_value]# AS feature_value FROM (
  SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY feature_ts DESC, source_id DESC) AS r FROM features) WHERE r = 1""", "features")
def _(t):
    return W.latest_per_key(t.features, ["team_id"], ["feature_ts", "source_id"]).select(
        "team_id", "source_id", "feature_name", rnd("feature_value").alias("feature_value"))


def _jac(c, p):
    return f"(CASE WHEN len(list_distinct(list_concat({c}, {p}))) = 0 THEN 1.0 ELSE len(list_intersect({c}, {p})) / len(list_distinct(list_concat({c}, {p}))) END)"


def _pos(c, p):
    return f"list_filter({c}, lambda x: x.position = '{p}')"


CONT_SQL = f"""
cont AS (SELECT team_id, announced_ts, no AS snapshot_no, {_jac('cur', 'prv')} AS continuity_index,
  {_jac(_pos('cur', 'Defender'), _pos('prv', 'Defender'))} AS defenders_continuity,
  {_jac(_pos('cur', 'Midfielder'), _pos('prv', 'Midfielder'))} AS midfielders_continuity,
  {_jac(_pos('cur', 'Attacker'), _pos('prv', 'Attacker'))} AS forwards_continuity,
  len(cur) AS squad_size, CASE WHEN no = 0 THEN 0 ELSE len(cur) - len(prv) END AS squad_size_delta
FROM (SELECT team_id, announced_ts, players AS cur, coalesce(lag(players) OVER w, []) AS prv, row_number() OVER w - 1 AS no
      FROM snapshots WINDOW w AS (PARTITION BY team_id ORDER BY announced_ts)))"""


@query("squad_continuity", f"""WITH {CONT_SQL}
SELECT team_id, CAST(announced_ts AS VARCHAR)[:10] AS day, CAST(snapshot_no AS INT) AS snapshot_no, #[continuity_index]# AS continuity_index,
  #[defenders_continuity]# AS defenders_continuity, #[midfielders_continuity]# AS midfielders_continuity, #[forwards_continuity]# AS forwards_continuity,
  CAST(squad_size AS INT) AS squad_size, CAST(squad_size_delta AS INT) AS squad_size_delta FROM cont""", "snapshots")
def _(t):
    c = W.squad_continuity(t.snapshots)
    return c.select("team_id", F.date_format("announced_ts", "yyyy-MM-dd").alias("day"), "snapshot_no",
                    *[rnd(n).alias(n) for n in ("continuity_index", *W.POSITIONS)], "squad_size", "squad_size_delta")


@query("feature_timeline_long", f"""WITH {CONT_SQL}
SELECT team_id, feature_name, #[feature_value]# AS feature_value, CAST(snapshot_no AS INT) AS source_id, '1.0.0' AS feature_version FROM (
  UNPIVOT (SELECT team_id, snapshot_no, CAST(continuity_index AS DOUBLE) AS continuity_index, CAST(defenders_continuity AS DOUBLE) AS defenders_continuity,
    CAST(midfielders_continuity AS DOUBLE) AS midfielders_continuity, CAST(forwards_continuity AS DOUBLE) AS forwards_continuity,
    CAST(squad_size AS DOUBLE) AS squad_size, CAST(squad_size_delta AS DOUBLE) AS squad_size_delta FROM cont)
  ON continuity_index, defenders_continuity, midfielders_continuity, forwards_continuity, squad_size, squad_size_delta
  INTO NAME feature_name VALUE feature_value)""", "snapshots")
def _(t):
    return W.feature_timeline(t.snapshots).select("team_id", "feature_name", rnd("feature_value").alias("feature_value"), "source_id", "feature_version")


@query("announcement_lead_hours", """
SELECT k.match_id, #[(epoch_us(k.kickoff_ts) - epoch_us(s.announced_ts)) / 3600e6]# AS lead_hours, s.announced_ts > k.kickoff_ts AS lead_violation
FROM kickoffs k JOIN (SELECT user_id AS team_id, max(date_trunc('week', ts)) AS announced_ts FROM events GROUP BY 1) s USING (team_id)""", "kickoffs")
def _(t):
    last = t.events.groupBy(F.col("user_id").alias("team_id")).agg(F.max(F.date_trunc("week", "ts")).alias("announced_ts"))
    df = t.kickoffs.join(last, "team_id")
    return W.lead_hours(df).select("match_id", rnd("lead_hours").alias("lead_hours"), "lead_violation")


def _uplift_rows(t):
    """Squared errors of the rating model against a flat model, per pool."""
    third = F.lit(1.0) / 3
    flat = 2.0 / 3
    return t.predictions.select("pool", "kickoff_ts", "match_id", F.lit(flat).alias("baseline"), brier_row().alias("model"), third.alias("_t")).drop("_t")


_BR = "(pow(p_home - CAST(actual = 1 AS INT), 2) + pow(p_draw - CAST(actual = 0 AS INT), 2) + pow(p_away - CAST(actual = -1 AS INT), 2))"


@query("rolling_uplift", f"""
SELECT pool, match_id, #[u]# AS rolling_uplift FROM (
  SELECT pool, match_id, avg(2.0/3 - {_BR}) OVER w AS u, count(*) OVER w AS n FROM predictions
  WINDOW w AS (PARTITION BY pool ORDER BY kickoff_ts, match_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE n = 30""", "predictions")
def _(t):
    return W.rolling_uplift(_uplift_rows(t), 30).select("pool", "match_id", rnd("rolling_uplift").alias("rolling_uplift"))


@query("sequence_violations", """
SELECT b.k AS user_id, n_rows, coalesce(duplicates, 0) AS duplicates, coalesce(gaps, 0) AS gaps, coalesce(out_of_order, 0) AS out_of_order
FROM (SELECT l_suppkey AS k, count(*) AS n_rows FROM lineitem GROUP BY 1) b
LEFT JOIN (SELECT k, count(*) AS duplicates FROM (SELECT l_suppkey AS k, l_shipdate FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1) d USING (k)
LEFT JOIN (SELECT k, count(*) AS gaps FROM (SELECT l_suppkey AS k, l_shipdate AS s, lag(l_shipdate) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS p
   FROM (SELECT DISTINCT l_suppkey, l_shipdate FROM lineitem)) WHERE epoch_us(s) - epoch_us(p) >= 31 * 86400000000 GROUP BY 1) g USING (k)
LEFT JOIN (SELECT k, count(*) AS out_of_order FROM (SELECT l_suppkey AS k, s, lag(s) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS p
   FROM (SELECT l_suppkey, l_orderkey, max(l_shipdate) AS s FROM lineitem GROUP BY 1, 2)) WHERE s < p GROUP BY 1) o USING (k)""")
def _(t):
    li = t.lineitem.select("l_suppkey", "l_shipdate", "l_orderkey")
    full = W.sequence_audit(li, "l_suppkey", "l_shipdate", "l_orderkey").drop("out_of_order")
    once = li.groupBy("l_suppkey", "l_orderkey").agg(F.max("l_shipdate").alias("l_shipdate"))
    late = W.sequence_audit(once, "l_suppkey", "l_shipdate", "l_orderkey").select("l_suppkey", "out_of_order")
    return full.join(late, "l_suppkey").withColumnRenamed("l_suppkey", "user_id")


_BR_ROWS = "SELECT *, " + _BR + " AS br FROM predictions"


@query("recent_vs_prior_mean", f"""
SELECT pool, #[recent]# AS recent, #[prior]# AS prior, #[abs(recent - prior)]# AS drift, abs(recent - prior) > 0.15 AS alert FROM (
  SELECT pool, avg(br) FILTER (r <= 10) AS recent, avg(br) FILTER (r > 10) AS prior, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY pool ORDER BY kickoff_ts DESC, match_id DESC) AS r FROM ({_BR_ROWS})) WHERE r <= 20 GROUP BY 1) WHERE n >= 20""", "predictions")
def _(t):
    df = t.predictions.withColumn("br", brier_row())
    return W.segment_drift(df, "pool", "br", W.ORDER).select("pool", *[rnd(c).alias(c) for c in ("recent", "prior", "drift")], "alert")


@query("two_cohort_divergence", f"""
SELECT #[a]# AS tournament_mean, #[b]# AS friendly_mean, #[abs(a - b)]# AS divergence, abs(a - b) > 0.15 AS alert FROM (
  SELECT avg(br) FILTER (c) AS a, avg(br) FILTER (NOT c) AS b FROM (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY kickoff_ts DESC, match_id DESC) AS r FROM (SELECT *, tournament <> 'Friendly' AS c FROM ({_BR_ROWS}))) WHERE r <= 10)""", "predictions")
def _(t):
    df = t.predictions.withColumn("br", brier_row())
    out = W.cohort_divergence(df, F.col("tournament") != "Friendly", "br", W.ORDER)
    return out.select(*[rnd(c).alias(c) for c in ("tournament_mean", "friendly_mean", "divergence")], "alert")


@query("brier_degradation", f"""
SELECT pool, #[recent]# AS recent, #[hist]# AS historical, #[recent - hist]# AS degradation, recent - hist > 0.01 AS alert FROM (
  SELECT pool, avg(br) FILTER (r <= 10) AS recent, avg(br) FILTER (r > 10) AS hist, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY pool ORDER BY kickoff_ts DESC, match_id DESC) AS r FROM ({_BR_ROWS})) GROUP BY 1) WHERE n >= 50""", "predictions")
def _(t):
    df = t.predictions.withColumn("br", brier_row())
    return W.brier_degradation(df, "pool", "br", W.ORDER).select("pool", *[rnd(c).alias(c) for c in ("recent", "historical", "degradation")], "alert")


@query("uplift_persistence", f"""
SELECT pool, CASE WHEN m > 0.005 THEN 'persistent' ELSE 'degraded' END AS status, #[m]# AS mean_uplift, #[s]# AS std_uplift, n >= 20 AND m < e * 0.9 AS is_degraded FROM (
  SELECT pool, avg(u) FILTER (r <= 10) AS m, stddev_pop(u) FILTER (r <= 10) AS s, avg(u) FILTER (q <= 10) AS e, count(*) AS n FROM (
    SELECT pool, 2.0/3 - br AS u, row_number() OVER (PARTITION BY pool ORDER BY kickoff_ts DESC, match_id DESC) AS r,
      row_number() OVER (PARTITION BY pool ORDER BY kickoff_ts, match_id) AS q FROM ({_BR_ROWS})) GROUP BY 1) WHERE n >= 2""", "predictions")
def _(t):
    df = _uplift_rows(t).withColumn("u", F.col("baseline") - F.col("model"))
    return W.uplift_persistence(df, "pool", "u", W.ORDER).select("pool", "status", rnd("mean_uplift").alias("mean_uplift"), rnd("std_uplift").alias("std_uplift"), "is_degraded")


@query("rolling_latency_percentiles", """
SELECT #[quantile_cont(latency_ms, 0.5)]# AS p50, #[quantile_cont(latency_ms, 0.95)]# AS p95, #[quantile_cont(latency_ms, 0.99)]# AS p99, count(*) AS n
FROM (SELECT latency_ms FROM prediction_log ORDER BY kickoff_ts DESC, request_id DESC LIMIT 1000)""", "prediction_log")
def _(t):
    out = W.latency_percentiles(t.prediction_log, "latency_ms", ["kickoff_ts", "request_id"])
    return out.select(*[rnd(c).alias(c) for c in W.PCTS], "n")


@query("latency_percentiles_by_hour", """
SELECT pool, hour, #[quantile_cont(latency_ms, 0.5)]# AS p50, #[quantile_cont(latency_ms, 0.95)]# AS p95, #[quantile_cont(latency_ms, 0.99)]# AS p99, count(*) AS n FROM (
  SELECT pool, strftime(kickoff_ts, '%Y-%m-%d %H') AS hour, latency_ms, row_number() OVER (PARTITION BY pool, strftime(kickoff_ts, '%Y-%m-%d %H') ORDER BY kickoff_ts DESC, request_id DESC) AS r
  FROM prediction_log) WHERE r <= 1000 GROUP BY 1, 2""", "prediction_log")
def _(t):
    log = t.prediction_log.withColumn("hour", F.date_format("kickoff_ts", "yyyy-MM-dd HH"))
    out = W.latency_percentiles(log, "latency_ms", ["kickoff_ts", "request_id"], ["pool", "hour"])
    return out.select("pool", "hour", *[rnd(c).alias(c) for c in W.PCTS], "n")


ACF_SQL = "acf AS (" + " UNION ALL ".join(
    f"SELECT pool, count(*) AS n, {lag} AS lag, coalesce(avg((x - mu) * (l - mu)) / var_pop(x), 0) AS acf FROM (SELECT pool, x, mu, lag(x, {lag}) OVER (PARTITION BY pool ORDER BY kickoff_ts, match_id) AS l FROM ser) GROUP BY pool"
    for lag in range(1, 11)) + ")"
SER_SQL = f"ser AS (SELECT pool, kickoff_ts, match_id, {_BR} AS x, avg({_BR}) OVER (PARTITION BY pool) AS mu FROM predictions)"


@query("autocorrelation", f"""WITH {SER_SQL}, {ACF_SQL}
SELECT pool, lag, #[acf]# AS acf FROM acf UNION ALL SELECT DISTINCT pool, 0, 1.0 FROM acf""", "predictions")
def _(t):
    out = W.autocorrelation(t.predictions.withColumn("br", brier_row()), "pool", "br", W.ORDER, 10)
    return out.select("pool", "lag", rnd("acf").alias("acf"))


@query("ljung_box", f"""WITH {SER_SQL}, {ACF_SQL}
SELECT pool, #[q]# AS q, #[exp(-q/2) * (1 + q/2 + pow(q/2,2)/2 + pow(q/2,3)/6 + pow(q/2,4)/24)]# AS p_value FROM (
  SELECT pool, max(n) * (max(n) + 2) * sum(pow(acf * (n - lag) / n, 2) / (n - lag)) AS q FROM acf GROUP BY 1)""", "predictions")
def _(t):
    out = W.ljung_box(t.predictions.withColumn("br", brier_row()), "pool", "br", W.ORDER, 10)
    return out.select("pool", rnd("q").alias("q"), rnd("p_value").alias("p_value"))


@query("adf_stationarity", f"""
SELECT pool, n, #5[b / sqrt(rss / (n - 3) * svv / det / n)]# AS adf_stat, b / sqrt(rss / (n - 3) * svv / det / n) < -2.86 AS is_stationary FROM (
  SELECT *, n * (syy - b * suy - c * svy) AS rss FROM (
    SELECT *, (suy * svv - svy * suv) / det AS b, (svy * suu - suy * suv) / det AS c FROM (
      SELECT *, suu * svv - suv * suv AS det FROM (
        SELECT pool, count(*) AS n, covar_pop(u, u) AS suu, covar_pop(v, v) AS svv, covar_pop(y, y) AS syy, covar_pop(u, v) AS suv, covar_pop(u, y) AS suy, covar_pop(v, y) AS svy FROM (
          SELECT pool, x - l1 AS y, l1 AS u, l1 - l2 AS v FROM (
            SELECT pool, {_BR} AS x, lag({_BR}) OVER w AS l1, lag({_BR}, 2) OVER w AS l2 FROM predictions
            WINDOW w AS (PARTITION BY pool ORDER BY kickoff_ts, match_id)) WHERE l2 IS NOT NULL) GROUP BY 1))))""", "predictions")
def _(t):
    out = W.adf_stationarity(t.predictions.withColumn("br", brier_row()), "pool", "br", W.ORDER)
    return out.select("pool", "n", rnd("adf_stat", 5).alias("adf_stat"), "is_stationary")


def _adf_sql(most: int) -> str:
    """Regressions with 0 to ``most`` lagged changes: products of all columns, then one lagged change after another swept out."""
    lags = ", ".join(f"lag({_BR}, {k}) OVER w AS l{k}" for k in range(1, most + 2))
    changes = ", ".join(f"l{k} - l{k + 1} AS c{k + 1}" for k in range(1, most + 1))
    left = list(range(most + 2))
    sql = f"""SELECT pool, count(*) AS n, {", ".join(f"covar_pop(c{i}, c{j}) AS s{i}_{j}" for i in left for j in left if i <= j)} FROM (
      SELECT pool, x - l1 AS c0, l1 AS c1, {changes} FROM (
        SELECT pool, {_BR} AS x, {lags} FROM predictions WINDOW w AS (PARTITION BY pool ORDER BY kickoff_ts, match_id)) WHERE l{most + 1} IS NOT NULL) GROUP BY 1"""
    kept: list[str] = []
    for lag in range(most + 1):
        now = [f"s0_1 / s1_1 / sqrt((s0_0 - s0_1 * s0_1 / s1_1) / (n - {lag + 2}) / s1_1) AS t{lag}", f"n * ln(s0_0 - s0_1 * s0_1 / s1_1) + {2 * (lag + 2)} AS a{lag}"]
        if lag < most:
            out = lag + 2
            left.remove(out)
            at = lambda i, o=out: f"s{min(i, o)}_{max(i, o)}"
            now += [f"s{i}_{j} - {at(i)} * {at(j)} / s{out}_{out} AS s{i}_{j}" for i in left for j in left if i <= j]
        sql = f"SELECT pool, n, {', '.join([*kept, *now])} FROM ({sql})"
        kept += [f"t{lag}", f"a{lag}"]
    tried = " UNION ALL ".join(f"SELECT pool, n, {lag} AS lag, t{lag} AS t, a{lag} AS aic FROM swept WHERE {lag} <= ceil(12 * pow(n / 100, 0.25))" for lag in range(most + 1))
    phi = "CASE WHEN z >= 0 THEN 1 - tail ELSE tail END"
    z = "CASE WHEN t <= -1.61 THEN 2.1659 + 1.4412 * t + 0.038269 * t * t ELSE 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t END"
    k = "(1 / (1 + 0.2316419 * abs(z)))"
    tail = f"exp(-z * z / 2) / sqrt(2 * pi()) * {k} * (0.319381530 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429))))"
    return f"""swept AS ({sql}), tried AS ({tried}),
    valued AS (SELECT *, CASE WHEN t < -18.83 THEN 0.0 WHEN t > 2.74 THEN 1.0 ELSE {phi} END AS p FROM (SELECT *, {tail} AS tail FROM (SELECT *, {z} AS z FROM tried)))"""


@query("adf_lag_regressions", f"""WITH {_adf_sql(8)}
SELECT pool, n, lag, #5[t]# AS adf_stat, #4[aic]# AS aic, #5[p]# AS p_value FROM valued""", "predictions")
def _(t):
    out = W.adf_lags(t.predictions.withColumn("br", brier_row()), "pool", "br", W.ORDER, 8)
    return out.select("pool", "n", "lag", rnd("adf_stat", 5).alias("adf_stat"), rnd("aic", 4).alias("aic"), rnd("p_value", 5).alias("p_value"))


@query("adf_best_lag", f"""WITH {_adf_sql(8)}
SELECT pool, n, lag, #5[t]# AS adf_stat, #5[p]# AS p_value, p < 0.05 AS is_stationary FROM valued
QUALIFY row_number() OVER (PARTITION BY pool ORDER BY aic, lag) = 1""", "predictions")
def _(t):
    out = W.adf_best_lag(t.predictions.withColumn("br", brier_row()), "pool", "br", W.ORDER, 8)
    return out.select("pool", "n", "lag", rnd("adf_stat", 5).alias("adf_stat"), rnd("p_value", 5).alias("p_value"), "is_stationary")
