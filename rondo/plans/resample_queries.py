"""Registered queries: resampling statistics."""

from pyspark.sql import functions as F

from ..functions.expr import brier_row
from ..operators import resample as B
from ..operators import windows as W
from .metric_queries import BR, r
from .registry import query

SUM = ("mean", "std", "ci_lower", "ci_upper", "median", "p_le_zero")


def _draw(i, j, n, seed):
    x = f"((({i})::BIGINT * 1000003 + ({j})::BIGINT * 7919 + ({seed}) + 1) % 2147483647)"
    x = f"(({x} * 48271) % 2147483647)"
    x = f"(({x} * 16807 + 12345) % 2147483647)"
    return f"({x} % ({n}))"


_SUMM = "#[avg(value)]# AS mean, #[stddev_pop(value)]# AS std, #[quantile_cont(value, 0.025)]# AS ci_lower, #[quantile_cont(value, 0.975)]# AS ci_upper, #[quantile_cont(value, 0.5)]# AS median, #[avg(CAST(value <= 0 AS INT))]# AS p_le_zero"


@query("block_bootstrap", f"""
WITH blk AS (SELECT a, b, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM (SELECT CAST(kickoff_ts AS DATE) AS d, sum(2.0/3 - {BR}) AS a, count(*) AS b FROM predictions GROUP BY 1)),
dr AS (SELECT it, {_draw('it', 'j', '(SELECT max(n) FROM blk)', 7)} AS i FROM range(1000) x(it), range((SELECT max(n) FROM blk)) w(j))
SELECT {_SUMM} FROM (SELECT it, sum(a) / sum(b) AS value FROM dr JOIN blk USING (i) GROUP BY 1)""", "predictions")
def _(t):
    df = t.predictions.withColumn("d", F.to_date("kickoff_ts"))
    return r(B.block_bootstrap(df, "d", 2.0 / 3 - brier_row(), iterations=1000, seed=7), *SUM)


@query("moving_block_bootstrap", f"""
WITH ser AS (SELECT pool, {BR} AS x, row_number() OVER (PARTITION BY pool ORDER BY kickoff_ts, match_id) - 1 AS pos, count(*) OVER (PARTITION BY pool) AS n FROM predictions),
bs AS (SELECT pool, pos AS i, sum(x) OVER (PARTITION BY pool ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s, n FROM ser),
sz AS (SELECT pool, any_value(n) AS n, avg(x) AS original FROM ser GROUP BY 1),
cl AS (SELECT pool, it, n, {_draw('it', 'j', 'n - 19', 3)} // {B.CELL} AS c, count(*) AS m FROM (SELECT pool, n, unnest(range(n // 20)) AS j FROM sz WHERE n >= 20), range(1000) x(it) GROUP BY ALL),
dr AS (SELECT pool, it, c * {B.CELL} + {_draw('it', 'k', f'least({B.CELL}, n - 19 - c * {B.CELL})', f'3 + (c + 1) * {B.CELL_SEED}')} AS i FROM (SELECT *, unnest(range(m)) AS k FROM cl))
SELECT pool, {_SUMM}, #[any_value(original)]# AS original FROM (SELECT pool, it, sum(s) / (count(*) * 20) AS value FROM dr JOIN bs USING (pool, i) GROUP BY 1, 2) JOIN sz USING (pool) GROUP BY 1""", "predictions")
def _(t):
    df = t.predictions.withColumn("br", brier_row())
    return r(B.moving_block_bootstrap(df, ["pool"], W.ORDER, "br", 20, 1000, 3), *SUM, "original")


@query("acceptance_tests", """
WITH f AS (SELECT pool AS feature, count(*) AS n_periods, avg(p_home) - 0.4 AS bi, avg(p_draw) - 0.24 AS li, 1 + avg(p_home - p_away) AS sl, avg(p_away) AS ks, min(p_home) - 0.3 AS ci FROM predictions GROUP BY 1)
SELECT feature, 'brier_improvement' AS test, #[bi]# AS metric, CASE WHEN bi >= 0.005 THEN 'PASSED' ELSE 'FAILED' END AS status FROM f
UNION ALL SELECT feature, 'logloss_improvement', #[li]#, CASE WHEN li >= 0.01 THEN 'PASSED' ELSE 'FAILED' END FROM f
UNION ALL SELECT feature, 'calibration_slope', #[sl]#, CASE WHEN sl BETWEEN 0.95 AND 1.05 THEN 'PASSED' ELSE 'FAILED' END FROM f
UNION ALL SELECT feature, 'temporal_stability', #[ks]#, CASE WHEN n_periods < 2 THEN 'INSUFFICIENT_DATA' WHEN ks > 0.05 THEN 'PASSED' ELSE 'FAILED' END FROM f
UNION ALL SELECT feature, 'bootstrap_ci', #[ci]#, CASE WHEN ci > 0 THEN 'PASSED' ELSE 'FAILED' END FROM f""", "predictions")
def _(t):
    f = t.predictions.groupBy(F.col("pool").alias("feature")).agg(
        F.count(F.lit(1)).alias("n_periods"), (F.avg("p_home") - 0.4).alias("brier_improvement"), (F.avg("p_draw") - 0.24).alias("logloss_improvement"),
        (1 + F.avg(F.col("p_home") - F.col("p_away"))).alias("slope"), F.avg("p_away").alias("ks_p"), (F.min("p_home") - 0.3).alias("ci_low"))
    return r(B.acceptance(f), "metric")
