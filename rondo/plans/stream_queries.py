"""Registered queries: streaming jobs driven to the end of the event table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as SC
from ..functions.expr import epoch_us, rnd
from ..operators import rating as R
from ..streaming import jobs as J
from .adapters import Tables
from .metric_queries import r
from .monitor_queries import _ACC, _GR, triggered
from .rating_queries import CAP, _COLS, _OUT
from .registry import query


class StreamTables(Tables):
    """Domain tables over the event table read as a stream."""

    @property
    def events(self) -> DataFrame:
        return self.spark.readStream.schema(SC.EVENTS).option("maxFilesPerTrigger", 64).parquet(f"{self.sf_dir}/events.parquet*")


def streamed(t) -> StreamTables:
    return StreamTables(J.stream_session(t.spark), t.sf_dir)


def stream_log(t):
    """Prediction-like log straight from the event stream."""
    i, v = F.col("event_id"), F.col("value")
    p = v / 1000.0
    return streamed(t).events.select(
        F.col("ts").cast("timestamp").alias("kickoff_ts"), F.when(i % 53 != 0, p).alias("p_home"), F.lit(0.25).alias("p_draw"), (0.75 - p).alias("p_away"), (10 + i % 190).alias("latency_ms"),
        F.when(i % 19 == 0, "FAILSAFE_MISSING_DATA").when(i % 41 == 0, "FAILSAFE_LEAKAGE").otherwise("SHADOW").alias("status"), (i % 3 - 1).cast("int").alias("actual"))


@query("stream_prediction_monitor", """
SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS window_start, count(*) AS requests, #[avg(CAST(event_id % 19 = 0 OR event_id % 41 = 0 AS INT))]# AS fallback_rate, count(*) FILTER (event_id % 53 = 0) AS nan_probabilities,
  #[avg(10 + event_id % 190)]# AS mean_latency, max(10 + event_id % 190) AS max_latency, #[coalesce(avg(pow(CASE WHEN event_id % 53 <> 0 THEN value / 1000.0 END - CAST(event_id % 3 = 2 AS INT), 2)), -1)]# AS brier_home, count(*) FILTER (event_id % 41 = 0 AND event_id % 19 <> 0) AS leakage_rejections
FROM events GROUP BY 1""")
def _(t):
    """All windows, the last ones included."""
    out = J.run_to_end(stream_log(t), "kickoff_ts", J.stream_health)
    out = out.withColumn("brier_home", F.coalesce("brier_home", F.lit(-1.0)))
    out = out.select(F.floor(epoch_us("window_start") / 1000000).alias("window_start"), "requests", "fallback_rate", "nan_probabilities", "mean_latency", "max_latency", "brier_home", "leakage_rejections")
    return r(out, "fallback_rate", "mean_latency", "brier_home")


@query("stream_cooldown_alerts", f"WITH {_GR}, {_ACC.format(scale=20)} SELECT g.trigger_id, g.guardrail, a.trigger_id IS NOT NULL AS accepted FROM gr g LEFT JOIN acc a USING (trigger_id)", "triggers", recursive=True)
def _(t):
    return J.run_to_end(triggered(streamed(t), 20), "ts", J.stream_cooldown)


@query("stream_rating_update", f"WITH {CAP} {_OUT}", "matches", recursive=True)
def _(t):
    out = J.run_to_end(streamed(t).matches, "kickoff_ts", lambda m: J.stream_ratings(m, R.TOURNAMENT_CAP, late="60 days"))
    return out.select("pool", "match_id", *[rnd(c, 3).alias(c) for c in _COLS])


@query("stream_dedupe_ingest", "SELECT event_id // 3 AS natural_key, 1::BIGINT AS n FROM events GROUP BY 1")
def _(t):
    rows = streamed(t).events.select(F.floor(F.col("event_id") / 3).alias("natural_key"), F.col("ts").cast("timestamp").alias("ts"))
    out = J.run_available(J.stream_dedupe(rows, ["natural_key"], "ts"))
    return out.groupBy("natural_key").agg(F.count(F.lit(1)).alias("n"))
