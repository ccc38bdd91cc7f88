"""Structured Streaming forms of the live monitor, guardrail cooldown, rating update and ingest.

Every job is a plain transformation of a streaming frame; ``run_available`` and ``run_to_end`` drive one over the input there is and
return what it wrote, ``start`` keeps it running. State is one timestamp per guardrail, one rating per team, the keys
inside the watermark, and the rows the watermark has not passed yet, by time bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StructField, StructType

from ..functions.expr import add, count_if, epoch_us, share
from ..operators.rating import Rules, _inputs
from ..session import ROCKSDB, shared_dir

def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own for keyed-state streams: their state store and one state partition per core; no other job's settings change."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return own


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None):
    """Write a streaming frame to Parquet; output and checkpoint live in shared folders, so a restart resumes exactly."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def _finish(df: DataFrame, base: str) -> None:
    q = start(df, f"{base}/out", f"{base}/checkpoint", trigger={"availableNow": True})
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def run_available(df: DataFrame) -> DataFrame:
    """Process everything available now and read the result back. What the watermark has not passed yet stays in state."""
    base = shared_dir(df.sparkSession)
    _finish(df, base)
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out")


def run_to_end(rows: DataFrame, ts: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a job over an input that has ended, so that its last windows close and its last rows leave the state.

    A clock stream is united with the input. It is empty until all input is processed; then it gets one row of a far future,
    which carries the watermark past every row of the input, and the job goes on from its checkpoint.
    """
    spark = rows.sparkSession
    base = shared_dir(spark)
    spark.createDataFrame([], "tick timestamp").write.parquet(f"{base}/clock")
    clock = spark.readStream.schema("tick timestamp").parquet(f"{base}/clock").select(F.col("tick").cast(dict(rows.dtypes)[ts]).alias(ts))
    out = job(rows.unionByName(clock, allowMissingColumns=True))
    _finish(out, base)
    spark.range(1).select(F.timestamp_micros(F.lit(7_258_118_400_000_000)).alias("tick")).write.mode("append").parquet(f"{base}/clock")
    _finish(out, base)
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def stream_health(log: DataFrame, ts: str = "kickoff_ts", window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Health of predictions per event-time window: requests, fallback share, missing probabilities, mean latency, Brier."""
    bad = add([F.when(F.col(p).isNull() | F.isnan(p), 1).otherwise(0) for p in ("p_home", "p_draw", "p_away")])
    sq = F.pow(F.col("p_home") - F.when(F.col("actual") == 1, 1.0).otherwise(0.0), F.lit(2.0))
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return log.withWatermark(ts, late).groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), share(F.col("status").contains("FAILSAFE")).alias("fallback_rate"), F.sum(bad).alias("nan_probabilities"),
        F.avg("latency_ms").alias("mean_latency"), F.max("latency_ms").alias("max_latency"), F.avg(sq).alias("brier_home"), count_if(F.col("status") == "FAILSAFE_LEAKAGE").alias("leakage_rejections")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests", "fallback_rate", "nan_probabilities", "mean_latency", "max_latency", "brier_home", "leakage_rejections")


class _InOrder(StatefulProcessor):
    """Holds the rows of a key in time buckets until the watermark has passed a bucket's end, and then hands its rows over in event order, whatever order they came in.

    One bucket is read at a time, so memory follows the rows of a key in ``bucket_us`` microseconds (whole milliseconds) and not those that wait. Each bucket has a
    timer; the timers of a key expire in the order of their times, which is checked.
    """

    fields: list[tuple[str, DataType]] = []
    order: tuple[str, ...] = ()

    def __init__(self, bucket_us: int):
        if bucket_us <= 0 or bucket_us % 1000:
            raise ValueError("a bucket is a whole number of milliseconds")
        self.bucket_us = bucket_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = StructType([StructField(n, t) for n, t in self.fields])
        self.waiting = handle.getMapState("waiting", StructType([StructField("bucket", LongType())]), StructType([StructField("rows", ArrayType(row))]))
        self.done = handle.getValueState("done", StructType([StructField("bucket", LongType())]))
        self.names = [n for n, _ in self.fields]
        self.prepare(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            if not len(part):
                continue
            part = part[self.names]
            for bucket, new in part.groupby(part["t"] // self.bucket_us):
                bucket = int(bucket)
                held = []
                if self.waiting.containsKey((bucket,)):
                    held = [tuple(r) for r in self.waiting.getValue((bucket,))[0]]
                else:
                    self.handle.registerTimer((bucket + 1) * self.bucket_us // 1000 + 1)
                self.waiting.updateValue((bucket,), (held + list(new.itertuples(index=False, name=None)),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bucket = (expiredTimerInfo.getExpiryTimeInMs() - 1) * 1000 // self.bucket_us - 1
        if self.done.exists() and self.done.get()[0] >= bucket:
            raise RuntimeError(f"bucket {bucket} came after bucket {self.done.get()[0]}")
        self.done.update((bucket,))
        ready = [tuple(r) for r in self.waiting.getValue((bucket,))[0]]
        self.waiting.removeKey((bucket,))
        at = [self.names.index(n) for n in self.order]
        yield self.apply(key, sorted(ready, key=lambda r: tuple(r[i] for i in at)))

    def close(self) -> None:
        pass


class _Cooldown(_InOrder):
    """One timestamp per guardrail: the last accepted trigger."""

    fields = [("t", LongType()), ("trigger_id", LongType()), ("cool", LongType())]
    order = ("t", "trigger_id")

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("t", LongType())]))

    def apply(self, key, rows: list[tuple]) -> pd.DataFrame:
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for t, trigger, cool in rows:
            ok = last is None or t - last >= cool
            last = t if ok else last
            out.append((trigger, key[0], ok))
        self.last.update((last,))
        return pd.DataFrame(out, columns=["trigger_id", "guardrail", "accepted"])


BUCKET_US = 3_600_000_000  # an hour


def stream_cooldown(triggers: DataFrame, ts: str = "ts", late: str = "1 hour", bucket_us: int = BUCKET_US) -> DataFrame:
    """Accept or suppress guardrail triggers (trigger_id, guardrail, cooldown_s) in event order. Rows that come later than ``late`` are dropped.

    A key's rows wait in buckets of ``bucket_us`` microseconds, so a result comes up to that much later than the watermark."""
    rows = triggers.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).select(
        ts, "guardrail", F.coalesce(F.col("trigger_id").cast("bigint"), F.lit(0)).alias("trigger_id"), epoch_us(ts).alias("t"), F.coalesce(F.col("cooldown_s").cast("bigint") * 1_000_000, F.lit(0)).alias("cool"))
    return rows.groupBy("guardrail").transformWithStateInPandas(_Cooldown(bucket_us), "trigger_id long, guardrail string, accepted boolean", "append", "EventTime")


_RATING = StructType([StructField("rating", DoubleType())])
_TEAM = StructType([StructField("team", LongType())])


class _Ratings(_InOrder):
    """Ratings of a pool's teams."""

    fields = [("t", LongType()), ("match_id", LongType()), ("home", LongType()), ("away", LongType()), *[(n, DoubleType()) for n in ("k", "extra", "bonus", "score", "base")], ("dampen", BooleanType())]
    order = ("t", "match_id")

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.ratings = handle.getMapState("ratings", _TEAM, _RATING)

    def apply(self, key, rows: list[tuple]) -> pd.DataFrame:
        seen: dict[int, float] = {}

        def rating(team: int, base: float) -> float:
            if team not in seen:
                seen[team] = self.ratings.getValue((team,))[0] if self.ratings.containsKey((team,)) else base
            return seen[team]

        out = []
        for _, match_id, home, away, k, extra, bonus, score, base, dampen in rows:
            rh, ra = rating(home, base), rating(away, base)
            if score is not None and score == score:
                gain = score - 1.0 / (1.0 + 10.0 ** (-(rh + bonus - ra) / 400.0))
                if dampen:
                    extra *= 2.2 / ((rh - ra if score == 1.0 else ra - rh) * 0.001 + 2.2)
                step = k * gain * (1.0 + extra)
                seen[home], seen[away] = rh + step, ra - step
            out.append((key[0], match_id, rh, ra, seen[home], seen[away]))
        for team, value in seen.items():
            self.ratings.updateValue((team,), (value,))
        return pd.DataFrame(out, columns=["pool", "match_id", "pre_h", "pre_a", "post_h", "post_a"])


def stream_ratings(matches: DataFrame, rules: Rules, late: str = "1 hour", bucket_us: int = BUCKET_US) -> DataFrame:
    """Incremental rating fold per pool: the same numbers as the batch fold, in whatever order matches come within the watermark's delay.

    Matches that come later than ``late`` are dropped, as in every event-time job.
    """
    _, *rest = _inputs(matches, rules)
    whole = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c)
    rows = matches.withColumn("kickoff_ts", F.col("kickoff_ts").cast("timestamp")).withWatermark("kickoff_ts", late).select("kickoff_ts", "pool", whole("match_id"), epoch_us("kickoff_ts").alias("t"), whole("home"), whole("away"), *rest)
    return rows.groupBy("pool").transformWithStateInPandas(_Ratings(bucket_us), "pool string, match_id long, pre_h double, pre_a double, post_h double, post_a double", "append", "EventTime")


def stream_dedupe(rows: DataFrame, keys: list[str], ts: str, late: str = "3 days") -> DataFrame:
    """Drop re-polled rows with the same natural key; keys are remembered for the watermark delay."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
