"""Streams over shuffled files give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from rondo import schemas as SC
from rondo.operators import monitor as MO
from rondo.operators import rating as R
from rondo.plans.adapters import Tables
from rondo.plans.monitor_queries import triggered
from rondo.streaming import jobs as J


class Shuffled(Tables):
    """The event table cut into files whose order has nothing to do with time; one file a trigger."""

    def __init__(self, spark, sf_dir, folder):
        super().__init__(J.stream_session(spark), sf_dir)
        rows = spark.read.parquet(f"{sf_dir}/events.parquet").collect()
        random.Random(5).shuffle(rows)
        for k in range(4):
            spark.createDataFrame(rows[k::4], SC.EVENTS).coalesce(1).write.mode("append").parquet(folder)
        self.folder = folder

    @property
    def events(self):
        return self.spark.readStream.schema(SC.EVENTS).option("maxFilesPerTrigger", 1).parquet(self.folder)


@pytest.fixture
def shuffled(spark, tmp_path):
    return Shuffled(spark, "/root/testdata/sf0.001", f"{tmp_path}/events")


@pytest.mark.parametrize("rules", [R.TOURNAMENT_CAP, R.GROUP_PHASE], ids=lambda r: r.name)
def test_ratings(shuffled, tables, rules):
    got = J.run_to_end(shuffled.matches, "kickoff_ts", lambda m: J.stream_ratings(m, rules, late="60 days"))
    want = R.elo_fold(tables.matches, rules)
    pairs = {r.match_id: r for r in want.collect()}
    rows = got.collect()
    assert len(rows) == len(pairs)
    assert max(abs(r[c] - pairs[r.match_id][c]) for r in rows for c in ("pre_h", "pre_a", "post_h", "post_a")) < 1e-9


def test_cooldown(shuffled, tables):
    got = J.run_to_end(triggered(shuffled, 20), "ts", lambda t: J.stream_cooldown(t, late="60 days"))
    want = {r.trigger_id: r.accepted for r in MO.cooldown(triggered(tables, 20)).collect()}
    assert {r.trigger_id: r.accepted for r in got.collect()} == want


def test_every_window_closes(shuffled, tables):
    log = shuffled.events.select(F.col("ts").cast("timestamp").alias("kickoff_ts"), *[F.lit(0.3).alias(p) for p in ("p_home", "p_draw", "p_away")], F.lit(1).alias("latency_ms"), F.lit("SHADOW").alias("status"), F.lit(1).alias("actual"))
    got = J.run_to_end(log, "kickoff_ts", lambda x: J.stream_health(x, late="60 days"))
    assert got.agg(F.sum("requests")).first()[0] == tables.events.count()


@pytest.mark.parametrize("bucket_us", [6 * 3_600_000_000, 40 * 86_400_000_000])
def test_a_bucket_is_all_that_a_key_holds_at_a_time(shuffled, tables, monkeypatch, bucket_us, tmp_path):
    """One pool with all rows, in whatever buckets: the same numbers, and no call gets more rows than its bucket has."""
    seen = tmp_path / "rows"
    plain = J._Ratings.apply

    def counted(self, key, rows):
        with seen.open("a") as f:
            f.write(f"{len(rows)} {rows[0][0] // self.bucket_us} {rows[-1][0] // self.bucket_us}\n")
        return plain(self, key, rows)

    monkeypatch.setattr(J._Ratings, "apply", counted)
    hot = lambda m: m.withColumn("pool", F.lit("hot"))
    got = J.run_to_end(shuffled.matches, "kickoff_ts", lambda m: J.stream_ratings(hot(m), R.CONSTANT_30, late="60 days", bucket_us=bucket_us)).collect()
    want = {r.match_id: r for r in R.elo_fold(hot(tables.matches), R.CONSTANT_30).collect()}
    assert len(got) == len(want) and max(abs(r.pre_h - want[r.match_id].pre_h) for r in got) < 1e-9
    if seen.exists():  # workers may not share the patched class
        calls = [tuple(map(int, x.split())) for x in seen.read_text().splitlines()]
        assert all(a == b for _, a, b in calls) and len(calls) == len({a for _, a, _ in calls})
