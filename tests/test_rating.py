import pytest
from pyspark.sql import functions as F

from rondo.operators import rating as R


def brute(rows, k=30.0, bonus=100.0, base=1500.0):
    """Plain sequential fold, the definition."""
    ratings, out = {}, {}
    for m in sorted(rows, key=lambda r: (r.kickoff_ts, r.match_id)):
        rh, ra = ratings.get((m.pool, m.home), base), ratings.get((m.pool, m.away), base)
        e = 1 / (1 + 10 ** (-(rh + (0 if m.neutral else bonus) - ra) / 400))
        s = 1.0 if m.home_score > m.away_score else 0.0 if m.home_score < m.away_score else 0.5
        ratings[m.pool, m.home], ratings[m.pool, m.away] = rh + k * (s - e), ra - k * (s - e)
        out[m.match_id] = (rh, ra)
    return out, ratings


@pytest.mark.parametrize("unit", ["year", "week", "day"])
def test_fold_equals_definition_in_any_slices(tables, unit):
    m = tables.matches
    want, final = brute(m.collect())
    folded = R.elo_fold(m, R.CONSTANT_30, unit=unit)
    got = {r.match_id: (r.pre_h, r.pre_a) for r in folded.collect()}
    assert got.keys() == want.keys()
    assert max(abs(a - b) for k in want for a, b in zip(got[k], want[k])) < 1e-9
    last = {(r.pool, r.team): r.rating for r in R.final_ratings(folded).collect()}
    assert max(abs(last[k] - final[k]) for k in final) < 1e-7


def test_sliced_fold_uses_seeds(spark, tables):
    m = tables.matches
    seeds = m.select("pool", F.explode(F.array("home", "away")).alias("team")).distinct().withColumn("rating", 1400.0 + F.col("team") * 10)
    a = R.elo_fold(m, R.GROUP_PHASE, seeds=seeds).select("match_id", "pre_h", "post_a")
    b = R.elo_fold(m, R.GROUP_PHASE, seeds=seeds, unit="week").select("match_id", F.col("pre_h").alias("x"), F.col("post_a").alias("y"))
    worst = a.join(b, "match_id").agg(F.max(F.abs(F.col("pre_h") - F.col("x"))), F.max(F.abs(F.col("post_a") - F.col("y"))), F.count(F.lit(1))).first()
    assert worst[2] == 1000 and worst[0] < 1e-7 and worst[1] < 1e-7


def test_ratings_are_zero_sum(tables):
    final = R.final_ratings(R.elo_fold(tables.matches, R.TOURNAMENT_CAP))
    for r in final.groupBy("pool").agg(F.avg("rating").alias("m")).collect():
        assert abs(r.m - 1500) < 1e-6


def test_longest_keyword_wins(spark):
    df = spark.createDataFrame([("FIFA World Cup qualification",), ("FIFA World Cup",), ("Kirin Cup",)], "tournament string")
    assert [r[0] for r in df.select(R.tournament_k()).collect()] == [50.0, 60.0, 35.0]
    assert [r[0] for r in df.select(R.tournament_k(longest_first=False)).collect()] == [60.0, 60.0, 35.0]


def _counted(monkeypatch):
    """Rows and groups that every call of the fold streams."""
    seen, plain = [], R._fold
    monkeypatch.setattr(R, "_fold", lambda rows: seen.append(rows) or plain(rows))
    return seen


@pytest.mark.parametrize("unit", [None, "day", "month"])
def test_every_slice_is_folded_once(tables, monkeypatch, unit):
    """Four pools of about 250 matches in slices of 60: each match goes through the fold once, whatever the slices."""
    m = tables.matches
    want, _ = brute(m.collect())
    seen = _counted(monkeypatch)
    got = R.elo_fold(m, R.CONSTANT_30, unit=unit, most=60).collect()
    assert len(seen) > (0 if unit == "month" else 3)  # the matches span one month
    folds = [(k, r.pool, r.grp, r.n) for k, rows in enumerate(seen) for r in rows.filter("kind = 1").groupBy("pool", "grp").agg(F.count("*").alias("n")).collect()]
    assert sum(f[3] for f in folds) == len(got) == len(want)
    assert len({f[:3] for f in folds}) == len(folds)
    assert max(abs(r.pre_h - want[r.match_id][0]) + abs(r.pre_a - want[r.match_id][1]) for r in got) < 1e-9


def test_teams_that_do_not_meet_are_folded_side_by_side(spark, tables, monkeypatch):
    """One pool of 12 leagues that never meet: every slice has 12 groups, none with another league's matches."""
    m = tables.matches.filter("home % 2 != away % 2").withColumn("pool", F.lit("one"))
    m = m.withColumn("home", F.col("home") - F.col("home") % 2 + F.lit(0)).withColumn("away", F.col("home") + 1)
    want, _ = brute(m.collect())
    seen = _counted(monkeypatch)
    got = R.elo_fold(m, R.CONSTANT_30, most=150).collect()
    assert len(seen) > 2 and max(abs(r.pre_h - want[r.match_id][0]) for r in got) < 1e-9
    for rows in seen:
        assert rows.filter("kind = 1 and int(home / 2) != int(grp / 2)").count() == 0
        assert rows.filter("kind = 1").select("grp").distinct().count() > 6


def test_no_slice_is_larger_than_asked(tables):
    m = tables.matches.withColumn("pool", F.when(F.col("match_id") % 3 > 0, "hot").otherwise(F.col("pool")))
    sliced, several = R._slices(m, None, 80)
    assert several and sliced.groupBy("pool", "slice").count().agg(F.max("count")).first()[0] <= 80
    assert sliced.count() == m.count()


def test_empty_table_has_no_ratings(tables):
    assert R.elo_fold(tables.matches.limit(0), R.CONSTANT_30).count() == 0
