import itertools

import pytest
from pyspark.sql import functions as F

from rondo import schemas as SC
from rondo.operators import joins as J
from rondo.operators import splits as SP
from rondo.sources import readers as RD
from rondo.sources import sinks as SK


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_fuzzy_match_equals_all_pairs(spark):
    words = ["".join(w) for w in itertools.islice(itertools.product("abc", "nor", "ae", "rst", "ae"), 60)] + ["aaaa", "aaaaaaaa", "Ivory Coast", "Trinidad", "x", "xy"]
    typos = [w[1:] for w in words] + [w + "s" for w in words] + [w[:2] + "q" + w[3:] for w in words] + words
    dim = [(w, float(i)) for i, w in enumerate(words)]
    got = {r.name: (r.matched, r.method) for r in J.fuzzy_match(spark.createDataFrame([(t,) for t in typos], "name string"), spark.createDataFrame(dim, "name string, rating double")).collect()}
    for t in set(typos):
        if t in words:
            assert got[t] == (t, "exact")
            continue
        sims = sorted(((-(1 - levenshtein(t, w) / max(len(t), len(w), 1)), w) for w in words))
        want = (sims[0][1], "fuzzy") if -sims[0][0] >= 0.75 else (None, "default")
        assert got[t] == want, t


def test_union_dedupe_keeps_the_first_batch(spark):
    a = spark.createDataFrame([("x", 1, "a"), ("x", 2, "a2")], "k string, id int, v string")
    b = spark.createDataFrame([("x", 0, "b"), ("y", 5, "b")], "k string, id int, v string")
    got = {r.k: r.v for r in J.union_dedupe([a, b], ["k"], ["id"]).collect()}
    assert got == {"x": "a", "y": "b"}


def test_fixture_checks_find_gaps_and_orphans(spark):
    df = spark.createDataFrame([(1, "group", 1, 3), (2, "group", 2, 9), (3, "final", 4, None)], "match_id int, phase string, chrono_order int, next_match int")
    got = {r.check: (r.value, r.ok) for r in J.fixture_checks(df, {"group": 2, "final": 1}).collect()}
    assert got == {"phase_group": (2, True), "phase_final": (1, True), "total": (3, True), "order_gap_free": (3, False), "next_match_orphans": (1, False)}


def test_read_matches_with_byte_order_mark(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_bytes(b"\xef\xbb\xbfdate,home_team,away_team,home_score,away_score,tournament,neutral\n2024-01-02,A,B,2,1,Friendly,TRUE\nbad,A,B,x,1,Friendly,FALSE\n")
    rows = RD.read_matches(spark, str(p)).orderBy("home_score").collect()
    assert rows[0].date is None and rows[0].home_score is None
    assert (str(rows[1].date), rows[1].home_score, rows[1].neutral) == ("2024-01-02", 2, True)


def test_read_league_layout(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text("Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR\n15/03/2023,A,B,2,1,H\n")
    r = RD.read_matches(spark, str(p), "league").first()
    assert (str(r.date), r.home_team, r.home_score, r.result) == ("2023-03-15", "A", 2, "H")


def test_entity_map_and_records(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text('{\n "Japan": {"victories": 4, "ppg12": 1.5},\n "Mexico": {"victories": 2, "ppg12": 1.0}\n}')
    got = {r.entity: (r.victories, r.ppg12, r.draws) for r in RD.read_entity_map(spark, str(p), SC.FORM).collect()}
    assert got == {"Japan": (4, 1.5, None), "Mexico": (2, 1.0, None)}
    q = tmp_path / "a.json"
    q.write_text('[{"name": "x", "position": "GK", "number": 1},\n {"name": "y"}]')
    assert RD.read_records(spark, str(q), SC.PLAYER).count() == 2


def test_feature_store_rewrites_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "store")
    mk = lambda rows: spark.createDataFrame(rows, "team_id long, feature_name string, feature_value double, feature_ts string").withColumn("feature_ts", F.to_timestamp("feature_ts"))
    SK.save_features(mk([(1, "f", 1.0, "2026-01-05"), (1, "f", 2.0, "2026-02-05")]), path)
    SK.save_features(mk([(1, "f", 3.0, "2026-02-06")]), path)
    assert sorted(r.feature_value for r in RD.read_feature_store(spark, path).collect()) == [1.0, 3.0]
    assert RD.read_feature_store(spark, path, [1], "2026-01").count() == 1


def test_fingerprint_ignores_order_and_sees_changes(spark, tmp_path):
    a = spark.range(100).withColumn("x", F.col("id") * 2)
    assert SK.fingerprint(a).first() == SK.fingerprint(a.orderBy(F.desc("id")).repartition(3)).first()
    wrote, mark = SK.export_if_changed(a, str(tmp_path / "out"), None)
    again, _ = SK.export_if_changed(a, str(tmp_path / "out"), mark)
    other, _ = SK.export_if_changed(a.withColumn("x", F.col("x") + 1), str(tmp_path / "out"), mark)
    assert (wrote, again, other) == (True, False, True)


def test_folds_are_in_time_order_with_embargo(tables):
    df = SP.purged_expanding_cv(tables.matches.select("match_id", "kickoff_ts"), "kickoff_ts", 4, 2)
    b = df.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("kickoff_ts"))).alias("a"), F.min(F.when(F.col("role") == "val", F.col("kickoff_ts"))).alias("z")).collect()
    assert len(b) == 4 and all((r.z - r.a).total_seconds() >= 2 * 86400 for r in b)


def test_empty_validation_folds_are_skipped(tables):
    df = SP.purged_expanding_cv(tables.matches.select("match_id", "kickoff_ts"), "kickoff_ts", 5, 15)
    assert 0 < df.select("fold").distinct().count() < 5


def test_backtest_reports_improvement(spark):
    rows = [(i, f"2025-{1 + i // 28:02d}-{1 + i % 28:02d}", 1 + (i * 7) % 3, 1.3, (i % 10) / 10) for i in range(250)]
    df = spark.createDataFrame(rows, "id int, d string, goals_home int, lambda_home_base double, continuity_index double").withColumn("kickoff_ts", F.to_timestamp("d"))
    out = SP.backtest_uplift(df, ["continuity_index"], k=2, embargo_days=5).collect()
    assert len(out) == 2 and all(r.improvement == pytest.approx(r.mse_base - r.mse_adjusted) for r in out)
