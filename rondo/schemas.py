"""Explicit schemas of the tables read from files."""

from pyspark.sql import types as T

_s, _i, _d = T.StringType(), T.IntegerType(), T.DoubleType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# raw result files, as text; typed by the reader
RESULTS_RAW = struct(date=_s, home_team=_s, away_team=_s, home_score=_s, away_score=_s, tournament=_s, neutral=_s)
RESULTS_FULL_RAW = struct(date=_s, home_team=_s, away_team=_s, home_score=_s, away_score=_s, tournament=_s, city=_s, country=_s, neutral=_s)
LEAGUE_RAW = struct(Date=_s, HomeTeam=_s, AwayTeam=_s, FTHG=_s, FTAG=_s, FTR=_s)
LEAGUE_ROUND_RAW = struct(Date=_s, HomeTeam=_s, AwayTeam=_s, FTHG=_s, FTAG=_s, FTR=_s, Competition=_s, Round=_s)

PLAYER = struct(name=_s, position=_s, number=_i)
SNAPSHOT = struct(snapshot_id=T.LongType(), team_id=T.LongType(), team_name=_s, players=T.ArrayType(PLAYER), source=_s,
                  announcement_timestamp_utc=T.TimestampType(), ingestion_timestamp_utc=T.TimestampType())
FEATURE_RECORD = struct(team_id=T.LongType(), feature_name=_s, feature_value=_d, feature_timestamp_utc=T.TimestampType(), source_snapshot_id=T.LongType(),
                        feature_version=_s, created_at_utc=T.TimestampType(), year_month=_s)
FORM = struct(victories=_i, draws=_i, losses=_i, ppg12=_d, gf_avg=_d, ga_avg=_d, gd_avg=_d, form_last_5=_d, form_last_12=_d)
TREND = struct(matches_12m=_i, ppg=_d, win_rate=_d, gf_avg=_d, ga_avg=_d, gd_avg=_d, form_last_5=_d, form_last_10=_d)
EVENTS = struct(event_id=T.LongType(), ts=T.TimestampNTZType(), user_id=T.LongType(), event_type=_s, value=_d, props=_s)
