"""Readers: result files, event tables, JSON entity maps, stored ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as SC

# layout -> (schema, names of the common columns) (fixed values)
LAYOUTS = {
    "results": (SC.RESULTS_RAW, {}),
    "results_full": (SC.RESULTS_FULL_RAW, {}),
    "league": (SC.LEAGUE_RAW, {"Date": "date", "HomeTeam": "home_team", "AwayTeam": "away_team", "FTHG": "home_score", "FTAG": "away_score", "FTR": "result"}),
    "league_round": (SC.LEAGUE_ROUND_RAW, {"Date": "date", "HomeTeam": "home_team", "AwayTeam": "away_team", "FTHG": "home_score", "FTAG": "away_score", "FTR": "result", "Competition": "tournament", "Round": "round"}),
}


def read_matches(spark: SparkSession, path: str, layout: str = "results", date_format: str | None = None) -> DataFrame:
    """Result CSV with header to a typed match table.

    Columns are taken by position, so a byte-order mark in the header does no harm; unparseable dates and scores
    become NULL (``clean_matches`` drops them).
    """
    schema, names = LAYOUTS[layout]
    fmt = date_format or ("dd/MM/yyyy" if names else "yyyy-MM-dd")
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=True, encoding="UTF-8", mode="PERMISSIVE").withColumnsRenamed(names)
    df = df.withColumn("date", F.try_to_timestamp("date", F.lit(fmt)).cast("date"))
    df = df.withColumns({c: F.expr(f"try_cast({c} AS int)") for c in ("home_score", "away_score")})
    if "neutral" in df.columns:
        df = df.withColumn("neutral", F.expr("try_cast(neutral AS boolean)"))
    return df


def read_events(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Event or kickoff table; only the wanted columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_entity_map(spark: SparkSession, path: str, value_schema: T.DataType, key: str = "entity", per_line: bool = False) -> DataFrame:
    """JSON objects keyed by entity to one row per entity; one object per file, or per line for large maps."""
    obj = F.from_json("value", T.MapType(T.StringType(), value_schema))
    rows = spark.read.text(path, wholetext=not per_line).select(F.explode(obj).alias(key, "_v"))
    return rows.select(key, "_v.*") if isinstance(value_schema, T.StructType) else rows.withColumnRenamed("_v", "value")


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON array of records to rows."""
    return spark.read.schema(schema).json(path, multiLine=True)


def load_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Ratings written by ``export_ratings``."""
    return spark.read.parquet(path)


def read_feature_store(spark: SparkSession, path: str, teams: list[int] | None = None, year_month: str | None = None) -> DataFrame:
    """Feature store; team and month filters prune partitions."""
    df = spark.read.parquet(path)
    if teams is not None:
        df = df.filter(F.col("team_id").isin(teams))
    return df if year_month is None else df.filter(F.col("year_month") == year_month)
