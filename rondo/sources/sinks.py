"""Sinks: feature store, partitioned layouts, snapshot log, ratings, reports, compaction, fingerprints.

Partitioned writes go through a rebalance hint: rows of a partition directory meet in few tasks, and adaptive
execution splits the ones that are too large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import epoch_us
from ..session import persist_table


def _write(df: DataFrame, path: str, partitions: list[str], mode: str = "overwrite", dynamic: bool = False) -> None:
    out = (df.hint("rebalance", *partitions) if partitions else df).write.mode(mode).option("compression", "snappy")
    if dynamic:
        out = out.option("partitionOverwriteMode", "dynamic")
    (out.partitionBy(*partitions) if partitions else out).parquet(path)


def save_features(df: DataFrame, path: str, ts: str = "feature_ts") -> None:
    """Long feature records partitioned by team and month; re-running a month replaces just that month."""
    _write(df.withColumn("year_month", F.date_format(ts, "yyyy-MM")), path, ["team_id", "year_month"], dynamic=True)


# layout -> partition columns (fixed values)
LAYOUTS = {"snapshots": ["team_id", "year", "month"], "matches": ["year", "month", "day"], "features": ["feature_name", "year"]}


def write_layout(df: DataFrame, kind: str, path: str, ts: str) -> None:
    """Snapshots by team / year / month, matches by year / month / day, features by name / year."""
    parts = {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)}
    cols = LAYOUTS[kind]
    _write(df.withColumns({c: parts[c] for c in cols if c in parts}), path, cols)


def append_snapshots(df: DataFrame, path: str, key: str = "team_id", ts: str = "announced_ts", source: str = "source") -> None:
    """Append to the snapshot log; the surrogate id is a hash of team, time and source, so it repeats on a retry."""
    _write(df.withColumn("snapshot_id", F.xxhash64(key, epoch_us(ts), source)), path, [], mode="append")


def export_ratings(df: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """Ratings with metadata columns."""
    _write(df.withColumns({k: F.lit(v) for k, v in metadata.items()}), path, [])


def export_reports(df: DataFrame, base: str, positions: list[str]) -> list[str]:
    """Fan a roster out to the full table, the model table and four summaries; returns the names written."""
    from ..operators.aggregates import group_stats, pivot_counts
    from ..operators.clean import roster_features

    df = persist_table(df)  # read once per table
    n = F.count(F.lit(1))
    meta = df.agg(n.alias("players"), F.count_distinct("country").alias("countries"), F.count_distinct("group").alias("groups"), F.count_distinct("confederation").alias("confederations"))
    tables = {
        "squads": df, "players": roster_features(df), "group_summary": pivot_counts(df, "group", "position", positions),
        "age_distribution": group_stats(df, "group", "age", 1), "confederation_summary": pivot_counts(df, "confederation", "position", positions), "metadata": meta}
    for name, table in tables.items():
        _write(table, f"{base}/{name}", [])
    return list(tables)


def write_records(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Prediction records or backtest iterations."""
    _write(df, path, list(by))


def compact_snapshots(spark: SparkSession, path: str, target: str, retention_days: int, now: str, key: str = "team_id", ts: str = "announced_ts") -> None:
    """Rewrite rows older than the retention into one directory per team. The source stays until the caller drops it."""
    old = spark.read.parquet(path).filter(epoch_us(ts) < epoch_us(F.lit(now)) - retention_days * 86_400_000_000)
    _write(old, target, [key])


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive fingerprint of a table: rows, xor and wrapped sum of row hashes; one row, one pass."""
    h = F.xxhash64(*df.columns)
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor("h").alias("hash_xor"), F.sum(F.pmod("h", F.lit(1_000_000_007))).alias("hash_sum"))


def export_if_changed(df: DataFrame, path: str, last: tuple | None) -> tuple[bool, tuple]:
    """Write only when the fingerprint differs from the last one; returns (written, fingerprint)."""
    now = tuple(fingerprint(df).first())
    if last is not None and tuple(last) == now:
        return False, now
    _write(df, path, [])
    return True, now


def to_entity_map(df: DataFrame, key: str, bucket: Column) -> DataFrame:
    """Rows to JSON objects keyed by entity, one object per bucket; ``bucket`` bounds the entries of an object."""
    rest = F.struct(*[c for c in df.columns if c != key])
    entry = F.struct(F.col(key).cast("string"), rest)
    return df.groupBy(bucket.alias("_b")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).select("value")
