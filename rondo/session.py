"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.functions import broadcast


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "rondo", cores: int | str = "*") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=1)
def _stand_in() -> tempfile.TemporaryDirectory:
    """One folder of a local process, removed when the process ends."""
    return tempfile.TemporaryDirectory(prefix="rondo-")


def _application_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _stand_in().name
    return f"{base.rstrip('/')}/rondo-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A fresh sub-folder of the cluster's shared checkpoint folder, below one folder per application.

    The folder comes from ``spark.checkpoint.dir``; only where that is unset (a local test session)
    does a temporary folder of the process stand in for it.
    """
    return f"{_application_dir(spark)}/{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; frames that still read them can't be used after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def persist_table(df, spark: SparkSession | None = None):
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives executor loss."""
    spark = spark or df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.folder = path
    return written


def release(*written) -> None:
    """Delete tables that ``persist_table`` wrote; nothing may read them any more."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


BROADCAST_BYTES = 32 << 20


def written_bytes(df) -> int:
    """Bytes of the files that a frame read from written tables stands on."""
    spark = df.sparkSession
    hadoop, total = spark._jsc.hadoopConfiguration(), 0
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        total += path.getFileSystem(hadoop).getFileStatus(path).getLen()
    return total


def small(df, written, most: int = BROADCAST_BYTES):
    """``df``, made of no more rows than a written table, with a broadcast hint if the table's files have at most ``most`` bytes."""
    return broadcast(df) if written_bytes(written) <= most else df


def dimension(df, most: int = BROADCAST_BYTES):
    """A small side of a join as a written table, with a broadcast hint if its size allows."""
    written = persist_table(df)
    return small(written, written, most)
