"""Session settings and the shared scratch folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import SparkSession

# Left to the cluster: executor sizes, shuffle partitions, checkpoint folder.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "postloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators expect; `extra` holds further `spark.*` settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a fresh local one only where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="postloom-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path for an intermediate table in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df):
    """Write `df` to the shared checkpoint folder and go on from the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, label: str):
    """`df` written as a table in the shared folder and read back: its work is done once, readers take the columns they need."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """What this Python process no longer uses goes back to the system: workers outlive their tasks, and the pools keep what they once had."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)
