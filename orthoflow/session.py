"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
# Intake classifies many cells per row. Generated methods beyond 8,000 bytes of bytecode are never
# compiled by the JVM's JIT; with this limit Spark plans such stages as several smaller ones.
HUGE_METHOD_SETTING = "spark.sql.codegen.hugeMethodLimit"
HUGE_METHOD_LIMIT = "8000"
# Number of partitions over which parsed tables are dealt first; unset: as Spark splits the files.
SPREAD_SETTING = "spark.orthoflow.spreadInputs"

# Spark shuffles both sides of a join by all its keys again unless told that a part of them is enough.
CO_PARTITION_SETTING = "spark.sql.requireAllClusterKeysForCoPartition"


def local_session(name: str, cores: str | None = None) -> SparkSession:
    """A local session for tests and measurements; a cluster brings its own."""
    cores = cores or os.environ.get("BENCH_CPUS") or "8"
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config(HUGE_METHOD_SETTING, HUGE_METHOD_LIMIT)
        .config(SPREAD_SETTING, cores)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config(CHECKPOINT_SETTING, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; fall back to a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(CHECKPOINT_SETTING)
    if folder:
        context.setCheckpointDir(folder)
    elif context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor never loses an iteration's input."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame) -> DataFrame:
    """Parquet in the shared folder: later steps read the columns they name, where a checkpoint is read by whole rows."""
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    folder = f"{base.rstrip('/')}/written-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)
