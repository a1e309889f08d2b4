"""Session helpers: the folder that driver and executors share, and tables written there."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


ROOT = str(Path(__file__).resolve().parent.parent)


#: for Python workers: freed arrays go back to the system, as executors keep their workers
WORKER_ENV = {"MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Arrow batches: setting, Spark's default, ours
BATCHES = [("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16777216b")]


def place(spark: SparkSession) -> None:
    """Let Python workers import this package from where it is installed, however the driver found it, and keep their
    memory small: texts are long, so Arrow batches are smaller unless the session asks for other sizes."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])
    for k, v in WORKER_ENV.items():
        env.setdefault(k, v)
    for name, default, ours in BATCHES:
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset one is made, on a single machine only: executors of a
    cluster would write to their own disks."""
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of frames that written() made and nothing reads any more."""
    for df in frames:
        if df is not None:
            spark = df.sparkSession
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.folder)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that are out of use, before more are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
