"""Session construction and the shared working folder.

Everything that has to be written between stages (key allocation, stream
sinks, checkpoints) goes below the folder the cluster names in
``spark.checkpoint.dir``. Only when that setting is absent (local runs and
tests) do we create one ourselves.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_scratch: list[str] = []


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "stockbook") -> SparkSession:
    """Build (or reuse) a session with the settings every job here assumes.

    The number of shuffle partitions and the driver's memory are the cluster's
    own unless asked for; only a local master gets small ones by default.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    local = bool(master) and master.startswith("local") and not master.startswith("local-cluster")
    parts = shuffle_partitions or os.environ.get("STOCKBOOK_SHUFFLE_PARTITIONS") or (8 if local else None)
    if parts:
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    memory = os.environ.get("STOCKBOOK_DRIVER_MEMORY") or ("16g" if local else None)
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    builder = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes",
                os.environ.get("STOCKBOOK_MAX_PARTITION_BYTES", "128m"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _conf_checkpoint_dir(spark: SparkSession) -> str | None:
    try:
        return spark.conf.get(_CHECKPOINT_KEY, None) or None
    except Exception:  # noqa: BLE001 - some session kinds refuse unknown keys
        return None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and checkpoints.

    Taken from ``spark.checkpoint.dir`` when the cluster sets it. Only a local
    master without that setting gets a fresh local folder, once per session
    (tests and single-machine runs); elsewhere a missing setting is an error.
    Sessions without a local SparkContext (Spark Connect) use the configured
    folder as is.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        sc = None
    if sc is None:
        configured = _conf_checkpoint_dir(spark)
        if not configured:
            raise RuntimeError(f"set {_CHECKPOINT_KEY} to a shared folder for this session")
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get(_CHECKPOINT_KEY, None) or _conf_checkpoint_dir(spark)
    if not configured:
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="stockbook-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unique path below the shared folder (never reused).

    ``clear_scratch`` deletes what was made this way.
    """
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    For a frame that several branches of a job read: they scan the written
    table instead of repeating its plan, and its row order in each file is
    fixed, whatever executors are lost later.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch paths of this process; returns how many there were.

    To be called when no DataFrame that reads them is needed any more. Uses the
    file system of each path, so it works for any shared storage.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = len(_scratch)
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
