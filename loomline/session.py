"""Session factory and the shared work folder of a session."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (tests and local runs).
LOCAL_SHARED = "/tmp/checkpoints/loomline"


def build_session(app: str = "loomline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew handling; ``conf`` overrides single settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset a session on one machine uses
    a local folder, and one on a cluster, whose machines would each write to their own, is told to set it."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return f"file://{LOCAL_SHARED}"


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; tables written there survive lost executors."""
    _MADE.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear_work(spark: SparkSession) -> int:
    """Delete what this process has written to the shared folder, when no result that reads it is needed any more; how many
    paths there were."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    gone = 0
    while _MADE:
        made = path(_MADE.pop())
        gone += made.getFileSystem(spark._jsc.hadoopConfiguration()).delete(made, True)
    return gone


def reread(spark: SparkSession, frame, label: str, **options: str):
    """Cut the lineage: write ``frame`` as Parquet in the shared folder and read it back with the same schema."""
    path = work_path(spark, label)
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(frame: DataFrame) -> DataFrame:
    """``frame`` over all cores where it is read in fewer pieces than there are: a small file of one row group would
    keep one core busy. A large input has more pieces and is not shuffled."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame
