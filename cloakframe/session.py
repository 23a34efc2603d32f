"""Session, shuffle and checkpoint settings shared by every module."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cloakframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and UTC; ``conf`` overrides any of it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder below the warehouse; on a
    cluster an error says what to set, since no machine-local folder would do.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    wanted = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not wanted:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")
    sc.setCheckpointDir(wanted)
    return wanted


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark knows exists; a store that cannot be read raises."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hash-partitioned by its keys into ``spark.sql.shuffle.partitions`` parts.

    A later grouping by the keys reuses the partitioning. Adaptive execution
    coalesces by bytes and would leave a small but slow table in one task;
    a number asked for stays. On one machine twice its cores are enough.
    """
    sc = df.sparkSession.sparkContext
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(n, 2 * sc.defaultParallelism) if sc.master.startswith("local[") else n, *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that is documented not to grow; more than ``limit`` rows raise."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; raise the documented bound on purpose")
    return rows
