"""Session defaults and the few cluster-wide facts that operators need."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "paperlode", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # small tables still use all cores
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PAPERLODE_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the folder the cluster shares (``spark.checkpoint.dir``).

    Only a session of one machine that names none, as in tests, gets a temporary folder; a cluster must name one, as
    what one machine holds is lost with it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="paperlode-"))
    return df.checkpoint(eager=True)


def spread(spark: SparkSession, floor: int = 1) -> int:
    """Partitions for a shuffle this engine asks for explicitly."""
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def widen(df: DataFrame) -> DataFrame:
    """The same rows over all cores where a scan has fewer splits than there are (one small file, say).

    Larger inputs are left as they are; it moves rows only, and changes no result.
    """
    sc = df.sparkSession.sparkContext
    return df.repartition(sc.defaultParallelism) if df.rdd.getNumPartitions() < sc.defaultParallelism else df
