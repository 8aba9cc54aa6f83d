"""Session helpers shared by every module."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitter's session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chunkloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one where that is unset and all runs on one machine.

    On a cluster without the setting there is no folder that all executors see, so that is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if configured is None and current.isEmpty():
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: a cluster must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="chunkloom-")
    if current.isEmpty():
        sc.setCheckpointDir(configured)
    return configured or current.get()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores where its scan has too few splits for them, as for a table of one small file; else as it is.

    For work that costs far more than moving the rows. Large tables have splits enough and are never shuffled here.
    df must be a scan with narrow steps only, so that counting its partitions plans it and runs nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if 2 * df.rdd.getNumPartitions() <= cores else df


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it from there: a cut of lineage that survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
