"""Session helpers: a local session for tests, and the shared folder that jobs may write to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: str | int = "*", name: str = "parlance", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PARLANCE_DRIVER_MEMORY", "6g"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Read from the session; a temporary one only where the setting is unset."""
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
        path = "file://" + tempfile.mkdtemp(prefix="parlance-")
        spark.conf.set(CHECKPOINT_CONF, path)
    return path


#: Paths that this driver has given out.
_GIVEN: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    _GIVEN.append(f"{shared_dir(spark).rstrip('/')}/parlance/{what}-{uuid.uuid4().hex}")
    return _GIVEN[-1]


def tidy(spark: SparkSession) -> int:
    """Delete all intermediate tables that this driver has written; how many there were. For the end of a job, when its
    results are stored elsewhere: results that are not would lose what they are read from."""
    n, jvm = 0, spark.sparkContext._jvm
    while _GIVEN:
        path = jvm.org.apache.hadoop.fs.Path(_GIVEN.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def spread(df, *keys: str):
    """Partition by keys into as many parts as shuffles have. Rows that are small in bytes but dear in work stay apart,
    where adaptive execution would join them into a few tasks; grouping by the keys needs no further shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def written(df, what: str):
    """Cut lineage: write ``df`` below the shared folder and read it back. Survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
