"""Session, table access, checkpoints and size checks shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be collected or broadcast by hand; every such use checks its size first.
SMALL_ROWS = 100_000
#: Bytes and rows up to which a checkpointed side is sent to every task instead of being shuffled.
SMALL_BYTES = 32 << 20


def get_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("frameloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FRAMELOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder of ``spark.checkpoint.dir``; a temporary one only in local mode."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="frameloom-checkpoint-")
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A scan for a costly Python stage: dealt over all cores where its files give fewer tasks than there are cores."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()  # the scan's own files, without planning the query
    size = sum(_size(spark, f) for f in files[:cores])
    tasks = max(len(files), size // _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    return df if files and tasks >= cores else df.repartition(cores)


def _size(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getLen()


def _bytes(text: str) -> int:
    m = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", text.strip().lower())
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]] if m else 128 << 20


def collect_small(df: DataFrame, limit: int = SMALL_ROWS) -> list:
    """Collects a table that is small by construction; fails instead of flooding the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows where a small table was expected")
    return rows


def broadcast_if_small(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame | None:
    """The side with a broadcast hint if its rows, as text, measure at most ``limit`` bytes; else None, and the caller
    joins it by a shuffle. ``df`` is read once for it and should be a checkpoint."""
    size = df.select((F.octet_length(F.to_json(F.struct("*"))) + 64).alias("n")).agg(F.sum("n")).first()[0] or 0
    return F.broadcast(df) if size <= limit else None
