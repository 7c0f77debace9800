"""Report and table sinks; every write goes through Spark's commit protocol."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or a temporary one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.gettempdir()}/frameloom-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header and fixed field order; lists are joined by ``;``, NaN and infinities become empty."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), ";")
        elif kind in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        cols.append(c.alias(name))
    df.select(*cols).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines without NaN."""
    clean = [(F.when(~F.isnan(f"`{n}`"), F.col(f"`{n}`")) if k in ("double", "float") else F.col(f"`{n}`")).alias(n) for n, k in df.dtypes]
    df.select(*clean).write.mode(mode).json(path)


def write_and_read_csv(df: DataFrame) -> DataFrame:
    """Round trip of the CSV sink."""
    path = scratch(df.sparkSession)
    write_csv(df, path)
    return df.sparkSession.read.schema(df.schema).option("header", True).option("escape", '"').option("emptyValue", "").csv(path).fillna("")


def write_control_file(path: str, content: dict) -> None:
    """Small JSON control file on the driver: written aside, synced, then renamed, so that readers see all or nothing."""
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(aside, "w", encoding="utf-8") as f:
        json.dump(content, f, sort_keys=True, allow_nan=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(aside, path)


def append_events(df: DataFrame, path: str) -> None:
    """Immutable event records: an append-only table; equal ids of one write get a numbered suffix."""
    from pyspark.sql import Window

    w = Window.partitionBy("record_id").orderBy("recorded_at", F.xxhash64(*df.columns))
    n = F.row_number().over(w)
    df.withColumn("record_id", F.when(n > 1, F.concat("record_id", F.lit("-"), n.cast("string"))).otherwise(F.col("record_id"))).write.mode("append").parquet(path)
