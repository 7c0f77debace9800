"""Sinks that grow: size-bounded append, sidecars, arrays, debounced state."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.sources.discovery import exists


def append_bounded(df: DataFrame, path: str, kind: str, size: str, order: list[str], limit: int) -> None:
    """Appends rows to numbered files of at most about ``limit`` bytes for each kind, going on in the last file's room.

    A row's file follows from all bytes before it: sums of blocks of rows first, then inside a block, so that no window
    holds a whole kind.
    """
    spark: SparkSession = df.sparkSession
    held = spark.read.parquet(path).groupBy(kind).agg(F.sum(size).alias("_held")) if exists(spark, f"{path}/_SUCCESS") else None
    ranged = df.repartitionByRange(kind, *order).sortWithinPartitions(kind, *order).withColumn("_block", F.spark_partition_id())
    sums = ranged.groupBy(kind, "_block").agg(F.sum(size).alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(kind).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    run = F.sum(size).over(Window.partitionBy(kind, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("_run", F.coalesce(run, F.lit(0))).join(F.broadcast(before), [kind, "_block"])  # a row for each task
    placed = placed.join(F.broadcast(held), kind, "left") if held is not None else placed.withColumn("_held", F.lit(0))
    number = F.floor((F.coalesce("_held", F.lit(0)) + F.col("_before") + F.col("_run")) / limit)
    placed.withColumn("file_no", number).drop("_block", "_run", "_before", "_held").write.mode("append").parquet(path)


def write_sidecars(df: DataFrame, key: str, path: str) -> None:
    """One JSON text for each row, beside the key that names its file."""
    df.select(F.col(key), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json")).write.mode("errorifexists").parquet(path)


def write_arrays(df: DataFrame, key: list[str], order: str, columns: list[str], rows: int, path: str) -> None:
    """Columns of each key as arrays in order, cut into pieces of ``rows``, so that no array grows with its key."""
    piece = F.floor(F.col(order) / rows)
    sorted_ = F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows")
    pieces = df.groupBy(*key, piece.alias("piece")).agg(sorted_)
    pieces.select(*key, "piece", *[F.col(f"rows.{c}").alias(c) for c in columns]).write.mode("errorifexists").parquet(path)


class DebouncedSave:
    """Saves a state at most once in ``interval`` seconds; what came in between is saved by the next call or by :meth:`flush`."""

    def __init__(self, save: Callable[[DataFrame], None], interval: float = 30.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.save, self.interval, self.clock = save, interval, clock
        self.last: float | None = None
        self.waiting: DataFrame | None = None
        self.saves = 0

    def __call__(self, state: DataFrame) -> bool:
        self.waiting = state
        if self.last is None or self.clock() - self.last >= self.interval:
            self.flush()
            return True
        return False

    def flush(self) -> None:
        if self.waiting is not None:
            self.save(self.waiting)
            self.waiting, self.last = None, self.clock()
            self.saves += 1
