"""Structured Streaming forms: watched folders, dedup, joins with error flush, state, compaction."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from frameloom.sinks.reports import scratch

#: Seconds that one side of a two-stream join waits for the other.
RENDEZVOUS = "600 seconds"


def watch(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None, glob: str | None = None) -> DataFrame:
    """New files of a folder as a stream; unfinished files are kept out by the glob, back pressure by files per batch."""
    r = spark.readStream.schema(schema).option("recursiveFileLookup", "false")
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(path)


def run_to_end(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Processes all that is there in micro-batches and returns the sink as a batch table (or nothing with ``each``).

    The sink and the checkpoint lie in a folder that all executors share, so that a restarted query goes on where it was.
    """
    spark = stream.sparkSession
    place = scratch(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True)
    if each is not None:
        writer.foreachBatch(each).start().awaitTermination()
        return None
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", f"{place}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{place}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    writer.outputMode(mode).foreachBatch(keep).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{place}/out")


def distinct_arrivals(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Each key once, however often it arrives within the delay; older state is dropped by the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def rendezvous(left: DataFrame, right: DataFrame, key: str, at: str, wait: str = RENDEZVOUS) -> DataFrame:
    """Pairs of two streams with one key whose times are at most ``wait`` apart; the watermark bounds what is kept."""
    a = left.withWatermark(at, wait).select([F.col(c).alias(f"a_{c}") for c in left.columns])
    b = right.withWatermark(at, wait).select([F.col(c).alias(f"b_{c}") for c in right.columns])
    near = F.col(f"b_{at}").between(F.col(f"a_{at}") - F.expr(f"INTERVAL {wait}"), F.col(f"a_{at}") + F.expr(f"INTERVAL {wait}"))
    return a.join(b, (F.col(f"a_{key}") == F.col(f"b_{key}")) & near)


def rendezvous_or_flush(left: DataFrame, right: DataFrame, key: str, at: str, wait: str = RENDEZVOUS) -> DataFrame:
    """Like :func:`rendezvous`, and left rows that nobody met come out alone once the watermark has passed them."""
    a = left.withWatermark(at, wait).select([F.col(c).alias(f"a_{c}") for c in left.columns])
    b = right.withWatermark(at, wait).select([F.col(c).alias(f"b_{c}") for c in right.columns])
    near = F.col(f"b_{at}").between(F.col(f"a_{at}"), F.col(f"a_{at}") + F.expr(f"INTERVAL {wait}"))
    return a.join(b, (F.col(f"a_{key}") == F.col(f"b_{key}")) & near, "left_outer")


def state_machine(events: DataFrame, key: str, at: str, status: str) -> DataFrame:
    """Latest status, its time and the number of runs of each key, as updates; last write wins by event time."""
    out = f"{key} {dict(events.dtypes)[key]}, status STRING, at BIGINT, attempts BIGINT"

    def step(name: tuple, batches, state: GroupState):
        now, when, runs = state.get if state.exists else ("pending", -1, 0)
        for b in batches:
            for s, t in zip(b["status"], b["at"], strict=True):
                runs += s == "running"
                if (t, s) >= (when, now):
                    now, when = s, int(t)
        state.update((now, when, int(runs)))
        yield pd.DataFrame({key: [name[0]], "status": [now], "at": [when], "attempts": [int(runs)]})

    slim = events.select(key, F.col(status).alias("status"), F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({at} AS TIMESTAMP_NTZ))").alias("at"))
    return slim.groupBy(key).applyInPandasWithState(step, out, "status STRING, at BIGINT, attempts BIGINT", "update", GroupStateTimeout.NoTimeout)


def upsert_latest(path: str, key: str, order: list[str], buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that keeps the newest row of each key. Keys are dealt over buckets and a batch writes the
    buckets again that it has keys of; a small index says which version of each bucket counts. Idempotent by batch
    number."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != key]
        best = lambda df: df.groupBy("_bucket", key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_m")).select("_bucket", key, "_m.*")
        new = best(batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        touched = sorted(r["_bucket"] for r in new.select("_bucket").distinct().collect())  # at most ``buckets``
        at = {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/index/{number - 1}").collect()} if number > 0 else {}
        old = [spark.read.parquet(f"{path}/v{at[b]}/_b={b}").withColumn("_bucket", F.lit(b)) for b in touched if b in at]
        for one in old:
            new = new.unionByName(one)
        best(new).withColumn("_b", F.col("_bucket")).drop("_bucket").repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(f"{path}/v{number}")
        spark.createDataFrame(sorted((at | dict.fromkeys(touched, number)).items()), "bucket INT, version INT").coalesce(1).write.mode("overwrite").parquet(f"{path}/index/{number}")

    return step


def read_latest(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The table that :func:`upsert_latest` keeps, after a batch."""
    at = spark.read.parquet(f"{path}/index/{number}").collect()
    return spark.read.option("recursiveFileLookup", "true").parquet(*[f"{path}/v{r['version']}/_b={r['bucket']}" for r in at])


def compact_batches(path: str, records_per_file: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that appends each batch in as few files as their bounded size allows."""

    def step(batch: DataFrame, number: int) -> None:
        files = max(1, -(-batch.count() // records_per_file))
        batch.repartition(files).write.mode("overwrite").option("maxRecordsPerFile", records_per_file).parquet(f"{path}/batch={number}")

    return step
