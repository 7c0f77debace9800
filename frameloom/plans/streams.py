"""Queries that run the streaming operators over the event table and return their sinks as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from frameloom.plans.registry import Registry
from frameloom.session import table
from frameloom.sinks.reports import scratch
from frameloom.streaming import streams

R = Registry()


def _split(spark, d, files: int = 4) -> tuple[str, DataFrame]:
    """The events as a folder of several files, as a watched folder would hold them."""
    place = scratch(spark)
    e = table(spark, d, "events")
    e.repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(place)
    return place, e


#: Type of the event that marks the end of a finite stream.
END = "__end"


def _ending(spark, d) -> tuple[str, StructType]:
    """The events as a watched folder, and an end mark ten days after the last of them."""
    place, e = scratch(spark), table(spark, d, "events").select("user_id", "event_type", "value", "ts").withColumn("is_end", F.lit(False))
    last = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("bigint").alias("user_id"), F.lit(END).alias("event_type"), F.lit(0.0).alias("value"), (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts"), F.lit(True).alias("is_end"))
    e.unionByName(last).write.parquet(place)
    return place, e.schema


@R.add("t01_watch_folder", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def t01_watch_folder(spark, d):
    place, e = _split(spark, d)
    seen = streams.run_to_end(streams.watch(spark, place, e.schema, files_per_batch=2, glob="*.parquet"))
    return seen.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@R.add("t02_streaming_dedup", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def t02_streaming_dedup(spark, d):
    place = scratch(spark)
    e = table(spark, d, "events")
    e.unionByName(e).write.parquet(place)  # everything arrives twice
    s = streams.watch(spark, place, e.schema).withColumn("at", F.col("ts").cast("timestamp"))
    once = streams.run_to_end(streams.distinct_arrivals(s, ["event_id"], "at", "1 hour").select("event_id", "user_id"))
    return once.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))

@R.add("t03_stream_join", """SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 600 SECOND AND a.ts + INTERVAL 600 SECOND WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def t03_stream_join(spark, d):
    place, e = _split(spark, d, 1)
    s = lambda kind: streams.watch(spark, place, e.schema).filter(F.col("event_type") == kind).withColumn("at", F.col("ts").cast("timestamp")).select("event_id", "user_id", "at")
    return streams.run_to_end(streams.rendezvous(s("view"), s("click"), "user_id", "at")).select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"))


@R.add("t04_join_timeout")
def t04_join_timeout(spark, d):
    """Pairs within 600 s, and rows whose partner never came once the watermark has passed them."""
    place, e = _split(spark, d, 1)
    s = lambda kind: streams.watch(spark, place, e.schema).filter(F.col("event_type") == kind).withColumn("at", F.col("ts").cast("timestamp")).select("event_id", "user_id", "at")
    out = streams.run_to_end(streams.rendezvous_or_flush(s("purchase"), s("click"), "user_id", "at"))
    return out.groupBy(F.col("b_event_id").isNull().alias("timed_out")).agg(F.count(F.lit(1)).alias("n"))


@R.add("t05_event_drain", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def t05_event_drain(spark, d):
    place, e = _split(spark, d)
    out = scratch(spark)
    seen: list[int] = []
    step = streams.upsert_latest(out, "user_id", ["ts", "event_id"])

    def each(batch, number):
        step(batch.select("user_id", "ts", "event_id", "event_type"), number)
        seen.append(number)

    streams.run_to_end(streams.watch(spark, place, e.schema, files_per_batch=2), each=each)
    return streams.read_latest(spark, out, max(seen)).select("user_id", "event_type", "ts")


@R.add("t06_state_machine", """WITH s AS (SELECT user_id, ts, CASE WHEN value < 2 THEN 'failed' WHEN value < 12 THEN 'running' ELSE 'done' END AS status FROM events)
SELECT user_id, arg_max(status, (ts, status)) AS status, count(*) FILTER (WHERE status = 'running') AS attempts FROM s GROUP BY user_id""")
def t06_state_machine(spark, d):
    place, e = _split(spark, d, 3)
    s = streams.watch(spark, place, e.schema, files_per_batch=1).withColumn("status", F.when(F.col("value") < 2, "failed").when(F.col("value") < 12, "running").otherwise("done"))
    updates = streams.run_to_end(streams.state_machine(s, "user_id", "ts", "status"), "update")
    return updates.groupBy("user_id").agg(F.max_by(F.struct("status", "attempts"), "_batch").alias("m")).select("user_id", "m.status", "m.attempts")


@R.add("t12_fan_out", "SELECT 'large' AS branch, count(*) AS n FROM events WHERE value >= 50 UNION ALL SELECT 'small', count(*) FROM events WHERE value < 50")
def t12_fan_out(spark, d):
    place, e = _split(spark, d)
    out = scratch(spark)

    def each(batch, number):
        both = batch.select(F.when(F.col("value") >= 50, "large").otherwise("small").alias("branch"), "event_id")
        both.write.mode("overwrite").partitionBy("branch").parquet(f"{out}/batch={number}")

    streams.run_to_end(streams.watch(spark, place, e.schema, files_per_batch=2), each=each)
    return spark.read.parquet(out).groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


@R.add("t13_compaction", "SELECT count(*) AS n, sum(event_id)::BIGINT AS checksum, true AS fewer_files FROM events")
def t13_compaction(spark, d):
    place, e = _split(spark, d, 8)
    out = scratch(spark)
    streams.run_to_end(streams.watch(spark, place, e.schema, files_per_batch=4), each=streams.compact_batches(out, 1_000_000))
    after = spark.read.parquet(out)
    fewer = len(after.inputFiles()) < len(spark.read.schema(e.schema).parquet(place).inputFiles())
    return after.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("checksum")).withColumn("fewer_files", F.lit(fewer))


@R.add("t15_event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t15_event_windows(spark, d):
    """Windows that come out once, when the watermark has passed them, and then leave the state; an end mark passes the last."""
    place, schema = _ending(spark, d)
    s = streams.watch(spark, place, schema).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    w = s.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    out = streams.run_to_end(w.select(F.col("w.start").alias("day"), "event_type", "n", "total"))
    return out.filter(F.col("event_type") != END).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))

@R.add("t16_session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS first, count(*) AS n FROM s GROUP BY user_id, k""")
def t16_session_windows(spark, d):
    """Sessions of a stream, each once it is over."""
    place, schema = _ending(spark, d)
    s = streams.watch(spark, place, schema).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    w = s.groupBy("user_id", "is_end", F.session_window("at", "6 hours").alias("w")).agg(F.min("ts").alias("first"), F.count(F.lit(1)).alias("n"))
    return streams.run_to_end(w.select("user_id", "is_end", "first", "n")).filter("NOT is_end").select("user_id", "first", "n")
