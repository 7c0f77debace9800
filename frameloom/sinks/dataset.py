"""Dataset sink: frame rows with a global running index, episodes, tasks and a descriptor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.sinks.reports import write_control_file


def running_index(frames: DataFrame, episode: str, frame: str) -> DataFrame:
    """Adds ``index``: a row's number over all episodes in order, from offsets of the episodes' sizes, so that the only
    wide window runs over one row for each episode."""
    sizes = frames.groupBy(episode).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(episode).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rn = F.row_number().over(Window.partitionBy(episode).orderBy(frame)) - 1
    return frames.join(offsets, episode).withColumn("index", (F.col("_off") + rn).cast("long")).drop("_off")


def write_dataset(frames: DataFrame, tasks: DataFrame, path: str, fps: float, episode: str = "episode_index", frame: str = "frame_index", records_per_file: int = 1_000_000) -> None:
    """Writes ``data``, ``meta/episodes``, ``meta/tasks`` and ``meta/info.json``; an existing dataset is an error.

    Frames are ranged by (episode, frame): files hold whole ranges in order, and readers of an episode prune by its
    statistics. Episode metadata is aggregated from what was written.
    """
    spark = frames.sparkSession
    indexed = running_index(frames, episode, frame)
    indexed.repartitionByRange(episode, frame).sortWithinPartitions(episode, frame).write.mode("errorifexists").option("maxRecordsPerFile", records_per_file).option("compression", "zstd").parquet(f"{path}/data")
    written = spark.read.parquet(f"{path}/data")
    episodes = written.groupBy(episode).agg(F.count(F.lit(1)).alias("length"), F.min("index").alias("dataset_from_index"), (F.max("index") + 1).alias("dataset_to_index"))
    episodes.coalesce(1 if episodes.count() < 100_000 else 8).write.mode("errorifexists").parquet(f"{path}/meta/episodes")
    tasks.write.mode("errorifexists").parquet(f"{path}/meta/tasks")
    total = spark.read.parquet(f"{path}/meta/episodes").agg(F.count(F.lit(1)).alias("episodes"), F.coalesce(F.sum("length"), F.lit(0)).alias("frames")).first()
    if "://" not in path:
        write_control_file(f"{path}/meta/info.json", {"fps": fps, "total_episodes": total["episodes"], "total_frames": total["frames"], "features": {n: t for n, t in frames.dtypes}})


def validate_dataset(frames: DataFrame, episodes: DataFrame, episode: str = "episode_index", frame: str = "frame_index") -> DataFrame:
    """``episode, issue`` of episodes that break an invariant: frames from 0 in steps of 1, length = rows, range fits."""
    got = frames.groupBy(episode).agg(F.count(F.lit(1)).alias("n"), F.min(frame).alias("lo"), F.max(frame).alias("hi"), F.count_distinct(frame).alias("d"))
    j = episodes.join(got, episode, "full_outer")
    issue = (
        F.when(F.col("n").isNull(), "no_frames").when(F.col("length").isNull(), "no_metadata").when(F.col("lo") != 0, "start").when((F.col("hi") + 1 != F.col("n")) | (F.col("d") != F.col("n")), "steps")
        .when(F.col("length") != F.col("n"), "length").when(F.col("dataset_to_index") - F.col("dataset_from_index") != F.col("length"), "range")
    )
    return j.select(episode, issue.alias("issue")).filter("issue IS NOT NULL")
