"""Run state: latest status, reconciliation with the inventory, roll-ups and resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statuses of an entry, and the stages a clip runs through.
STATUSES = ["pending", "running", "done", "failed", "skipped"]
STAGES = ["geo", "depth", "hands", "slam"]


def latest(events: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last event of each key, and ``attempts``: how often it ran."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("_l")
    return events.groupBy(*keys).agg(last, F.count_if(F.col("status") == "running").alias("attempts")).select(*keys, "_l.*", "attempts")


def roll_back(state: DataFrame) -> DataFrame:
    """After a crash, what was running is pending again."""
    return state.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def reconcile(inventory: DataFrame, state: DataFrame, key: str, resume: bool = True, retry: bool = False) -> DataFrame:
    """``key, decision``: pending, done, failed, skipped, or missing where the inventory lacks a known key.

    Running entries are rolled back first. Skipped ones stay out; done ones too on resume, failed ones unless retried.
    """
    inv = inventory.select(key).distinct().withColumn("_here", F.lit(True))
    s = roll_back(state.select(key, "status"))
    both = inv.join(s, key, "full_outer")
    decision = (
        F.when(F.col("_here").isNull(), "missing")
        .when(F.col("status") == "skipped", "skipped")
        .when((F.col("status") == "done") & F.lit(resume), "done")
        .when((F.col("status") == "failed") & ~F.lit(retry), "failed")
        .otherwise("pending")
    )
    return both.select(key, decision.alias("decision"))


def status_counts(state: DataFrame) -> DataFrame:
    """Entries by status, statuses without entries too."""
    dim = state.sparkSession.createDataFrame([(s,) for s in STATUSES], "status STRING")
    return dim.join(state.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").fillna(0, ["n"])


def roll_up(clips: DataFrame, key: str) -> DataFrame:
    """Status of a video from its clips: undecided while one is open, failed if any failed, done if any is, else skipped."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    agg = clips.groupBy(key).agg(count("pending", "running").alias("open"), count("failed").alias("failed"), count("done").alias("done"))
    return agg.select(key, F.when(F.col("open") > 0, "unchanged").when(F.col("failed") > 0, "failed").when(F.col("done") > 0, "done").otherwise("skipped").alias("status"))


def all_done(stages: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """Keys whose required stages are all done (relational division)."""
    done = stages.filter((F.col("status") == "done") & F.col("stage").isin(required))
    return done.groupBy(*keys).agg(F.count_distinct("stage").alias("_n")).filter(F.col("_n") == len(required)).select(*keys)


def resume_map(stages: DataFrame, keys: list[str]) -> DataFrame:
    """Done stages of each clip, sorted."""
    return stages.filter("status = 'done'").groupBy(*keys).agg(F.sort_array(F.collect_set("stage")).alias("stages"))


def dependency_join(a: DataFrame, b: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """Two branches of one scene: the row is branch b's plus ``carried`` of branch a; an error of a comes first, and
    the event lists follow each other."""
    left = a.select(key, *carried, F.col("error").alias("_error"), F.col("events").alias("_events"))
    j = b.join(left, key)
    rest = [c for c in b.columns if c not in ("error", "events")]
    return j.select(*rest, *carried, F.coalesce("_error", "error").alias("error"), F.concat("_events", "events").alias("events"))


def unmatched_errors(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Failed rows of either branch whose partner never came."""
    left = a.filter("error IS NOT NULL").join(b.select(key), key, "left_anti").select(key, "error", F.lit("a").alias("branch"))
    right = b.filter("error IS NOT NULL").join(a.select(key), key, "left_anti").select(key, "error", F.lit("b").alias("branch"))
    return left.unionByName(right)
