"""Checks of produced segments against what was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expected_segments(df: DataFrame, key: str, duration: str, size: float, min_tail: float) -> DataFrame:
    """``key, segment, start, stop`` of whole segments; a tail shorter than ``min_tail`` is dropped unless it is all
    there is, and one within half a second of the full size counts as full."""
    d = F.col(duration)
    full = F.floor((d + 0.5) / size).cast("long")
    rest = d - full * size
    n = full + F.when((rest >= min_tail) | (full == 0), 1).otherwise(0)
    rows = df.filter(d > 0).select(key, d.alias("_d"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("segment"))
    return rows.select(key, "segment", (F.col("segment") * size).alias("start"), F.least((F.col("segment") + 1) * size, F.greatest(F.col("_d"), F.lit(0.0))).alias("stop"))


def verify_segments(sources: DataFrame, segments: DataFrame, key: str, seconds: float = 1.0, share: float = 0.01, frames: int = 5) -> DataFrame:
    """``key, status``: the first that holds of probe_src, miss, seg_miss, seg_extra, probe_out, frames, duration, fps,
    resolution, ok.

    ``sources`` has ``key, duration, frames, fps, width, height, error, expected``; ``segments`` has ``key, segment,
    duration, frames, fps, width, height, error``. Tolerances are the larger of the absolute and the relative one.
    """
    e = segments.join(sources.select(key, "expected"), key)
    got = e.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("segment") < 0) | (F.col("segment") >= F.col("expected"))).alias("extra"),
        F.count_distinct(F.when(F.col("segment").between(0, F.col("expected") - 1), F.col("segment"))).alias("fit"), F.count_if(F.col("error").isNotNull()).alias("bad"),
        F.sum("duration").alias("d"), F.sum("frames").alias("f"), F.min("fps").alias("fps_lo"), F.max("fps").alias("fps_hi"), F.min("width").alias("w"), F.max("width").alias("w_hi"), F.min("height").alias("h"), F.max("height").alias("h_hi"),
    )
    j = sources.join(got, key, "left")
    off = lambda a, b, tol: F.abs(F.col(a) - F.col(b)) > F.greatest(F.lit(float(tol)), F.col(b) * share)
    status = (
        F.when(F.col("error").isNotNull() | (F.coalesce("duration", F.lit(0.0)) <= 0), "probe_src")
        .when(F.coalesce("n", F.lit(0)) == 0, "miss")
        .when(F.col("fit") < F.col("expected"), "seg_miss")
        .when(F.col("extra") > 0, "seg_extra")
        .when(F.col("bad") > 0, "probe_out")
        .when(off("f", "frames", frames), "frames")
        .when(off("d", "duration", seconds), "duration")
        .when((F.abs(F.col("fps_lo") - F.col("fps")) > 0.01) | (F.abs(F.col("fps_hi") - F.col("fps")) > 0.01), "fps")
        .when((F.col("w") != F.col("width")) | (F.col("w_hi") != F.col("width")) | (F.col("h") != F.col("height")) | (F.col("h_hi") != F.col("height")), "resolution")
        .otherwise("ok")
    )
    return j.select(key, status.alias("status"))


def overlaps(df: DataFrame, keys: list[str], start: str, stop: str, slack: float = 1e-3) -> DataFrame:
    """Rows that begin before the previous one of their key has ended."""
    before = F.lag(stop).over(Window.partitionBy(*keys).orderBy(start, stop))
    return df.withColumn("_before", before).filter(F.col(start) < F.col("_before") - slack).drop("_before")


def clamp_segments(df: DataFrame, start: str, stop: str, total: str) -> DataFrame:
    """Segments held to [0, total); empty and inverted ones are dropped."""
    inside = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.col(total)))
    return df.filter(F.col(stop) > F.col(start)).withColumns({start: inside(start), stop: inside(stop)}).filter(F.col(stop) > F.col(start))


def scan_rules(lines: DataFrame, text: str, rules: dict[str, str]) -> DataFrame:
    """Adds one row for each rule (name -> pattern) that a line breaks; the rules are part of the expression, not a join."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(pattern), F.lit(name)) for name, pattern in rules.items()]))
    return lines.withColumn("rule", F.explode(hits))


def duplicate_targets(plan: DataFrame, target: str) -> DataFrame:
    return plan.groupBy(target).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def audit_counts(expected: DataFrame, actual: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Full outer audit of row counts: ``key, expected, actual, issue`` (missing, extra, count or null)."""
    j = expected.select(key, F.col(count).alias("expected")).join(actual.select(key, F.col(count).alias("actual")), key, "full_outer")
    issue = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("actual") != F.col("expected"), "count")
    return j.withColumn("issue", issue)
