"""Continuous periods and gaps of intervals per entity, in two levels of time shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.skew import all_not_null
from frameloom.session import checkpoint

#: Time units in a shard. A shard has at most so many distinct starts, which bounds every local window.
SHARD = 1 << 16


def shard_of(c: Column, shard: int) -> Column:
    """Floor of c / shard in whole numbers, for negative times too."""
    return F.call_function("div", c - F.pmod(c, F.lit(shard)), F.lit(shard)).cast("long")


def merge_intervals(df: DataFrame, keys: list[str], start: str, stop: str, shard: int = SHARD) -> DataFrame:
    """Maximal periods of the half-open intervals [start, stop) of each entity; touching intervals join.

    Returns ``keys, start, stop``. Rows with a null key or bound, and rows with stop <= start, take no part; an empty
    input gives an empty result; other columns of ``df`` are ignored; repeated rows change nothing.

    Intervals are clipped to the first and the last shard they touch, and the whole shards between go as one span, so
    that a long interval never becomes more than three rows. Clips merge inside (entity, shard); clips that reach a
    shard's edge and the spans are then stitched per entity, at most a few rows for each of its shards.
    """
    w = F.lit(shard)
    rows = (
        df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{start}`").cast("long").alias("a"), F.col(f"`{stop}`").cast("long").alias("b"))
        .filter(all_not_null([*(f"k{i}" for i in range(len(keys))), "a", "b"]) & (F.col("b") > F.col("a")))
    )
    ks = [f"k{i}" for i in range(len(keys))]
    longest = rows.groupBy(*ks, "a").agg(F.max("b").alias("b"))
    placed = longest.withColumn("s0", shard_of(F.col("a"), shard)).withColumn("s1", shard_of(F.col("b") - 1, shard))
    piece = lambda s, a, b: F.struct(s.cast("long").alias("s"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    s0, s1, a, b = (F.col(c) for c in ("s0", "s1", "a", "b"))
    clips = placed.select(*ks, F.inline(F.when(s0 == s1, F.array(piece(s0, a, b))).otherwise(F.array(piece(s0, a, (s0 + 1) * w), piece(s1, s1 * w, b)))))

    by_shard = Window.partitionBy(*ks, "s").orderBy("a")
    local = (
        clips.groupBy(*ks, "s", "a").agg(F.max("b").alias("b"))
        .withColumn("before", F.max("b").over(by_shard.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("isle", F.sum(F.when(F.col("before").isNull() | (a > F.col("before")), 1).otherwise(0)).over(by_shard))
        .groupBy(*ks, "s", "isle").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("isle")
        .withColumn("edge", (a == F.col("s") * w) | (b - F.col("s") * w == w))
    )
    local = checkpoint(local)

    # Whole shards: +1 where a span begins and -1 where it ends; a shard is full where the running sum is positive.
    spans = placed.filter(s1 > s0 + 1).select(*ks, (s0 + 1).alias("s"), s1.alias("e"))
    marks = (
        spans.select(*ks, F.inline(F.array(F.struct(F.col("s").alias("s"), F.lit(1).alias("d")), F.struct(F.col("e").alias("s"), F.lit(-1).alias("d")))))
        .groupBy(*ks, "s").agg(F.sum("d").alias("d"))
    )
    used = local.select(*ks, "s").distinct().withColumn("d", F.lit(0).cast("long"))
    level = (
        marks.unionByName(used).groupBy(*ks, "s").agg(F.sum("d").alias("d"))
        .withColumn("open", F.sum("d").over(Window.partitionBy(*ks).orderBy("s")))
        .withColumn("next", F.lead("s").over(Window.partitionBy(*ks).orderBy("s")))
    )
    full = level.filter("open > 0")
    coarse = full.select(*ks, (F.col("s") * w).alias("a"), (F.col("next") * w).alias("b"))
    inside = local.filter(~F.col("edge")).join(full.select(*ks, "s"), [*ks, "s"], "left_anti").select(*ks, "a", "b")

    per = Window.partitionBy(*ks).orderBy("a", "b")
    stitched = (
        local.filter("edge").select(*ks, "a", "b").unionByName(coarse)
        .withColumn("before", F.max("b").over(per.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("isle", F.sum(F.when(F.col("before").isNull() | (a > F.col("before")), 1).otherwise(0)).over(per))
        .groupBy(*ks, "isle").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("isle")
    )
    # A stitched period can end inside a shard only where a clip ended, so inner clips outside full shards stay apart.
    periods = inside.unionByName(stitched)
    return periods.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.col("a").alias("start"), F.col("b").alias("stop"))


def interval_gaps(periods: DataFrame, keys: list[str], shard: int = SHARD) -> DataFrame:
    """Holes between neighbouring disjoint periods (``keys, start, stop``) of an entity; same columns.

    The next period is looked up inside the shard of the period's start; a shard's last period takes the first start
    of the entity's next used shard.
    """
    p = periods.withColumn("_s", shard_of(F.col("start"), shard))
    firsts = p.groupBy(*keys, "_s").agg(F.min("start").alias("_first"))
    nexts = firsts.withColumn("_next", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_s"))).drop("_first")
    here = p.withColumn("_lead", F.lead("start").over(Window.partitionBy(*keys, "_s").orderBy("start")))
    last = here.filter(F.col("_lead").isNull()).drop("_lead").join(nexts, [*keys, "_s"]).withColumnRenamed("_next", "_lead")
    both = here.filter(F.col("_lead").isNotNull()).unionByName(last.filter(F.col("_lead").isNotNull()))
    return both.select(*keys, F.col("stop").alias("start"), F.col("_lead").alias("stop"))


def coverage(df: DataFrame, keys: list[str], start: str, stop: str, shard: int = SHARD) -> DataFrame:
    """Periods and gaps together: ``kind, keys, start, stop``."""
    periods = checkpoint(merge_intervals(df, keys, start, stop, shard))
    gaps = interval_gaps(periods, keys, shard)
    return periods.select(F.lit("period").alias("kind"), *keys, "start", "stop").unionByName(gaps.select(F.lit("gap").alias("kind"), *keys, "start", "stop"))
