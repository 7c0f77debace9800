"""Mixing of sources to target shares of the total size, with a cap on how often a record is used."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.session import checkpoint, collect_small

#: Hash buckets of a source; only the bucket that holds the cut is looked at row by row.
BUCKETS = 4096


def water_fill(available: Mapping[str, float], shares: Mapping[str, float], caps: Mapping[str, int], total: float) -> dict[str, float]:
    """Size to take from each source: its share of ``total``, clamped at ``available x cap``; what a clamped source
    can't give goes to the others in proportion to their shares, until nothing is clamped or all are."""
    room = {s: available.get(s, 0) * caps[s] for s in shares}
    took = {s: 0.0 for s in shares}
    open_, left = {s for s in shares if room[s] > 0 and shares[s] > 0}, float(total)
    while open_ and left > 1e-9:
        weight = sum(shares[s] for s in open_)
        full = {s for s in open_ if left * shares[s] / weight >= room[s]}
        if not full:
            return took | {s: left * shares[s] / weight for s in open_}
        for s in full:
            took[s] = float(room[s])
            left -= room[s]
        open_ -= full
    return took


def mix(df: DataFrame, source: str, size: str, ids: list[str], targets: DataFrame, total: float | None = None, seed: int = 42, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``uses`` (0 uses are left out), and a report of the shares reached.

    ``targets`` has ``source, target_share, max_repeats``, one row for each source. Sources compare trimmed and in
    lower case; rows that agree in ``ids``, source and size count once. Rows with a null or non-positive size, and
    rows of a source without a target, add nothing and aren't chosen. ``total`` is the size to reach, by default the
    size of all rows that count. A source is used r = taken / available times: each row floor(r) times, and the rows
    first in a seeded hash order once more until the rest is reached, so the size taken is off by one row at most.
    """
    norm = lambda c: F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    want = {r["s"]: (float(r["target_share"]), int(r["max_repeats"])) for r in collect_small(targets.select(norm(F.col("source")).alias("s"), "target_share", "max_repeats").dropna())}
    shown = [c for c in dict.fromkeys([*ids, source, size])]
    rows = df.select(*shown).withColumn("_s", norm(F.col(f"`{source}`"))).filter(F.col("_s").isin(list(want)) & (F.col(f"`{size}`") > 0))
    rows = rows.groupBy("_s", F.col(f"`{size}`").cast("long").alias("_size"), *[F.col(f"`{i}`") for i in ids]).agg(F.lit(1).alias("_one")).drop("_one")
    key = F.xxhash64(F.lit(seed), "_s", "_size", *ids)
    keyed = rows.withColumn("_h", key).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    keyed = checkpoint(keyed)
    parts = checkpoint(keyed.groupBy("_s", "_b").agg(F.sum("_size").alias("_sum")))  # sources x buckets rows
    have = {r["_s"]: r["n"] for r in collect_small(parts.groupBy("_s").agg(F.sum("_sum").alias("n")))}
    goal = sum(have.values()) if total is None else total
    took = water_fill(have, {s: a for s, (a, _) in want.items()}, {s: c for s, (_, c) in want.items()}, goal)

    spark = df.sparkSession
    plan = [(s, int(took[s] // have[s]) if have.get(s) else 0, took[s] - (took[s] // have[s]) * have[s] if have.get(s) else 0.0) for s in sorted(want)]
    per = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cuts = parts.join(F.broadcast(spark.createDataFrame(plan, "_s STRING, _whole INT, _rest DOUBLE")), "_s").withColumn("_before", F.coalesce(F.sum("_sum").over(per), F.lit(0)))
    cuts = checkpoint(cuts)
    placed = keyed.join(F.broadcast(cuts) if len(want) * buckets <= 1_000_000 else cuts, ["_s", "_b"])
    inside = Window.partitionBy("_s", "_b").orderBy("_h", *ids).rowsBetween(Window.unboundedPreceding, -1)
    at_cut = (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_sum") > F.col("_rest"))
    cut = placed.filter(at_cut).withColumn("_at", F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    extra = cut.withColumn("_more", (F.col("_at") + F.col("_size") / 2 <= F.col("_rest")).cast("int")).drop("_at")
    clear = placed.filter(~at_cut).withColumn("_more", (F.col("_before") + F.col("_sum") <= F.col("_rest")).cast("int"))
    used = clear.unionByName(extra).withColumn("uses", F.col("_whole") + F.col("_more")).filter("uses > 0")
    chosen = used.select(*ids, F.col("_s").alias("source"), F.col("_size").alias("size"), "uses")

    sums = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("rows_used"), F.sum("uses").alias("uses"), F.sum(F.col("size") * F.col("uses")).alias("size_used"), F.max("uses").alias("most_uses"))
    names = spark.createDataFrame([(s, a, c, int(have.get(s, 0)), float(took[s])) for s, (a, c) in sorted(want.items())], "source STRING, target_share DOUBLE, max_repeats INT, size_available BIGINT, size_planned DOUBLE")
    whole = Window.partitionBy(F.lit(1))  # over one row for each source
    report = names.join(sums, "source", "left").fillna(0).withColumn("share", F.coalesce(F.try_divide(F.col("size_used"), F.sum("size_used").over(whole)), F.lit(0.0)))
    return chosen, report
