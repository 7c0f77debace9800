"""Deterministic selection: diverse samples, nested tiers, holdouts, shards, splits."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int | str, *columns: str) -> Column:
    """A seeded order that depends on the values only."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)


def diverse_sample(df: DataFrame, group: str, item: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows that spread over the groups: rank by hash inside each group, then round robin over the groups in the
    order of their hashes; all rows where there are no more than ``n``. The rank inside a group is the only window;
    rows ranked beyond ``n`` can't be chosen and leave before the final top-n."""
    depth = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, group, item), item))
    ranked = df.withColumn("_depth", depth).filter(F.col("_depth") <= n)
    return ranked.orderBy("_depth", hash_order(seed, group), group).limit(n).drop("_depth")


def nested_tiers(df: DataFrame, group: str, item: str, sizes: Mapping[str, int], seed: int = 42) -> DataFrame:
    """``tier`` column: the smallest tier that holds the row; each tier is the prefix of the next larger one."""
    largest = max(sizes.values())
    depth = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, group, item), item))
    top = df.withColumn("_depth", depth).orderBy("_depth", hash_order(seed, group), group).limit(largest)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_depth", hash_order(seed, group), group))  # over the top rows only
    tier = F.lit(None).cast("string")
    for name, size in sorted(sizes.items(), key=lambda x: -x[1]):
        tier = F.when(F.col("_place") <= size, F.lit(name)).otherwise(tier)
    return top.withColumn("_place", place).withColumn("tier", tier).drop("_depth", "_place")


def holdout(df: DataFrame, columns: list[str], n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows first in hash order."""
    return df.orderBy(hash_order(seed, *columns), *columns).limit(n)


def retained(total: int, fraction: float) -> int:
    """Rounded half up, at least one for a positive fraction, at most all."""
    return 0 if fraction <= 0 or total <= 0 else min(total, max(1, int(total * fraction + 0.5)))


def dataset_seed(seed: int, name: str) -> int:
    """The first eight bytes of a SHA-256, little-endian."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:8], "little")


def seeded_fraction(df: DataFrame, columns: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """A seeded subset without replacement whose size is :func:`retained`; the order is by hash, not by a generator."""
    return holdout(df, columns, retained(df.count(), fraction), seed)


def evenly_spaced(df: DataFrame, order: str, k: int) -> DataFrame:
    """``k`` rows at even distances in an order, first and last included; the positions are few and broadcast."""
    from frameloom.operators.skew import two_level_rank

    n = df.count()
    picks = sorted({int(i * (n - 1) / (k - 1)) for i in range(k)}) if k > 1 and n > k else list(range(n if k > 1 else min(n, 1)))
    ranked = two_level_rank(df.withColumn("_all", F.lit(0)), ["_all"], [F.col(order)], F.floor(F.col(order) / 1000), "_rank").drop("_all")
    return ranked.filter((F.col("_rank") - 1).isin(picks)).drop("_rank")


def balance_shards(costs: Mapping[str, float], shards: int) -> dict[str, int]:
    """Greedy longest-first assignment of whole groups to the shard with the least load; on the driver, over groups only."""
    heap = [(0.0, s) for s in range(shards)]
    out: dict[str, int] = {}
    for name, cost in sorted(costs.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + cost, shard))
    return out


def fixed_split(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows of a fixed list in its order (``ordinal``); a listed id without a row is an error."""
    spark = df.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), f"ordinal INT, {key} {dict(df.dtypes)[key]}")
    missing = [r[key] for r in wanted.join(df, key, "left_anti").collect()]  # of the list's length at most
    if missing:
        raise ValueError(f"ids without a row: {missing}")
    return df.join(F.broadcast(wanted), key)
