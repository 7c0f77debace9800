"""Joins and ranks that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot beyond this part of all rows.
HOT = 64


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Joins many rows to a lookup table that has each key once.

    Only the lookup rows of hot keys are written out ``salts`` times, and the rows of a hot key are dealt over the
    copies by a hash of the ``spread`` columns, so that no task gets all of them. Keys are told hot by their hashes: a
    hash with more than a ``HOT``-th of the rows, of which there are fewer than ``HOT``. Null keys match nothing.
    """
    key = F.xxhash64(*keys)
    counts = left.groupBy(key.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    total, most, kinds = counts.agg(F.sum("n"), F.max("n"), F.count(F.lit(1))).first()
    if not total or most * HOT <= total or kinds == 0:
        return left.join(right, keys, how)
    hot = [r["h"] for r in counts.filter(F.col("n") * HOT > total).collect()]  # fewer than HOT rows
    salted = key.isin(hot)
    dealt = left.withColumn("_salt", F.when(salted, F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(0).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.when(salted, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def two_level_rank(df: DataFrame, group: list[str], order: list[Column], bucket: Column, name: str = "rank") -> DataFrame:
    """1-based rank inside ``group`` in the order of (bucket, order), without a window over a whole group.

    ``bucket`` cuts every group into pieces that are ranked apart; the pieces' counts give the offsets.
    """
    b = df.withColumn("_bucket", bucket)
    sizes = b.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    ranked = b.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)))
    return ranked.join(offsets, [*group, "_bucket"]).withColumn(name, F.col("_rn") + F.col("_off")).drop("_rn", "_off", "_bucket")


def all_not_null(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
