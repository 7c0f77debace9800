"""Mergeable moments (count, mean, sum of squared deviations) that can be reweighted without a second scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partial_moments(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(column).cast("double").alias("n"), F.avg(column).alias("mean"), (F.var_pop(column) * F.count(column)).alias("m2"))


def scale_moments(df: DataFrame, fraction: str) -> DataFrame:
    """Moments as if only a fraction of the rows had been seen: count and m2 shrink, the mean stays."""
    return df.withColumns({"n": F.col("n") * F.col(fraction), "m2": F.col("m2") * F.col(fraction)})


def merge_moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Chan's parallel merge of any number of partial moments in one aggregation."""
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / total
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - total * mean * mean
    out = df.groupBy(*keys).agg(total.alias("n"), mean.alias("mean"), (F.sum("m2") + between).alias("m2"))
    return out.withColumn("n", F.col("n").cast("long")) if keys else out
