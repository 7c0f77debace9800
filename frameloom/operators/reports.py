"""Benchmark reports: corpus aggregates, side means, ranking, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.numbers import finite
from frameloom.functions.text import side_suffix

#: Metrics that are better when larger; all others are better when smaller.
LARGER_IS_BETTER = ["FAcc", "Recall", "F1", "AUC", "delta1", "delta2", "delta3"]


def unpivot_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``keys, metric, value`` with non-finite values as null."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), finite(F.col(m)).alias("value")) for m in metrics])
    return df.select(*keys, F.inline(pairs))


def report_tree(long: DataFrame, sequence: str = "seq_id") -> DataFrame:
    """``head, dataset, metric, side, n, mean``: overall (side null) and, for ids that end in #left or #right, by side.

    Both levels come from one aggregation over grouping sets. Means skip nulls; a mean of nothing is null.
    """
    s = long.withColumn("side", side_suffix(F.col(sequence)))
    # A row without side would make a null group at the side level too; the grouping id tells the levels apart.
    both = s.groupingSets([["head", "dataset", "metric"], ["head", "dataset", "metric", "side"]], "head", "dataset", "metric", "side")
    agg = both.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.grouping("side").alias("_overall"))
    return agg.filter((F.col("_overall") == 1) | F.col("side").isNotNull()).drop("_overall")


def ratio(top: Column, low: Column) -> Column:
    """Sum over sum, null where the denominator is 0; never a mean of ratios."""
    return F.sum(top) / F.nullif(F.sum(low), F.lit(0))


def classification(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1 from additive counts."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": F.try_divide(2 * p * r, p + r)}


def rank_models(long: DataFrame, model: str, larger: list[str] | None = None) -> DataFrame:
    """``model, score, metrics, rank``: mean over the metrics of the min-max loss, missing values counting as worst.

    A metric needs two finite values that differ. A single model has score 0 over no metrics. Ties go to the lower name.
    """
    larger = LARGER_IS_BETTER if larger is None else larger
    signed = F.when(F.col("metric").isin(larger), -F.col("value")).otherwise(F.col("value"))
    v = long.filter(F.col("value").isNotNull()).select(model, "metric", signed.alias("v"))
    spans = v.groupBy("metric").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
    used = spans.filter((F.col("n") >= 2) & (F.col("hi") - F.col("lo") > F.greatest(F.lit(1e-12), 1e-12 * F.greatest(F.abs("hi"), F.abs("lo")))))
    total = used.agg(F.count(F.lit(1)).alias("metrics"))
    loss = v.join(F.broadcast(used), "metric").select(model, ((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("loss"))
    got = loss.groupBy(model).agg(F.sum("loss").alias("s"), F.count(F.lit(1)).alias("have"))
    all_models = long.select(model).distinct().join(got, model, "left").crossJoin(F.broadcast(total))
    missing = F.col("metrics") - F.coalesce("have", F.lit(0))
    score = F.when(F.col("metrics") > 0, (F.coalesce("s", F.lit(0.0)) + missing) / F.col("metrics")).otherwise(0.0)
    scored = all_models.select(model, score.alias("score"), "metrics")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("score", model)))  # one row for each model


def best_by_metric(long: DataFrame, model: str, larger: list[str] | None = None) -> DataFrame:
    """All models that share the best value of a metric."""
    larger = LARGER_IS_BETTER if larger is None else larger
    signed = F.when(F.col("metric").isin(larger), -F.col("value")).otherwise(F.col("value"))
    v = long.filter(F.col("value").isNotNull()).withColumn("_v", signed)
    best = v.groupBy("metric").agg(F.min("_v").alias("_v"))
    return v.join(F.broadcast(best), ["metric", "_v"]).select("metric", model, "value")
