"""Profiles, histograms, value counts and diversity of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.numbers import finite


#: Rows up to which exact quantiles are taken by one aggregation, which holds the distinct values of a group in a task.
ONE_PASS_ROWS = 5_000_000


def exact_quantiles(df: DataFrame, value: str, qs: list[float], by: list[str]) -> DataFrame:
    """``by, q``: exact quantiles with linear interpolation, nulls left out, without holding a group in one task.

    Each wanted rank is narrowed down twice: to a bucket of an order-preserving histogram, 64 for each doubling, and to
    one of 1024 equal parts of that bucket. Only the values of those parts are counted one by one.
    """
    v = F.col("_v")
    rows = df.select(*by, F.col(f"`{value}`").cast("double").alias("_v")).filter("_v IS NOT NULL")
    power = F.floor(F.log2(F.abs(v)) * 64).cast("int") + 200_000
    first = rows.withColumn("_b", F.when(v == 0, 0).when(v > 0, power).otherwise(-power))
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    place = [F.struct(F.lit(i).alias("_i"), F.lit(q).alias("_q")) for i, q in enumerate(qs)]
    wanted = n.withColumn("_w", F.explode(F.array(*place))).select(*by, "_w._i", ((F.col("_n") - 1) * F.col("_w._q")).alias("_pos"))
    ends = wanted.select(*by, "_i", F.explode(F.array(*[F.struct(f.alias("_rank"), (F.col("_pos") - F.floor("_pos")).alias("_share"), F.lit(e).alias("_end")) for e, f in ((0, F.floor("_pos")), (1, F.ceil("_pos")))])).alias("_e")).select(*by, "_i", "_e.*")

    def narrow(sizes: DataFrame, bucket: str, targets: DataFrame, within: list[str]) -> DataFrame:
        """The bucket of each target and its rank inside."""
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        spans = sizes.withColumn("_before", before)
        t, s = (lambda c: F.col(f"t.{c}")), (lambda c: F.col(f"s.{c}"))
        same = [t(c).eqNullSafe(s(c)) for c in within]
        hit = targets.alias("t").join(spans.alias("s"), [*same, t("_rank") >= s("_before"), t("_rank") < s("_before") + s("_c")])
        rest = [t(c) for c in targets.columns if c != "_rank"]
        more = [s(c) for c in spans.columns if c not in within and c not in ("_c", "_before")]
        return hit.select(*rest, *more, (t("_rank") - s("_before")).alias("_rank"))

    coarse = first.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    one = narrow(coarse, "_b", ends, by)
    chosen = one.select(*by, "_b", "_lo", "_hi").distinct()
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(1023), F.floor((v - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * 1024).cast("int"))).otherwise(0)
    f, c = first.alias("f"), F.broadcast(chosen).alias("c")  # two rows for each quantile of a group
    second = f.join(c, [F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*by, "_b"]]).select(*[F.col(f"f.{k}") for k in by], F.col("f._b"), F.col("f._v"), F.col("c._lo"), F.col("c._hi")).withColumn("_p", part)
    fine = second.groupBy(*by, "_b", "_p").agg(F.count(F.lit(1)).alias("_c"))
    two = narrow(fine, "_p", one.drop("_lo", "_hi"), [*by, "_b"])
    picked = F.broadcast(two.select(*by, "_b", "_p").distinct()).alias("c")
    values = second.alias("f").join(picked, [F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*by, "_b", "_p"]]).select("f.*").groupBy(*by, "_b", "_p", "_v").agg(F.count(F.lit(1)).alias("_c"))
    three = narrow(values, "_v", two, [*by, "_b", "_p"])
    both = three.groupBy(*by, "_i").agg(F.max(F.when(F.col("_end") == 0, F.col("_v"))).alias("_a"), F.max(F.when(F.col("_end") == 1, F.col("_v"))).alias("_z"), F.max("_share").alias("_share"))
    each = both.select(*by, F.struct("_i", (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_share")).alias("x")).alias("_x"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["x"]).alias("q"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null; the right side's other columns are added."""
    r = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    return left.join(r, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)], "left").drop(*[f"_r{i}" for i in range(len(keys))])


def numeric_profile(df: DataFrame, columns: list[str], digits: int = 6, by: list[str] | None = None) -> DataFrame:
    """``column, count, min, p25, median, p75, p90, p95, max, mean, total`` of each column, non-finite values left out.

    Quantiles are exact with linear interpolation. The columns are unpivoted first, so that all share one aggregation.
    """
    by = by or []
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), finite(F.col(c)).alias("v")) for c in columns])
    long = df.select(*by, F.inline(pairs))
    qs = [0.25, 0.5, 0.75, 0.9, 0.95]
    ranked = exact_quantiles(long, "v", qs, [*by, "column"]) if df.count() > ONE_PASS_ROWS else None
    q = F.percentile("v", F.array(*[F.lit(x) for x in qs])) if ranked is None else F.lit(None)
    agg = long.groupBy(*by, "column").agg(F.count("v").alias("count"), F.min("v").alias("min"), q.alias("q"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.sum("v").alias("total"))
    if ranked is not None:
        agg = join_null_safe(agg.drop("q"), ranked, [*by, "column"])
    named = [F.round(F.col("q")[i], digits).alias(n) for i, n in enumerate(("p25", "median", "p75", "p90", "p95"))]
    return agg.select(*by, "column", "count", F.round("min", digits).alias("min"), *named, F.round("max", digits).alias("max"), F.round("mean", digits).alias("mean"), F.round("total", 3).alias("total"))


def quantiles(df: DataFrame, column: str, qs: list[float], by: list[str]) -> DataFrame:
    v = finite(F.col(column))
    if df.count() > ONE_PASS_ROWS:
        p = join_null_safe(df.groupBy(*by).agg(F.count(v).alias("n")), exact_quantiles(df.withColumn("_x", v), "_x", qs, by), by)
    else:
        p = df.groupBy(*by).agg(F.count(v).alias("n"), F.percentile(v, F.array(*[F.lit(q) for q in qs])).alias("q"))
    return p.select(*by, "n", *[F.round(F.col("q")[i], 6).alias(f"p{round(q * 100)}") for i, q in enumerate(qs)])


def edge_labels(edges: list[float]) -> list[str]:
    text = [f"{e:g}" for e in edges]
    return [f"<{text[0]}", *[f"{a}-{b}" for a, b in zip(text, text[1:], strict=False)], f">={text[-1]}"]


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """``bucket, label, files, pct`` of all buckets, empty ones too. A value on an edge lies in the upper bucket; the
    percentages are of the non-null values."""
    spark = df.sparkSession
    v = finite(F.col(column))
    bucket = sum((F.when(v >= e, 1).otherwise(0) for e in edges), F.lit(0))
    counts = df.filter(v.isNotNull()).groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("files"))
    labels = spark.createDataFrame(list(enumerate(edge_labels(edges))), "bucket INT, label STRING")
    full = labels.join(counts, "bucket", "left").fillna(0, ["files"])
    total = F.sum("files").over(Window.partitionBy(F.lit(1)))  # over one row for each label
    return full.withColumn("pct", F.coalesce(F.round(F.try_divide(F.col("files") * 100.0, total), 4), F.lit(0.0)))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """``value, files, pct``; null and empty count as unknown; percentages are of all rows, also where ``top`` cuts."""
    value = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("unknown"))
    counts = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("files"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    out = counts.crossJoin(F.broadcast(total)).select("value", "files", F.round(F.col("files") * 100.0 / F.col("total"), 4).alias("pct"))
    return out.orderBy(F.desc("files"), "value").limit(top) if top else out


def entropy(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Shannon entropy in nats, its share of the largest possible, and exp of it; one category has 0 and 0."""
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    # -sum p ln p = ln N - (sum n ln n) / N, so that one pass over the counts is enough.
    agg = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("s"), F.count(F.lit(1)).alias("categories"))
    h = F.log("total") - F.col("s") / F.col("total")
    return agg.select(*by, "total", "categories", F.round(h, 6).alias("entropy"), F.round(F.when(F.col("categories") > 1, h / F.log("categories")).otherwise(0.0), 6).alias("normalised"), F.round(F.exp(h), 6).alias("effective"))


def token_frequency(df: DataFrame, text: str, top: int, stop: list[str], least: int = 3) -> DataFrame:
    """The ``top`` tokens of at least ``least`` letters that are no stop words; ties in alphabetical order."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)).alias("token")).filter((F.length("token") >= least) & ~F.col("token").isin(stop))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(top)


def masked_mean(v: Column, mask: Column) -> Column:
    m = mask.cast("double")
    return F.sum(v * m) / F.greatest(F.sum(m), F.lit(1.0))
