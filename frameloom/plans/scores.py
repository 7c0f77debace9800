"""Queries on benchmark scores, and on ordering, sampling and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions.numbers import finite, round_half_up_count
from frameloom.operators import profile, reports, sampling
from frameloom.plans import base
from frameloom.plans.base import NEWEST, newest
from frameloom.plans.registry import Registry
from frameloom.session import collect_small, table

R = Registry()
SC = base.sql("SCORES")
METRICS = ["ate", "rpe", "recall"]
LONG = f"SELECT head, dataset, seq_id, status, unnest(['ate', 'rpe', 'recall']) AS metric, unnest([ate::DOUBLE, rpe::DOUBLE, recall::DOUBLE]) AS value FROM {SC}"


def _scores(spark, d):
    return base.load(spark, d, "SCORES")


def _long(spark, d):
    return reports.unpivot_metrics(_scores(spark, d), ["head", "dataset", "seq_id", "status"], METRICS)


@R.add("a25_finite_mean", f"SELECT source, count(*) AS n, count(v) AS used, round(avg(v), 6) AS mean FROM (SELECT source, CASE WHEN isfinite(hand_presence_logits[1]) THEN hand_presence_logits[1]::DOUBLE END AS v FROM {NEWEST}) GROUP BY source")
def a25_finite_mean(spark, d):
    v = finite(F.get("hand_presence_logits", F.lit(0)))
    return newest(spark, d, "hand_presence_logits", "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("used"), F.round(F.avg(v), 6).alias("mean"))


@R.add("a26_report_tree", f"""WITH l AS (SELECT *, CASE WHEN contains(seq_id, '#') THEN split_part(seq_id, '#', 2) END AS side FROM ({LONG}))
SELECT head, dataset, metric, NULL AS side, count(value) AS n, round(avg(value), 6) AS mean FROM l GROUP BY ALL UNION ALL SELECT head, dataset, metric, side, count(value), round(avg(value), 6) FROM l WHERE side IS NOT NULL GROUP BY ALL""")
def a26_report_tree(spark, d):
    return reports.report_tree(_long(spark, d)).withColumn("mean", F.round("mean", 6))


@R.add("a27_status_counts", f"SELECT head, dataset, count(*) FILTER (WHERE status = 'evaluated') AS evaluated, count(*) FILTER (WHERE status = 'error') AS error, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM {SC} GROUP BY head, dataset")
def a27_status_counts(spark, d):
    return _scores(spark, d).groupBy("head", "dataset").pivot("status", ["evaluated", "error", "skipped"]).agg(F.count(F.lit(1))).fillna(0)


@R.add("a28_corpus_ratios", f"SELECT head, dataset, round(sum(ate * frames) / nullif(sum(frames), 0), 6) AS ate, round(sum(CASE WHEN recall > 0.3 THEN frames END)::DOUBLE / nullif(sum(frames), 0), 6) AS share FROM {SC} GROUP BY head, dataset")
def a28_corpus_ratios(spark, d):
    n = F.col("frames")
    return _scores(spark, d).groupBy("head", "dataset").agg(F.round(reports.ratio(F.col("ate") * n, n), 6).alias("ate"), F.round(reports.ratio(F.when(F.col("recall") > 0.3, n), n), 6).alias("share"))


PRESENCE = """SELECT p.source, p.hand_presence_logits[1] >= 0 OR p.hand_presence_logits[2] >= 0 AS pred, g.hand_valid AS gt
FROM (SELECT * FROM prediction QUALIFY row_number() OVER (PARTITION BY seq_id, frame ORDER BY ingested_at DESC) = 1) p JOIN (SELECT * FROM gtsequence QUALIFY row_number() OVER (PARTITION BY seq_id, frame ORDER BY ingested_at DESC) = 1) g ON g.seq_id = p.seq_id AND g.frame = p.frame
WHERE NOT isnan(p.hand_presence_logits[1]) AND NOT isnan(p.hand_presence_logits[2]) AND g.hand_valid IS NOT NULL"""


def _presence(spark, d):
    newest = lambda t, c: table(spark, d, t).groupBy("seq_id", "frame").agg(F.max_by(F.struct("source", c), "ingested_at").alias("m"))
    p = newest("prediction", "hand_presence_logits").select("seq_id", "frame", "m.source", F.col("m.hand_presence_logits").alias("l"))
    g = newest("gtsequence", "hand_valid").select("seq_id", "frame", F.col("m.hand_valid").alias("gt"))
    a, b = F.get("l", F.lit(0)), F.get("l", F.lit(1))
    return p.join(g, ["seq_id", "frame"]).filter(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & F.col("gt").isNotNull()).select("source", "seq_id", "frame", ((a >= 0) | (b >= 0)).alias("pred"), "gt")


@R.add("a29_precision_recall", f"""WITH c AS (SELECT source, count(*) FILTER (WHERE pred AND gt) AS tp, count(*) FILTER (WHERE pred AND NOT gt) AS fp, count(*) FILTER (WHERE NOT pred AND gt) AS fn FROM ({PRESENCE}) GROUP BY source)
SELECT source, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def a29_precision_recall(spark, d):
    p, g = F.col("pred"), F.col("gt")
    c = _presence(spark, d).groupBy("source").agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"))
    m = reports.classification(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("source", "tp", "fp", "fn", *[F.round(v, 6).alias(k) for k, v in m.items()])


@R.add("a30_coverage_counters", f"SELECT source, count(*) FILTER (WHERE gt) AS gt_frames, count(*) FILTER (WHERE gt AND pred) AS tp, count(*) FILTER (WHERE gt AND NOT pred) AS fn, count(*) FILTER (WHERE NOT gt AND pred) AS fp, round(avg(CASE WHEN gt THEN (gt = pred)::INT END), 6) AS frame_accuracy FROM ({PRESENCE}) GROUP BY source")
def a30_coverage_counters(spark, d):
    p, g = F.col("pred"), F.col("gt")
    return _presence(spark, d).groupBy("source").agg(F.count_if(g).alias("gt_frames"), F.count_if(g & p).alias("tp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & p).alias("fp"), F.round(F.avg(F.when(g, (g == p).cast("int"))), 6).alias("frame_accuracy"))


@R.add("g27_presence_errors", f"SELECT source, pred, count(*) AS n FROM ({PRESENCE}) WHERE pred <> gt GROUP BY source, pred")
def g27_presence_errors(spark, d):
    return _presence(spark, d).filter("pred <> gt").groupBy("source", "pred").agg(F.count(F.lit(1)).alias("n"))


@R.add("a48_presence_log", f"SELECT source, round(avg((pred = gt)::INT), 6) AS accuracy, round(avg(pred::INT), 6) AS positive_rate FROM ({PRESENCE}) GROUP BY source")
def a48_presence_log(spark, d):
    p, g = F.col("pred"), F.col("gt")
    return _presence(spark, d).groupBy("source").agg(F.round(F.avg((p == g).cast("int")), 6).alias("accuracy"), F.round(F.avg(p.cast("int")), 6).alias("positive_rate"))


@R.add("a31_sequence_equal", f"SELECT dataset, round(avg(ate), 6) AS ate_mean, round(median(ate), 6) AS ate_median, round(sum(frames) / sum(seconds), 6) AS fps, sum(frames)::BIGINT AS n_frames FROM {SC} WHERE status = 'evaluated' GROUP BY dataset")
def a31_sequence_equal(spark, d):
    s = _scores(spark, d).filter("status = 'evaluated'")
    return s.groupBy("dataset").agg(F.round(F.avg("ate"), 6).alias("ate_mean"), F.round(F.percentile("ate", F.lit(0.5)), 6).alias("ate_median"), F.round(F.sum("frames") / F.sum("seconds"), 6).alias("fps"), F.sum("frames").alias("n_frames"))


PAIR = "(SELECT l_suppkey % 20 AS k, l_quantity::DOUBLE AS g, l_extendedprice::DOUBLE / 2000 AS p FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0)"


def _pair(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity > 0 AND l_extendedprice > 0").select((F.col("l_suppkey") % 20).alias("k"), F.col("l_quantity").cast("double").alias("g"), (F.col("l_extendedprice") / 2000).alias("p"))


@R.add("a32_depth_errors", f"""SELECT k, round(avg(abs(p - g) / g), 6) AS abs_rel, round(avg((p - g) ** 2 / g), 5) AS sq_rel, round(sqrt(avg((p - g) ** 2)), 6) AS rmse, round(sqrt(avg((ln(p) - ln(g)) ** 2)), 6) AS rmse_log,
  round(avg((greatest(p / g, g / p) < 1.25)::INT), 6) AS delta1, round(avg((greatest(p / g, g / p) < 1.5625)::INT), 6) AS delta2, round(avg((greatest(p / g, g / p) < 1.953125)::INT), 6) AS delta3 FROM {PAIR} GROUP BY k""")
def a32_depth_errors(spark, d):
    from frameloom.operators.metrics import depth_errors

    return _pair(spark, d).groupBy("k").agg(*depth_errors(F.col("p"), F.col("g"), {"sq_rel": 5}))


@R.add("a33_median_scale", f"SELECT k, round(median(g) / median(p), 6) AS scale FROM {PAIR} GROUP BY k")
def a33_median_scale(spark, d):
    return _pair(spark, d).groupBy("k").agg(F.round(F.percentile("g", F.lit(0.5)) / F.percentile("p", F.lit(0.5)), 6).alias("scale"))


@R.add("a34_least_squares", f"SELECT k, round(regr_slope(g, p), 6) AS scale, round(regr_intercept(g, p), 5) AS shift FROM {PAIR} GROUP BY k")
def a34_least_squares(spark, d):
    return _pair(spark, d).groupBy("k").agg(F.round(F.regr_slope("g", "p"), 6).alias("scale"), F.round(F.regr_intercept("g", "p"), 5).alias("shift"))


@R.add("a35_robust_alignment", f"""WITH r AS (SELECT k, median(g / p) AS s, quantile_cont(g, 0.98) AS top FROM {PAIR} GROUP BY k), m AS (SELECT median(s) AS mid FROM r)
SELECT k, round(s, 6) AS scale, round(top, 6) AS p98, k = (SELECT arg_min(k, (abs(s - mid), k)) FROM r, m) AS representative FROM r""")
def a35_robust_alignment(spark, d):
    r = _pair(spark, d).groupBy("k").agg(F.percentile(F.col("g") / F.col("p"), F.lit(0.5)).alias("s"), F.percentile("g", F.lit(0.98)).alias("top"))
    mid = r.agg(F.percentile("s", F.lit(0.5)).alias("mid"))
    best = r.crossJoin(F.broadcast(mid)).agg(F.min_by("k", F.struct(F.abs(F.col("s") - F.col("mid")), F.col("k"))).alias("best"))
    return r.crossJoin(F.broadcast(best)).select("k", F.round("s", 6).alias("scale"), F.round("top", 6).alias("p98"), (F.col("k") == F.col("best")).alias("representative"))


@R.add("a44_masked_mean", "SELECT l_returnflag AS flag, round(sum(l_extendedprice * (l_tax > 0.04)::INT) / greatest(sum((l_tax > 0.04)::INT), 1), 4) AS v FROM lineitem GROUP BY 1")
def a44_masked_mean(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(profile.masked_mean(F.col("l_extendedprice"), F.col("l_tax") > 0.04), 4).alias("v"))


MODELS = "SELECT concat('model_', CAST(s_nationkey AS VARCHAR)) AS model, 'm' || CAST(s_suppkey % 4 AS VARCHAR) AS metric, round(avg(s_acctbal), 2) AS value FROM supplier GROUP BY ALL"


def _models(spark, d):
    return table(spark, d, "supplier").groupBy(F.concat(F.lit("model_"), F.col("s_nationkey").cast("string")).alias("model"), F.concat(F.lit("m"), (F.col("s_suppkey") % 4).cast("string")).alias("metric")).agg(F.round(F.avg("s_acctbal"), 2).alias("value"))


@R.add("a45_best_by_metric", f"SELECT metric, model, value FROM ({MODELS}) QUALIFY rank() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'm1' THEN -value ELSE value END) = 1")
def a45_best_by_metric(spark, d):
    return reports.best_by_metric(_models(spark, d), "model", ["m1"])


@R.add("a46_beats_reference", f"SELECT m.model, m.metric, round(m.value - r.v, 6) AS delta FROM ({MODELS}) m JOIN (VALUES ('m0', 4000.0), ('m1', 6000.0)) r(metric, v) ON r.metric = m.metric WHERE CASE WHEN m.metric = 'm1' THEN m.value > r.v ELSE m.value < r.v END")
def a46_beats_reference(spark, d):
    r = spark.createDataFrame([("m0", 4000.0), ("m1", 6000.0)], "metric STRING, v DOUBLE")
    better = F.when(F.col("metric") == "m1", F.col("value") > F.col("v")).otherwise(F.col("value") < F.col("v"))
    return _models(spark, d).join(F.broadcast(r), "metric").filter(better).select("model", "metric", F.round(F.col("value") - F.col("v"), 6).alias("delta"))


@R.add("o13_rank_models", f"""WITH v AS (SELECT model, metric, CASE WHEN metric = 'm1' THEN -value ELSE value END AS v FROM ({MODELS})), s AS (SELECT metric, min(v) AS lo, max(v) AS hi FROM v GROUP BY metric HAVING count(*) >= 2 AND max(v) > min(v)),
g AS (SELECT m.model, s.metric, coalesce((v - lo) / (hi - lo), 1.0) AS loss FROM (SELECT DISTINCT model FROM v) m CROSS JOIN s LEFT JOIN v ON v.model = m.model AND v.metric = s.metric)
SELECT model, round(avg(loss), 6) AS score, count(*) AS metrics, row_number() OVER (ORDER BY avg(loss), model) AS rank FROM g GROUP BY model""")
def o13_rank_models(spark, d):
    return reports.rank_models(_models(spark, d), "model", ["m1"]).withColumn("score", F.round("score", 6))


@R.add("a47_timing_roll_up", "SELECT l_linestatus AS dataset, stage, round(sum(v), 4) AS seconds FROM (SELECT l_linestatus, unnest(['predict', 'evaluate']) AS stage, unnest([l_quantity, l_tax * 10]) AS v FROM lineitem) GROUP BY ALL")
def a47_timing_roll_up(spark, d):
    m = F.create_map(F.lit("predict"), F.col("l_quantity"), F.lit("evaluate"), F.col("l_tax") * 10)
    return table(spark, d, "lineitem").select(F.col("l_linestatus").alias("dataset"), F.explode(m).alias("stage", "v")).groupBy("dataset", "stage").agg(F.round(F.sum("v"), 4).alias("seconds"))


@R.add("a49_dataset_sizes", "SELECT source, count(DISTINCT seq_id) AS n_seqs, count(*) AS n_frames FROM prediction GROUP BY source")
def a49_dataset_sizes(spark, d):
    return table(spark, d, "prediction").groupBy("source").agg(F.count_distinct("seq_id").alias("n_seqs"), F.count(F.lit(1)).alias("n_frames"))


# Sets

@R.add("x01_union_all", "SELECT c_nationkey AS k, 'c' AS who FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
def x01_union_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("who")).unionByName(table(spark, d, "supplier").select(F.lit("s").alias("who"), F.col("s_nationkey").alias("k")))


@R.add("x02_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def x02_union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@R.add("x03_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def x03_except(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@R.add("x04_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def x04_intersect(spark, d):
    return table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@R.add("x05_ordered_distinct", "SELECT episode_index, array_to_string(list_transform(list_filter(list_zip(tasks, range(0, len(tasks))), lambda x: list_position(tasks, x[1]) = x[2] + 1), lambda x: x[1]), '|') AS tasks FROM episodes WHERE tasks IS NOT NULL")
def x05_ordered_distinct(spark, d):
    return table(spark, d, "episodes").filter("tasks IS NOT NULL").select("episode_index", F.array_join(F.array_distinct("tasks"), "|").alias("tasks"))


@R.add("x06_distinct", "SELECT DISTINCT kind, episode_index FROM data_files")
def x06_distinct(spark, d):
    return table(spark, d, "data_files").select("kind", "episode_index").distinct()


@R.add("x07_merge_shards", f"SELECT head, count(*) AS n, round(avg(ate), 6) AS ate FROM (SELECT * FROM {SC} WHERE l_orderkey % 2 = 0 UNION ALL SELECT * FROM {SC} WHERE l_orderkey % 2 = 1) GROUP BY head")
def x07_merge_shards(spark, d):
    s = _scores(spark, d)
    return s.filter("l_orderkey % 2 = 0").unionByName(s.filter("l_orderkey % 2 = 1")).groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ate"), 6).alias("ate"))


# Ordering and sampling

@R.add("o04_diverse_sample", """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256(concat_ws(':', '42', o_custkey, o_orderkey)), o_orderkey) AS depth FROM orders)
SELECT o_custkey, o_orderkey FROM r ORDER BY depth, sha256(concat_ws(':', '42', o_custkey)), o_custkey LIMIT 500""")
def o04_diverse_sample(spark, d):
    return sampling.diverse_sample(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 500)


@R.add("o05_nested_tiers", """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256(concat_ws(':', '42', p_brand, p_partkey)), p_partkey) AS depth FROM part),
t AS (SELECT *, row_number() OVER (ORDER BY depth, sha256(concat_ws(':', '42', p_brand)), p_brand) AS place FROM r)
SELECT p_brand, p_partkey, CASE WHEN place <= 25 THEN 'min' WHEN place <= 100 THEN 'quarter' WHEN place <= 200 THEN 'half' ELSE 'full' END AS tier FROM t WHERE place <= 400""")
def o05_nested_tiers(spark, d):
    return sampling.nested_tiers(table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", {"min": 25, "quarter": 100, "half": 200, "full": 400})


@R.add("o06_hash_holdout", "SELECT user_id, event_id FROM events ORDER BY sha256(concat_ws(':', '42', user_id, event_id)), user_id, event_id LIMIT 437")
def o06_hash_holdout(spark, d):
    return sampling.holdout(table(spark, d, "events").select("user_id", "event_id"), ["user_id", "event_id"], 437)


@R.add("o07_retained_count", "SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN 0 ELSE least(n_nationkey * 3, greatest(1, floor(n_nationkey * 3 * 0.15 + 0.5)))::BIGINT END AS kept FROM nation")
def o07_retained_count(spark, d):
    return table(spark, d, "nation").select("n_nationkey", round_half_up_count(F.col("n_nationkey") * 3, F.lit(0.15)).alias("kept"))


@R.add("o09_seeded_subset", "SELECT c_custkey FROM customer ORDER BY sha256(concat_ws(':', '7', c_custkey)), c_custkey LIMIT (SELECT greatest(1, floor(count(*) * 0.1 + 0.5))::BIGINT FROM customer)")
def o09_seeded_subset(spark, d):
    return sampling.seeded_fraction(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 0.1, 7)


@R.add("o10_evenly_spaced", "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) WHERE i IN (SELECT floor(j * (n - 1) / 31.0)::BIGINT FROM range(0, 32) t(j))")
def o10_evenly_spaced(spark, d):
    return sampling.evenly_spaced(table(spark, d, "part").select("p_partkey"), "p_partkey", 32)


@R.add("o11_shard_balance")
def o11_shard_balance(spark, d):
    """Greedy longest-first: the costs of the groups (a few thousand at most) are balanced on the driver."""
    costs = table(spark, d, "prediction").groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    shards = sampling.balance_shards({r["seq_id"]: r["n"] for r in collect_small(costs)}, 4)
    return costs.join(F.broadcast(spark.createDataFrame(list(shards.items()), "seq_id STRING, shard INT")), "seq_id").groupBy("shard").agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("frames"))


@R.add("o14_centre_slice", "WITH n AS (SELECT seq_id, max(frame) + 1 AS n FROM prediction GROUP BY seq_id) SELECT DISTINCT p.seq_id, p.frame FROM prediction p JOIN n ON n.seq_id = p.seq_id WHERE frame >= (n - 100) // 2 AND frame < (n - 100) // 2 + 100 AND n >= 100")
def o14_centre_slice(spark, d):
    p = table(spark, d, "prediction").select("seq_id", "frame")
    n = p.groupBy("seq_id").agg((F.max("frame") + 1).alias("n")).filter("n >= 100")
    start = F.expr("(n - 100) div 2")
    return p.join(n, "seq_id").filter((F.col("frame") >= start) & (F.col("frame") < start + 100)).select("seq_id", "frame").distinct()


@R.add("o15_newest_first", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40")
def o15_newest_first(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(40).select("o_orderkey", "o_orderdate")


@R.add("o16_mixed_roots", "SELECT 'customer' AS root, count(*) AS n FROM (SELECT * FROM customer ORDER BY sha256(concat_ws(':', '42', c_custkey)), c_custkey LIMIT (SELECT floor(count(*) * 0.5 + 0.5)::BIGINT FROM customer)) UNION ALL SELECT 'supplier', count(*) FROM supplier")
def o16_mixed_roots(spark, d):
    c = sampling.seeded_fraction(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), ["id"], 0.5).withColumn("root", F.lit("customer"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("root"))).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
