"""Queries on frame sequences: clips, runs, motion, outliers, moments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frameloom.operators import sequences as seq
from frameloom.plans import base
from frameloom.plans.registry import Registry
from frameloom.session import table

R = Registry()
FR = base.sql("FRAMES")
POS = ["x", "y", "z"]


def _frames(spark, d):
    return base.load(spark, d, "FRAMES")


@R.add("w01_tumbling_clips", """WITH e AS (SELECT episode_index, length, 30 AS fps FROM episodes),
c AS (SELECT episode_index, length, unnest(range(0, greatest(0, ceil((length - 450) / 420.0))::BIGINT + 1)) AS clip_idx FROM e WHERE length > 0)
SELECT episode_index, clip_idx, clip_idx * 420 AS start, least(clip_idx * 420 + 450, length) AS stop FROM c""")
def w01_tumbling_clips(spark, d):
    return seq.tumbling_clips(table(spark, d, "episodes").withColumn("fps", F.lit(30.0)), ["episode_index"], "fps", "length", 15, 1)


@R.add("f14_short_tail", """WITH c AS (SELECT episode_index, length, unnest(range(0, greatest(0, ceil((length - 300) / 300.0))::BIGINT + 1)) AS clip_idx FROM episodes WHERE length > 0),
b AS (SELECT episode_index, clip_idx, clip_idx * 300 AS start, least(clip_idx * 300 + 300, length) AS stop, count(*) OVER (PARTITION BY episode_index) AS n FROM c)
SELECT episode_index, clip_idx, start, stop FROM b WHERE n = 1 OR clip_idx < n - 1 OR stop - start >= 90""")
def f14_short_tail(spark, d):
    return seq.tumbling_clips(table(spark, d, "episodes").withColumn("fps", F.lit(30.0)), ["episode_index"], "fps", "length", 10, 0, 3.0)


@R.add("w03_training_clips", "SELECT episode_index, start, start + 32 AS stop FROM (SELECT episode_index, unnest(range(0, length - 31, 32)) AS start FROM episodes WHERE length >= 32)")
def w03_training_clips(spark, d):
    return seq.training_clips(table(spark, d, "episodes"), ["episode_index"], "length", 32, 32)


@R.add("w04_covering_windows", """WITH s AS (SELECT episode_index, length, unnest(range(0, ceil(greatest(0, length - 64) / 56.0)::BIGINT + 1)) AS i FROM episodes WHERE length > 0)
SELECT DISTINCT episode_index, least(i * 56, greatest(0, length - 64)) AS start, least(least(i * 56, greatest(0, length - 64)) + 64, length) AS stop FROM s""")
def w04_covering_windows(spark, d):
    return seq.covering_windows(table(spark, d, "episodes"), ["episode_index"], "length", 64, 8)


@R.add("w05_keep_segments", f"""WITH s AS (SELECT seq_id, frame, coalesce(NOT left_on AND NOT right_on, true) AS cut FROM {FR}),
i AS (SELECT *, frame - row_number() OVER (PARTITION BY seq_id, cut ORDER BY frame) AS isle FROM s),
r AS (SELECT seq_id, min(frame) AS a, max(frame) + 1 AS b FROM i WHERE cut GROUP BY seq_id, isle HAVING count(*) >= 10),
e AS (SELECT * FROM r UNION ALL SELECT seq_id, max(frame) + 1, max(frame) + 1 FROM s GROUP BY seq_id),
k AS (SELECT seq_id, coalesce(lag(b) OVER (PARTITION BY seq_id ORDER BY a, b), 0) / 30.0 AS start, a / 30.0 AS stop FROM e)
SELECT seq_id, round(start, 6) AS start, round(stop, 6) AS stop FROM k WHERE stop - start >= 1 AND stop > start""")
def w05_keep_segments(spark, d):
    cut = F.coalesce(~F.col("left_on") & ~F.col("right_on"), F.lit(True))
    kept = seq.keep_segments(_frames(spark, d), ["seq_id"], "frame", cut, 30.0, 10 / 30 + 1e-9, 1.0)
    return kept.select("seq_id", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"))


@R.add("f07_hand_cut_mask", f"SELECT seq_id, frame, (coalesce(left_on, false)::INT + coalesce(right_on, false)::INT = 0) AS cut FROM {FR}")
def f07_hand_cut_mask(spark, d):
    on = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    left, right = on("left_on"), on("right_on")
    return _frames(spark, d).select("seq_id", "frame", ((left + right == 0) | (left + right > 2) | ~((left <= 1) & (right <= 1) & (left + right >= 1))).alias("cut"))


@R.add("w06_contiguous_slices", f"SELECT seq_id, min(frame) AS first, max(frame) AS last, count(*) AS n FROM (SELECT seq_id, frame, frame - row_number() OVER (PARTITION BY seq_id ORDER BY frame) AS isle FROM {FR}) GROUP BY seq_id, isle")
def w06_contiguous_slices(spark, d):
    return seq.islands(_frames(spark, d).select("seq_id", "frame"), ["seq_id"], "frame")


@R.add("w07_true_runs", f"SELECT seq_id, min(frame) AS first, max(frame) AS last, count(*) AS n FROM (SELECT seq_id, frame, frame - row_number() OVER (PARTITION BY seq_id ORDER BY frame) AS isle FROM {FR} WHERE left_on) GROUP BY seq_id, isle HAVING count(*) >= 3")
def w07_true_runs(spark, d):
    return seq.islands(_frames(spark, d).filter("left_on").select("seq_id", "frame"), ["seq_id"], "frame").filter("n >= 3")


@R.add("w08_run_chunks", f"""WITH r AS (SELECT seq_id, frame, frame - row_number() OVER (PARTITION BY seq_id ORDER BY frame) AS isle FROM {FR} WHERE right_on),
k AS (SELECT seq_id, frame, isle, (row_number() OVER (PARTITION BY seq_id, isle ORDER BY frame) - 1) // 100 AS chunk FROM r)
SELECT seq_id, min(frame) AS first, max(frame) AS last, chunk::BIGINT AS chunk FROM k GROUP BY seq_id, isle, chunk""")
def w08_run_chunks(spark, d):
    runs = seq.islands(_frames(spark, d).filter("right_on").select("seq_id", "frame"), ["seq_id"], "frame")
    cut = runs.select("seq_id", "first", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 100))).alias("chunk"))
    return cut.select("seq_id", (F.col("first") + F.col("chunk") * 100).alias("first"), F.least(F.col("first") + F.col("chunk") * 100 + 99, F.col("last")).alias("last"), "chunk")


STEPS = f"""SELECT *, frame - lag(frame) OVER w AS gap, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) / (frame - lag(frame) OVER w) AS speed FROM {FR} WINDOW w AS (PARTITION BY seq_id ORDER BY frame)"""


@R.add("w09_speed", f"SELECT seq_id, frame, gap, round(speed, 6) AS speed FROM ({STEPS})")
def w09_speed(spark, d):
    return seq.steps(_frames(spark, d), ["seq_id"], "frame", POS).select("seq_id", "frame", "gap", F.round("speed", 6).alias("speed"))


@R.add("w10_second_difference", f"SELECT seq_id, frame, round(lead(x) OVER w - 2 * x + lag(x) OVER w, 6) AS ax FROM {FR} WINDOW w AS (PARTITION BY seq_id ORDER BY frame)")
def w10_second_difference(spark, d):
    w = Window.partitionBy("seq_id").orderBy("frame")
    return _frames(spark, d).select("seq_id", "frame", F.round(seq.second_difference("x", w), 6).alias("ax"))


ISLE = f"SELECT *, frame - row_number() OVER (PARTITION BY seq_id ORDER BY frame) AS isle FROM {FR}"


@R.add("w11_jitter", f"""WITH j AS (SELECT seq_id, sqrt((lead(x) OVER w - 2 * x + lag(x) OVER w) ** 2 + (lead(y) OVER w - 2 * y + lag(y) OVER w) ** 2 + (lead(z) OVER w - 2 * z + lag(z) OVER w) ** 2) AS j FROM ({ISLE}) WINDOW w AS (PARTITION BY seq_id, isle ORDER BY frame))
SELECT seq_id, count(j) AS n, round(avg(j), 6) AS jitter FROM j GROUP BY seq_id""")
def w11_jitter(spark, d):
    f = _frames(spark, d).withColumn("isle", F.col("frame") - F.row_number().over(Window.partitionBy("seq_id").orderBy("frame")))
    w = Window.partitionBy("seq_id", "isle").orderBy("frame")
    j = F.sqrt(sum((F.pow(seq.second_difference(c, w), 2) for c in POS), F.lit(0.0)))
    return f.select("seq_id", j.alias("j")).groupBy("seq_id").agg(F.count("j").alias("n"), F.round(F.avg("j"), 6).alias("jitter"))


LIMITS = f"""SELECT s.seq_id, any_value(n) AS n, any_value(med) AS med, median(abs(speed - med)) AS mad, greatest(0.05, any_value(med) + 3 * 1.4826 * median(abs(speed - med))) AS lim
FROM ({STEPS}) s JOIN (SELECT seq_id, median(speed) AS med, count(speed) AS n FROM ({STEPS}) GROUP BY seq_id) m ON m.seq_id = s.seq_id WHERE speed IS NOT NULL GROUP BY s.seq_id"""


@R.add("w12_hampel_limits", f"SELECT seq_id, n, round(med, 6) AS med, round(mad, 6) AS mad, round(lim, 6) AS \"limit\" FROM ({LIMITS})")
def w12_hampel_limits(spark, d):
    s = seq.steps(_frames(spark, d), ["seq_id"], "frame", POS).filter("speed IS NOT NULL")
    return seq.robust_limits(s, ["seq_id"], "speed", 3.0, 0.05).select("seq_id", "n", *[F.round(c, 6).alias(c) for c in ("med", "mad", "limit")])


@R.add("w13_hampel_spikes", f"""WITH b AS (SELECT s.*, coalesce(speed > lim AND n + 1 >= 5, false) AS big FROM ({STEPS}) s LEFT JOIN ({LIMITS}) l ON l.seq_id = s.seq_id),
m AS (SELECT seq_id, frame, big, lag(frame) OVER w IS NULL AS is_first, lead(big) OVER w AS nxt, lead(big, 2) OVER w AS nxt2, lag(big) OVER w AS prev FROM b WINDOW w AS (PARTITION BY seq_id ORDER BY frame))
SELECT seq_id, frame FROM m WHERE CASE WHEN is_first THEN nxt AND NOT coalesce(nxt2, false) WHEN nxt IS NULL THEN big AND NOT coalesce(prev, false) ELSE big AND nxt END""")
def w13_hampel_spikes(spark, d):
    return seq.hampel(_frames(spark, d), ["seq_id"], "frame", POS, 3.0, 0.05).filter("spike").select("seq_id", "frame")


@R.add("w14_hampel_filter", f"""WITH b AS (SELECT s.*, coalesce(speed > lim AND n + 1 >= 5, false) AS big FROM ({STEPS}) s LEFT JOIN ({LIMITS}) l ON l.seq_id = s.seq_id),
m AS (SELECT seq_id, frame, big, lag(frame) OVER w IS NULL AS is_first, lead(big) OVER w AS nxt, lead(big, 2) OVER w AS nxt2, lag(big) OVER w AS prev FROM b WINDOW w AS (PARTITION BY seq_id ORDER BY frame))
SELECT seq_id, count(*) AS frames, count(*) FILTER (WHERE CASE WHEN is_first THEN nxt AND NOT coalesce(nxt2, false) WHEN nxt IS NULL THEN big AND NOT coalesce(prev, false) ELSE big AND nxt END) AS removed FROM m GROUP BY seq_id""")
def w14_hampel_filter(spark, d):
    return seq.hampel(_frames(spark, d), ["seq_id"], "frame", POS, 3.0, 0.05).groupBy("seq_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if("spike").alias("removed"))


@R.add("w16_gap_fill", f"""WITH n AS (SELECT seq_id, frame, x, y, z, lead(frame) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM {FR} WINDOW w AS (PARTITION BY seq_id ORDER BY frame)),
g AS (SELECT *, unnest(range(frame, CASE WHEN nf - frame - 1 BETWEEN 1 AND 30 THEN nf ELSE frame + 1 END)) AS p FROM n)
SELECT seq_id, p AS frame, round(CASE WHEN p = frame THEN x ELSE x + (nx - x) * (p - frame) / (nf - frame) END, 6) AS x, round(CASE WHEN p = frame THEN y ELSE y + (ny - y) * (p - frame) / (nf - frame) END, 6) AS y,
  round(CASE WHEN p = frame THEN z ELSE z + (nz - z) * (p - frame) / (nf - frame) END, 6) AS z, p <> frame AS filled FROM g""")
def w16_gap_fill(spark, d):
    return seq.fill_gaps(_frames(spark, d), ["seq_id"], "frame", POS, 30).select("seq_id", "frame", *[F.round(c, 6).alias(c) for c in POS], "filled")


@R.add("w17_gap_list", f"SELECT seq_id, frame + 1 AS gap_start, nxt AS gap_stop FROM (SELECT seq_id, frame, lead(frame) OVER (PARTITION BY seq_id ORDER BY frame) AS nxt FROM {FR}) WHERE nxt - frame > 1")
def w17_gap_list(spark, d):
    nxt = F.lead("frame").over(Window.partitionBy("seq_id").orderBy("frame"))
    return _frames(spark, d).select("seq_id", "frame", nxt.alias("gap_stop")).filter("gap_stop - frame > 1").select("seq_id", (F.col("frame") + 1).alias("gap_start"), "gap_stop")


@R.add("w19_noise_scale", f"""WITH s AS (SELECT seq_id, lead(x) OVER w - 2 * x + lag(x) OVER w AS a FROM {FR} WINDOW w AS (PARTITION BY seq_id ORDER BY frame)),
m AS (SELECT seq_id, median(a) AS med FROM s GROUP BY seq_id)
SELECT s.seq_id, round(greatest(1e-6, 1.4826 * median(abs(a - med)) / sqrt(6)), 9) AS scale FROM s JOIN m ON m.seq_id = s.seq_id WHERE a IS NOT NULL GROUP BY s.seq_id""")
def w19_noise_scale(spark, d):
    w = Window.partitionBy("seq_id").orderBy("frame")
    s = _frames(spark, d).select("seq_id", seq.second_difference("x", w).alias("a")).filter("a IS NOT NULL")
    mad = seq.robust_limits(s, ["seq_id"], "a", 0.0, 0.0)
    return mad.select("seq_id", F.round(F.greatest(F.lit(1e-6), 1.4826 * F.col("mad") / F.sqrt(F.lit(6.0))), 9).alias("scale"))


@R.add("w20_speed_weight", f"""WITH s AS (SELECT seq_id, frame, speed, row_number() OVER w AS i, count(*) OVER (PARTITION BY seq_id) AS n, first_value(speed) OVER w AS f, last_value(speed) OVER (PARTITION BY seq_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM ({STEPS}) WHERE speed IS NOT NULL WINDOW w AS (PARTITION BY seq_id ORDER BY frame)),
a AS (SELECT seq_id, frame, speed, (coalesce(lag(speed, 2) OVER w, f) + coalesce(lag(speed) OVER w, f) + speed + coalesce(lead(speed) OVER w, l) + coalesce(lead(speed, 2) OVER w, l)) / 5 AS m FROM s WINDOW w AS (PARTITION BY seq_id ORDER BY frame)),
q AS (SELECT seq_id, median(m) AS med FROM a GROUP BY seq_id)
SELECT a.seq_id, frame, round(m, 6) AS smooth, round(CASE WHEN med > 0 THEN m / med END, 4) AS weight FROM a JOIN q ON q.seq_id = a.seq_id""")
def w20_speed_weight(spark, d):
    s = seq.steps(_frames(spark, d), ["seq_id"], "frame", POS).filter("speed IS NOT NULL")
    w = Window.partitionBy("seq_id").orderBy("frame")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("speed").over(whole), F.last("speed").over(whole)
    at = lambda k: F.coalesce(F.lag("speed", -k).over(w), last) if k > 0 else F.coalesce(F.lag("speed", -k).over(w), first)
    smooth = s.select("seq_id", "frame", ((at(-2) + at(-1) + F.col("speed") + at(1) + at(2)) / 5).alias("m"))
    med = smooth.groupBy("seq_id").agg(F.percentile("m", F.lit(0.5)).alias("med"))
    return smooth.join(med, "seq_id").select("seq_id", "frame", F.round("m", 6).alias("smooth"), F.round(F.when(F.col("med") > 0, F.col("m") / F.col("med")), 4).alias("weight"))


QUAT = f"SELECT seq_id, frame, sin(frame * 0.9) AS qx, cos(frame * 0.9) * CASE WHEN frame % 5 = 0 THEN -1 ELSE 1 END AS qw FROM {FR}"


@R.add("w23_sign_continuity", f"""WITH q AS (SELECT *, CASE WHEN qx * lag(qx) OVER w + qw * lag(qw) OVER w < 0 THEN 1 ELSE 0 END AS neg FROM ({QUAT}) WINDOW w AS (PARTITION BY seq_id ORDER BY frame))
SELECT seq_id, frame, CASE WHEN sum(neg) OVER (PARTITION BY seq_id ORDER BY frame ROWS UNBOUNDED PRECEDING) % 2 = 1 THEN -1 ELSE 1 END AS sign FROM q""")
def w23_sign_continuity(spark, d):
    w = Window.partitionBy("seq_id").orderBy("frame")
    q = _frames(spark, d).select("seq_id", "frame", F.sin(F.col("frame") * 0.9).alias("qx"), (F.cos(F.col("frame") * 0.9) * F.when(F.col("frame") % 5 == 0, -1).otherwise(1)).alias("qw"))
    neg = F.when(F.col("qx") * F.lag("qx").over(w) + F.col("qw") * F.lag("qw").over(w) < 0, 1).otherwise(0)
    flips = F.sum("neg").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return q.withColumn("neg", neg).select("seq_id", "frame", F.when(flips % 2 == 1, -1).otherwise(1).alias("sign"))


@R.add("w24_rebase_position", f"""SELECT seq_id, frame, frame // 32 AS clip, round(x - first_value(x) OVER w, 6) AS dx, round(y - first_value(y) OVER w, 6) AS dy, round(z - first_value(z) OVER w, 6) AS dz FROM {FR} WINDOW w AS (PARTITION BY seq_id, frame // 32 ORDER BY frame)""")
def w24_rebase_position(spark, d):
    f = _frames(spark, d).withColumn("clip", F.floor(F.col("frame") / 32))
    w = Window.partitionBy("seq_id", "clip").orderBy("frame")
    return f.select("seq_id", "frame", "clip", *[F.round(F.col(c) - F.first(c).over(w), 6).alias(f"d{c}") for c in POS])


@R.add("w25_clip_moments", f"""WITH c AS (SELECT source, x - first_value(x) OVER w AS p, x - lag(x) OVER w AS v, x - 2 * lag(x) OVER w + lag(x, 2) OVER w AS a FROM {FR} WINDOW w AS (PARTITION BY seq_id, frame // 32 ORDER BY frame))
SELECT source, count(p) AS n_position, count(v) AS n_velocity, count(a) AS n_acceleration, round(stddev_pop(p), 6) AS position, round(stddev_pop(v), 6) AS velocity, round(stddev_pop(a), 6) AS acceleration FROM c GROUP BY source""")
def w25_clip_moments(spark, d):
    f = _frames(spark, d).withColumn("clip", F.floor(F.col("frame") / 32))
    w = Window.partitionBy("seq_id", "clip").orderBy("frame")
    lag1, lag2 = F.lag("x").over(w), F.lag("x", 2).over(w)
    c = f.select("source", (F.col("x") - F.first("x").over(w)).alias("p"), (F.col("x") - lag1).alias("v"), (F.col("x") - 2 * lag1 + lag2).alias("a"))
    return c.groupBy("source").agg(*[F.count(k).alias(f"n_{n}") for k, n in (("p", "position"), ("v", "velocity"), ("a", "acceleration"))], *[F.round(F.stddev_pop(k), 6).alias(n) for k, n in (("p", "position"), ("v", "velocity"), ("a", "acceleration"))])


@R.add("w27_overlap_blend", f"""WITH w AS (SELECT seq_id, unnest(range(0, max(frame) // 24 + 1)) * 24 AS s FROM {FR} GROUP BY seq_id),
j AS (SELECT f.seq_id, f.frame, f.x + (s % 7) * 0.01 AS v, least(f.frame - s + 1, s + 32 - f.frame, 9) AS wt FROM {FR} f JOIN w ON w.seq_id = f.seq_id AND f.frame >= s AND f.frame < s + 32)
SELECT seq_id, frame, round(sum(v * wt) / sum(wt), 6) AS blended FROM j GROUP BY seq_id, frame""")
def w27_overlap_blend(spark, d):
    """A frame lies in at most two windows of 32 frames that begin every 24: it names them itself, without a join."""
    f = _frames(spark, d).filter("frame >= 0")
    last = F.floor(F.col("frame") / 24)
    starts = F.filter(F.array(last * 24, (last - 1) * 24), lambda s: (s >= 0) & (F.col("frame") < s + 32))
    e = f.select("seq_id", "frame", "x", F.explode(starts).alias("s"))
    v, wt = F.col("x") + (F.col("s") % 7) * 0.01, F.least(F.col("frame") - F.col("s") + 1, F.col("s") + 32 - F.col("frame"), F.lit(9))
    return e.groupBy("seq_id", "frame").agg(F.round(F.sum(v * wt) / F.sum(wt), 6).alias("blended"))


@R.add("w28_first_per_episode", f"SELECT seq_id, min(frame) AS frame, round(arg_min(x, frame), 6) AS x FROM {FR} GROUP BY seq_id")
def w28_first_per_episode(spark, d):
    return _frames(spark, d).groupBy("seq_id").agg(F.min("frame").alias("frame"), F.round(F.min_by("x", "frame"), 6).alias("x"))


@R.add("w29_counter_rate", """WITH c AS (SELECT user_id, event_id, ts, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) % 500 AS counter FROM events)
SELECT user_id, event_id, round(greatest(0, counter - lag(counter) OVER w) / (date_diff('microsecond', lag(ts) OVER w, ts) / 1e6), 6) AS rate FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def w29_counter_rate(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    c = table(spark, d, "events").select("user_id", "event_id", "ts", (F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)) % 500).alias("counter"))
    dt = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) / 1e6
    return c.select("user_id", "event_id", F.round(F.greatest(F.lit(0.0), F.col("counter") - F.lag("counter").over(w)) / dt, 6).alias("rate"))


@R.add("w31_decimation", f"""WITH n AS (SELECT seq_id, frame, row_number() OVER (PARTITION BY seq_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY seq_id) AS n FROM {FR})
SELECT seq_id, frame FROM n WHERE i % greatest(1, pow(2, ceil(log2(n / 60.0))))::BIGINT = 0""")
def w31_decimation(spark, d):
    w = Window.partitionBy("seq_id")
    k = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / 60.0)))).cast("long")
    f = _frames(spark, d).select("seq_id", "frame", (F.row_number().over(w.orderBy("frame")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    return f.filter(F.col("i") % k == 0).select("seq_id", "frame")


@R.add("w32_carry_tail", """WITH t AS (SELECT event_type, event_id, ts, value, max(ts) OVER (PARTITION BY event_type) AS last FROM events)
SELECT event_type, event_id, round(date_diff('microsecond', last, ts) / 1e6, 6) AS t, value FROM t WHERE date_diff('microsecond', ts, last) <= 7200000000 UNION ALL SELECT event_type, NULL, 0, NULL FROM events GROUP BY event_type""")
def w32_carry_tail(spark, d):
    """The last two hours of each series, shifted to end at 0, closed by a row without value that breaks the line."""
    e = table(spark, d, "events")
    last = e.groupBy("event_type").agg(F.max("ts").alias("last"))
    back = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("last"))
    tail = e.join(last, "event_type").filter(back <= 7_200_000_000).select("event_type", "event_id", F.round(-back / 1e6, 6).alias("t"), "value")
    return tail.unionByName(last.select("event_type", F.lit(None).cast("long").alias("event_id"), F.lit(0.0).alias("t"), F.lit(None).cast("double").alias("value")))


@R.add("w33_stride_keep_last", f"SELECT seq_id, frame FROM (SELECT seq_id, frame, row_number() OVER (PARTITION BY seq_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY seq_id) AS n FROM {FR}) WHERE i % 30 = 0 OR i = n - 1")
def w33_stride_keep_last(spark, d):
    w = Window.partitionBy("seq_id")
    f = _frames(spark, d).select("seq_id", "frame", (F.row_number().over(w.orderBy("frame")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    return f.filter((F.col("i") % 30 == 0) | (F.col("i") == F.col("n") - 1)).select("seq_id", "frame")


@R.add("w34_windowed_metric", f"SELECT seq_id, frame, round(CASE WHEN count(*) OVER w >= 3 THEN avg(x) OVER w END, 6) AS metric FROM {FR} WINDOW w AS (PARTITION BY seq_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def w34_windowed_metric(spark, d):
    w = Window.partitionBy("seq_id").orderBy("frame").rowsBetween(-2, 0)
    return _frames(spark, d).select("seq_id", "frame", F.round(F.when(F.count(F.lit(1)).over(w) >= 3, F.avg("x").over(w)), 6).alias("metric"))


@R.add("w35_clip_starts", "SELECT episode_index, unnest(CASE WHEN length >= 600 THEN range(0, length - 599, 600) ELSE [0] END)::BIGINT AS start FROM episodes WHERE length > 0")
def w35_clip_starts(spark, d):
    starts = F.when(F.col("length") >= 600, F.expr("sequence(0L, length - 600, 600L)")).otherwise(F.array(F.lit(0).cast("long")))
    return table(spark, d, "episodes").filter("length > 0").select("episode_index", F.explode(starts).alias("start"))


@R.add("w36_overlap_check", """WITH s AS (SELECT DISTINCT lower(trim(source)) AS source, source_dataset_index AS i, source_frame_start AS a, source_frame_stop AS b FROM sample_manifest WHERE source IS NOT NULL AND source_dataset_index IS NOT NULL AND source_frame_stop > source_frame_start),
n AS (SELECT *, lead(a) OVER (PARTITION BY source, i ORDER BY a, b) AS nxt FROM s) SELECT source, count(*) AS overlaps FROM n WHERE nxt < b GROUP BY source""")
def w36_overlap_check(spark, d):
    keys = ["source", "source_dataset_index"]
    m = table(spark, d, "sample_manifest").withColumn("source", F.lower(F.trim("source"))).filter("source IS NOT NULL AND source_dataset_index IS NOT NULL AND source_frame_stop > source_frame_start")
    s = m.select(*keys, "source_frame_start", "source_frame_stop").distinct()
    w = Window.partitionBy(*keys).orderBy("source_frame_start", "source_frame_stop")
    return s.withColumn("nxt", F.lead("source_frame_start").over(w)).filter("nxt < source_frame_stop").groupBy("source").agg(F.count(F.lit(1)).alias("overlaps"))


@R.add("w39_acceleration_trimmed", f"""WITH i AS ({ISLE}), a AS (SELECT seq_id, isle, x, row_number() OVER w AS rn, count(*) OVER (PARTITION BY seq_id, isle) AS n, (lead(x) OVER w - 2 * x + lag(x) OVER w) * 900 AS acc FROM i WINDOW w AS (PARTITION BY seq_id, isle ORDER BY frame))
SELECT seq_id, count(*) AS n, round(avg(abs(acc)), 6) AS acceleration FROM a WHERE n >= 5 AND rn > 1 AND rn < n GROUP BY seq_id""")
def w39_acceleration_trimmed(spark, d):
    f = _frames(spark, d).withColumn("isle", F.col("frame") - F.row_number().over(Window.partitionBy("seq_id").orderBy("frame")))
    run = Window.partitionBy("seq_id", "isle")
    w = run.orderBy("frame")
    a = f.select("seq_id", F.row_number().over(w).alias("rn"), F.count(F.lit(1)).over(run).alias("n"), (seq.second_difference("x", w) * 900).alias("acc"))
    return a.filter("n >= 5 AND rn > 1 AND rn < n").groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs("acc")), 6).alias("acceleration"))


@R.add("a16_motion_stats", f"""WITH b AS (SELECT seq_id, count(*) AS n, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) AS span, arg_min(x, frame) AS x0, arg_min(y, frame) AS y0, arg_min(z, frame) AS z0, arg_max(x, frame) AS x1, arg_max(y, frame) AS y1, arg_max(z, frame) AS z1 FROM {FR} GROUP BY seq_id HAVING count(*) >= 2),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY seq_id) AS n FROM {FR}) WHERE i % 30 = 0 OR i = n - 1),
s AS (SELECT seq_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS step FROM k WINDOW w AS (PARTITION BY seq_id ORDER BY frame)),
p AS (SELECT seq_id, sum(step) AS path FROM s GROUP BY seq_id)
SELECT b.seq_id, n, round(span, 6) AS span, round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2 + (z1 - z0) ** 2), 6) AS net, round(path, 6) AS path, round(n / 30.0, 6) AS duration FROM b JOIN p ON p.seq_id = b.seq_id""")
def a16_motion_stats(spark, d):
    f = _frames(spark, d)
    ends = [F.min_by(F.struct(*POS), "frame").alias("a"), F.max_by(F.struct(*POS), "frame").alias("b")]
    base_ = f.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.sqrt(sum((F.pow(F.max(c) - F.min(c), 2) for c in POS), F.lit(0.0))).alias("span"), *ends).filter("n >= 2")
    w = Window.partitionBy("seq_id")
    sampled = f.select("seq_id", "frame", *POS, (F.row_number().over(w.orderBy("frame")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n")).filter("i % 30 = 0 OR i = n - 1")
    step = F.sqrt(sum((F.pow(F.col(c) - F.lag(c).over(w.orderBy("frame")), 2) for c in POS), F.lit(0.0)))
    path = sampled.select("seq_id", step.alias("step")).groupBy("seq_id").agg(F.sum("step").alias("path"))
    net = F.sqrt(sum((F.pow(F.col(f"b.{c}") - F.col(f"a.{c}"), 2) for c in POS), F.lit(0.0)))
    return base_.join(path, "seq_id").select("seq_id", "n", F.round("span", 6).alias("span"), F.round(net, 6).alias("net"), F.round("path", 6).alias("path"), F.round(F.col("n") / 30.0, 6).alias("duration"))


@R.add("a17_hand_usage", f"SELECT source, count(*) FILTER (WHERE left_on AND right_on) AS \"both\", count(*) FILTER (WHERE left_on AND NOT right_on) AS only_left, count(*) FILTER (WHERE right_on AND NOT left_on) AS only_right, count(*) FILTER (WHERE NOT left_on AND NOT right_on) AS none FROM {FR} GROUP BY source")
def a17_hand_usage(spark, d):
    left, right = F.col("left_on"), F.col("right_on")
    return _frames(spark, d).groupBy("source").agg(F.count_if(left & right).alias("both"), F.count_if(left & ~right).alias("only_left"), F.count_if(right & ~left).alias("only_right"), F.count_if(~left & ~right).alias("none"))


@R.add("a18_activity_bins", f"""WITH b AS (SELECT seq_id, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) AS span FROM {FR} GROUP BY seq_id)
SELECT CASE WHEN span < 0.15 THEN 'still' WHEN span < 0.5 THEN 'small' WHEN span < 1.5 THEN 'medium' ELSE 'large' END AS activity, count(*) AS episodes FROM b GROUP BY 1""")
def a18_activity_bins(spark, d):
    span = F.sqrt(sum((F.pow(F.max(c) - F.min(c), 2) for c in POS), F.lit(0.0)))
    b = _frames(spark, d).groupBy("seq_id").agg(span.alias("span"))
    label = F.when(F.col("span") < 0.15, "still").when(F.col("span") < 0.5, "small").when(F.col("span") < 1.5, "medium").otherwise("large")
    return b.groupBy(label.alias("activity")).agg(F.count(F.lit(1)).alias("episodes"))


@R.add("a20_moments", f"SELECT source, count(x) AS n, round(avg(x), 6) AS mean_x, round(stddev_pop(x), 6) AS std_x, round(greatest(stddev_pop(y), 0.01), 6) AS std_y FROM {FR} GROUP BY source")
def a20_moments(spark, d):
    return _frames(spark, d).groupBy("source").agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean_x"), F.round(F.stddev_pop("x"), 6).alias("std_x"), F.round(F.greatest(F.stddev_pop("y"), F.lit(0.01)), 6).alias("std_y"))


@R.add("a21_partial_moments", f"""WITH p AS (SELECT source, seq_id, count(x) AS n, avg(x) AS mean, var_pop(x) * count(x) AS m2 FROM {FR} GROUP BY source, seq_id), t AS (SELECT source, sum(n) AS n, sum(n * mean) / sum(n) AS mean FROM p GROUP BY source)
SELECT p.source, any_value(t.n)::BIGINT AS n, round(any_value(t.mean), 6) AS mean, round(sqrt(sum(m2 + p.n * (p.mean - t.mean) ** 2) / any_value(t.n)), 6) AS std FROM p JOIN t ON t.source = p.source GROUP BY p.source""")
def a21_partial_moments(spark, d):
    from frameloom.operators.moments import merge_moments, partial_moments

    merged = merge_moments(partial_moments(_frames(spark, d), ["source", "seq_id"], "x"), ["source"])
    return merged.select("source", "n", F.round("mean", 6).alias("mean"), F.round(F.sqrt(F.col("m2") / F.col("n")), 6).alias("std"))


@R.add("a23_weighted_merge", f"""WITH p AS (SELECT source, count(x) * f AS n, avg(x) AS mean, var_pop(x) * count(x) * f AS m2 FROM {FR} JOIN (VALUES ('kitchen_cap', 0.5), ('lab_glove', 0.25), ('rig_legacy', 1.0)) w(s, f) ON w.s = source GROUP BY source, f)
SELECT round(sum(n), 6) AS n, round(sum(n * mean) / sum(n), 6) AS mean, round(sqrt((sum(m2) + sum(n * mean ** 2) - sum(n * mean) ** 2 / sum(n)) / sum(n)), 6) AS std FROM p""")
def a23_weighted_merge(spark, d):
    from frameloom.operators.moments import merge_moments, partial_moments, scale_moments

    p = partial_moments(_frames(spark, d), ["source"], "x")
    kept = spark.createDataFrame([("kitchen_cap", 0.5), ("lab_glove", 0.25), ("rig_legacy", 1.0)], "source STRING, fraction DOUBLE")
    m = merge_moments(scale_moments(p.join(F.broadcast(kept), "source"), "fraction"), [])
    return m.select(F.round("n", 6).alias("n"), F.round("mean", 6).alias("mean"), F.round(F.sqrt(F.col("m2") / F.col("n")), 6).alias("std"))


@R.add("a41_average_speed", f"SELECT seq_id, count(*) AS pairs, round(avg(speed), 6) AS speed, round(sum(speed * gap), 6) AS path FROM ({STEPS}) WHERE gap = 1 GROUP BY seq_id")
def a41_average_speed(spark, d):
    s = seq.steps(_frames(spark, d), ["seq_id"], "frame", POS).filter("gap = 1")
    return s.groupBy("seq_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("speed"), 6).alias("speed"), F.round(F.sum(F.col("speed") * F.col("gap")), 6).alias("path"))


@R.add("s24_stride_frames", f"SELECT seq_id, frame, row_number() OVER (PARTITION BY seq_id ORDER BY frame) - 1 AS n FROM {FR} WHERE frame % 5 = 0")
def s24_stride_frames(spark, d):
    return _frames(spark, d).filter("frame % 5 = 0").select("seq_id", "frame", (F.row_number().over(Window.partitionBy("seq_id").orderBy("frame")) - 1).cast("long").alias("n"))


@R.add("g12_clip_slice", f"""WITH s AS (SELECT seq_id, frame FROM {FR} WHERE frame BETWEEN 40 AND 139 AND (frame - 40) % 4 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY frame) - 1 AS i FROM s)
SELECT seq_id, frame, i FROM n WHERE frame = 40 + i * 4""")
def g12_clip_slice(spark, d):
    """Every fourth frame of a clip, renumbered, up to the first one that is missing."""
    s = _frames(spark, d).filter("frame BETWEEN 40 AND 139 AND (frame - 40) % 4 = 0").select("seq_id", "frame")
    n = s.withColumn("i", (F.row_number().over(Window.partitionBy("seq_id").orderBy("frame")) - 1).cast("long"))
    return n.filter("frame = 40 + i * 4")


@R.add("g31_scaled_trajectory", f"SELECT seq_id, frame, round((x - cx) / s, 4) AS nx FROM (SELECT seq_id, frame, x, avg(x) OVER w AS cx, sqrt(var_pop(x) OVER w + var_pop(y) OVER w + var_pop(z) OVER w) AS s FROM {FR} WINDOW w AS (PARTITION BY seq_id)) WHERE s > 1e-6")
def g31_scaled_trajectory(spark, d):
    w = Window.partitionBy("seq_id")
    f = _frames(spark, d).select("seq_id", "frame", "x", F.avg("x").over(w).alias("cx"), F.sqrt(sum((F.var_pop(c).over(w) for c in POS), F.lit(0.0))).alias("s"))
    return f.filter("s > 1e-6").select("seq_id", "frame", F.round((F.col("x") - F.col("cx")) / F.col("s"), 4).alias("nx"))


@R.add("j06_point_in_interval", """WITH i AS (SELECT user_id, event_id, ts AS a, ts + INTERVAL 2 HOUR AS b FROM events WHERE event_type = 'signup')
SELECT e.user_id, e.event_id, i.event_id AS task_id FROM events e JOIN i ON i.user_id = e.user_id AND e.ts BETWEEN i.a AND i.b WHERE e.event_type = 'view'""")
def j06_point_in_interval(spark, d):
    e = table(spark, d, "events").withColumn("t", F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), F.col("ts")))
    tasks = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("task_id"), F.col("t").alias("a"), (F.col("t") + 7_200_000_000).alias("b"))
    return seq.interval_join(e.filter("event_type = 'view'").select("user_id", "event_id", "t"), tasks, ["user_id"], "t", "a", "b", 7.2e9).select("user_id", "event_id", "task_id")


@R.add("a40_interval_stats", """WITH i AS (SELECT user_id, event_id, ts AS a, ts + INTERVAL 2 HOUR AS b FROM events WHERE event_type = 'signup')
SELECT i.event_id AS task_id, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max, round(avg(CASE WHEN value < 5 THEN 1.0 ELSE 0 END) * 100, 6) AS idle_pct FROM events e JOIN i ON i.user_id = e.user_id AND e.ts BETWEEN i.a AND i.b WHERE e.event_type <> 'signup' GROUP BY i.event_id""")
def a40_interval_stats(spark, d):
    e = table(spark, d, "events").withColumn("t", F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), F.col("ts")))
    tasks = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("task_id"), F.col("t").alias("a"), (F.col("t") + 7_200_000_000).alias("b"))
    j = seq.interval_join(e.filter("event_type <> 'signup'").select("user_id", "value", "t"), tasks, ["user_id"], "t", "a", "b", 7.2e9)
    return j.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max"), F.round(F.avg(F.when(F.col("value") < 5, 1.0).otherwise(0.0)) * 100, 6).alias("idle_pct"))


@R.add("j07_nearest_time", """WITH r AS (SELECT user_id, event_id AS near_id, ts AS rts FROM events WHERE event_type = 'click')
SELECT e.user_id, e.event_id, near_id, abs(date_diff('microsecond', rts, ts)) AS gap FROM events e LEFT JOIN r ON r.user_id = e.user_id WHERE e.event_type = 'error' QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY abs(date_diff('microsecond', rts, ts)), rts) = 1""")
def j07_nearest_time(spark, d):
    e = table(spark, d, "events").withColumn("t", F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), F.col("ts")))
    right = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("near_id"), "t")
    left = e.filter("event_type = 'error'").select("user_id", "event_id", "t")
    return seq.nearest_join(left, right, ["user_id"], "t", ["near_id"]).select("user_id", "event_id", "near_id", "gap")


@R.add("j16_prediction_truth", "SELECT source, count(*) AS pairs FROM (SELECT DISTINCT p.source, p.seq_id, p.frame FROM prediction p JOIN gtsequence g ON g.seq_id = p.seq_id AND g.frame = p.frame) GROUP BY source")
def j16_prediction_truth(spark, d):
    keys = ["seq_id", "frame"]
    p, g = table(spark, d, "prediction").select("source", *keys).distinct(), table(spark, d, "gtsequence").select(*keys).distinct()
    return p.join(g, keys, "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("pairs"))
