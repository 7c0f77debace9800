"""Metric heads on predictions and truth: wrist paths in the world, and hands carried on from a sequence's first frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from frameloom.operators import alignment, metrics
from frameloom.operators.skew import salted_lookup
from frameloom.plans.base import NEWEST, newest
from frameloom.plans.registry import Registry
from frameloom.plans.scalars import GT, _joints

R = Registry()

#: The right wrist as predicted and as annotated, both taken to the world by the frame's camera.
PAIRS = f"""(SELECT p.seq_id, p.frame, p.source, {", ".join(f"e[{4 * i + 1}]::DOUBLE * h[110] + e[{4 * i + 2}]::DOUBLE * h[111] + e[{4 * i + 3}]::DOUBLE * h[112] + e[{4 * i + 4}] AS p{a}, e[{4 * i + 1}]::DOUBLE * j[1] + e[{4 * i + 2}]::DOUBLE * j[2] + e[{4 * i + 3}]::DOUBLE * j[3] + e[{4 * i + 4}] AS g{a}" for i, a in enumerate("xyz"))}
FROM (SELECT seq_id, frame, source, extrinsic_c2w AS e, hand AS h FROM {NEWEST} WHERE len(extrinsic_c2w) = 16 AND len(hand) = 218 AND len(list_filter(extrinsic_c2w, lambda v: NOT isfinite(v) OR abs(v) > 1000)) = 0
  AND len(list_filter(hand[110:112], lambda v: NOT isfinite(v) OR abs(v) > 20)) = 0 AND hand_presence_logits[2] >= 0 AND NOT isnan(hand_presence_logits[2])) p
JOIN (SELECT seq_id, frame, hand_joints_3d AS j FROM {GT} WHERE len(hand_joints_3d) = 63) g ON g.seq_id = p.seq_id AND g.frame = p.frame)"""


def pairs(spark, d):
    logit = F.get("hand_presence_logits", F.lit(1))
    small = lambda c, most: F.forall(c, lambda v: ~F.isnan(v) & (F.abs(v) <= most))
    p = newest(spark, d, "source", "extrinsic_c2w", "hand", "hand_presence_logits").filter((F.size("extrinsic_c2w") == 16) & (F.size("hand") == 218) & (logit >= 0) & ~F.isnan(logit))
    p = p.withColumn("h", F.slice("hand", 110, 3)).filter(small("extrinsic_c2w", 1000) & small("h", 20)).select("seq_id", "frame", "source", F.col("extrinsic_c2w").alias("e"), "h")
    both = p.join(_joints(spark, d).filter("size(j) = 63").select("seq_id", "frame", "j"), ["seq_id", "frame"])
    at = lambda c, i: F.get(c, F.lit(i)).cast("double")
    world = lambda c, i: sum((at("e", 4 * i + k) * at(c, k) for k in range(3)), F.lit(0.0)) + at("e", 4 * i + 3)
    return both.select("seq_id", "frame", "source", *[world(c, i).alias(f"{n}{a}") for i, a in enumerate("xyz") for n, c in (("p", "h"), ("g", "j"))])


def _trace(keys: str, source: str) -> str:
    """Sum ``tr`` of the signed singular values of each group's covariance in closed form: the largest from the largest
    eigenvalue of the symmetric square, the other two from its minors and determinant, which loses no digits."""
    cov = ", ".join(f"covar_pop(g{a}, p{b}) AS c{i}{k}" for i, a in enumerate("xyz") for k, b in enumerate("xyz"))
    pairs_ = ((0, 1), (0, 2), (1, 2))
    minors = " + ".join(f"(c{i}{m} * c{k}{n} - c{i}{n} * c{k}{m}) ** 2" for i, k in pairs_ for m, n in pairs_)
    square = ", ".join(f"c0{i} * c0{k} + c1{i} * c1{k} + c2{i} * c2{k} AS a{i}{k}" for i in range(3) for k in range(i, 3))
    return f"""m AS (SELECT {keys}, count(*) AS n, var_pop(px) + var_pop(py) + var_pop(pz) AS vp, var_pop(gx) + var_pop(gy) + var_pop(gz) AS vg, {cov} FROM {source} GROUP BY {keys}),
a AS (SELECT *, {square}, c00 * (c11 * c22 - c12 * c21) - c01 * (c10 * c22 - c12 * c20) + c02 * (c10 * c21 - c11 * c20) AS det FROM m),
q AS (SELECT *, (a00 + a11 + a22) / 3 AS q FROM a),
w AS (SELECT *, sqrt(((a00 - q) ** 2 + (a11 - q) ** 2 + (a22 - q) ** 2 + 2 * (a01 ** 2 + a02 ** 2 + a12 ** 2)) / 6) AS w FROM q),
r AS (SELECT *, acos(greatest(-1, least(1, CASE WHEN w > 0 THEN ((a00 - q) * ((a11 - q) * (a22 - q) - a12 ** 2) - a01 * (a01 * (a22 - q) - a12 * a02) + a02 * (a01 * a12 - (a11 - q) * a02)) / w ** 3 / 2 ELSE 1 END))) / 3 AS phi FROM w),
l AS (SELECT *, sqrt(greatest(q + 2 * w * cos(phi), 0)) AS d0, {minors} AS e2 FROM r),
f AS (SELECT *, CASE WHEN d0 > 0 THEN d0 + sqrt(greatest((e2 - (det / d0) ** 2) / d0 ** 2 + 2 * det / d0, 0)) ELSE 0 END AS tr FROM l)"""


STEPS = f"""steps AS (SELECT seq_id, sum(sqrt(dx ** 2 + dy ** 2 + dz ** 2)) AS path, avg(CASE WHEN gap = 1 THEN sqrt((ex - dx) ** 2 + (ey - dy) ** 2 + (ez - dz) ** 2) END) AS rpe FROM (
  SELECT seq_id, frame - lag(frame) OVER w AS gap, {", ".join(f"g{a} - lag(g{a}) OVER w AS d{a}, p{a} - lag(p{a}) OVER w AS e{a}" for a in "xyz")} FROM {PAIRS} WINDOW w AS (PARTITION BY seq_id ORDER BY frame)) GROUP BY seq_id)"""


@R.add("m01_umeyama", f"WITH {_trace('seq_id', PAIRS)} SELECT seq_id, n, round(CASE WHEN n >= 3 AND vp > 1e-9 THEN tr / vp END, 5) AS scale, round(CASE WHEN n >= 3 AND vp > 1e-9 THEN sqrt(greatest(vg - tr ** 2 / vp, 0)) * 1000 END, 2) AS ate_mm, n < 3 OR vp <= 1e-9 AS degenerate FROM f")
def m01_umeyama(spark, d):
    """Fit of each predicted wrist path onto the annotated one with scale; a still or too short path is degenerate."""
    bad = (F.col("n") < 3) | (F.col("vp") <= 1e-9)
    f = alignment.fits(alignment.moments(pairs(spark, d), ["seq_id"]))
    return f.select("seq_id", "n", F.round(F.when(~bad, F.col("scale")), 5).alias("scale"), F.round(F.when(~bad, alignment.rmse(True) * 1000), 2).alias("ate_mm"), bad.alias("degenerate"))


def _trajectory(spark, d):
    p = pairs(spark, d)
    w = Window.partitionBy("seq_id").orderBy("frame")
    ds = {f"{n}{a}": F.col(f"{s}{a}") - F.lag(f"{s}{a}").over(w) for a in "xyz" for n, s in (("d", "g"), ("e", "p"))}
    size = lambda f: F.sqrt(sum((F.pow(f(a), 2) for a in "xyz"), F.lit(0.0)))
    step = p.select("seq_id", (F.col("frame") - F.lag("frame").over(w)).alias("gap"), *[c.alias(n) for n, c in ds.items()])
    steps = step.groupBy("seq_id").agg(F.sum(size(lambda a: F.col(f"d{a}"))).alias("path"), F.avg(F.when(F.col("gap") == 1, size(lambda a: F.col(f"e{a}") - F.col(f"d{a}")))).alias("rpe"))
    f = alignment.fits(alignment.moments(p, ["seq_id"]), with_scale=False).filter((F.col("n") >= 3) & (F.col("vp") > 1e-9))
    ate = alignment.rmse(False)
    return f.join(steps, "seq_id").filter("path > 1e-6").select("seq_id", "n", F.col("path").alias("path_m"), (ate * 1000).alias("ate_mm"), (ate / F.col("path") * 100).alias("ate_pct"), (F.col("rpe") * 1000).alias("rpe_t_mm"))


TRAJECTORY = f"WITH {_trace('seq_id', PAIRS)}, {STEPS}, t AS (SELECT f.seq_id, n, path AS path_m, sqrt(greatest(vp + vg - 2 * tr, 0)) * 1000 AS ate_mm, sqrt(greatest(vp + vg - 2 * tr, 0)) / path * 100 AS ate_pct, rpe * 1000 AS rpe_t_mm FROM f JOIN steps ON steps.seq_id = f.seq_id WHERE n >= 3 AND vp > 1e-9 AND path > 1e-6)"
_ROUND = {"path_m": 4, "ate_mm": 2, "ate_pct": 3, "rpe_t_mm": 3}


@R.add("m02_trajectory", TRAJECTORY + " SELECT seq_id, n, " + ", ".join(f"round({c}, {k}) AS {c}" for c, k in _ROUND.items()) + " FROM t")
def m02_trajectory(spark, d):
    """Errors of each wrist path after a rigid fit: absolute, relative to the path, and from frame to frame."""
    return _trajectory(spark, d).select("seq_id", "n", *[F.round(c, k).alias(c) for c, k in _ROUND.items()])


@R.add("m03_extrinsics_head", TRAJECTORY + " " + " UNION ALL ".join(f"SELECT '{c}' AS metric, count({c}) AS n, round(avg({c}), 2) AS mean, round(quantile_cont({c}, 0.5), 2) AS median FROM t" for c in ("ate_mm", "ate_pct", "rpe_t_mm")))
def m03_extrinsics_head(spark, d):
    """Sequence-equal means and medians of the trajectory errors."""
    from frameloom.operators.reports import unpivot_metrics

    long = unpivot_metrics(_trajectory(spark, d), ["seq_id"], ["ate_mm", "ate_pct", "rpe_t_mm"])
    return long.groupBy("metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 2).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 2).alias("median"))


def world_chunk(p: np.ndarray, g: np.ndarray) -> dict[str, float]:
    """Errors in mm of a chunk's path: aligned by its first two points, as a whole, and its end relative to its length;
    mean difference of the accelerations."""
    fit = lambda n, scale: metrics.umeyama(p[:n], g[:n], with_scale=scale)
    error = lambda s, r, t: np.linalg.norm(s * p @ r.T + t - g, axis=1)
    path = float(np.linalg.norm(np.diff(g, axis=0), axis=1).sum())
    first, whole = error(*fit(2, False)), error(*fit(len(p), True))
    accel = np.linalg.norm(np.diff(p, 2, axis=0) - np.diff(g, 2, axis=0), axis=1).mean()
    return {"w_mpjpe_mm": first.mean() * 1000, "wa_mpjpe_mm": whole.mean() * 1000, "rte_pct": first[-1] / path * 100 if path > 1e-9 else np.nan, "accel_mm": accel * 1000}


@R.add("m07_world_hands")
def m07_world_hands(spark, d):
    """Per chunk of 100 frames, which bounds every group whatever the length of a sequence."""
    names = ["w_mpjpe_mm", "wa_mpjpe_mm", "rte_pct", "accel_mm"]

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("frame")
        if len(df) < 5:
            return pd.DataFrame(columns=["seq_id", "chunk", "frames", *names])
        p, g = (df[[f"{s}{a}" for a in "xyz"]].to_numpy() for s in ("p", "g"))
        return pd.DataFrame([{"seq_id": df["seq_id"].iloc[0], "chunk": df["chunk"].iloc[0], "frames": len(df), **world_chunk(p, g)}])

    chunks = pairs(spark, d).withColumn("chunk", F.floor(F.col("frame") / 100))
    return chunks.groupBy("seq_id", "chunk").applyInPandas(one, "seq_id STRING, chunk BIGINT, frames BIGINT, " + ", ".join(f"{n} DOUBLE" for n in names))


_FINE_HAND = "len(hand) = 218 AND len(list_filter(hand[110:118], lambda v: NOT isfinite(v) OR abs(v) > 20)) = 0 AND hand_presence_logits[2] >= 0 AND NOT isnan(hand_presence_logits[2])"
#: The right hand's 21 joints as predicted: the first annotated hand of a sequence, turned and moved as the prediction
#: turns and moves since that frame; and as annotated.
HANDS = f"""(SELECT c.seq_id, c.frame, c.source, list_transform(range(0, 63), lambda k: t[k % 3 + 1] + list_sum(list_transform(range(0, 3), lambda m: list_sum(list_transform(range(1, 4), lambda i: r[3 * (k % 3) + i] * r0[3 * m + i])) * x0[3 * (k // 3) + m + 1]))) AS p, j AS g
FROM (SELECT q.seq_id, q.frame, q.source, j, list_transform(hand[110:112], lambda v: v::DOUBLE) AS t, {{turn}} AS r FROM (SELECT seq_id, frame, source, hand FROM {NEWEST} WHERE {_FINE_HAND}) q JOIN (SELECT seq_id, frame, list_transform(hand_joints_3d, lambda v: v::DOUBLE) AS j FROM {GT} WHERE len(hand_joints_3d) = 63) y ON y.seq_id = q.seq_id AND y.frame = q.frame) c
JOIN (SELECT q.seq_id, arg_min({{turn}}, q.frame) AS r0, arg_min(list_transform(j, lambda v, k: v - j[(k - 1) % 3 + 1]), q.frame) AS x0 FROM (SELECT seq_id, frame, hand FROM {NEWEST} WHERE {_FINE_HAND}) q JOIN (SELECT seq_id, frame, list_transform(hand_joints_3d, lambda v: v::DOUBLE) AS j FROM {GT} WHERE len(hand_joints_3d) = 63) y ON y.seq_id = q.seq_id AND y.frame = q.frame GROUP BY q.seq_id) o ON o.seq_id = c.seq_id)"""
_H = [f"hand[{i}]::DOUBLE" for i in range(113, 119)]
HANDS = HANDS.replace("{turn}", f"[{', '.join(_H)}, {_H[1]} * {_H[5]} - {_H[2]} * {_H[4]}, {_H[2]} * {_H[3]} - {_H[0]} * {_H[5]}, {_H[0]} * {_H[4]} - {_H[1]} * {_H[3]}]")


def hands(spark, d):
    logit = F.get("hand_presence_logits", F.lit(1))
    q = newest(spark, d, "source", "hand", "hand_presence_logits").filter((F.size("hand") == 218) & (logit >= 0) & ~F.isnan(logit)).withColumn("h", F.transform(F.slice("hand", 110, 9), lambda v: v.cast("double")))
    q = q.filter(F.forall("h", lambda v: ~F.isnan(v) & (F.abs(v) <= 20)))
    h = lambda i: F.get("h", F.lit(i))
    turn = F.array(*[h(i) for i in range(3, 9)], h(4) * h(8) - h(5) * h(7), h(5) * h(6) - h(3) * h(8), h(3) * h(7) - h(4) * h(6))
    y = _joints(spark, d).filter("size(j) = 63").select("seq_id", "frame", F.transform("j", lambda v: v.cast("double")).alias("j"))
    both = q.select("seq_id", "frame", "source", F.slice("h", 1, 3).alias("t"), turn.alias("r")).join(y, ["seq_id", "frame"])
    around = F.transform("j", lambda v, k: v - F.get("j", F.pmod(k, F.lit(3))))
    first = both.groupBy("seq_id").agg(F.min_by(F.struct(F.col("r").alias("r0"), around.alias("x0")), "frame").alias("o")).select("seq_id", "o.*")
    since = salted_lookup(both, first, ["seq_id"], ["frame"])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    three = F.sequence(F.lit(0), F.lit(2))
    turned = lambda k, m: total(F.transform(three, lambda i: F.get("r", 3 * F.pmod(k, F.lit(3)) + i) * F.get("r0", 3 * m + i)))
    joint = lambda k: F.get("t", F.pmod(k, F.lit(3))) + total(F.transform(three, lambda m: turned(k, m) * F.get("x0", k - F.pmod(k, F.lit(3)) + m)))
    return since.select("seq_id", "frame", "source", F.transform(F.sequence(F.lit(0), F.lit(62)), joint).alias("p"), F.col("j").alias("g"))


def _rel(sql: bool):
    if sql:
        k = [f"((p[3*i+{c}]::DOUBLE - p[{c}]) - (g[3*i+{c}]::DOUBLE - g[{c}])) ** 2" for c in (1, 2, 3)]
        return f"list_sum(list_transform(range(0, 21), lambda i: sqrt({' + '.join(k)}))) / 21"
    at = lambda a, i, k: F.get(a, 3 * i + k).cast("double") - F.get(a, F.lit(k)).cast("double")
    err = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.sqrt(sum((F.pow(at(F.col("p"), i, k) - at(F.col("g"), i, k), 2) for k in range(3)), F.lit(0.0))))
    return F.aggregate(err, F.lit(0.0), lambda s, x: s + x) / 21


@R.add("m06_mpjpe", f"SELECT source, count(*) AS n, round(avg({_rel(True)}), 6) AS mpjpe FROM {HANDS} GROUP BY source")
def m06_mpjpe(spark, d):
    """Root-relative joint error, in array expressions."""
    return hands(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(_rel(False)), 6).alias("mpjpe"))


def _by_hand(df, fn, schema: str):
    """Columns of a kernel on hands ``p, g`` added to their rows, batch by batch."""

    def run(batches):
        for b in batches:
            if len(b):
                yield pd.concat([b[["seq_id", "frame", "source"]].reset_index(drop=True), fn(b["p"], b["g"])], axis=1)

    return df.mapInPandas(run, "seq_id STRING, frame BIGINT, source STRING, " + schema)


FITTED = "rel DOUBLE, aligned DOUBLE, rigid DOUBLE, scale DOUBLE"


def fit_hands(p: pd.Series, g: pd.Series) -> pd.DataFrame:
    """Errors of hands as they are around the wrist, and after a fit of each with and without scale; the scale."""
    a, b = (np.stack(v.to_numpy()).astype(float).reshape(-1, 21, 3) for v in (p, g))
    rel, aligned = metrics.joint_errors(a, b)
    ca, cb = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    u, dd, vt = np.linalg.svd(cb.transpose(0, 2, 1) @ ca)
    sign = np.ones((len(a), 3))
    sign[:, 2] = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)
    r = (u * sign[:, None]) @ vt
    spread = (ca**2).sum((1, 2))
    scale = (dd * sign).sum(1) / np.where(spread > 0, spread, 1)
    rigid = np.linalg.norm(ca @ r.transpose(0, 2, 1) - cb, axis=2).mean(1)
    return pd.DataFrame({"rel": rel, "aligned": aligned, "rigid": rigid, "scale": scale})


@R.add("m06_pa_mpjpe", f"SELECT source, count(*) AS n, round(avg({_rel(True)}), 6) AS mpjpe, true AS aligned_is_less FROM {HANDS} GROUP BY source")
def m06_pa_mpjpe(spark, d):
    """The same error beside the one after a fit of each frame, which is less in the mean."""
    e = _by_hand(hands(spark, d), fit_hands, FITTED)
    return e.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rel"), 6).alias("mpjpe"), (F.avg("aligned") <= F.avg("rel") + 1e-9).alias("aligned_is_less"))


@R.add("g37_procrustes", f"SELECT seq_id, frame, round({_rel(True)}, 5) AS rel, true AS fits FROM {HANDS}")
def g37_procrustes(spark, d):
    """Fit of each frame's hand by itself; ``fits`` says that its squared error is no more than the root-relative one's bound."""
    e = _by_hand(hands(spark, d), fit_hands, FITTED)
    return e.select("seq_id", "frame", F.round("rel", 5).alias("rel"), ((F.col("aligned") <= 2 * F.col("rel") + 1e-9) & (F.col("scale") > 0)).alias("fits"))


@R.add("m10_alignments")
def m10_alignments(spark, d):
    """Per frame: errors of hands as they are, by the first two joints, and by a fit of the whole hand, in mm."""

    def errors(p: pd.Series, g: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(p, g, strict=True):
            x, y = (np.asarray(v, float).reshape(21, 3) for v in (a, b))
            two, all_ = metrics.umeyama(x[:2], y[:2], with_scale=False), metrics.umeyama(x, y)
            moved = [x, *[s * x @ r.T + t for s, r, t in (two, all_)]]
            rows.append([float(np.linalg.norm(m - y, axis=1).mean() * 1000) for m in moved])
        return pd.DataFrame(rows, columns=["none", "first_two", "whole"])

    return _by_hand(hands(spark, d), errors, "none DOUBLE, first_two DOUBLE, whole DOUBLE").drop("source")


@R.add("m08_coverage_pose", f"""WITH g AS (SELECT source, seq_id, frame FROM {GT}), p AS (SELECT seq_id, frame, hand_presence_logits[2] >= 0 AS there FROM {NEWEST} WHERE NOT isnan(hand_presence_logits[2])),
e AS (SELECT seq_id, frame, sqrt((px - gx) ** 2 + (py - gy) ** 2 + (pz - gz) ** 2) AS error FROM {PAIRS})
SELECT source, count(*) AS gt_frames, count(*) FILTER (WHERE there) AS hit, count(*) FILTER (WHERE there IS NOT TRUE) AS missed, round(avg(CASE WHEN there IS NOT TRUE THEN 0.5 ELSE least(error, 0.5) END), 6) AS penalised
FROM g LEFT JOIN p ON p.seq_id = g.seq_id AND p.frame = g.frame LEFT JOIN e ON e.seq_id = g.seq_id AND e.frame = g.frame GROUP BY source""")
def m08_coverage_pose(spark, d):
    """A truth frame without a predicted hand counts as missed, and in the pose error with the penalty of half a metre."""
    logit = F.get("hand_presence_logits", F.lit(1))
    p = newest(spark, d, "hand_presence_logits").filter(logit.isNotNull() & ~F.isnan(logit)).select("seq_id", "frame", (logit >= 0).alias("there"))
    e = pairs(spark, d).select("seq_id", "frame", F.sqrt(sum((F.pow(F.col(f"p{a}") - F.col(f"g{a}"), 2) for a in "xyz"), F.lit(0.0))).alias("error"))
    j = _joints(spark, d).drop("j").join(p, ["seq_id", "frame"], "left").join(e, ["seq_id", "frame"], "left")
    hit = F.coalesce("there", F.lit(False))
    penalised = F.when(~hit, 0.5).when(F.col("error").isNotNull(), F.least("error", F.lit(0.5))).otherwise(0.5)
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("gt_frames"), F.count_if(hit).alias("hit"), F.count_if(~hit).alias("missed"), F.round(F.avg(penalised), 6).alias("penalised"))


RUNS = f"(SELECT *, frame - row_number() OVER (PARTITION BY seq_id ORDER BY frame) AS run FROM {PAIRS})"


@R.add("g36_root_translation_error", f"""WITH {_trace('seq_id, run', RUNS)},
s AS (SELECT seq_id, run, min(frame) AS first, sum(sqrt(dx ** 2 + dy ** 2 + dz ** 2)) AS path FROM (SELECT seq_id, run, frame, {", ".join(f"g{a} - lag(g{a}) OVER (PARTITION BY seq_id, run ORDER BY frame) AS d{a}" for a in "xyz")} FROM {RUNS}) GROUP BY seq_id, run)
SELECT f.seq_id, first, n, round(sqrt(greatest(vp + vg - 2 * tr, 0)) / path * 100, 3) AS rte_pct FROM f JOIN s ON s.seq_id = f.seq_id AND s.run = f.run WHERE n >= 5 AND path > 1e-3 AND vp > 1e-9""")
def g36_root_translation_error(spark, d):
    """Root mean squared error of the wrist after a rigid fit of each run without a gap, relative to the run's path."""
    w = Window.partitionBy("seq_id").orderBy("frame")
    p = pairs(spark, d).withColumn("run", F.col("frame") - F.row_number().over(w))
    by = Window.partitionBy("seq_id", "run").orderBy("frame")
    step = F.sqrt(sum((F.pow(F.col(f"g{a}") - F.lag(f"g{a}").over(by), 2) for a in "xyz"), F.lit(0.0)))
    path = p.select("seq_id", "run", "frame", step.alias("step")).groupBy("seq_id", "run").agg(F.min("frame").alias("first"), F.sum("step").alias("path"))
    f = alignment.fits(alignment.moments(p, ["seq_id", "run"]), with_scale=False).join(path, ["seq_id", "run"])
    return f.filter("n >= 5 AND path > 1e-3 AND vp > 1e-9").select("seq_id", "first", "n", F.round(alignment.rmse(False) / F.col("path") * 100, 3).alias("rte_pct"))


@R.add("m11_camera_terms", f"""WITH e AS (SELECT seq_id, source, frame, extrinsic_c2w AS e FROM {NEWEST} WHERE len(extrinsic_c2w) = 16 AND len(list_filter(extrinsic_c2w, lambda v: NOT isfinite(v) OR abs(v) > 1000)) = 0),
s AS (SELECT source, {", ".join(f"e[{k}]::DOUBLE - lag(e[{k}]) OVER w AS t{k}" for k in (4, 8, 12))}, {" + ".join(f"e[{k}]::DOUBLE * lag(e[{k}]) OVER w" for k in (1, 2, 3, 5, 6, 7, 9, 10, 11))} AS tr FROM e WINDOW w AS (PARTITION BY seq_id ORDER BY frame))
SELECT source, count(tr) AS n, round(avg(abs(t4) + abs(t8) + abs(t12)), 6) AS translation_l1, round(avg(CASE WHEN tr IS NOT NULL THEN degrees(acos(greatest(-1, least(1, (tr - 1) / 2)))) END), 3) AS rotation_deg FROM s GROUP BY source""")
def m11_camera_terms(spark, d):
    """Camera loss terms as metrics from frame to frame: L1 of the translation, angle of the rotation."""
    fine = (F.size("extrinsic_c2w") == 16) & F.forall("extrinsic_c2w", lambda v: ~F.isnan(v) & (F.abs(v) <= 1000))
    w = Window.partitionBy("seq_id").orderBy("frame")
    e = newest(spark, d, "source", "extrinsic_c2w").filter(fine).withColumn("b", F.lag("extrinsic_c2w").over(w))
    at = lambda c, i: F.get(c, F.lit(i)).cast("double")
    move = sum((F.abs(at("extrinsic_c2w", i) - at("b", i)) for i in (3, 7, 11)), F.lit(0.0))
    trace = sum((at("extrinsic_c2w", i) * at("b", i) for i in (0, 1, 2, 4, 5, 6, 8, 9, 10)), F.lit(0.0))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))
    return e.groupBy("source").agg(F.count("b").alias("n"), F.round(F.avg(F.when(F.col("b").isNotNull(), move)), 6).alias("translation_l1"), F.round(F.avg(F.when(F.col("b").isNotNull(), angle)), 3).alias("rotation_deg"))
