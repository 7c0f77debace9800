"""Further queries: fingerprints, totals, heads, grids, conversions and control tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from frameloom.functions import arrays, numbers
from frameloom.operators import metrics, profile, registry, reports, sequences
from frameloom.plans import base
from frameloom.plans.base import newest
from frameloom.plans.registry import Registry
from frameloom.plans.scalars import GT, NEWEST, POSE, _joints, _poses
from frameloom.session import collect_small, table
from frameloom.sinks.reports import scratch, write_csv, write_json

R = Registry()
M, FR, ST, SC = (base.sql(n) for n in ("MEDIA", "FRAMES", "STAGES", "SCORES"))
PAIR = "(SELECT l_suppkey % 20 AS k, l_quantity::DOUBLE AS g, l_extendedprice::DOUBLE / 2000 AS p FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0)"


@R.add("a22_std_floor", f"SELECT source, round(greatest(stddev_pop(x), 1.2), 6) AS std FROM {FR} GROUP BY source")
def a22_std_floor(spark, d):
    return base.load(spark, d, "FRAMES").groupBy("source").agg(F.round(F.greatest(F.stddev_pop("x"), F.lit(1.2)), 6).alias("std"))


@R.add("a24_fingerprint", f"SELECT sha256(string_agg(concat_ws(':', source, n, printf('%.3f', m)), ',' ORDER BY source)) AS fingerprint FROM (SELECT source, count(x) AS n, avg(x) AS m FROM {FR} GROUP BY source)")
def a24_fingerprint(spark, d):
    """Digest of per-source moments: a changed dataset has another one."""
    m = base.load(spark, d, "FRAMES").groupBy("source").agg(F.concat_ws(":", F.first("source"), F.count("x").cast("string"), F.format_string("%.3f", F.avg("x"))).alias("line"))
    return m.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), ","), 256).alias("fingerprint"))


@R.add("a42_camera_totals", f"SELECT source, round(sum(sqrt((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2)), 3) AS metres FROM (SELECT source, x, y, z, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM {FR} WINDOW w AS (PARTITION BY seq_id ORDER BY frame)) GROUP BY source")
def a42_camera_totals(spark, d):
    s = sequences.steps(base.load(spark, d, "FRAMES"), ["seq_id"], "frame", ["x", "y", "z"])
    return s.groupBy("source").agg(F.round(F.sum(F.col("speed") * F.col("gap")), 3).alias("metres"))


@R.add("w02_physical_splits", "SELECT episode_index, clip_idx, clip_idx * 450 AS start, least(clip_idx * 450 + 450, length) AS stop FROM (SELECT episode_index, length, unnest(range(0, greatest(0, ceil((length - 450) / 450.0))::BIGINT + 1)) AS clip_idx FROM episodes WHERE length > 450)")
def w02_physical_splits(spark, d):
    e = table(spark, d, "episodes").filter("length > 450").withColumn("fps", F.lit(30.0))
    return sequences.tumbling_clips(e, ["episode_index"], "fps", "length", 15.0)


@R.add("w30_io_rates", """WITH c AS (SELECT user_id, event_id, ts, sum(value) OVER w % 900 AS rd, sum(value * 2) OVER w % 700 AS wr FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round(greatest(0, rd - lag(rd) OVER w) / (date_diff('microsecond', lag(ts) OVER w, ts) / 1e6), 6) AS read_rate, round(greatest(0, wr - lag(wr) OVER w) / (date_diff('microsecond', lag(ts) OVER w, ts) / 1e6), 6) AS write_rate FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def w30_io_rates(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    c = table(spark, d, "events").select("user_id", "event_id", "ts", (F.sum("value").over(upto) % 900).alias("rd"), (F.sum(F.col("value") * 2).over(upto) % 700).alias("wr"))
    dt = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) / 1e6
    grow = lambda n: F.round(F.greatest(F.lit(0.0), F.col(n) - F.lag(n).over(w)) / dt, 6)
    return c.select("user_id", "event_id", grow("rd").alias("read_rate"), grow("wr").alias("write_rate"))


@R.add("w38_rotation_velocity")
def w38_rotation_velocity(spark, d):
    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("frame")
        m = np.stack(df["e"].to_numpy()).astype(float).reshape(-1, 4, 4)
        fine = metrics.proper(m)
        m, f = m[fine][:, :3, :3], df["frame"].to_numpy()[fine]
        if len(m) < 3:
            return pd.DataFrame(columns=["seq_id", "frame", "velocity", "acceleration"])
        v = metrics.matrix_to_axis_angle(m[:-1].transpose(0, 2, 1) @ m[1:])
        a = np.linalg.norm(np.diff(v, axis=0), axis=1)
        return pd.DataFrame({"seq_id": df["seq_id"].iloc[0], "frame": f[2:], "velocity": np.linalg.norm(v[1:], axis=1), "acceleration": a})

    return metrics.by_key(_poses(spark, d), "seq_id").applyInPandas(one, "seq_id STRING, frame BIGINT, velocity DOUBLE, acceleration DOUBLE")


_NEED = {"episodes": ["episode_index", "length"], "tasks": ["task", "task_index"], "prediction": ["depth", "frame", "hand", "mask"]}


@R.add("f02_column_check", f"SELECT need.t AS name, string_agg(need.c, ',' ORDER BY need.c) FILTER (WHERE h.column_name IS NULL) AS missing FROM (VALUES {', '.join(f"('{t}', '{c}')" for t, cs in _NEED.items() for c in cs)}) need(t, c) LEFT JOIN (SELECT DISTINCT table_name, column_name FROM information_schema.columns) h ON h.table_name = need.t AND h.column_name = need.c GROUP BY 1")
def f02_column_check(spark, d):
    """Required columns that a table lacks, from its schema alone."""
    missing = [(t, ",".join(sorted(set(cs) - set(table(spark, d, t).columns))) or None) for t, cs in _NEED.items()]
    return spark.createDataFrame(missing, "name STRING, missing STRING")

@R.add("f26_on_screen", f"SELECT source, count(*) AS joints, count(*) FILTER (WHERE z > 0.01 AND 400 * x / z + 240 BETWEEN 0 AND 479 AND 400 * y / z + 240 BETWEEN 0 AND 479) AS on_screen FROM (SELECT source, j[3 * i + 1]::DOUBLE AS x, j[3 * i + 2]::DOUBLE AS y, j[3 * i + 3]::DOUBLE AS z FROM (SELECT source, hand_joints_3d AS j, unnest(range(0, 21)) AS i FROM {GT})) GROUP BY source")
def f26_on_screen(spark, d):
    at = lambda i, k: F.get("j", 3 * i + k).cast("double")
    e = _joints(spark, d).select("source", "j", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    i = F.col("i")
    p = arrays.project(at(i, 0), at(i, 1), at(i, 2), F.lit(400.0), F.lit(400.0), F.lit(240.0), F.lit(240.0))
    seen = e.select("source", p.alias("p"))
    return seen.groupBy("source").agg(F.count(F.lit(1)).alias("joints"), F.count_if(F.col("p.visible") & F.col("p.u").between(0, 479) & F.col("p.v").between(0, 479)).alias("on_screen"))


@R.add("f18_changed_attributes", f"""SELECT media_id, 'resolution' AS changed, CASE WHEN ok IS NOT TRUE THEN 'probe_out' WHEN abs(fps - 30) > 0.01 THEN 'fps' ELSE 'ok' END AS status FROM {M}
UNION ALL SELECT media_id, 'fps', CASE WHEN ok IS NOT TRUE THEN 'probe_out' WHEN width <> 1280 THEN 'resolution' ELSE 'ok' END FROM {M}
UNION ALL SELECT media_id, 'fps,resolution', CASE WHEN ok IS NOT TRUE THEN 'probe_out' ELSE 'ok' END FROM {M}""")
def f18_changed_attributes(spark, d):
    """Checks after steps that change the resolution, the rate or both: what a step changes is left out."""
    rules = {"probe_out": ~F.col("ok"), "fps": F.abs(F.col("fps") - 30) > 0.01, "resolution": F.col("width") != 1280}

    def status(changed: str):
        out = F.lit("ok")
        for name in reversed([n for n in rules if n not in changed.split(",")]):
            out = F.when(rules[name], name).otherwise(out)
        return F.struct(F.lit(changed).alias("changed"), out.alias("status"))

    return base.load(spark, d, "MEDIA").select("media_id", F.inline(F.array(*[status(c) for c in ("resolution", "fps", "fps,resolution")])))

@R.add("k05_completion_log", "SELECT DISTINCT scene, clip_idx FROM " + ST + " WHERE status = 'done'")
def k05_completion_log(spark, d):
    place = scratch(spark)
    done = base.load(spark, d, "STAGES").filter("status = 'done'").select("scene", "clip_idx").distinct()
    for part in (0, 1):  # two runs append to one log
        done.filter(F.pmod(F.xxhash64("scene", "clip_idx"), F.lit(2)) == part).write.mode("append").json(place)
    return spark.read.schema("scene STRING, clip_idx INT").json(place).distinct()


@R.add("k08_benchmark_report", f"""WITH r AS (SELECT head, dataset, count(*) AS n, avg(ate) AS ate FROM {SC} GROUP BY ALL)
SELECT 'json' AS form, head, dataset, n, round(ate, 6) AS ate, NULL AS line FROM r UNION ALL SELECT 'markdown', head, dataset, NULL, NULL, printf('| %s | %s | %d | %.4f |', head, dataset, n, ate) FROM r""")
def k08_benchmark_report(spark, d):
    """The small aggregate as a JSON and as a Markdown report, both read back."""
    place = scratch(spark)
    agg = base.load(spark, d, "SCORES").groupBy("head", "dataset").agg(F.count(F.lit(1)).alias("n"), F.avg("ate").alias("ate"))
    write_json(agg, f"{place}/json")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "head", "dataset", F.col("n").cast("string"), F.regexp_replace(F.format_number("ate", 4), ",", "")), F.lit(" |"))
    agg.select(line.alias("value")).coalesce(1).write.text(f"{place}/markdown")
    none = lambda t: F.lit(None).cast(t)
    j = spark.read.schema(agg.schema).json(f"{place}/json").select(F.lit("json").alias("form"), "head", "dataset", "n", F.round("ate", 6).alias("ate"), none("string").alias("line"))
    cell = lambda i: F.trim(F.split("value", r"\|")[i])
    m = spark.read.text(f"{place}/markdown").select(F.lit("markdown").alias("form"), cell(1).alias("head"), cell(2).alias("dataset"), none("bigint").alias("n"), none("double").alias("ate"), F.col("value").alias("line"))
    return j.unionByName(m)

@R.add("k10_index_cache", "SELECT episode_index, length, true AS cached FROM episodes")
def k10_index_cache(spark, d):
    """Index table under the signature of its input; the second call finds the signature unchanged and reads it back."""
    from frameloom.sources.discovery import cached_component

    place, e = scratch(spark), table(spark, d, "episodes").select("episode_index", "length")
    signature = e.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(F.xxhash64("episode_index", "length") % 1_000_003).cast("string")), 256)).first()[0]
    cached_component(spark, place, "set", "index", signature, lambda: e)
    index, hit = cached_component(spark, place, "set", "index", signature, lambda: e)
    return index.withColumn("cached", F.lit(hit))

@R.add("o12_sequence_shards")
def o12_sequence_shards(spark, d):
    from frameloom.operators.sampling import balance_shards

    costs = table(spark, d, "gtsequence").groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    shards = balance_shards({r["seq_id"]: r["n"] for r in collect_small(costs)}, 3)
    return spark.createDataFrame(sorted(shards.items()), "seq_id STRING, shard INT") if shards else costs.select("seq_id", F.lit(0).alias("shard"))


@R.add("c09_short_duration", f"SELECT media_id, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%.1fm', s / 60) ELSE printf('%.1fh', s / 3600) END AS label FROM (SELECT media_id, floor(duration_sec * 2)::DOUBLE / 2 AS s FROM {M} WHERE duration_sec IS NOT NULL)")
def c09_short_duration(spark, d):
    """``format_number`` rounds the exact binary value, halves to even, as C's printf does; ``format_string`` rounds the shortest decimal up."""
    s = F.col("s")
    one = lambda x, unit: F.concat(F.expr(f"format_number({x}, '0.0')"), F.lit(unit))
    m = base.load(spark, d, "MEDIA").filter("duration_sec IS NOT NULL").select("media_id", (F.floor(F.col("duration_sec") * 2) / 2).cast("double").alias("s"))
    return m.select("media_id", F.when(s < 60, one("s", "s")).when(s < 3600, one("s / 60", "m")).otherwise(one("s / 3600", "h")).alias("label"))


@R.add("c32_fov_from_intrinsics", f"SELECT media_id, round(degrees(2 * atan(width / (2 * 900.0))), 6) AS fov_h, round(degrees(2 * atan(height / (2 * 900.0))), 6) AS fov_v FROM {M} WHERE width > 0")
def c32_fov_from_intrinsics(spark, d):
    fov = lambda c: F.round(F.degrees(numbers.focal_to_fov(F.col(c).cast("double"), F.lit(900.0))), 6)
    return base.load(spark, d, "MEDIA").filter("width > 0").select("media_id", fov("width").alias("fov_h"), fov("height").alias("fov_v"))


@R.add("c33_intrinsics_from_fov", f"SELECT media_id, round(width / (2 * tan(0.6)), 6) AS fx FROM {M} WHERE width > 0")
def c33_intrinsics_from_fov(spark, d):
    return base.load(spark, d, "MEDIA").filter("width > 0").select("media_id", F.round(numbers.fov_to_focal(F.col("width").cast("double"), F.lit(1.2)), 6).alias("fx"))


@R.add("c40_relative_pose")
def c40_relative_pose(spark, d):
    """Inverse and relative motion of each pose to the first of its sequence."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("frame")
        m = np.stack(df["e"].to_numpy()).astype(float).reshape(-1, 4, 4)
        fine = metrics.proper(m)
        m, f = m[fine], df["frame"].to_numpy()[fine]
        rel = np.linalg.inv(m[:1]) @ m if len(m) else m
        return pd.DataFrame({"seq_id": df["seq_id"].iloc[0], "frame": f, "x": rel[:, 0, 3], "y": rel[:, 1, 3], "z": rel[:, 2, 3]})

    return metrics.by_key(_poses(spark, d), "seq_id").applyInPandas(one, "seq_id STRING, frame BIGINT, x DOUBLE, y DOUBLE, z DOUBLE")


@R.add("c41_rotation_projection")
def c41_rotation_projection(spark, d):
    @F.pandas_udf("DOUBLE")
    def moved(e: pd.Series) -> pd.Series:
        m = np.stack(e.to_numpy()).astype(float).reshape(-1, 4, 4)[:, :3, :3]
        return pd.Series(np.abs(metrics.project_rotation(m) - m).max((1, 2)))

    return _poses(spark, d).select("seq_id", "frame", moved("e").alias("moved"))


@R.add("c52_run_signature", "SELECT head, sha256(concat_ws('|', head, n, datasets)) AS signature FROM (SELECT head, count(*) AS n, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets FROM " + SC + " GROUP BY head)")
def c52_run_signature(spark, d):
    g = base.load(spark, d, "SCORES").groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("dataset")), ",").alias("datasets"))
    return g.select("head", F.sha2(F.concat_ws("|", "head", F.col("n").cast("string"), "datasets"), 256).alias("signature"))


@R.add("c54_file_stamp")
def c54_file_stamp(spark, d):
    m = table(spark, d, "region").select("_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return m.select("file_name", (F.col("file_size") > 0).alias("filled"))


@R.add("m05_depth_head", f"WITH s AS (SELECT k, median(g) / median(p) AS scale FROM {PAIR} GROUP BY k) SELECT a.k, round(avg(abs(p * scale - g) / g), 6) AS abs_rel, round(sqrt(avg((p * scale - g) ** 2)), 6) AS rmse FROM {PAIR} a JOIN s ON s.k = a.k GROUP BY a.k")
def m05_depth_head(spark, d):
    """Errors after each group's median scale."""
    a = table(spark, d, "lineitem").filter("l_quantity > 0 AND l_extendedprice > 0").select((F.col("l_suppkey") % 20).alias("k"), F.col("l_quantity").cast("double").alias("g"), (F.col("l_extendedprice") / 2000).alias("p"))
    s = a.groupBy("k").agg((F.percentile("g", F.lit(0.5)) / F.percentile("p", F.lit(0.5))).alias("scale"))
    errors = metrics.depth_errors(F.col("p") * F.col("scale"), F.col("g"))
    return a.join(s, "k").groupBy("k").agg(errors[0], errors[2])


@R.add("m13_joint_terms", f"WITH g AS (SELECT source, hand_joints_3d AS j FROM {GT}) SELECT source, round(avg(sqrt((j[1]::DOUBLE - j[28]) ** 2 + (j[2]::DOUBLE - j[29]) ** 2 + (j[3]::DOUBLE - j[30]) ** 2)), 4) AS palm FROM g GROUP BY source")
def m13_joint_terms(spark, d):
    """Masked mean of a joint distance."""
    part = lambda a: F.slice(F.col("j"), a, 3)
    return _joints(spark, d).groupBy("source").agg(F.round(profile.masked_mean(arrays.distance(part(1), part(28)), F.lit(1)), 4).alias("palm"))


@R.add("m14_consistency_terms", f"""SELECT g.source, round(avg(abs(j[3]::DOUBLE - h[3])), 4) AS depth_gap FROM (SELECT source, seq_id, frame, hand_joints_3d AS j FROM {GT}) g JOIN (SELECT seq_id, frame, hand AS h FROM {NEWEST} WHERE hand_presence_logits[1] >= 0 AND NOT isnan(hand_presence_logits[1]) AND isfinite(hand[3]) AND abs(hand[3]) < 100) p ON p.seq_id = g.seq_id AND p.frame = g.frame GROUP BY g.source""")
def m14_consistency_terms(spark, d):
    p = table(spark, d, "prediction").groupBy("seq_id", "frame").agg(F.max_by(F.struct("hand", "hand_presence_logits"), "ingested_at").alias("m"))
    z = F.get("m.hand", F.lit(2)).cast("double")
    near = p.filter((F.get("m.hand_presence_logits", F.lit(0)) >= 0) & ~F.isnan(F.get("m.hand_presence_logits", F.lit(0))) & ~F.isnan(z) & (F.abs(z) < 100)).select("seq_id", "frame", z.alias("z"))
    j = _joints(spark, d).join(near, ["seq_id", "frame"])
    return j.groupBy("source").agg(F.round(F.avg(F.abs(F.get("j", F.lit(2)).cast("double") - F.col("z"))), 4).alias("depth_gap"))


@R.add("m15_metric_curves", f"""WITH s AS (SELECT seq_id, frame, x - lag(x) OVER w AS v, x - 2 * lag(x) OVER w + lag(x, 2) OVER w AS a FROM {FR} WINDOW w AS (PARTITION BY seq_id ORDER BY frame))
SELECT seq_id, frame, round(v, 6) AS velocity, round(a, 6) AS acceleration, round(CASE WHEN count(v) OVER r >= 5 THEN avg(abs(v)) OVER r END, 12) AS smooth FROM s WINDOW r AS (PARTITION BY seq_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def m15_metric_curves(spark, d):
    w = Window.partitionBy("seq_id").orderBy("frame")
    one, two = F.lag("x").over(w), F.lag("x", 2).over(w)
    s = base.load(spark, d, "FRAMES").select("seq_id", "frame", (F.col("x") - one).alias("v"), (F.col("x") - 2 * one + two).alias("a"))
    r = w.rowsBetween(-4, 0)
    return s.select("seq_id", "frame", F.round("v", 6).alias("velocity"), F.round("a", 6).alias("acceleration"), F.round(F.when(F.count("v").over(r) >= 5, F.avg(F.abs("v")).over(r)), 12).alias("smooth"))


@R.add("u01_metric_heads", f"SELECT 'extrinsics' AS head, 'evaluated' AS status, 'ate' AS metric, round(avg(ate), 6) AS value FROM {SC} UNION ALL SELECT 'depth', 'skipped', NULL, NULL UNION ALL SELECT 'points', 'not_implemented', NULL, NULL")
def u01_metric_heads(spark, d):
    ate = lambda df: df.agg(F.round(F.avg("ate"), 6).alias("value")).select(F.lit("ate").alias("metric"), "value")
    heads = {"extrinsics": (["pose"], ate), "depth": (["depth"], ate), "points": (["pose"], None)}
    return registry.evaluate_heads(base.load(spark, d, "SCORES"), heads, ["pose", "hands"])


@R.add("u04_step_chain", f"SELECT media_id, least(fps, 30.0) AS fps, least(width, 1280) AS width FROM {M} WHERE fps IS NOT NULL AND ok")
def u04_step_chain(spark, d):
    p = registry.Plugins(strict=True)
    p.register("fps")(lambda df, most: df.withColumn("fps", F.least("fps", F.lit(most))).filter("fps IS NOT NULL"))
    p.register("resolution")(lambda df, most: df.withColumn("width", F.least("width", F.lit(most))))
    p.register("keep_ok")(lambda df: df.filter("ok"))
    m = base.load(spark, d, "MEDIA").filter("fps IS NOT NULL").withColumn("fps", F.col("fps").cast("double"))
    return registry.run_stages(m, "fps + resolution, keep_ok", p, {"fps": {"most": 30.0}, "resolution": {"most": 1280}}).select("media_id", "fps", "width")


@R.add("u05_routed_output", f"SELECT CASE WHEN width * height = 0 THEN 'none' ELSE concat(width, 'x', height) END AS label, count(*) AS n FROM {M} GROUP BY 1")
def u05_routed_output(spark, d):
    """Rows routed by the label of what they really are: a computed partition column."""
    place = scratch(spark)
    label = F.when(F.col("width") * F.col("height") == 0, "none").otherwise(F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")))
    base.load(spark, d, "MEDIA").select("media_id", label.alias("label")).repartition("label").write.partitionBy("label").parquet(place)
    return spark.read.parquet(place).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@R.add("u11_capabilities", f"SELECT source, bool_or(extrinsic_c2w IS NOT NULL) AS pose, bool_or(hand IS NOT NULL) AS hands FROM {NEWEST} GROUP BY source")
def u11_capabilities(spark, d):
    return newest(spark, d, "source", "extrinsic_c2w", "hand").groupBy("source").agg(F.bool_or(F.col("extrinsic_c2w").isNotNull()).alias("pose"), F.bool_or(F.col("hand").isNotNull()).alias("hands"))


@R.add("g03_aligned_lookup", "SELECT e.episode_index, arg_min(f.file_id, f.file_id) AS file_id FROM episodes e JOIN data_files f ON f.episode_index = e.episode_index AND f.kind = 'parquet' AND f.frame_to < e.length GROUP BY e.episode_index")
def g03_aligned_lookup(spark, d):
    f = table(spark, d, "data_files").filter("kind = 'parquet'").select("episode_index", "file_id", "frame_to")
    e = table(spark, d, "episodes").select("episode_index", "length")
    return f.join(e, "episode_index").filter("frame_to < length").groupBy("episode_index").agg(F.min("file_id").alias("file_id"))


@R.add("g14_clip_identity", f"SELECT DISTINCT coalesce(CASE WHEN clip_idx > 0 THEN scene END, concat(scene, '_root')) AS parent, clip_idx FROM {ST}")
def g14_clip_identity(spark, d):
    parent = F.coalesce(F.when(F.col("clip_idx") > 0, F.col("scene")), F.concat("scene", F.lit("_root")))
    return base.load(spark, d, "STAGES").select(parent.alias("parent"), "clip_idx").distinct()


@R.add("g22_report_digest", f"""WITH t AS (SELECT head, dataset, avg(ate) AS ate FROM {SC} GROUP BY ALL)
SELECT head, sha256(string_agg(concat(dataset, '=', round(ate * 1000)::BIGINT), ';' ORDER BY dataset)) AS digest FROM t GROUP BY head""")
def g22_report_digest(spark, d):
    """Digest of each head's report without its sequences."""
    tree = base.load(spark, d, "SCORES").groupBy("head", "dataset").agg(F.avg("ate").alias("ate"))
    item = F.struct("dataset", F.concat("dataset", F.lit("="), F.round(F.col("ate") * 1000).cast("bigint").cast("string")).alias("text"))
    items = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"])
    return tree.groupBy("head").agg(F.sha2(F.array_join(items, ";"), 256).alias("digest"))

@R.add("g23_legacy_match", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey AND c_nationkey = o_orderkey % 25")
def g23_legacy_match(spark, d):
    """A match needs equality of every recorded field."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 25).cast("int").alias("c_nationkey"))
    return o.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_custkey", "c_nationkey"]).select("o_orderkey", "c_custkey")


@R.add("g24_history", "SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth, count(*) OVER (PARTITION BY user_id) AS records FROM events WHERE event_type <> 'error' QUALIFY nth <= 20")
def g24_history(spark, d):
    """The twenty newest records of each user, newest first, with their number in all: a top-k report."""
    e = table(spark, d, "events").filter("event_type <> 'error'")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    total = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return e.select("user_id", "event_id", "event_type", "ts", nth.alias("nth"), total.alias("records")).filter("nth <= 20")

@R.add("g25_snapshot_grid", f"WITH a AS (SELECT head, dataset, round(avg(ate), 6) AS ate FROM {SC} WHERE NOT (head = 'head_A' AND dataset = 'set_O') GROUP BY ALL) SELECT h.head, s.dataset, a.ate FROM (SELECT DISTINCT head FROM {SC}) h CROSS JOIN (SELECT DISTINCT dataset FROM {SC}) s LEFT JOIN a ON a.head = h.head AND a.dataset = s.dataset")
def g25_snapshot_grid(spark, d):
    """Methods by datasets, holes shown as nulls: each method carries its map, the datasets are few."""
    s = base.load(spark, d, "SCORES")
    a = s.filter("NOT (head = 'head_A' AND dataset = 'set_O')").groupBy("head", "dataset").agg(F.round(F.avg("ate"), 6).alias("ate"))
    names = s.agg(F.collect_set("dataset").alias("datasets"), F.collect_set("head").alias("heads"))
    grid = names.select(F.explode("heads").alias("head"), "datasets").select("head", F.explode("datasets").alias("dataset"))
    return grid.join(a, ["head", "dataset"], "left")


@R.add("g26_stage_seconds", "SELECT event_id, 'k' AS stage, CAST(json_extract(props, '$.k') AS DOUBLE) AS seconds FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def g26_stage_seconds(spark, d):
    """Stages and seconds of an archived JSON map, whatever its keys."""
    m = F.from_json("props", "MAP<STRING, DOUBLE>")
    return table(spark, d, "events").select("event_id", F.explode(m).alias("stage", "seconds"))

@R.add("g28_keypoints", f"SELECT seq_id, frame, 21 AS joints, round(hand_joints_3d[13]::DOUBLE, 5) AS tip_x FROM {GT}")
def g28_keypoints(spark, d):
    """The 21 joints as triples, by array index."""
    triples = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.slice("j", i * 3 + 1, F.lit(3)))
    return _joints(spark, d).select("seq_id", "frame", F.size(triples).alias("joints"), F.round(F.get(F.get(triples, F.lit(4)), F.lit(0)).cast("double"), 5).alias("tip_x"))


@R.add("g33_penalised_error", f"WITH e AS (SELECT source, CASE WHEN j[3] > 0.75 THEN 1.0 ELSE abs(j[1]::DOUBLE) END AS v, (j[3] > 0.5)::INT AS m FROM (SELECT source, hand_joints_3d AS j FROM {GT})) SELECT source, round(sum(v * m) / greatest(sum(m), 1), 6) AS error FROM e GROUP BY source")
def g33_penalised_error(spark, d):
    """A fixed penalty where the measure fails, inside a mask."""
    at = lambda i: arrays.at(F.col("j"), i)
    v = F.when(F.get("j", F.lit(2)) > 0.75, 1.0).otherwise(F.abs(at(0)))
    return _joints(spark, d).groupBy("source").agg(F.round(profile.masked_mean(v, F.get("j", F.lit(2)) > 0.5), 6).alias("error"))


@R.add("g34_episode_scales", f"SELECT seq_id, round(greatest(stddev_pop(x), 1e-3), 6) AS sx, round(greatest(stddev_pop(y), 1e-3), 6) AS sy, round(greatest(stddev_pop(z), 1e-3), 6) AS sz FROM {FR} GROUP BY seq_id")
def g34_episode_scales(spark, d):
    return base.load(spark, d, "FRAMES").groupBy("seq_id").agg(*[F.round(F.greatest(F.stddev_pop(c), F.lit(1e-3)), 6).alias(f"s{c}") for c in ("x", "y", "z")])


@R.add("g38_export_conversion", f"SELECT seq_id, frame, round(-(e[1]::DOUBLE * e[4] + e[5]::DOUBLE * e[8] + e[9]::DOUBLE * e[12]), 3) + 0.0 AS tx FROM {POSE}")
def g38_export_conversion(spark, d):
    """Camera-to-world poses as world-to-camera rows of another export: R' and -R't."""
    c = arrays.camera_centre(F.col("e"))
    return _poses(spark, d).select("seq_id", "frame", (F.round(c[0], 3) + 0.0).alias("tx"))


@R.add("a26_long_form", f"SELECT head, metric, count(value) AS n FROM (SELECT head, unnest(['ate', 'rpe', 'recall']) AS metric, unnest([ate::DOUBLE, rpe::DOUBLE, recall::DOUBLE]) AS value FROM {SC}) GROUP BY ALL")
def a26_long_form(spark, d):
    return reports.unpivot_metrics(base.load(spark, d, "SCORES"), ["head"], ["ate", "rpe", "recall"]).groupBy("head", "metric").agg(F.count("value").alias("n"))
