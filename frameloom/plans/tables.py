"""Queries on sources, sinks and dataset layouts, and on the grouped kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from frameloom.operators import metrics, sequences
from frameloom.plans import base
from frameloom.plans.base import newest
from frameloom.plans.registry import Registry
from frameloom.plans.scalars import GT, NEWEST, POSE, _joints, _poses
from frameloom.session import checkpoint, table
from frameloom.sinks.dataset import running_index, validate_dataset, write_dataset
from frameloom.sinks.reports import append_events, scratch, write_csv, write_json
from frameloom.sources import files

R = Registry()
M = base.sql("MEDIA")
FR = base.sql("FRAMES")


@R.add("s01_inventory")
def s01_inventory(spark, d):
    """Files of the input folder, from the listing alone."""
    return files.inventory(spark, d, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), (F.col("length") > 0).alias("filled"))


@R.add("s03_multi_root", """SELECT DISTINCT file_path, source, substr(file_path, length(source) + 2) AS relative, split_part(substr(file_path, length(source) + 2), '/', 1) AS folder FROM (
SELECT file_path, CASE WHEN file_path LIKE 'data/chunk-000/%' THEN 'data/chunk-000' WHEN file_path LIKE 'data/%' THEN 'data' WHEN file_path LIKE 'videos/%' THEN 'videos' END AS source FROM data_files) WHERE source IS NOT NULL""")
def s03_multi_root(spark, d):
    """Three roots, one inside another: each file once, below the deepest root that holds it."""
    f = table(spark, d, "data_files").select("file_path")
    roots = ["data", "videos", "data/chunk-000"]
    scans = [f.filter(F.col("file_path").startswith(r + "/")) for r in roots]
    found = files.nearest_root(scans[0].unionByName(scans[1]).unionByName(scans[2]).dropDuplicates(["file_path"]), "file_path", roots)
    relative = F.expr("substring(file_path, length(root) + 2)")
    return found.select("file_path", F.col("root").alias("source"), relative.alias("relative"), F.split(relative, "/")[0].alias("folder"))



FILES = "SELECT file_id, concat('root', episode_index % 5) AS root, CASE WHEN episode_index % 5 = 0 THEN replace(file_path, '.mp4', '.avi') ELSE file_path END AS path FROM data_files"


@R.add("s04_preferred_videos", f"WITH f AS (SELECT *, bool_or(path LIKE '%.mp4') OVER (PARTITION BY root) AS mp4 FROM ({FILES}) WHERE path LIKE '%.mp4' OR path LIKE '%.avi') SELECT file_id, root FROM f WHERE NOT mp4 OR path LIKE '%.mp4'")
def s04_preferred_videos(spark, d):
    k = F.col("episode_index") % 5
    f = table(spark, d, "data_files").select("file_id", F.concat(F.lit("root"), k.cast("string")).alias("root"), F.when(k == 0, F.replace(F.col("file_path"), F.lit(".mp4"), F.lit(".avi"))).otherwise(F.col("file_path")).alias("path"))
    return files.preferred_videos(f, "root", "path").select("file_id", "root")


@R.add("s07_probe_cache", "SELECT file_id, strlen(payload) AS bytes, file_id % 3 <> 0 AS cached FROM data_files WHERE written_at IS NOT NULL")
def s07_probe_cache(spark, d):
    """Files whose (path, time) was probed before take the persisted result; only new and changed ones are probed."""
    place, f = scratch(spark), table(spark, d, "data_files").filter("written_at IS NOT NULL").select("file_id", "written_at", "payload")
    probed = lambda df: df.select("file_id", "written_at", F.octet_length("payload").alias("bytes"))
    before = f.withColumn("written_at", F.when(F.col("file_id") % 3 == 1, F.col("written_at")).when(F.col("file_id") % 3 == 2, F.col("written_at")).otherwise(F.col("written_at") - F.expr("INTERVAL 1 HOUR")))
    probed(before).write.parquet(place)
    cache = spark.read.parquet(place)
    keys = ["file_id", "written_at"]
    hits = f.drop("payload").join(cache, keys)
    return hits.select("file_id", "bytes", F.lit(True).alias("cached")).unionByName(probed(f.join(cache, keys, "left_anti")).select("file_id", "bytes", F.lit(False).alias("cached")))

@R.add("s08_episode_scan", "SELECT episode_index, length, data_chunk_index, data_file_index, dataset_from_index, dataset_to_index FROM episodes")
def s08_episode_scan(spark, d):
    return table(spark, d, "episodes").select("episode_index", "length", "data_chunk_index", "data_file_index", "dataset_from_index", "dataset_to_index")


@R.add("s09_discover_episodes", "SELECT 'all' AS mode, episode_index, length FROM episodes UNION ALL SELECT 'with video', episode_index, length FROM episodes WHERE episode_index IN (SELECT episode_index FROM data_files WHERE kind = 'video')")
def s09_discover_episodes(spark, d):
    """Episodes of the index, read from its cache; those without a stored video are left out where one is required."""
    from frameloom.sources.discovery import cached_component

    place, e = scratch(spark), table(spark, d, "episodes").select("episode_index", "length")
    cached_component(spark, place, "set", "episodes", "v1", lambda: e)
    index, _ = cached_component(spark, place, "set", "episodes", "v1", lambda: e)
    videos = table(spark, d, "data_files").filter("kind = 'video'").select("episode_index")
    every = index.select(F.lit("all").alias("mode"), "episode_index", "length")
    return every.unionByName(index.join(videos, "episode_index", "left_semi").select(F.lit("with video").alias("mode"), "episode_index", "length"))

@R.add("s11_single_episode", "SELECT seq_id, frame, ts FROM prediction WHERE seq_id = (SELECT min(seq_id) FROM prediction)")
def s11_single_episode(spark, d):
    p = table(spark, d, "prediction")
    first = p.agg(F.min("seq_id")).first()[0]
    return p.filter(F.col("seq_id") == first).select("seq_id", "frame", "ts")


@R.add("s12_first_frames", f"SELECT seq_id, arg_min(source, frame) AS source, min(frame) AS frame, round(arg_min(ts, frame), 6) AS ts FROM {NEWEST} GROUP BY seq_id")
def s12_first_frames(spark, d):
    """Frame 0 of each sequence by a pushed filter; sequences without one give their first frame."""
    zero = newest(spark, d, "source", "ts").filter("frame = 0")
    rest = newest(spark, d, "source", "ts").join(zero.select("seq_id"), "seq_id", "left_anti")
    first = rest.groupBy("seq_id").agg(F.min_by(F.struct("source", "frame", "ts"), "frame").alias("m")).select("seq_id", "m.*")
    return zero.select("seq_id", "source", "frame", "ts").unionByName(first).withColumn("ts", F.round("ts", 6))

@R.add("s14_name_conflicts", "SELECT source, count(DISTINCT source_dataset_index) AS roots FROM (SELECT lower(trim(source)) AS source, source_dataset_index FROM sample_manifest) WHERE source IS NOT NULL GROUP BY source HAVING count(DISTINCT source_dataset_index) > 1")
def s14_name_conflicts(spark, d):
    m = table(spark, d, "sample_manifest").select(F.lower(F.trim("source")).alias("source"), "source_dataset_index").filter("source IS NOT NULL")
    return m.groupBy("source").agg(F.count_distinct("source_dataset_index").alias("roots")).filter("roots > 1")


@R.add("s16_tolerant_jsonl", "SELECT DISTINCT event_id % 100 AS k FROM events WHERE event_id % 10 <> 3")
def s16_tolerant_jsonl(spark, d):
    """A log with broken lines: what parses counts, each key once."""
    place = scratch(spark)
    line = F.when(F.col("event_id") % 10 == 3, F.lit('{"k": ')).otherwise(F.to_json(F.struct((F.col("event_id") % 100).alias("k"))))
    table(spark, d, "events").select(line.alias("value")).write.text(place)
    return files.json_lines(spark, place, "k BIGINT").distinct()


@R.add("s19_text_poses", f"SELECT count(*) AS n, round(sum(x), 3) AS sx FROM {FR}")
def s19_text_poses(spark, d):
    place = scratch(spark)
    f = base.load(spark, d, "FRAMES")
    rows = f.select(F.concat_ws(" ", "frame", "x", "y", "z", F.lit(0), F.lit(0), F.lit(0), F.lit(1)).alias("value"))
    rows.unionByName(spark.createDataFrame([("# ts tx ty tz qx qy qz qw",)], "value STRING")).write.text(place)
    return files.pose_table(spark, place).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("tx"), 3).alias("sx"))


@R.add("s22_ordered_dedup", "SELECT file_path, min(file_id) AS ordinal FROM data_files GROUP BY file_path")
def s22_ordered_dedup(spark, d):
    return table(spark, d, "data_files").groupBy("file_path").agg(F.min("file_id").alias("ordinal"))


@R.add("d06_task_dictionary", "SELECT DISTINCT task_index, __index_level_0__ AS task FROM tasks")
def d06_task_dictionary(spark, d):
    return files.task_dictionary(table(spark, d, "tasks")).distinct()


@R.add("g18_feature_shape", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '720x1280' ELSE '480x480' END AS shape FROM nation")
def g18_feature_shape(spark, d):
    """Shape of the preferred video feature, else of any feature of kind video."""
    k = F.col("n_nationkey")
    feature = lambda dtype, shape: F.struct(F.lit(dtype).alias("dtype"), F.lit(shape).alias("shape"))
    features = F.when(k % 2 == 0, F.create_map(F.lit("images.ego"), feature("video", "720x1280"), F.lit("other"), feature("video", "1x1"))).otherwise(F.create_map(F.lit("state"), feature("float", "122"), F.lit("cam"), feature("video", "480x480")))
    any_video = F.get(F.map_values(F.map_filter(features, lambda n, f: f["dtype"] == "video")), F.lit(0))
    return table(spark, d, "nation").select("n_nationkey", F.coalesce(F.try_element_at(features, F.lit("images.ego")), any_video)["shape"].alias("shape"))


@R.add("g19_nearest_root", "SELECT file_id, CASE WHEN file_path LIKE 'data/chunk-000/%' THEN 'data/chunk-000' WHEN file_path LIKE 'data/%' THEN 'data' WHEN file_path LIKE 'videos/%' THEN 'videos' END AS root FROM data_files")
def g19_nearest_root(spark, d):
    return files.nearest_root(table(spark, d, "data_files").select("file_id", "file_path"), "file_path", ["data", "videos", "data/chunk-000"]).select("file_id", "root")


@R.add("g05_candidate_paths", "SELECT f.i * 3 + n.i AS ordinal, concat(f.v, '/', n.v) AS path FROM (VALUES (0, 'labels'), (1, 'sidecar')) f(i, v), (VALUES (0, 'a.json'), (1, 'a.jsonl'), (2, 'b.json')) n(i, v)")
def g05_candidate_paths(spark, d):
    return spark.createDataFrame(files.candidate_paths(["labels", "sidecar"], ["a.json", "a.jsonl", "b.json"]), "ordinal INT, path STRING")


@R.add("g01_segments_or_default", "SELECT episode_index, CASE WHEN len(atomic_segments) > 0 THEN len(atomic_segments) ELSE 1 END AS segments, CASE WHEN len(atomic_segments) > 0 THEN NULL ELSE length END AS default_stop FROM episodes")
def g01_segments_or_default(spark, d):
    """Segments of an episode, or one over its whole range."""
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("atomic_index"), F.lit(0).cast("long").alias("start"), F.col("length").alias("stop")))
    own = F.transform("atomic_segments", lambda u: F.struct(u["atomic_index"].alias("atomic_index"), u["start_frame"].alias("start"), u["end_frame"].alias("stop")))
    rows = table(spark, d, "episodes").select("episode_index", F.explode(F.when(F.size("atomic_segments") > 0, own).otherwise(whole)).alias("s"))
    return rows.groupBy("episode_index").agg(F.count(F.lit(1)).alias("segments"), F.max(F.when(F.col("s.atomic_index") < 0, F.col("s.stop"))).alias("default_stop"))


@R.add("g02_atomic_segments", "SELECT episode_index, u.atomic_index AS atomic_index, u.task_index AS task_index, u.start_frame AS start_frame, u.end_frame AS end_frame FROM (SELECT episode_index, unnest(atomic_segments) AS u FROM episodes)")
def g02_atomic_segments(spark, d):
    return table(spark, d, "episodes").select("episode_index", F.explode("atomic_segments").alias("u")).select("episode_index", "u.*")


@R.add("g04_default_task", "SELECT e.episode_index, coalesce(e.tasks[1], 'null') AS task FROM episodes e")
def g04_default_task(spark, d):
    return table(spark, d, "episodes").select("episode_index", F.coalesce(F.get("tasks", F.lit(0)), F.lit("null")).alias("task"))


@R.add("g13_clip_items", "SELECT episode_index, clip_idx, CASE WHEN clip_idx = 0 THEN length END AS seconds FROM (SELECT episode_index, length, unnest(range(0, ceil(length / 300.0)::BIGINT)) AS clip_idx FROM episodes WHERE length > 0)")
def g13_clip_items(spark, d):
    n = F.ceil(F.col("length") / 300).cast("long")
    e = table(spark, d, "episodes").filter("length > 0").select("episode_index", "length", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("clip_idx"))
    return e.select("episode_index", "clip_idx", F.when(F.col("clip_idx") == 0, F.col("length")).alias("seconds"))


@R.add("g15_folder_suffix", "SELECT p_partkey, CASE WHEN rn = 1 THEN p_name ELSE concat(p_name, printf('_%02d', rn)) END AS folder FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)")
def g15_folder_suffix(spark, d):
    rn = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_name", rn.alias("rn")).select("p_partkey", F.when(F.col("rn") == 1, F.col("p_name")).otherwise(F.concat("p_name", F.format_string("_%02d", "rn"))).alias("folder"))


@R.add("g17_diagnostics", f"SELECT 'missing_fps' AS name, count(*) FILTER (WHERE fps IS NULL) AS n, round(count(*) FILTER (WHERE fps IS NULL) * 100.0 / count(*), 4) AS pct FROM {M}")
def g17_diagnostics(spark, d):
    missing = F.count_if(F.col("fps").isNull())
    return base.load(spark, d, "MEDIA").agg(missing.alias("n"), F.round(missing * 100.0 / F.count(F.lit(1)), 4).alias("pct")).select(F.lit("missing_fps").alias("name"), "n", "pct")


DATASET = f"SELECT dense_rank() OVER (ORDER BY seq_id) - 1 AS episode_index, row_number() OVER (PARTITION BY seq_id ORDER BY frame) - 1 AS frame_index, x FROM {FR}"


def _dataset(spark, d):
    f = base.load(spark, d, "FRAMES")
    names = f.select("seq_id").distinct()
    number = names.withColumn("episode_index", (F.row_number().over(Window.orderBy("seq_id")) - 1).cast("long"))  # one row for each sequence
    return f.join(number, "seq_id").select("episode_index", (F.row_number().over(Window.partitionBy("seq_id").orderBy("frame")) - 1).cast("long").alias("frame_index"), "x")


@R.add("k01_dataset_writer", f"SELECT episode_index, count(*) AS length, min(i) AS dataset_from_index, max(i) + 1 AS dataset_to_index FROM (SELECT episode_index, row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS i FROM ({DATASET})) GROUP BY episode_index")
def k01_dataset_writer(spark, d):
    place = scratch(spark)
    write_dataset(_dataset(spark, d), files.task_dictionary(table(spark, d, "tasks")).distinct(), place.replace("file:", "", 1).replace("///", "/") if place.startswith("file:") else place, 30.0)
    return spark.read.parquet(f"{place}/meta/episodes")


@R.add("k01_running_index", f"SELECT episode_index, frame_index, row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS \"index\" FROM ({DATASET})")
def k01_running_index(spark, d):
    return running_index(_dataset(spark, d), "episode_index", "frame_index").select("episode_index", "frame_index", "index")


@R.add("f20_dataset_validator", """WITH g AS (SELECT episode_index, count(*) AS n FROM data_files GROUP BY 1) SELECT coalesce(e.episode_index, g.episode_index) AS episode_index, CASE WHEN g.n IS NULL THEN 'no_frames' WHEN e.length IS NULL THEN 'no_metadata' WHEN length <> n THEN 'length' END AS issue
FROM episodes e FULL JOIN g ON g.episode_index = e.episode_index WHERE g.n IS NULL OR e.length IS NULL OR length <> n""")
def f20_dataset_validator(spark, d):
    w = Window.partitionBy("episode_index").orderBy("file_id")
    frames = table(spark, d, "data_files").select("episode_index", (F.row_number().over(w) - 1).alias("frame_index"))
    return validate_dataset(frames, table(spark, d, "episodes").select("episode_index", "length", "dataset_from_index", "dataset_to_index"))


@R.add("k04_event_log", "SELECT CASE WHEN n = 1 THEN CAST(user_id AS VARCHAR) ELSE concat(user_id, '-', n) END AS record_id FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events)")
def k04_event_log(spark, d):
    place = scratch(spark)
    append_events(table(spark, d, "events").select(F.col("user_id").cast("string").alias("record_id"), F.col("ts").alias("recorded_at")), place)
    return spark.read.parquet(place).select("record_id")


@R.add("k07_diversity_report", f"""SELECT source, count(DISTINCT folder) AS folders, count(*) AS files, count(DISTINCT extension) AS extensions, count(DISTINCT codec) AS codecs, count(DISTINCT pixel_format) AS pixel_formats, count(DISTINCT resolution) AS resolutions,
round(sum(duration_sec), 2) AS duration_sum, round(avg(duration_sec), 4) AS duration_mean, round(min(duration_sec), 4) AS duration_min, round(max(duration_sec), 4) AS duration_max, sum(size_bytes)::BIGINT AS size_sum, count(*) FILTER (WHERE has_audio) AS with_audio, count(*) FILTER (WHERE ok) AS ok_files FROM {M} GROUP BY source""")
def k07_diversity_report(spark, d):
    """Fourteen columns as a CSV with a header in fixed order, read back."""
    place = scratch(spark)
    n = lambda c: F.count_distinct(c)
    t = F.col("duration_sec").cast("double")
    report = base.load(spark, d, "MEDIA").groupBy("source").agg(
        n("folder").alias("folders"), F.count(F.lit(1)).alias("files"), n("extension").alias("extensions"), n("codec").alias("codecs"), n("pixel_format").alias("pixel_formats"), n("resolution").alias("resolutions"),
        F.round(F.sum(t), 2).alias("duration_sum"), F.round(F.avg(t), 4).alias("duration_mean"), F.round(F.min(t), 4).alias("duration_min"), F.round(F.max(t), 4).alias("duration_max"),
        F.sum("size_bytes").alias("size_sum"), F.count_if("has_audio").alias("with_audio"), F.count_if("ok").alias("ok_files"),
    )
    write_csv(report, place)
    return spark.read.schema(report.schema).option("header", True).csv(place)



# Grouped kernels: rotation maths and greedy scans on one sequence at a time


def _by_sequence(df, fn, schema):
    return metrics.by_key(df, "seq_id").applyInPandas(fn, schema)


_TURN = " + ".join(f"e[{k}]::DOUBLE * lag(e[{k}]) OVER w" for k in (1, 2, 3, 5, 6, 7, 9, 10, 11))
_STEP = " + ".join(f"(e[{k}]::DOUBLE - lag(e[{k}]) OVER w) ** 2" for k in (4, 8, 12))


@R.add("w15_block_spikes", f"""WITH s AS (SELECT seq_id, frame, e, row_number() OVER w AS n, count(*) OVER (PARTITION BY seq_id) AS total, lag(e) OVER w AS b, frame - lag(frame) OVER w AS gap, sqrt({_STEP}) AS step, {_TURN} AS tr FROM {POSE} WINDOW w AS (PARTITION BY seq_id ORDER BY frame)),
l AS (SELECT * FROM s WHERE b IS NOT NULL AND total >= 4 AND (step / gap > 0.15 OR degrees(acos(greatest(-1, least(1, (tr - 1) / 2)))) / gap > 45)),
p AS (SELECT seq_id, n, b, lead(n) OVER v AS next_n, lead(e) OVER v AS next_e FROM l WINDOW v AS (PARTITION BY seq_id ORDER BY n)),
r AS (SELECT DISTINCT seq_id, unnest(generate_series(n, next_n - 1)) AS n FROM p WHERE next_n - n <= 15 AND sqrt({" + ".join(f"(next_e[{k}]::DOUBLE - b[{k}]) ** 2" for k in (4, 8, 12))}) < 0.15)
SELECT s.seq_id, s.frame FROM r JOIN s ON s.seq_id = r.seq_id AND s.n = r.n""")
def w15_block_spikes(spark, d):
    """Camera readings between two neighbouring leaps, by step or turn, of which the second leads back."""
    return sequences.block_spikes(_poses(spark, d).filter("size(e) = 16"), "seq_id", "frame", "e")


@R.add("w16_slerp_fill")
def w16_slerp_fill(spark, d):
    """Rotations of frames missing in gaps of at most 30, by spherical interpolation."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("frame")
        m = np.stack(df["e"].to_numpy()).astype(float).reshape(-1, 4, 4)[:, :3, :3]
        fine = np.abs(np.linalg.det(m) - 1) < 0.01
        q, f = metrics.matrix_to_quaternion(metrics.project_rotation(m[fine])), df["frame"].to_numpy()[fine]
        rows = []
        for i in np.flatnonzero((np.diff(f) > 1) & (np.diff(f) <= 31)):
            at = np.arange(f[i] + 1, f[i + 1])
            rows += [(df["seq_id"].iloc[0], int(k), v.tolist()) for k, v in zip(at, metrics.slerp(q[i], q[i + 1], (at - f[i]) / (f[i + 1] - f[i])), strict=True)]
        return pd.DataFrame(rows, columns=["seq_id", "frame", "q"])

    return _by_sequence(_poses(spark, d), one, "seq_id STRING, frame BIGINT, q ARRAY<DOUBLE>")


@R.add("w18_kalman_smoother")
def w18_kalman_smoother(spark, d):
    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("frame")
        t = df["frame"].to_numpy() / 30.0
        return pd.DataFrame({"seq_id": df["seq_id"], "frame": df["frame"], **{c: metrics.kalman_smooth(t, df[c].to_numpy()) for c in ("x", "y", "z")}})

    return _by_sequence(base.load(spark, d, "FRAMES").select("seq_id", "frame", "x", "y", "z"), one, "seq_id STRING, frame BIGINT, x DOUBLE, y DOUBLE, z DOUBLE")


@R.add("w21_camera_frame_smoother")
def w21_camera_frame_smoother(spark, d):
    """Wrists taken to the world by each frame's camera, smoothed there, and taken back (cogrouped by sequence)."""

    def one(hands: pd.DataFrame, cams: pd.DataFrame) -> pd.DataFrame:
        both = hands.merge(cams, on=["seq_id", "frame"]).sort_values("frame")
        if both.empty:
            return pd.DataFrame(columns=["seq_id", "frame", "x", "y", "z"])
        m = np.stack(both["e"].to_numpy()).astype(float).reshape(-1, 4, 4)
        w = np.stack(both["j"].to_numpy()).astype(float)[:, :3]
        world = np.einsum("nij,nj->ni", m[:, :3, :3], w) + m[:, :3, 3]
        t = both["frame"].to_numpy() / 30.0
        smooth = np.stack([metrics.kalman_smooth(t, world[:, i]) for i in range(3)], 1)
        back = np.einsum("nji,nj->ni", m[:, :3, :3], smooth - m[:, :3, 3])
        return pd.DataFrame({"seq_id": both["seq_id"], "frame": both["frame"], "x": back[:, 0], "y": back[:, 1], "z": back[:, 2]})

    return _joints(spark, d).select("seq_id", "frame", "j").groupBy("seq_id").cogroup(_poses(spark, d).groupBy("seq_id")).applyInPandas(one, "seq_id STRING, frame BIGINT, x DOUBLE, y DOUBLE, z DOUBLE")


@R.add("w26_window_chain")
def w26_window_chain(spark, d):
    """Poses cut into windows of 32 every 24 frames, each rebased to its first pose, and chained again."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("frame")
        m = np.stack(df["e"].to_numpy()).astype(float).reshape(-1, 4, 4)
        good = (np.abs(np.linalg.det(m[:, :3, :3]) - 1) < 0.01) & (np.abs(m[:, 3, 3] - 1) < 1e-3)
        m, f = m[good], df["frame"].to_numpy()[good]
        if len(m) < 33:
            return pd.DataFrame(columns=["seq_id", "frames", "drift"])
        starts = np.arange(0, len(m) - 8, 24)
        windows = [np.linalg.inv(m[s]) @ m[s : s + 32] for s in starts]
        chained = metrics.chain_windows(starts, windows)
        truth = np.linalg.inv(m[0]) @ m[: len(chained)]
        return pd.DataFrame({"seq_id": [df["seq_id"].iloc[0]], "frames": [len(f)], "drift": [float(np.abs(chained - truth).max() < 1e-3)]})

    return _by_sequence(_poses(spark, d), one, "seq_id STRING, frames BIGINT, drift DOUBLE")


@R.add("w37_relative_pose_error")
def w37_relative_pose_error(spark, d):
    def one(df: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(df.sort_values("frame")["e"].to_numpy()).astype(float).reshape(-1, 4, 4)
        m = m[(np.abs(np.linalg.det(m[:, :3, :3]) - 1) < 0.01) & (np.abs(m[:, 3, 3] - 1) < 1e-3)]
        if len(m) < 2:
            return pd.DataFrame(columns=["seq_id", "pairs", "mean_deg", "mean_m"])
        rel = np.linalg.inv(m[:-1]) @ m[1:]
        return pd.DataFrame({"seq_id": [df["seq_id"].iloc[0]], "pairs": [len(rel)], "mean_deg": [float(metrics.geodesic_deg(m[:-1, :3, :3], m[1:, :3, :3]).mean())], "mean_m": [float(np.linalg.norm(rel[:, :3, 3], axis=1).mean())]})

    return _by_sequence(_poses(spark, d), one, "seq_id STRING, pairs BIGINT, mean_deg DOUBLE, mean_m DOUBLE")


@R.add("c35_rotation_forms")
def c35_rotation_forms(spark, d):
    """Axis-angle, quaternion and two-row forms of each camera rotation, with the error of going back."""

    @F.pandas_udf("axis_angle ARRAY<DOUBLE>, quaternion ARRAY<DOUBLE>, six ARRAY<DOUBLE>, error DOUBLE")
    def forms(e: pd.Series) -> pd.DataFrame:
        m = metrics.project_rotation(np.stack(e.to_numpy()).astype(float).reshape(-1, 4, 4)[:, :3, :3])
        v, q, s = metrics.matrix_to_axis_angle(m), metrics.matrix_to_quaternion(m), metrics.matrix_to_six(m)
        error = np.max([np.abs(metrics.axis_angle_to_matrix(v) - m).max((1, 2)), np.abs(metrics.quaternion_to_matrix(q) - m).max((1, 2)), np.abs(metrics.six_to_matrix(s) - m).max((1, 2))], axis=0)
        return pd.DataFrame({"axis_angle": list(v), "quaternion": list(q), "six": list(s), "error": error})

    return _poses(spark, d).select("seq_id", "frame", forms("e").alias("f")).select("seq_id", "frame", "f.*")


@R.add("c38_camera_to_world", f"""SELECT g.seq_id, g.frame, round(e[1]::DOUBLE * j[1] + e[2]::DOUBLE * j[2] + e[3]::DOUBLE * j[3] + e[4], 3) + 0.0 AS wx FROM (SELECT seq_id, frame, hand_joints_3d AS j FROM {GT}) g JOIN (SELECT seq_id, frame, extrinsic_c2w AS e FROM {NEWEST} WHERE len(list_filter(extrinsic_c2w, lambda v: NOT isfinite(v) OR abs(v) > 1000)) = 0) p ON p.seq_id = g.seq_id AND p.frame = g.frame""")
def c38_camera_to_world(spark, d):
    at = lambda c, i: F.get(c, F.lit(i)).cast("double")
    j = _joints(spark, d).join(_poses(spark, d), ["seq_id", "frame"])
    return j.select("seq_id", "frame", (F.round(sum((at("e", i) * at("j", i) for i in range(3)), F.lit(0.0)) + at("e", 3), 3) + 0.0).alias("wx"))


@R.add("f01_state_projection", f"SELECT seq_id, frame, 122 AS width, round(CASE WHEN isfinite(hand[1]) THEN hand[1]::DOUBLE ELSE 0 END, 4) + 0.0 AS left_x, round(CASE WHEN isfinite(hand[112]) THEN hand[112]::DOUBLE ELSE 0 END, 4) + 0.0 AS right_z, round(list_sum(list_transform(hand[100:109], lambda v: CASE WHEN isfinite(v) THEN v::DOUBLE ELSE 0 END)), 3) + 0.0 AS left_shape FROM {NEWEST} WHERE len(hand) = 218")
def f01_state_projection(spark, d):
    """State vector of both hands: position 3, rotation as axis-angle 3, pose of 15 joints as axis-angle 45, shape 10."""

    def state(batches):
        for b in batches:
            if not len(b):
                continue
            x = np.nan_to_num(np.stack(b["hand"].to_numpy()).astype(float), posinf=0, neginf=0).reshape(-1, 2, 109)
            with np.errstate(all="ignore"):
                m = np.nan_to_num(metrics.six_to_matrix(x[:, :, 3:99].reshape(-1, 2, 16, 6)))
            v = metrics.matrix_to_axis_angle(m).reshape(-1, 2, 48)
            yield pd.DataFrame({"seq_id": b["seq_id"], "frame": b["frame"], "state": list(np.concatenate([x[:, :, :3], v, x[:, :, 99:]], 2).reshape(len(x), -1))})

    s = newest(spark, d, "hand").filter("size(hand) = 218").mapInPandas(state, "seq_id STRING, frame BIGINT, state ARRAY<DOUBLE>")
    at = lambda i: F.get("state", F.lit(i))
    shape = F.aggregate(F.slice("state", 52, 10), F.lit(0.0), lambda a, v: a + v)
    return s.select("seq_id", "frame", F.size("state").alias("width"), (F.round(at(0), 4) + 0.0).alias("left_x"), (F.round(at(63), 4) + 0.0).alias("right_z"), (F.round(shape, 3) + 0.0).alias("left_shape"))

@R.add("u06_predictor", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * (-1 + 2 * ((i - 1) % 64) / 63.0))), 4) + 0.0 AS score FROM embeddings")
def u06_predictor(spark, d):
    """An opaque predictor as an iterator over Arrow batches: its state is built once for each task."""

    def predict(batches):
        weight = np.linspace(-1, 1, 64)
        for b in batches:
            if len(b):
                x = np.stack(b["embedding"].to_numpy()).astype(float)
                yield pd.DataFrame({"vec_id": b["vec_id"], "score": x @ np.resize(weight, x.shape[1])})

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(predict, "vec_id BIGINT, score DOUBLE").select("vec_id", (F.round("score", 4) + 0.0).alias("score"))

@R.add("u07_first_detection", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first FROM events GROUP BY ALL")
def u07_first_detection(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first"))


@R.add("w22_smoothed_jitter", f"SELECT seq_id, round(avg(sqrt(ax ** 2 + ay ** 2 + az ** 2)), 6) + 0.0 AS raw_jitter, true AS calmer FROM (SELECT seq_id, {', '.join(f'{c} - 2 * lag({c}) OVER w + lag({c}, 2) OVER w AS a{c}' for c in 'xyz')} FROM {FR} WINDOW w AS (PARTITION BY seq_id ORDER BY frame)) GROUP BY seq_id HAVING count(ax) > 0")
def w22_smoothed_jitter(spark, d):
    """Jitter, the mean second difference, of each path as it is, and whether the smoother lessens it."""
    w = Window.partitionBy("seq_id").orderBy("frame")
    second = F.sqrt(sum((F.pow(F.col(c) - 2 * F.lag(c).over(w) + F.lag(c, 2).over(w), 2) for c in "xyz"), F.lit(0.0)))
    jitter = lambda df, name: df.select("seq_id", second.alias("j")).groupBy("seq_id").agg(F.avg("j").alias(name))
    raw = jitter(base.load(spark, d, "FRAMES").select("seq_id", "frame", "x", "y", "z"), "raw")
    smooth = jitter(w18_kalman_smoother(spark, d), "smooth")
    return raw.join(smooth, "seq_id").filter("raw IS NOT NULL").select("seq_id", (F.round("raw", 6) + 0.0).alias("raw_jitter"), (F.col("smooth") <= F.col("raw") + 1e-9).alias("calmer"))
