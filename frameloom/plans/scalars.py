"""Queries that prove the scalar functions: names, labels, numbers, geometry, arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import arrays, numbers, text
from frameloom.plans import base
from frameloom.plans.base import NEWEST, newest
from frameloom.plans.registry import Registry
from frameloom.session import table

R = Registry()
M = base.sql("MEDIA")


def _files(spark, d):
    return table(spark, d, "data_files").select("file_id", "file_path", "kind", "episode_index", "frame_from", "frame_to", "size_bytes")


@R.add("c01_relative_path", "SELECT file_id, CASE WHEN file_path LIKE 'data/%' THEN substr(file_path, 6) ELSE file_path END AS key FROM data_files")
def c01_relative_path(spark, d):
    return _files(spark, d).select("file_id", text.relative_to(F.col("file_path"), "data/").alias("key"))


@R.add("c02_scene_key", "SELECT file_id, regexp_replace(file_path, '[.][^./]+$', '') AS scene FROM data_files")
def c02_scene_key(spark, d):
    return _files(spark, d).select("file_id", text.without_suffix(F.col("file_path")).alias("scene"))


@R.add("c03_clip_key", "SELECT DISTINCT episode_index, printf('clip_%03d', episode_index % 1200) AS clip FROM data_files")
def c03_clip_key(spark, d):
    return _files(spark, d).select("episode_index", text.clip_key(F.col("episode_index") % 1200).alias("clip")).distinct()


@R.add("c04_truncate", "SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(left(text, 200), '...[truncated]') ELSE text END AS cut FROM documents")
def c04_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 200).alias("cut"))


@R.add("c05_name_parts", "SELECT file_id, TRY_CAST(regexp_extract(file_path, 'chunk-([0-9]+)', 1) AS INT) AS chunk, TRY_CAST(regexp_extract(file_path, 'file-([0-9]+)', 1) AS INT) AS file, TRY_CAST(nullif(regexp_extract(file_path, '-r([0-9]+)[.]', 1), '') AS INT) AS rewrite FROM data_files")
def c05_name_parts(spark, d):
    number = lambda p: F.regexp_extract("file_path", p, 1).try_cast("int")
    return _files(spark, d).select("file_id", number(r"chunk-(\d+)").alias("chunk"), number(r"file-(\d+)").alias("file"), number(r"-r(\d+)\.").alias("rewrite"))


@R.add("c06_part_number", "SELECT p_partkey, TRY_CAST(nullif(regexp_extract(concat(p_name, '_part_', CAST(p_size AS VARCHAR)), '_part_?([0-9]+)$', 1), '') AS INT) AS part FROM part")
def c06_part_number(spark, d):
    return table(spark, d, "part").select("p_partkey", text.part_number(F.concat("p_name", F.lit("_part_"), F.col("p_size").cast("string"))).alias("part"))


@R.add("c07_hand_side", """SELECT task_index, CASE WHEN lower(trim(__index_level_0__)) IN ('left', 'l', '0') THEN 'left' WHEN lower(trim(__index_level_0__)) IN ('right', 'r', '1') THEN 'right' WHEN contains(lower(__index_level_0__), 'left') THEN 'left' WHEN contains(lower(__index_level_0__), 'right') THEN 'right' ELSE 'none' END AS side FROM tasks""")
def c07_hand_side(spark, d):
    return table(spark, d, "tasks").select("task_index", text.hand_side(F.col("__index_level_0__")).alias("side"))


@R.add("c08_duration_label", """WITH s AS (SELECT DISTINCT length AS s FROM episodes UNION SELECT unnest([0, 59, 60, 61, 120, 3599, 3600, 3601, 3660, 7200, 7321]))
SELECT s, CASE WHEN s <= 60 THEN concat(s, 's') WHEN s < 3600 THEN concat(s // 60, 'm', CASE WHEN s % 60 > 0 THEN concat(s % 60, 's') ELSE '' END) WHEN s = 3600 THEN '60m'
  ELSE concat(s // 3600, 'h', CASE WHEN s % 3600 // 60 > 0 THEN concat(s % 3600 // 60, 'm') ELSE '' END, CASE WHEN s % 60 > 0 THEN concat(s % 60, 's') ELSE '' END) END AS label FROM s""")
def c08_duration_label(spark, d):
    edge = spark.createDataFrame([(i,) for i in (0, 59, 60, 61, 120, 3599, 3600, 3601, 3660, 7200, 7321)], "s BIGINT")
    return table(spark, d, "episodes").select(F.col("length").alias("s")).union(edge).distinct().select("s", numbers.duration_label(F.col("s")).alias("label"))


@R.add("c10_clock", f"SELECT media_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS clock FROM (SELECT media_id, round_even(duration_sec::DOUBLE, 0)::BIGINT AS s FROM {M} WHERE duration_sec IS NOT NULL)")
def c10_clock(spark, d):
    return base.load(spark, d, "MEDIA").filter("duration_sec IS NOT NULL").select("media_id", numbers.clock(F.col("duration_sec").cast("double")).alias("clock"))


@R.add("c11_container_label", "SELECT s_suppkey, CASE WHEN list_contains(n, 'mp4') THEN 'mp4' WHEN list_contains(n, 'mov') THEN 'mov' WHEN list_contains(n, 'matroska') THEN 'matroska' ELSE n[1] END AS container FROM (SELECT s_suppkey, string_split(CASE s_suppkey % 4 WHEN 0 THEN 'mov,mp4,m4a' WHEN 1 THEN 'matroska,webm' WHEN 2 THEN 'avi' ELSE 'qt,mov' END, ',') AS n FROM supplier)")
def c11_container_label(spark, d):
    k = F.col("s_suppkey") % 4
    return table(spark, d, "supplier").select("s_suppkey", text.container_label(F.when(k == 0, "mov,mp4,m4a").when(k == 1, "matroska,webm").when(k == 2, "avi").otherwise("qt,mov")).alias("container"))


@R.add("c12_task_text", r"SELECT task_index, trim(regexp_replace(lower(regexp_replace(__index_level_0__, '^[A-Za-z]+-[0-9]+:\s*', '')), '[\s_]+', ' ', 'g')) AS task FROM tasks")
def c12_task_text(spark, d):
    return table(spark, d, "tasks").select("task_index", text.task_text(F.col("__index_level_0__")).alias("task"))


#: Words of the scene categories, in the order that decides ties.
SCENES = {"kitchen": "kettle|pan|peeler|ladle|grater|sink|hob", "workshop": "wrench|spanner|chisel|workbench|drill|bolt", "office": "keyboard|remote|notebook|stapler|envelope|desk"}


def _scene_sql() -> str:
    counts = ", ".join(f"len(list_distinct(regexp_extract_all(lower(__index_level_0__), '{p}'))) AS {n}" for n, p in SCENES.items())
    best = "greatest(" + ", ".join(SCENES) + ")"
    return f"SELECT task_index, CASE WHEN {best} = 0 THEN 'other' " + " ".join(f"WHEN {n} = {best} THEN '{n}'" for n in SCENES) + f" END AS scene FROM (SELECT task_index, {counts} FROM tasks WHERE __index_level_0__ IS NOT NULL)"


@R.add("c13_scene_class", _scene_sql())
def c13_scene_class(spark, d):
    low = F.lower("__index_level_0__")
    scores = F.array(*[F.struct(F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(p), 0))).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, p) in enumerate(SCENES.items())])
    best = F.array_max(scores)
    return table(spark, d, "tasks").filter(F.col("__index_level_0__").isNotNull()).select("task_index", F.when(best["n"] == 0, "other").otherwise(best["name"]).alias("scene"))


#: Verbs of the action families; a text may have several.
ACTIONS = {"move": "push|pull|lift|carry|put", "turn": "turn|twist|stir|fold", "open": "open|close|unplug", "clean": "wipe|rinse|wash", "fix": "tighten|loosen|cut|hang"}


@R.add("c14_action_families", "SELECT task_index, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(__index_level_0__), '{p}') THEN '{n}' END" for n, p in ACTIONS.items()) + "], lambda x: x IS NOT NULL), ',') AS families FROM tasks WHERE __index_level_0__ IS NOT NULL")
def c14_action_families(spark, d):
    low = F.lower("__index_level_0__")
    return table(spark, d, "tasks").filter(F.col("__index_level_0__").isNotNull()).select("task_index", F.array_join(F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in ACTIONS.items()])), ",").alias("families"))


@R.add("c15_slug", "SELECT p_partkey, regexp_replace(regexp_replace(concat(p_name, ' #', p_brand, '/'), '[^A-Za-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def c15_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" #"), "p_brand", F.lit("/"))).alias("slug"))


@R.add("c16_output_name", "SELECT file_id, printf('%s__%s_%04d.npz', list_extract(string_split(file_path, '/'), 1), regexp_replace(list_extract(string_split(file_path, '/'), -1), '[.][^.]+$', ''), file_id % 10000) AS name FROM data_files")
def c16_output_name(spark, d):
    return _files(spark, d).select("file_id", F.format_string("%s__%s_%04d.npz", F.split("file_path", "/")[0], text.stem(F.col("file_path")), F.col("file_id") % 10000).alias("name"))


@R.add("c17_side_suffix", f"SELECT seq_id, CASE WHEN contains(seq_id, '#') AND list_extract(string_split(seq_id, '#'), -1) IN ('left', 'right') THEN list_extract(string_split(seq_id, '#'), -1) END AS side FROM (SELECT DISTINCT seq_id FROM {base.sql('SCORES')})")
def c17_side_suffix(spark, d):
    return base.load(spark, d, "SCORES").select("seq_id").distinct().select("seq_id", text.side_suffix(F.col("seq_id")).alias("side"))


@R.add("c18_sampling_group", "SELECT DISTINCT seq_id, regexp_replace(seq_id, '[-_]?[0-9]+$', '') AS grp FROM prediction")
def c18_sampling_group(spark, d):
    return table(spark, d, "prediction").select("seq_id").distinct().select("seq_id", text.sampling_group(F.col("seq_id")).alias("grp"))


@R.add("c19_tier_slug", "SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN 'full' WHEN n_nationkey < 5 THEN concat('min-', n_nationkey) WHEN n_nationkey % 25 = 0 THEN 'quarter' ELSE concat('first-', n_nationkey) END AS tier FROM nation")
def c19_tier_slug(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", F.when(k == 0, "full").when(k < 5, F.concat(F.lit("min-"), k.cast("string"))).when(k % 25 == 0, "quarter").otherwise(F.concat(F.lit("first-"), k.cast("string"))).alias("tier"))


@R.add("c20_split_list", "SELECT s_suppkey, array_to_string(list_filter(list_transform(string_split(concat(' Fps, ,', s_name, ' ,fps+trim'), ','), lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS ops FROM supplier")
def c20_split_list(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(text.split_list(F.concat(F.lit(" Fps, ,"), "s_name", F.lit(" ,fps+trim"))), "|").alias("ops"))


@R.add("c21_finite_number", "SELECT event_id, TRY_CAST(CASE event_id % 4 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN 'n/a' WHEN 2 THEN '' ELSE '12' END AS DOUBLE) AS v FROM events")
def c21_finite_number(spark, d):
    k = F.col("event_id") % 4
    return table(spark, d, "events").select("event_id", numbers.to_finite(F.when(k == 0, F.col("value").cast("string")).when(k == 1, "n/a").when(k == 2, "").otherwise("12")).alias("v"))


@R.add("c22_rate", "SELECT p_partkey, round(CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 5 = 0 THEN p_size::DOUBLE ELSE p_partkey::DOUBLE / p_size END, 6) AS rate FROM part")
def c22_rate(spark, d):
    s = F.col("p_size").cast("string")
    return table(spark, d, "part").select("p_partkey", F.round(numbers.rate(F.when(F.col("p_size") % 7 == 0, F.concat(s, F.lit("/0"))).when(F.col("p_size") % 5 == 0, s).otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit("/"), s))), 6).alias("rate"))


@R.add("c23_ratio", "SELECT p_partkey, round(CASE WHEN p_partkey > 0 AND p_size > 9 THEN p_partkey::DOUBLE / (p_size - 9) END, 6) AS ratio FROM part")
def c23_ratio(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(numbers.ratio(F.concat(F.col("p_partkey").cast("string"), F.lit(":"), (F.col("p_size") - 9).cast("string"))), 6).alias("ratio"))


@R.add("c24_fps_label", "SELECT k, CASE WHEN k % 10 = 0 THEN 'unknown' WHEN k % 10 IN (1, 2) THEN '29.97' WHEN k % 10 IN (3, 4) THEN '30' WHEN k % 10 = 5 THEN '23.976' ELSE CAST(k % 10 + 31 AS VARCHAR) END AS label FROM (SELECT s_suppkey AS k FROM supplier)")
def c24_fps_label(spark, d):
    k = F.col("k") % 10
    v = F.when(k == 0, None).when(k == 1, 29.98).when(k == 2, 29.95).when(k == 3, 30.01).when(k == 4, 30.02).when(k == 5, 23.98).otherwise(k + 31.0)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).select("k", numbers.fps_label(v.cast("double")).alias("label"))


@R.add("c25_aspect_label", f"SELECT media_id, CASE WHEN height = 0 THEN 'unknown' WHEN width = 1920 OR width = 1280 THEN '16:9' WHEN width = 320 THEN '3.56' ELSE '9:16' END AS label FROM {M}")
def c25_aspect_label(spark, d):
    return base.load(spark, d, "MEDIA").select("media_id", numbers.aspect_label(F.try_divide(F.col("width").cast("double"), F.col("height").cast("double"))).alias("label"))


@R.add("c26_orientation", f"SELECT media_id, CASE WHEN height = 0 THEN 'unknown' WHEN width::DOUBLE / height BETWEEN 0.98 AND 1.02 THEN 'square' WHEN width > height THEN 'landscape' ELSE 'portrait' END AS orientation FROM {M}")
def c26_orientation(spark, d):
    return base.load(spark, d, "MEDIA").select("media_id", numbers.orientation(F.col("width"), F.col("height")).alias("orientation"))


@R.add("c27_right_angle", "SELECT event_id, ((round_even((value * 10 - 400) / 90, 0)::BIGINT * 90) % 360 + 360)::INT % 360 AS rotation FROM events")
def c27_right_angle(spark, d):
    return table(spark, d, "events").select("event_id", numbers.right_angle(F.col("value") * 10 - 400).alias("rotation"))


@R.add("c28_pick_resolution")
def c28_pick_resolution(spark, d):
    m = base.load(spark, d, "MEDIA").filter("width > 0").select("width", "height").distinct()
    return m.select("width", "height", numbers.pick_resolution(F.col("width").cast("double"), F.col("height").cast("double"), 1280, 720).alias("r")).select("width", "height", "r.w", "r.h")


_SCALED = "greatest(2, floor(floor({} * least(1280.0 / width, 720.0 / height, 1.0) + 1e-9) / 2)::INT * 2)"


@R.add("c28_target_modes", f"""SELECT DISTINCT width, height, mode, 1280 AS w, 720 AS h, CASE WHEN mode = 'pad' THEN {_SCALED.format('width')} ELSE 1280 END AS content_w, CASE WHEN mode = 'pad' THEN {_SCALED.format('height')} ELSE 720 END AS content_h
FROM {M}, (SELECT unnest(['pad', 'resize']) AS mode) WHERE width > 0 AND height > 0""")
def c28_target_modes(spark, d):
    """Sizes of the two modes that always give the target."""
    m = base.load(spark, d, "MEDIA").filter("width > 0 AND height > 0").select("width", "height").distinct()
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    each = F.array(*[F.struct(F.lit(k).alias("mode"), numbers.target_resolution(w, h, 1280, 720, k).alias("r")) for k in ("pad", "resize")])
    return m.select("width", "height", F.inline(each)).select("width", "height", "mode", "r.*")


@R.add("c29_output_fps", f"SELECT media_id, round(least(fps, 30.0)::DOUBLE, 3) AS fps FROM {M}")
def c29_output_fps(spark, d):
    return base.load(spark, d, "MEDIA").select("media_id", F.when(F.col("fps").isNotNull(), F.round(F.least(F.col("fps"), F.lit(30.0)), 3)).otherwise(F.lit(30.0)).cast("double").alias("fps"))


@R.add("c31_intrinsics", f"SELECT media_id, round(width * 0.8 * 640 / width, 6) AS fx, round(height * 0.9 * 360 / height, 6) AS fy, round(2 * atan(width / (2 * width * 0.8)), 9) AS fov_h, round(tan(2 * atan(width / (2 * width * 0.8)) / 2), 6) AS back FROM {M} WHERE width > 0")
def c31_intrinsics(spark, d):
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    fov = numbers.focal_to_fov(w, w * 0.8)
    return base.load(spark, d, "MEDIA").filter("width > 0").select("media_id", F.round(w * 0.8 * 640 / w, 6).alias("fx"), F.round(h * 0.9 * 360 / h, 6).alias("fy"), F.round(fov, 9).alias("fov_h"), F.round(w / (2 * numbers.fov_to_focal(w, fov)), 6).alias("back"))


@R.add("c34_quaternion_matrix", "SELECT event_id, round(1 - 2 * (s * s), 6) AS m00, round(-2 * s * c, 6) AS m01, round(1 - 2 * (s * s), 6) AS m11 FROM (SELECT event_id, sin(value / 50) AS s, cos(value / 50) AS c FROM events)")
def c34_quaternion_matrix(spark, d):
    s, c = F.sin(F.col("value") / 50), F.cos(F.col("value") / 50)
    m = arrays.quaternion_matrix(F.lit(0.0), F.lit(0.0), s, c)
    return table(spark, d, "events").select("event_id", F.round(m[0], 6).alias("m00"), F.round(m[1], 6).alias("m01"), F.round(m[4], 6).alias("m11"))


_SIX = ", ".join(f"hand[{i}]::DOUBLE AS {n}" for i, n in zip(range(4, 10), ("a1", "a2", "a3", "b1", "b2", "b3"), strict=True))


@R.add("c36_six_to_matrix", f"""WITH h AS (SELECT seq_id, frame, {_SIX} FROM {NEWEST} WHERE hand_presence_logits[1] >= 0 AND len(list_filter(hand[4:9], lambda v: NOT isfinite(v) OR abs(v) >= 10)) = 0),
x AS (SELECT *, a1 / n AS x1, a2 / n AS x2, a3 / n AS x3 FROM (SELECT *, sqrt(a1 ** 2 + a2 ** 2 + a3 ** 2) AS n FROM h) WHERE n > 1e-6),
y AS (SELECT *, b1 - s * x1 AS c1, b2 - s * x2 AS c2, b3 - s * x3 AS c3 FROM (SELECT *, x1 * b1 + x2 * b2 + x3 * b3 AS s FROM x)),
z AS (SELECT *, c1 / m AS y1, c2 / m AS y2, c3 / m AS y3 FROM (SELECT *, sqrt(c1 ** 2 + c2 ** 2 + c3 ** 2) AS m FROM y) WHERE m > 1e-6)
SELECT seq_id, frame, {', '.join(f'round({e}, 4) + 0.0 AS r{i}' for i, e in enumerate(('x1', 'x2', 'x3', 'y1', 'y2', 'y3', 'x2 * y3 - x3 * y2', 'x3 * y1 - x1 * y3', 'x1 * y2 - x2 * y1')))} FROM z""")
def c36_six_to_matrix(spark, d):
    """Rotation from its first two rows, made orthonormal, in column expressions."""
    p = newest(spark, d, "hand", "hand_presence_logits").filter("get(hand_presence_logits, 0) >= 0").filter(F.forall(F.slice("hand", 4, 6), lambda v: ~F.isnan(v) & (F.abs(v) < 10)))
    v = [arrays.at(F.col("hand"), i) for i in range(3, 9)]
    p = p.select("seq_id", "frame", *[c.alias(n) for c, n in zip(v, ("a0", "a1", "a2", "b0", "b1", "b2"), strict=True)])
    col = lambda n: [F.col(f"{n}{i}") for i in range(3)]
    dot = lambda x, y: sum((i * k for i, k in zip(x, y, strict=True)), F.lit(0.0))
    p = p.withColumn("n", F.sqrt(dot(col("a"), col("a")))).filter("n > 1e-6").withColumns({f"x{i}": F.col(f"a{i}") / F.nullif(F.col("n"), F.lit(0.0)) for i in range(3)})
    p = p.withColumn("s", dot(col("x"), col("b"))).withColumns({f"c{i}": F.col(f"b{i}") - F.col("s") * F.col(f"x{i}") for i in range(3)})
    p = p.withColumn("m", F.sqrt(dot(col("c"), col("c")))).filter("m > 1e-6").withColumns({f"y{i}": F.col(f"c{i}") / F.nullif(F.col("m"), F.lit(0.0)) for i in range(3)})
    x, y = col("x"), col("y")
    z = [x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0]]
    return p.select("seq_id", "frame", *[(F.round(c, 4) + 0.0).alias(f"r{i}") for i, c in enumerate([*x, *y, *z])])



POSE = f"(SELECT seq_id, frame, extrinsic_c2w AS e FROM {NEWEST} WHERE len(list_filter(extrinsic_c2w, lambda v: NOT isfinite(v) OR abs(v) > 1000)) = 0)"


def _poses(spark, d):
    fine = F.forall("extrinsic_c2w", lambda v: ~F.isnan(v) & (F.abs(v) <= 1000))
    return newest(spark, d, "extrinsic_c2w").filter(fine).withColumnRenamed("extrinsic_c2w", "e")


@R.add("c37_project", f"SELECT seq_id, frame, z > 0.01 AS visible, round(CASE WHEN z > 0.01 THEN 500 * x / z + 320 END, 4) AS u FROM (SELECT seq_id, frame, e[4]::DOUBLE AS x, e[12]::DOUBLE AS z FROM {POSE})")
def c37_project(spark, d):
    x, y, z = (arrays.at(F.col("e"), i) for i in (3, 7, 11))
    p = arrays.project(x, y, z, F.lit(500.0), F.lit(500.0), F.lit(320.0), F.lit(240.0))
    return _poses(spark, d).select("seq_id", "frame", p.alias("p")).select("seq_id", "frame", "p.visible", F.round("p.u", 4).alias("u"))


ROT = [0, 1, 2, 4, 5, 6, 8, 9, 10]


@R.add("c39_geodesic", f"""WITH p AS (SELECT seq_id, frame, e, lag(e) OVER (PARTITION BY seq_id ORDER BY frame) AS b FROM {POSE})
SELECT seq_id, frame, round(degrees(acos(greatest(-1, least(1, ({" + ".join(f"e[{i + 1}]::DOUBLE * b[{i + 1}]::DOUBLE" for i in ROT)} - 1) / 2)))), 2) AS angle FROM p WHERE b IS NOT NULL""")
def c39_geodesic(spark, d):
    from pyspark.sql import Window

    p = _poses(spark, d).withColumn("b", F.lag("e").over(Window.partitionBy("seq_id").orderBy("frame"))).filter("b IS NOT NULL")
    return p.select("seq_id", "frame", F.round(arrays.geodesic_degrees(F.col("e"), F.col("b"), ROT), 2).alias("angle"))


@R.add("c42_sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 9) AS p FROM events")
def c42_sigmoid(spark, d):
    return table(spark, d, "events").select("event_id", F.round(numbers.sigmoid((F.col("value") - 50) / 10), 9).alias("p"))


@R.add("c43_camera_centre", f"SELECT seq_id, frame, round(-(e[1]::DOUBLE * e[4] + e[5]::DOUBLE * e[8] + e[9]::DOUBLE * e[12]), 4) + 0.0 AS cx FROM {POSE}")
def c43_camera_centre(spark, d):
    return _poses(spark, d).select("seq_id", "frame", F.round(arrays.camera_centre(F.col("e"))[0], 4).alias("cx"))


@R.add("c44_bankers_round", "SELECT event_id, round_even(value, 1) AS v, round_even(event_id / 2.0, 0)::BIGINT AS half FROM events")
def c44_bankers_round(spark, d):
    return table(spark, d, "events").select("event_id", F.bround("value", 1).alias("v"), F.bround(F.col("event_id") / 2.0).cast("long").alias("half"))


@R.add("c45_width_check", "SELECT vec_id, len(embedding) AS width, label FROM embeddings")
def c45_width_check(spark, d):
    e = table(spark, d, "embeddings")
    k = e.select(F.size("embedding")).first()[0]
    return e.select("vec_id", F.size(arrays.with_width(F.col("embedding"), k)).cast("long").alias("width"), "label")


@R.add("c46_padded", "SELECT vec_id, round(list_sum(list_resize(embedding, 20, 0)::DOUBLE[])::DOUBLE, 5) AS s, 20 AS n FROM embeddings")
def c46_padded(spark, d):
    p = arrays.padded(F.col("embedding").cast("array<double>"), 20)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(p, F.lit(0.0), lambda s, x: s + x), 5).alias("s"), F.size(p).alias("n"))


@R.add("c47_class_counts", "SELECT vec_id, len(list_filter(embedding, lambda x: x < 0)) AS below, len(list_filter(embedding, lambda x: x > 0)) AS above FROM embeddings")
def c47_class_counts(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size(F.filter("embedding", lambda x: x < 0)).cast("long").alias("below"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("above"))


@R.add("c48_segment_locator", "SELECT event_id, coalesce(CAST(json_extract(props, '$.segments.k') AS BIGINT), CAST(json_extract(props, '$.k') AS BIGINT)) AS k FROM events")
def c48_segment_locator(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.segments.k"), F.get_json_object("props", "$.k")).cast("long").alias("k"))


@R.add("c49_first_present_key", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS v FROM events")
def c49_first_present_key(spark, d):
    """The first key that is present wins, also with an explicit null."""
    p = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"task": null, '), F.substring("props", 2, 100))).otherwise(F.col("props"))
    keys = F.json_object_keys(p)
    return table(spark, d, "events").select("event_id", F.when(F.array_contains(keys, "task"), F.get_json_object(p, "$.task")).otherwise(F.get_json_object(p, "$.k")).cast("long").alias("v"))


@R.add("c50_state_normaliser", "SELECT event_id, event_type AS stage, CASE WHEN event_id % 2 = 0 THEN 'done' ELSE 'failed' END AS status FROM events")
def c50_state_normaliser(spark, d):
    """A stage state may be a bare status or an object with one."""
    raw = F.when(F.col("event_id") % 2 == 0, F.lit("done")).otherwise(F.lit('{"status": "failed", "error": "x"}'))
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("stage"), F.coalesce(F.when(raw.startswith("{"), F.get_json_object(raw, "$.status")), raw).alias("status"))


@R.add("c51_signature", "SELECT n_nationkey, sha256(concat_ws('|', n_name, n_nationkey, n_regionkey)) AS signature FROM nation")
def c51_signature(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.sha2(F.concat_ws("|", "n_name", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")), 256).alias("signature"))


@R.add("c53_inventory_digest", "SELECT kind, sha256(string_agg(h, ',' ORDER BY h)) AS digest FROM (SELECT kind, substr(sha256(file_path), 1, 1) AS b, sha256(string_agg(sha256(concat_ws(':', file_path, file_id, size_bytes)), ',' ORDER BY sha256(concat_ws(':', file_path, file_id, size_bytes)))) AS h FROM data_files GROUP BY kind, b) GROUP BY kind")
def c53_inventory_digest(spark, d):
    """Order-free digest in two levels, so that no task holds more than a sixteenth of a kind's hashes."""
    h = F.sha2(F.concat_ws(":", "file_path", F.col("file_id").cast("string"), F.col("size_bytes").cast("string")), 256)
    part = _files(spark, d).select("kind", F.substring(F.sha2("file_path", 256), 1, 1).alias("b"), h.alias("h")).groupBy("kind", "b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("h"))
    return part.groupBy("kind").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("digest"))


@R.add("c55_flatten_report", "SELECT l_returnflag AS head, l_linestatus AS dataset, metric, round(avg(v), 6) AS value FROM (SELECT l_returnflag, l_linestatus, unnest(['qty', 'tax']) AS metric, unnest([l_quantity, l_tax]) AS v FROM lineitem) GROUP BY ALL")
def c55_flatten_report(spark, d):
    tree = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("head"), F.col("l_linestatus").alias("dataset")).agg(F.create_map(F.lit("qty"), F.avg("l_quantity"), F.lit("tax"), F.avg("l_tax")).alias("m"))
    return tree.select("head", "dataset", F.explode("m").alias("metric", "value")).withColumn("value", F.round("value", 6))


@R.add("c56_data_path", "SELECT episode_index, printf('data/chunk-%03d/file-%03d.parquet', data_chunk_index, data_file_index) AS path FROM episodes")
def c56_data_path(spark, d):
    return table(spark, d, "episodes").select("episode_index", text.data_path(F.col("data_chunk_index"), F.col("data_file_index")).alias("path"))


@R.add("c57_timestamp_parse", "SELECT event_id, strptime(strftime(ts, '%Y%m%d_%H%M%S'), '%Y%m%d_%H%M%S') AS t FROM events")
def c57_timestamp_parse(spark, d):
    return table(spark, d, "events").select("event_id", F.to_timestamp_ntz(F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("yyyyMMdd_HHmmss")).alias("t"))


@R.add("m04_intrinsics_error", f"SELECT source, round(avg(abs(fov_p - fov_h) / fov_h) * 100, 6) AS fov_error FROM (SELECT source, 0.4 + (media_id % 220) / 100.0 AS fov_h, 0.45 + (media_id % 200) / 100.0 AS fov_p FROM {M}) GROUP BY source")
def m04_intrinsics_error(spark, d):
    k = F.col("media_id")
    g, p = 0.4 + (k % 220) / 100.0, 0.45 + (k % 200) / 100.0
    return base.load(spark, d, "MEDIA").groupBy("source").agg(F.round(F.avg(F.abs(p - g) / g) * 100, 6).alias("fov_error"))


NEWEST_GT = "(SELECT * FROM gtsequence QUALIFY row_number() OVER (PARTITION BY seq_id, frame ORDER BY ingested_at DESC) = 1)"
GT = f"(SELECT * FROM {NEWEST_GT} WHERE hand_valid AND len(list_filter(hand_joints_3d, lambda v: NOT isfinite(v) OR abs(v) > 100)) = 0)"


def _joints(spark, d):
    """The joints of the frames whose counting row, the newest, has a valid hand with finite numbers."""
    g = table(spark, d, "gtsequence").groupBy("seq_id", "frame").agg(F.max_by(F.struct("source", "hand_joints_3d", "hand_valid"), "ingested_at").alias("m")).select("seq_id", "frame", "m.*")
    return g.filter(F.col("hand_valid") & F.forall("hand_joints_3d", lambda v: ~F.isnan(v) & (F.abs(v) <= 100))).select("seq_id", "frame", "source", F.col("hand_joints_3d").alias("j"))


@R.add("m12_parameter_terms", f"SELECT source, round(sum(abs(hand_presence_logits[1]) * (hand_presence_logits[1] >= 0)::INT)::DOUBLE / greatest(sum((hand_presence_logits[1] >= 0)::INT), 1), 4) AS term FROM {NEWEST} WHERE isfinite(hand_presence_logits[1]) GROUP BY source")
def m12_parameter_terms(spark, d):
    from frameloom.operators.profile import masked_mean

    v = F.get("hand_presence_logits", F.lit(0)).cast("double")
    return newest(spark, d, "hand_presence_logits", "source").filter(~F.isnan(v) & (F.abs(v) < float("inf"))).groupBy("source").agg(F.round(masked_mean(F.abs(v), v >= 0), 4).alias("term"))


@R.add("u10_weighted_terms", "SELECT l_returnflag AS run, round(avg(1.0 * l_quantity + 0.5 * l_tax + 0.1 * l_discount), 6) AS loss FROM lineitem GROUP BY 1")
def u10_weighted_terms(spark, d):
    weights = {"l_quantity": 1.0, "l_tax": 0.5, "l_discount": 0.1}
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run")).agg(F.round(F.avg(total), 6).alias("loss"))


@R.add("g29_mirror", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v, i: CASE WHEN (i - 1) % 3 = 0 THEN v::DOUBLE ELSE -v::DOUBLE END)), 5) AS s FROM embeddings")
def g29_mirror(spark, d):
    m = arrays.mirrored(F.col("embedding").cast("array<double>"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(m, F.lit(0.0), lambda s, x: s + x), 5).alias("s"))


@R.add("g30_normalised_error", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: (v::DOUBLE / 0.1) ** 2))), 4) AS e FROM embeddings")
def g30_normalised_error(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(arrays.norm(F.transform(F.col("embedding").cast("array<double>"), lambda v: v / 0.1)), 4).alias("e"))


@R.add("g32_rotation_health", f"SELECT count(*) AS n, round(avg(abs(sqrt(e[1]::DOUBLE ** 2 + e[2]::DOUBLE ** 2 + e[3]::DOUBLE ** 2) - 1)), 5) AS length_error, round(avg(abs(e[1]::DOUBLE * e[5] + e[2]::DOUBLE * e[6] + e[3]::DOUBLE * e[7])), 5) AS angle_error FROM {POSE}")
def g32_rotation_health(spark, d):
    e = lambda i: arrays.at(F.col("e"), i)
    size = F.sqrt(e(0) * e(0) + e(1) * e(1) + e(2) * e(2))
    return _poses(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(size - 1)), 5).alias("length_error"), F.round(F.avg(F.abs(e(0) * e(4) + e(1) * e(5) + e(2) * e(6))), 5).alias("angle_error"))


@R.add("g35_term_window", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 2 WHEN contains(p_name, 'bolt') THEN 3 ELSE 1 END AS win FROM part")
def g35_term_window(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.when(n.contains("ring"), 2).when(n.contains("bolt"), 3).otherwise(1).alias("win"))
