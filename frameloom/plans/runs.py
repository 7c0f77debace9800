"""Queries on run state, verification, predicates and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frameloom.operators import manifest, verify
from frameloom.plans import base
from frameloom.plans.base import NEWEST, newest
from frameloom.plans.registry import Registry
from frameloom.session import table

R = Registry()
ST = base.sql("STAGES")
M = base.sql("MEDIA")

LATEST = f"SELECT scene, clip_idx, stage, arg_max(status, (ts, event_id)) AS status, count(*) FILTER (WHERE status = 'running') AS attempts FROM {ST} GROUP BY scene, clip_idx, stage"


def _latest(spark, d):
    return manifest.latest(base.load(spark, d, "STAGES"), ["scene", "clip_idx", "stage"], ["ts", "event_id"], ["status", "error"])


@R.add("t06_latest_state", f"{LATEST}")
def t06_latest_state(spark, d):
    return _latest(spark, d).drop("error")


@R.add("t07_mark_transitions", f"SELECT scene, clip_idx, stage, min(ts) FILTER (WHERE status = 'running') AS started_at, max(ts) FILTER (WHERE status IN ('done', 'failed', 'skipped')) AS finished_at, count(*) FILTER (WHERE status = 'failed') AS failures FROM {ST} GROUP BY scene, clip_idx, stage")
def t07_mark_transitions(spark, d):
    s = F.col("status")
    return base.load(spark, d, "STAGES").groupBy("scene", "clip_idx", "stage").agg(F.min(F.when(s == "running", F.col("ts"))).alias("started_at"), F.max(F.when(s.isin("done", "failed", "skipped"), F.col("ts"))).alias("finished_at"), F.count_if(s == "failed").alias("failures"))


@R.add("t08_crash_rollback", f"SELECT scene, clip_idx, stage, CASE WHEN status = 'running' THEN 'pending' ELSE status END AS status FROM ({LATEST})")
def t08_crash_rollback(spark, d):
    return manifest.roll_back(_latest(spark, d)).select("scene", "clip_idx", "stage", "status")


VIDEO = f"SELECT scene, arg_max(status, (ts, event_id)) AS status FROM {ST} GROUP BY scene"
INVENTORY = "SELECT DISTINCT concat('scene_', CAST(c_custkey % 200 AS VARCHAR)) AS scene FROM customer WHERE c_custkey % 200 <> 7"


@R.add("f10_reconcile", f"""SELECT coalesce(i.scene, s.scene) AS scene, CASE WHEN i.scene IS NULL THEN 'missing' WHEN status = 'skipped' THEN 'skipped' WHEN status = 'done' THEN 'done' WHEN status = 'failed' THEN 'failed' ELSE 'pending' END AS decision
FROM ({INVENTORY}) i FULL JOIN ({VIDEO}) s ON s.scene = i.scene""")
def f10_reconcile(spark, d):
    inventory = table(spark, d, "customer").filter("c_custkey % 200 <> 7").select(F.concat(F.lit("scene_"), (F.col("c_custkey") % 200).cast("string")).alias("scene"))
    state = manifest.latest(base.load(spark, d, "STAGES"), ["scene"], ["ts", "event_id"], ["status"])
    return manifest.reconcile(inventory, state, "scene")


@R.add("a36_status_counts", f"SELECT s.status, count(v.scene) AS n FROM (VALUES ('pending'), ('running'), ('done'), ('failed'), ('skipped')) s(status) LEFT JOIN ({VIDEO}) v ON v.status = s.status GROUP BY s.status")
def a36_status_counts(spark, d):
    return manifest.status_counts(manifest.latest(base.load(spark, d, "STAGES"), ["scene"], ["ts", "event_id"], ["status"]))


@R.add("a37_video_roll_up", f"""SELECT scene, CASE WHEN count(*) FILTER (WHERE status IN ('pending', 'running')) > 0 THEN 'unchanged' WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (WHERE status = 'done') > 0 THEN 'done' ELSE 'skipped' END AS status
FROM (SELECT scene, clip_idx, arg_max(status, (ts, event_id)) AS status FROM {ST} GROUP BY scene, clip_idx) GROUP BY scene""")
def a37_video_roll_up(spark, d):
    clips = manifest.latest(base.load(spark, d, "STAGES"), ["scene", "clip_idx"], ["ts", "event_id"], ["status"])
    return manifest.roll_up(clips, "scene")


@R.add("a38_all_stages_done", f"SELECT scene, clip_idx FROM ({LATEST}) WHERE status = 'done' AND stage IN ('geo', 'depth', 'hands', 'slam') GROUP BY scene, clip_idx HAVING count(DISTINCT stage) = 4")
def a38_all_stages_done(spark, d):
    return manifest.all_done(_latest(spark, d), ["scene", "clip_idx"], manifest.STAGES)


@R.add("g08_videos_all_done", f"SELECT scene FROM (SELECT scene, clip_idx FROM ({LATEST}) WHERE status = 'done' AND stage IN ('geo', 'depth') GROUP BY scene, clip_idx HAVING count(DISTINCT stage) = 2) GROUP BY scene HAVING count(*) = 3")
def g08_videos_all_done(spark, d):
    done = manifest.all_done(_latest(spark, d), ["scene", "clip_idx"], ["geo", "depth"])
    return done.groupBy("scene").agg(F.count(F.lit(1)).alias("n")).filter("n = 3").select("scene")


@R.add("a39_parent_completion", f"SELECT scene, 3 AS expected, count(DISTINCT clip_idx) FILTER (WHERE status = 'done' AND stage = 'slam') AS finished FROM ({LATEST}) GROUP BY scene")
def a39_parent_completion(spark, d):
    done = (F.col("status") == "done") & (F.col("stage") == "slam")
    return _latest(spark, d).groupBy("scene").agg(F.lit(3).alias("expected"), F.count_distinct(F.when(done, F.col("clip_idx"))).alias("finished"))


@R.add("a43_run_summary", f"SELECT count(*) FILTER (WHERE status = 'done') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS total FROM ({VIDEO})")
def a43_run_summary(spark, d):
    s = manifest.latest(base.load(spark, d, "STAGES"), ["scene"], ["ts", "event_id"], ["status"])
    return s.agg(F.count_if(F.col("status") == "done").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.count(F.lit(1)).alias("total"))


@R.add("g07_stage_lookup", f"SELECT scene, clip_idx FROM ({LATEST}) WHERE stage = 'hands' AND status = 'done'")
def g07_stage_lookup(spark, d):
    return _latest(spark, d).filter("stage = 'hands' AND status = 'done'").select("scene", "clip_idx")


@R.add("g09_resume_map", f"SELECT scene, clip_idx, array_to_string(list_sort(list(DISTINCT stage)), ',') AS stages FROM ({LATEST}) WHERE status = 'done' GROUP BY scene, clip_idx")
def g09_resume_map(spark, d):
    return manifest.resume_map(_latest(spark, d), ["scene", "clip_idx"]).withColumn("stages", F.array_join("stages", ","))


@R.add("g10_keys_by_status", f"SELECT scene FROM ({VIDEO}) WHERE status IN ('failed', 'running')")
def g10_keys_by_status(spark, d):
    return manifest.latest(base.load(spark, d, "STAGES"), ["scene"], ["ts", "event_id"], ["status"]).filter(F.col("status").isin("failed", "running")).select("scene")


@R.add("g11_drop_done_clips", f"SELECT c.scene, c.clip_idx, c.stage, c.status FROM ({LATEST}) c WHERE c.scene NOT IN (SELECT scene FROM ({VIDEO}) WHERE status = 'done')")
def g11_drop_done_clips(spark, d):
    done = manifest.latest(base.load(spark, d, "STAGES"), ["scene"], ["ts", "event_id"], ["status"]).filter("status = 'done'")
    return _latest(spark, d).join(done, "scene", "left_anti").select("scene", "clip_idx", "stage", "status")


BRANCH = "SELECT concat(scene, '_', CAST(clip_idx AS VARCHAR)) AS scene, count(*) AS n, max(error) AS error, min(event_id) AS first_id, array_to_string(list_sort(list(event_id))[1:3], ',') AS events FROM {st} WHERE stage = '{stage}' GROUP BY 1"


def _branch(spark, d, stage):
    e = base.load(spark, d, "STAGES").filter(F.col("stage") == stage)
    return e.groupBy(F.concat("scene", F.lit("_"), F.col("clip_idx").cast("string")).alias("scene")).agg(F.count(F.lit(1)).alias("n"), F.max("error").alias("error"), F.min("event_id").alias("first_id"), F.slice(F.sort_array(F.collect_list("event_id")), 1, 3).alias("events"))


@R.add("j02_dependency_join", f"""SELECT b.scene, b.n, b.first_id, a.n AS a_n, coalesce(a.error, b.error) AS error, concat(a.events, ',', b.events) AS events
FROM ({BRANCH.format(st=ST, stage='geo')}) a JOIN ({BRANCH.format(st=ST, stage='depth')}) b ON a.scene = b.scene""")
def j02_dependency_join(spark, d):
    a = _branch(spark, d, "geo").withColumnRenamed("n", "a_n")
    return manifest.dependency_join(a, _branch(spark, d, "depth"), "scene", ["a_n"]).withColumn("events", F.array_join("events", ","))


@R.add("j03_unmatched_errors", f"""WITH a AS ({BRANCH.format(st=ST, stage='geo')}), b AS ({BRANCH.format(st=ST, stage='final')} HAVING count(*) > 5)
SELECT scene, error, 'a' AS branch FROM a WHERE error IS NOT NULL AND scene NOT IN (SELECT scene FROM b) UNION ALL SELECT scene, error, 'b' FROM b WHERE error IS NOT NULL AND scene NOT IN (SELECT scene FROM a)""")
def j03_unmatched_errors(spark, d):
    return manifest.unmatched_errors(_branch(spark, d, "geo"), _branch(spark, d, "final").filter("n > 5"), "scene")


# Verification of outputs

SOURCES = f"SELECT media_id, max(duration_sec)::DOUBLE AS duration, floor(max(duration_sec) * 30)::BIGINT AS frames, CASE WHEN media_id % 101 = 0 THEN 'unreadable' END AS error FROM {M} GROUP BY media_id"


def _sources(spark, d):
    m = base.load(spark, d, "MEDIA").groupBy("media_id").agg(F.max("duration_sec").alias("duration_sec"))
    s = m.select("media_id", F.col("duration_sec").cast("double").alias("duration"), F.floor(F.col("duration_sec") * 30).cast("long").alias("frames"), F.when(F.col("media_id") % 101 == 0, "unreadable").alias("error"))
    return s.withColumns({"fps": F.lit(30.0), "width": F.lit(1280), "height": F.lit(720)})


EXPECTED = f"""SELECT media_id, unnest(range(0, n)) AS segment, duration FROM (SELECT media_id, duration, (floor((duration + 0.5) / 600)::BIGINT + CASE WHEN duration - floor((duration + 0.5) / 600) * 600 >= 1 OR floor((duration + 0.5) / 600) = 0 THEN 1 ELSE 0 END) AS n FROM ({SOURCES}))"""


@R.add("c30_expected_segments", f"SELECT media_id, segment, segment * 600.0 AS start, round(least((segment + 1) * 600.0, duration), 6) AS stop FROM ({EXPECTED})")
def c30_expected_segments(spark, d):
    e = verify.expected_segments(_sources(spark, d), "media_id", "duration", 600.0, 1.0)
    return e.select("media_id", "segment", "start", F.round("stop", 6).alias("stop"))


def _segments(spark, d):
    """Produced segments with every kind of fault, from the expected ones."""
    e = verify.expected_segments(_sources(spark, d), "media_id", "duration", 600.0, 1.0)
    k = F.col("media_id") % 23
    made = e.filter((k != 1) & ((k != 2) | (F.col("segment") > 0)))
    size = F.col("stop") - F.col("start")
    return made.select(
        "media_id", "segment",
        (size + F.when(k == 5, 30.0).otherwise(0.0)).alias("duration"), (F.floor(size * 30) + F.when(k == 4, 900).otherwise(0)).alias("frames"),
        F.when(k == 6, 25.0).otherwise(30.0).alias("fps"), F.when(k == 7, 640).otherwise(1280).alias("width"), F.lit(720).alias("height"), F.when((k == 8) & (F.col("segment") == 0), "broken").alias("error"),
    )


@R.add("f15_verify_segments", f"""WITH e AS ({EXPECTED}), s AS (SELECT media_id, segment, least((segment + 1) * 600.0, duration) - segment * 600.0 AS size, media_id % 23 AS k FROM e WHERE media_id % 23 <> 1 AND (media_id % 23 <> 2 OR segment > 0)),
g AS (SELECT media_id, count(*) AS n, any_value(k) AS k, sum(size + CASE WHEN k = 5 THEN 30 ELSE 0 END) AS d, sum(floor(size * 30) + CASE WHEN k = 4 THEN 900 ELSE 0 END) AS f, count(*) FILTER (WHERE k = 8 AND segment = 0) AS bad FROM s GROUP BY media_id),
x AS (SELECT media_id, count(*) AS expected FROM e GROUP BY media_id)
SELECT q.media_id, CASE WHEN error IS NOT NULL OR duration IS NULL THEN 'probe_src' WHEN n IS NULL THEN 'miss' WHEN n < expected THEN 'seg_miss' WHEN bad > 0 THEN 'probe_out' WHEN abs(f - frames) > greatest(5, frames * 0.01) THEN 'frames'
  WHEN abs(d - duration) > greatest(1, duration * 0.01) THEN 'duration' WHEN k = 6 THEN 'fps' WHEN k = 7 THEN 'resolution' ELSE 'ok' END AS status
FROM ({SOURCES}) q LEFT JOIN x ON x.media_id = q.media_id LEFT JOIN g ON g.media_id = q.media_id""")
def f15_verify_segments(spark, d):
    n = verify.expected_segments(_sources(spark, d), "media_id", "duration", 600.0, 1.0).groupBy("media_id").agg(F.count(F.lit(1)).alias("expected"))
    return verify.verify_segments(_sources(spark, d).join(n, "media_id", "left"), _segments(spark, d), "media_id")


@R.add("f16_totals_check", f"""WITH t AS (SELECT o_custkey % 50 AS k, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) SELECT k, n, CASE WHEN abs(n - 300) > greatest(20, 3) THEN 'count' WHEN abs(total - 75000000) > 7500000 THEN 'total' ELSE 'ok' END AS status FROM t""")
def f16_totals_check(spark, d):
    t = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return t.select("k", "n", F.when(F.abs(F.col("n") - 300) > 20, "count").when(F.abs(F.col("total") - 75e6) > 7.5e6, "total").otherwise("ok").alias("status"))


@R.add("f17_overlap_status", """WITH s AS (SELECT user_id, event_id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS a, value * 60 AS len FROM events WHERE event_type = 'view'),
p AS (SELECT *, lag(a + len) OVER (PARTITION BY user_id ORDER BY a, a + len) AS before FROM s) SELECT user_id, event_id FROM p WHERE a < before - 1e-3""")
def f17_overlap_status(spark, d):
    a = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), F.col("ts")) / 1e6
    s = table(spark, d, "events").filter("event_type = 'view'").select("user_id", "event_id", a.alias("a"), (a + F.col("value") * 60).alias("b"))
    return verify.overlaps(s, ["user_id"], "a", "b").select("user_id", "event_id")


@R.add("f19_orphans", "SELECT DISTINCT f.episode_index FROM data_files f ANTI JOIN episodes e ON e.episode_index = f.episode_index AND e.length > 0")
def f19_orphans(spark, d):
    return table(spark, d, "data_files").select("episode_index").distinct().join(table(spark, d, "episodes").filter("length > 0"), "episode_index", "left_anti")


@R.add("f13_segment_clamp", """SELECT episode_index, u.atomic_index, greatest(0, least(u.start_frame - 20, length - 100)) AS start, greatest(0, least(u.end_frame, length - 100)) AS stop
FROM (SELECT episode_index, length, unnest(atomic_segments) AS u FROM episodes) WHERE u.end_frame > u.start_frame - 20 AND greatest(0, least(u.end_frame, length - 100)) > greatest(0, least(u.start_frame - 20, length - 100))""")
def f13_segment_clamp(spark, d):
    e = table(spark, d, "episodes").select("episode_index", (F.col("length") - 100).alias("total"), F.explode("atomic_segments").alias("u"))
    s = e.select("episode_index", "u.atomic_index", (F.col("u.start_frame") - 20).alias("start"), F.col("u.end_frame").alias("stop"), "total")
    return verify.clamp_segments(s, "start", "stop", "total").drop("total")


@R.add("f03_length_filter", "SELECT episode_index, length FROM episodes WHERE length >= 450")
def f03_length_filter(spark, d):
    return table(spark, d, "episodes").filter("length >= 450").select("episode_index", "length")


@R.add("f08_label_semi_join", "SELECT doc_id FROM documents d SEMI JOIN episodes e ON e.episode_index = d.episode_index AND e.length > 600")
def f08_label_semi_join(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "episodes").filter("length > 600"), "episode_index", "left_semi").select("doc_id")


@R.add("f09_candidate_labels", "SELECT DISTINCT episode_index FROM (SELECT episode_index, unnest([file_path, replace(file_path, '.parquet', '.mp4')]) AS p FROM data_files WHERE kind = 'parquet') c SEMI JOIN (SELECT DISTINCT file_path FROM data_files WHERE n_records > 0) f ON f.file_path = c.p")
def f09_candidate_labels(spark, d):
    f = table(spark, d, "data_files")
    c = f.filter("kind = 'parquet'").select("episode_index", F.explode(F.array("file_path", F.replace(F.col("file_path"), F.lit(".parquet"), F.lit(".mp4")))).alias("p"))
    have = f.filter("n_records > 0").select(F.col("file_path").alias("p")).distinct()
    return c.join(have, "p", "left_semi").select("episode_index").distinct()


@R.add("f11_capability_match", "SELECT s_suppkey, h.head FROM (SELECT s_suppkey, list_filter(['pose', CASE WHEN s_suppkey % 2 = 0 THEN 'depth' END, CASE WHEN s_suppkey % 3 = 0 THEN 'hands' END], lambda x: x IS NOT NULL) AS have FROM supplier) s, (VALUES ('extrinsics', ['pose']), ('depth', ['pose', 'depth']), ('world', ['pose', 'hands', 'depth'])) h(head, need) WHERE list_has_all(have, need)")
def f11_capability_match(spark, d):
    k = F.col("s_suppkey")
    have = F.array_compact(F.array(F.lit("pose"), F.when(k % 2 == 0, "depth"), F.when(k % 3 == 0, "hands")))
    need = {"extrinsics": ["pose"], "depth": ["pose", "depth"], "world": ["pose", "hands", "depth"]}
    heads = F.array(*[F.when(F.size(F.array_except(F.array(*[F.lit(x) for x in v]), F.col("have"))) == 0, F.lit(h)) for h, v in need.items()])
    return table(spark, d, "supplier").select("s_suppkey", have.alias("have")).select("s_suppkey", F.explode(F.array_compact(heads)).alias("head"))


@R.add("f12_group_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM (SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderkey)) AS g FROM orders GROUP BY o_custkey) WHERE g BETWEEN 11 AND 30)")
def f12_group_range(spark, d):
    """A range of sequences that never splits a group: groups in order of first appearance, counted, then joined back."""
    o = table(spark, d, "orders")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    picked = first.orderBy("first").offset(10).limit(20).select("o_custkey")
    return o.join(F.broadcast(picked), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@R.add("f22_complete_reports", "SELECT n.n_regionkey AS region, bool_and(c.n_nationkey IS NOT NULL) AS complete FROM nation n LEFT JOIN (SELECT DISTINCT c_nationkey AS n_nationkey FROM customer WHERE c_acctbal > 9500) c ON c.n_nationkey = n.n_nationkey GROUP BY 1")
def f22_complete_reports(spark, d):
    have = table(spark, d, "customer").filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("n_nationkey"), F.lit(True).alias("have")).distinct()
    return table(spark, d, "nation").join(have, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("region")).agg(F.bool_and(F.col("have").isNotNull()).alias("complete"))


RULES = {"email": r"[a-z0-9._]+@[a-z0-9]+\.[a-z]+", "scene_id": r"scene=[0-9]{5}", "memory": r"mem=[0-9]+MiB", "retry": r"\(retry\)"}


@R.add("f23_text_audit", "SELECT doc_id, r.rule FROM documents, (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in RULES.items()) + ") r(rule, pattern) WHERE regexp_matches(text, r.pattern)")
def f23_text_audit(spark, d):
    return verify.scan_rules(table(spark, d, "documents").select("doc_id", "text"), "text", RULES).select("doc_id", "rule")


@R.add("j19_rules_by_lines", "SELECT rule, count(*) AS lines FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in RULES.items()) + ") r(rule, pattern) WHERE regexp_matches(line, r.pattern) GROUP BY rule")
def j19_rules_by_lines(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return verify.scan_rules(lines, "line", RULES).groupBy("rule").agg(F.count(F.lit(1)).alias("lines"))


@R.add("f25_presence", f"SELECT seq_id, frame, CASE WHEN hand_presence_logits[1] IS NOT NULL AND NOT isnan(hand_presence_logits[1]) THEN hand_presence_logits[1] >= 0 ELSE ts % 1 >= 0.5 END AS present FROM {NEWEST}")
def f25_presence(spark, d):
    logit = F.get("hand_presence_logits", F.lit(0))
    return newest(spark, d, "hand_presence_logits", "ts").select("seq_id", "frame", F.when(logit.isNotNull() & ~F.isnan(logit), logit >= 0).otherwise(F.col("ts") % 1 >= 0.5).alias("present"))


@R.add("f27_finite_rows", f"SELECT source, count(*) AS n, count(*) FILTER (WHERE len(list_filter(extrinsic_c2w, lambda v: NOT isfinite(v))) = 0) AS finite_rows FROM {NEWEST} GROUP BY source")
def f27_finite_rows(spark, d):
    fine = F.forall("extrinsic_c2w", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    return newest(spark, d, "extrinsic_c2w", "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(fine).alias("finite_rows"))


@R.add("k11_duplicate_targets", "SELECT target, count(*) AS n FROM (SELECT regexp_replace(file_path, '-r[0-9]+', '') AS target FROM data_files) GROUP BY target HAVING count(*) > 1")
def k11_duplicate_targets(spark, d):
    return verify.duplicate_targets(table(spark, d, "data_files").select(F.regexp_replace("file_path", "-r[0-9]+", "").alias("target")), "target")


@R.add("s31_frame_audit", """WITH e AS (SELECT seq_id, count(DISTINCT frame) AS n FROM prediction GROUP BY seq_id), a AS (SELECT seq_id, count(DISTINCT frame) AS n FROM gtsequence GROUP BY seq_id)
SELECT coalesce(e.seq_id, a.seq_id) AS seq_id, e.n AS expected, a.n AS actual, CASE WHEN a.n IS NULL THEN 'missing' WHEN e.n IS NULL THEN 'extra' WHEN a.n <> e.n THEN 'count' END AS issue FROM e FULL JOIN a ON a.seq_id = e.seq_id""")
def s31_frame_audit(spark, d):
    n = lambda t: table(spark, d, t).select("seq_id", "frame").distinct().groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    return verify.audit_counts(n("prediction"), n("gtsequence"), "seq_id")


@R.add("f21_external_audit", """SELECT seq_id, issue, count(*) AS n FROM (SELECT seq_id, CASE WHEN hand IS NULL THEN 'no_hand' WHEN len(hand) <> 218 THEN 'hand_shape' WHEN extrinsic_c2w IS NULL THEN 'no_pose' WHEN len(extrinsic_c2w) <> 16 THEN 'pose_shape' WHEN len(list_filter(extrinsic_c2w, lambda v: NOT isfinite(v))) > 0 THEN 'not_finite' END AS issue FROM prediction) WHERE issue IS NOT NULL GROUP BY ALL""")
def f21_external_audit(spark, d):
    bad = F.exists("extrinsic_c2w", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    issue = F.when(F.col("hand").isNull(), "no_hand").when(F.size("hand") != 218, "hand_shape").when(F.col("extrinsic_c2w").isNull(), "no_pose").when(F.size("extrinsic_c2w") != 16, "pose_shape").when(bad, "not_finite")
    return table(spark, d, "prediction").select("seq_id", issue.alias("issue")).filter("issue IS NOT NULL").groupBy("seq_id", "issue").agg(F.count(F.lit(1)).alias("n"))


# Joins

@R.add("j01_metadata_files", """WITH m AS (SELECT data_chunk_index, data_file_index, min(dataset_from_index) AS file_start FROM episodes GROUP BY ALL)
SELECT e.episode_index, e.dataset_from_index - file_start AS offset_in_file FROM episodes e JOIN m USING (data_chunk_index, data_file_index)""")
def j01_metadata_files(spark, d):
    e = table(spark, d, "episodes").select("episode_index", "data_chunk_index", "data_file_index", "dataset_from_index")
    w = Window.partitionBy("data_chunk_index", "data_file_index")  # a file has a bounded number of episodes
    return e.select("episode_index", (F.col("dataset_from_index") - F.min("dataset_from_index").over(w)).alias("offset_in_file"))


@R.add("j05_interval_overlap", """WITH a AS (SELECT episode_index, length, unnest(atomic_segments) AS u FROM episodes), m AS (SELECT episode_index, length // 4 AS s, length // 2 AS e FROM episodes)
SELECT a.episode_index, a.u.atomic_index AS atomic_index, greatest(s, a.u.start_frame) AS start, least(e, a.u.end_frame) AS stop, row_number() OVER (PARTITION BY a.episode_index ORDER BY a.u.atomic_index) - 1 AS ordinal FROM a JOIN m ON m.episode_index = a.episode_index AND greatest(s, a.u.start_frame) < least(e, a.u.end_frame)""")
def j05_interval_overlap(spark, d):
    """The merged segment lies in the same row as its atomic ones: no join, an array expression."""
    s, e = F.expr("length div 4"), F.expr("length div 2")
    x = table(spark, d, "episodes").select("episode_index", s.alias("s"), e.alias("e"), "atomic_segments")
    clip = F.array_sort(F.transform("atomic_segments", lambda u: F.struct(u["atomic_index"].alias("atomic_index"), F.greatest(F.col("s"), u["start_frame"]).alias("start"), F.least(F.col("e"), u["end_frame"]).alias("stop"))))
    hit = F.filter(clip, lambda u: u["start"] < u["stop"])
    return x.select("episode_index", F.posexplode(hit).alias("ordinal", "u")).select("episode_index", "u.atomic_index", "u.start", "u.stop", F.col("ordinal").cast("long"))


@R.add("j05_last_atomic_wins", """WITH a AS (SELECT episode_index, unnest(atomic_segments) AS u FROM episodes), f AS (SELECT episode_index, u.atomic_index AS ai, u.task_index AS ti, unnest(range(u.start_frame // 50, (u.end_frame - 1) // 50 + 1)) AS cell FROM a WHERE u.end_frame > u.start_frame)
SELECT episode_index, cell, arg_max(ti, ai) AS task_index FROM f GROUP BY episode_index, cell""")
def j05_last_atomic_wins(spark, d):
    a = table(spark, d, "episodes").select("episode_index", F.explode("atomic_segments").alias("u")).filter("u.end_frame > u.start_frame")
    cells = a.select("episode_index", "u.atomic_index", "u.task_index", F.explode(F.expr("sequence(u.start_frame div 50, (u.end_frame - 1) div 50)")).alias("cell"))
    return cells.groupBy("episode_index", "cell").agg(F.max_by("task_index", "atomic_index").alias("task_index"))


@R.add("j08_semi", "SELECT c_custkey FROM customer c SEMI JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000")
def j08_semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@R.add("j09_anti", "SELECT c_custkey FROM customer c ANTI JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000")
def j09_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@R.add("j10_existing_files", "SELECT e.episode_index FROM episodes e SEMI JOIN (SELECT DISTINCT episode_index FROM data_files WHERE kind = 'video') f ON f.episode_index = e.episode_index")
def j10_existing_files(spark, d):
    have = table(spark, d, "data_files").filter("kind = 'video'").select("episode_index").distinct()
    return table(spark, d, "episodes").join(have, "episode_index", "left_semi").select("episode_index")


@R.add("j11_fallback_chain", """WITH c AS (SELECT o_orderkey, unnest([o_custkey * 7, o_custkey * 3, o_custkey]) AS k, unnest([0, 1, 2]) AS pos FROM orders)
SELECT o_orderkey, arg_min(c_custkey, pos) AS label, min(pos) AS pos FROM c JOIN customer ON c_custkey = k WHERE c_acctbal > 5000 GROUP BY o_orderkey""")
def j11_fallback_chain(spark, d):
    k = F.col("o_custkey")
    c = table(spark, d, "orders").select("o_orderkey", F.posexplode(F.array(k * 7, k * 3, k)).alias("pos", "c_custkey"))
    return c.join(table(spark, d, "customer").filter("c_acctbal > 5000"), "c_custkey").groupBy("o_orderkey").agg(F.min_by("c_custkey", "pos").alias("label"), F.min("pos").alias("pos"))


@R.add("j12_positional", """WITH a AS (SELECT episode_index, unnest(tasks) AS task, unnest(range(0, len(tasks))) AS i FROM episodes), c AS (SELECT episode_index, unnest([0, 1, 2]) AS clip FROM episodes)
SELECT c.episode_index, clip, coalesce(task, 'null') AS task FROM c LEFT JOIN a ON a.episode_index = c.episode_index AND i = clip""")
def j12_positional(spark, d):
    c = table(spark, d, "episodes").select("episode_index", "tasks", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("clip"))
    return c.select("episode_index", "clip", F.coalesce(F.get("tasks", F.col("clip")), F.lit("null")).alias("task"))


@R.add("j13_nearest_value", """WITH c AS (SELECT p_partkey, p_size, unnest([10, 20, 30, 45]) AS n FROM part) SELECT p_partkey, n FROM c QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN abs(n - p_size) <= 2 THEN 0 ELSE 1 END, CASE WHEN abs(n - p_size) <= 2 THEN abs(n - p_size) END, n DESC) = 1""")
def j13_nearest_value(spark, d):
    """The value within the tolerance that is nearest, else the largest."""
    options = F.array(*[F.struct(F.when(F.abs(F.lit(n) - F.col("p_size")) <= 2, F.abs(F.lit(n) - F.col("p_size"))).otherwise(F.lit(10**6)).alias("off"), F.lit(-n).alias("neg")) for n in (10, 20, 30, 45)])
    return table(spark, d, "part").select("p_partkey", (-F.array_min(options)["neg"]).alias("n"))


@R.add("j14_fixed_split", "SELECT ordinal, n_nationkey, n_name FROM (VALUES (0, 7), (1, 3), (2, 21)) s(ordinal, k) JOIN nation ON n_nationkey = k")
def j14_fixed_split(spark, d):
    from frameloom.operators.sampling import fixed_split

    return fixed_split(table(spark, d, "nation"), "n_nationkey", [7, 3, 21]).select("ordinal", "n_nationkey", "n_name")


@R.add("j15_task_remap", "WITH n AS (SELECT text, row_number() OVER (ORDER BY text) - 1 AS new_index FROM (SELECT DISTINCT __index_level_0__ AS text FROM tasks WHERE __index_level_0__ IS NOT NULL)) SELECT DISTINCT t.task_index, new_index FROM tasks t JOIN n ON n.text = t.__index_level_0__")
def j15_task_remap(spark, d):
    from frameloom.operators.skew import two_level_rank

    t = table(spark, d, "tasks").filter("`__index_level_0__` IS NOT NULL").select("task_index", F.col("__index_level_0__").alias("text")).distinct()
    new = two_level_rank(t.select("text").distinct().withColumn("all", F.lit(0)), ["all"], [F.col("text")], F.substring("text", 1, 2), "rank")
    return t.join(new.select("text", (F.col("rank") - 1).alias("new_index")), "text").select("task_index", "new_index")


@R.add("j17_newest_report", "SELECT o_custkey AS signature, o_orderkey AS report FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def j17_newest_report(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("signature")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("report"))


@R.add("j18_model_metric_grid", """WITH v AS (SELECT s_nationkey AS model, s_suppkey % 6 AS metric, avg(s_acctbal) AS v FROM supplier GROUP BY ALL)
SELECT m.model, k.metric, round(coalesce(v, 1.0), 6) AS loss FROM (SELECT DISTINCT model FROM v) m CROSS JOIN (SELECT DISTINCT metric FROM v) k LEFT JOIN v ON v.model = m.model AND v.metric = k.metric""")
def j18_model_metric_grid(spark, d):
    """Every model with every metric: the grid of two dimension tables of a few rows each, filled with the worst loss."""
    v = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("model"), (F.col("s_suppkey") % 6).alias("metric")).agg(F.avg("s_acctbal").alias("v"))
    seen = v.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("metric", "v"))).alias("of"))
    metrics = v.agg(F.collect_set("metric").alias("metrics"))
    grid = seen.join(F.broadcast(metrics)).select("model", "of", F.explode("metrics").alias("metric"))
    return grid.select("model", "metric", F.round(F.coalesce(F.try_element_at("of", F.col("metric")), F.lit(1.0)), 6).alias("loss"))


@R.add("j20_expected_external", """WITH e AS (SELECT n_nationkey AS k, n_name FROM nation), a AS (SELECT c_nationkey + 5 AS k, count(*) AS n FROM customer GROUP BY 1)
SELECT coalesce(e.k, a.k) AS k, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' WHEN n < 50 THEN 'incomplete' ELSE 'ok' END AS status FROM e FULL JOIN a ON a.k = e.k""")
def j20_expected_external(spark, d):
    e = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.lit(1).alias("e"))
    a = table(spark, d, "customer").groupBy((F.col("c_nationkey") + 5).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("n") < 50, "incomplete").otherwise("ok")
    return e.join(a, "k", "full_outer").select("k", status.alias("status"))
