"""Compaction, coverage and implausible readings on small cases: brute force, skew, nulls, empty and clashing inputs."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import compaction, coverage, spikes

FILES = "kind STRING, file_id BIGINT, written_at TIMESTAMP_NTZ, payload STRING"


def keys_of(spark, rows, schema=FILES, **more):
    blobs = compaction.compact(spark.createDataFrame(rows, schema), **more)
    return sorted(map(tuple, compaction.record_keys(compaction.read_compacted(blobs)).collect())), blobs


def test_compaction_edges(spark):
    line = lambda e, f: json.dumps({"episode_index": e, "frame_index": f, "x": "ü" * 50})
    rows = [
        ("parquet", 1, None, line(1, 0) + "\r\n" + line(1, 1) + "\n\n" + line(1, 2)[:20]),
        ("parquet", 2, None, line(1, 1) + "\n" + line(1, 2)),
        ("parquet", 2, None, line(1, 1) + "\n" + line(1, 2)),
        ("parquet", 3, None, None), ("parquet", 4, None, ""), ("parquet", 5, None, '{"episode_index":null,"frame_index":3}'), (None, 6, None, line(9, 9)),
        ("video", 7, None, "4,0,100,K\r\n4,1,50,P\n4,2,7"), ("video", 8, None, "4,2,77,P"), ("video", 9, None, "4,3,,K\n4,4,5,\n4,5"),
    ]
    got, blobs = keys_of(spark, rows)
    assert got == [("parquet", 1, 0), ("parquet", 1, 1), ("parquet", 1, 2), ("video", 4, 0), ("video", 4, 1), ("video", 4, 2)]
    assert blobs.count() == 2


def test_compaction_sizes_and_damage(spark):
    rows = [("video", i, None, "\n".join(f"{i % 3},{f},{f * 7},P" for f in range(i, i + 400))) for i in range(60)]
    got, blobs = keys_of(spark, rows, target_bytes=4096)
    assert got == sorted({("video", i % 3, f) for i in range(60) for f in range(i, i + 400)})
    assert blobs.filter("raw_bytes > 4096").count() == 0
    bad = blobs.withColumn("raw_sha256", F.lit("0"))
    with pytest.raises(Exception, match="content differs"):
        compaction.read_compacted(bad).count()


def test_compaction_empty_and_clashing(spark):
    assert keys_of(spark, [])[0] == []
    rows = [("video", 1, None, "4,0,100,K", "a", 3, "q")]
    got, _ = keys_of(spark, rows, FILES + ", line STRING, k INT, part STRING")
    assert got == [("video", 4, 0)]


def brute_periods(rows):
    by = {}
    for k, a, b in rows:
        if k is not None and a is not None and b is not None and b > a:
            by.setdefault(k, []).append((a, b))
    out = []
    for k, v in by.items():
        v.sort()
        merged = [list(v[0])]
        for a, b in v[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [("period", k, a, b) for a, b in merged]
        out += [("gap", k, x[1], y[0]) for x, y in zip(merged, merged[1:], strict=False)]
    return sorted(out)


@pytest.mark.parametrize("shard", [4, 16, 1 << 16])
def test_coverage_against_brute_force(spark, shard):
    rnd = random.Random(shard)
    rows = []
    for _ in range(600):
        a = rnd.randrange(-200, 400)
        rows.append((rnd.choice(["hot", "hot", "hot", "b", None]), a if rnd.random() > 0.05 else None, a + rnd.choice([-3, 0, 1, 2, 3, 5, 70])))
    rows += [("long", 0, 10**12), ("long", -(10**12), -5), ("long", 5, 6), ("touch", 0, 8), ("touch", 8, 16), ("touch", 16, 17), ("touch", 0, 8)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "k STRING, a BIGINT, b BIGINT, s INT, start INT")
    got = sorted(map(tuple, coverage.coverage(df, ["k"], "a", "b", shard).collect()))
    assert got == brute_periods(rows)


def test_coverage_empty(spark):
    df = spark.createDataFrame([], "k STRING, a BIGINT, b BIGINT")
    assert coverage.coverage(df, ["k"], "a", "b").count() == 0


PRED = "seq_id STRING, frame BIGINT, source STRING, ts DOUBLE, extrinsic_c2w ARRAY<FLOAT>, hand ARRAY<FLOAT>, hand_presence_logits ARRAY<FLOAT>, ingested_at TIMESTAMP_NTZ, state INT, x STRING"
GT = "seq_id STRING, frame BIGINT, source STRING, hand_joints_3d ARRAY<FLOAT>, hand_valid BOOLEAN, ingested_at TIMESTAMP_NTZ"


def pose(p):
    m = np.eye(4)
    m[:3, 3] = p
    return [float(v) for v in m.ravel()]


def scene(n=400, seed=0):
    """A camera and a left hand in smooth motion; what is planted and what must stay clean."""
    rnd = np.random.default_rng(seed)
    six = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    rows, joints, planted = [], [], set()
    for f in range(n):
        t = f / 30
        cam = np.array([np.sin(t), np.cos(t), 0.1 * t]) + rnd.normal(0, 1e-4, 3)
        hand = np.array([0.1 * np.sin(2 * t), 0.1, 0.9]) + rnd.normal(0, 1e-4, 3)
        logit = [2.0, -1.0]
        if f in (100, 101):
            cam = cam + 1.0
            planted.add(("s", f, "extrinsic_c2w"))
        e = pose(cam)
        if f == 150:
            e[15] = 0.0
            planted.add(("s", f, "extrinsic_c2w"))
        if 200 <= f < 230:
            e = pose([0.5, 0.5, 0.5])
            if f > 200:
                planted.add(("s", f, "extrinsic_c2w"))
        h = [*map(float, hand), *six, *(six * 15), *([0.1] * 10)] + [float("nan")] * 109  # the right hand isn't there
        if f == 300:
            h[0] += 0.4
            planted.add(("s", f, "hand"))
        if f == 310:
            h[99] = 25.0
            planted.add(("s", f, "hand"))
        if f == 320:
            h, logit = [float("inf")] * 218, [float("nan"), None]
        rows.append(("s", f, "rig", t, e, h, logit, None, 1, "x"))
        base = np.array([[0, 0, 0.7]] + [[0.02 * (i % 4 + 1), 0.02 * (i // 4), 0.7] for i in range(20)]) + hand - [0, 0, 0.9]
        if f == 50:
            base[8] += 0.2
            planted.add(("s", f, "hand_joints_3d"))
        joints.append(("s", f, "rig", [float(v) for v in (base + rnd.normal(0, 1e-4, base.shape)).ravel()], f != 60, None))
    return rows, joints, planted


def test_spikes_planted(spark):
    rows, joints, planted = scene()
    rows += rows[5:8]  # exact copies
    rows += [("s", 9, "rig", 0.0, None, None, None, None, 1, "x"), (None, 1, None, 0.0, pose([0, 0, 0]), None, None, None, None, None)]
    got = {tuple(r) for r in spikes.implausible(spark.createDataFrame(rows, PRED), spark.createDataFrame(joints, GT)).select("seq_id", "frame", "field").distinct().collect()}
    assert planted <= got
    assert got - planted <= {("s", 200, "extrinsic_c2w")}  # the stretch begins with a jump


def test_spikes_latest_row_counts(spark):
    rows, joints, _ = scene(60)
    broken = [(*r[:4], pose([float("nan"), 0, 0]), *r[5:]) for r in rows[10:12]]
    import datetime

    first, second = datetime.datetime(2025, 1, 1), datetime.datetime(2025, 1, 2)
    mix = [(*r[:7], second, *r[8:]) for r in rows] + [(*r[:7], first, *r[8:]) for r in broken]
    got = spikes.implausible(spark.createDataFrame(mix, PRED), spark.createDataFrame([], GT))
    assert got.filter("field = 'extrinsic_c2w'").count() == 0
    mix = [(*r[:7], first, *r[8:]) for r in rows] + [(*r[:7], second, *r[8:]) for r in broken]
    got = spikes.implausible(spark.createDataFrame(mix, PRED), spark.createDataFrame([], GT))
    assert sorted(r["frame"] for r in got.filter("test = 'impossible'").collect()) == [10, 11]


def test_spikes_empty_and_static(spark):
    empty = spikes.implausible(spark.createDataFrame([], PRED), spark.createDataFrame([], GT))
    assert empty.count() == 0
    still = [("s", f, "tripod", 0.0, pose([1, 2, 3]), None, None, None, 1, "x") for f in range(300)]
    assert spikes.implausible(spark.createDataFrame(still, PRED), spark.createDataFrame([], GT)).count() == 0


def test_long_stretch_over_a_block_border(spark):
    rows = [("s", f, "rig", 0.0, pose([f * 0.01 if not 4080 <= f < 4120 else 40.8, 0, 0]), None, None, None, 1, "x") for f in range(3900, 4300)]
    got = spikes.implausible(spark.createDataFrame(rows, PRED), spark.createDataFrame([], GT)).filter("test = 'frozen' AND part = 'all'")
    assert sorted(r["frame"] for r in got.collect()) == list(range(4081, 4120))


def test_compaction_parses_few_lines_and_joins_the_rest(spark):
    line = lambda e, f: '{"episode_index":%d,"frame_index":%d,"main_type":1}' % (e, f)
    rows = [("parquet", i, None, "\n".join(line(i, f) for f in range(20)) + "\n") for i in range(30)]
    rows += [("parquet", 100, None, line(3, 19) + "\n" + line(3, 20)), ("parquet", 101, None, rows[5][3]), ("parquet", 102, None, '{"frame_index":7,"episode_index":200}\r\n{"frame_index":8,"epis')]
    index = compaction.file_index(spark.createDataFrame(rows, FILES))
    assert {r["file_id"]: r["parsed"] for r in index.collect() if r["parsed"]} == {102: 2}
    actions = {r["file_id"]: r["action"] for r in compaction.plan_files(index).collect()}
    assert actions == {i: "lines" if i in (3, 100) else "join" for i in [*[i for i in range(30) if i != 5], 100, 101, 102]}
    got, _ = keys_of(spark, rows)
    assert got == sorted([("parquet", i, f) for i in range(30) for f in range(20)] + [("parquet", 3, 20), ("parquet", 200, 7)])


def test_merged_frames_hold_the_same_lines(spark):
    rows = [("video", i, None, "\n".join(f"{i},{f},{f * 7},P" for f in range(300))) for i in range(40)]
    blobs = compaction.compact(spark.createDataFrame(rows, FILES), target_bytes=4096).cache()
    merged = compaction.merge_blobs(blobs, 40_000)
    lines = lambda b: sorted(r["line"] for r in compaction.read_compacted(b).collect())
    assert lines(merged) == lines(blobs)
    assert merged.count() < blobs.count() / 4 and merged.agg(F.max("raw_bytes")).first()[0] <= 40_000
    with pytest.raises(Exception, match="content differs"):
        compaction.read_keys(merged.withColumn("frames", F.transform("frames", lambda f: f.withField("sha256", F.lit("0"))))).count()


def test_compaction_against_line_by_line(spark):
    import random

    rng = random.Random(5)
    rows, best = [], {}
    for i in range(300):
        e, lo = rng.choice([1, 1, 1, 2, 3]), rng.choice([0, 10, 50, 70_000, 10**12]) + rng.randrange(3000)
        frames = sorted(rng.sample(range(lo, lo + 40), rng.randrange(1, 12)))
        rows.append(("video", i, None, "\n".join(f"{e},{f},{i},K" for f in frames)))
        for f in frames:
            best[(e, f)] = max(best.get((e, f), -1), i)
    blobs = compaction.compact(spark.createDataFrame(rows, FILES), target_bytes=2000)
    got = sorted(r["line"] for r in compaction.read_compacted(blobs).collect())
    assert got == sorted(f"{e},{f},{i},K" for (e, f), i in best.items())
