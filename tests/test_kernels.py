"""Analytic cases of the grouped kernels and the driver-side helpers."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.operators import metrics, sampling
from frameloom.sources import files


def poses(centres):
    m = np.tile(np.eye(4), (len(centres), 1, 1))
    m[:, :3, 3] = centres
    return m


def test_known_similarity():
    t = np.arange(10.0)
    gt = poses(np.stack([0.03 * t**2, 0.1 * t, 0.02 * t], 1))
    pred = gt.copy()
    pred[:, :3, 3] *= 2
    free, fixed = metrics.trajectory_metrics(pred, gt), metrics.trajectory_metrics(pred, gt, with_scale=False)
    assert free["scale"] == pytest.approx(0.5) and free["ate_mm"] == pytest.approx(0, abs=1e-6)
    assert fixed["ate_mm"] > 100
    still = poses(np.zeros((10, 3)))
    assert metrics.trajectory_metrics(pred, still)["degenerate"] == 1.0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=3, max_size=3))
def test_rotation_forms_round_trip(v):
    m = metrics.axis_angle_to_matrix(np.array([v]))
    assert np.allclose(m @ m.transpose(0, 2, 1), np.eye(3), atol=1e-9)
    assert np.allclose(metrics.axis_angle_to_matrix(metrics.matrix_to_axis_angle(m)), m, atol=1e-6)
    assert np.allclose(metrics.quaternion_to_matrix(metrics.matrix_to_quaternion(m)), m, atol=1e-6)
    assert np.allclose(metrics.six_to_matrix(metrics.matrix_to_six(m)), m, atol=1e-9)


def test_slerp_is_even():
    q = metrics.matrix_to_quaternion(metrics.axis_angle_to_matrix(np.array([[0, 0, 0], [0, 0, 1.0]])))
    mid = metrics.slerp(q[0], q[1], np.array([0.5]))
    assert np.allclose(metrics.matrix_to_axis_angle(metrics.quaternion_to_matrix(mid)), [[0, 0, 0.5]], atol=1e-6)


def test_block_spikes_mark_round_trips():
    p = np.zeros((40, 3))
    p[10:14, 0] = 1.0
    p[30:, 1] = 1.0  # a lasting move is none
    bad = metrics.block_spikes(p, np.arange(40))
    assert np.flatnonzero(bad).tolist() == [10, 11, 12, 13]


def test_kalman_smooths_and_keeps_lines():
    t = np.arange(100) / 30
    noise = np.random.default_rng(1).normal(0, 0.01, 100)
    smooth = metrics.kalman_smooth(t, 2 * t + noise)
    assert np.abs(np.diff(smooth, 2)).mean() < 0.5 * np.abs(np.diff(2 * t + noise, 2)).mean()
    assert metrics.kalman_smooth(t[:3], t[:3]).tolist() == t[:3].tolist()


def test_chained_windows():
    rnd = np.random.default_rng(0)
    m = poses(rnd.normal(size=(70, 3)))
    m[:, :3, :3] = metrics.axis_angle_to_matrix(rnd.normal(size=(70, 3)))
    starts = np.arange(0, 64, 24)
    chained = metrics.chain_windows(starts, [np.linalg.inv(m[s]) @ m[s : s + 32] for s in starts])
    assert np.allclose(chained, np.linalg.inv(m[0]) @ m[: len(chained)], atol=1e-9)


def test_shards_are_balanced_and_complete():
    shards = sampling.balance_shards({"a": 5, "b": 8, "c": 13, "d": 21}, 2)
    load = [sum({"a": 5, "b": 8, "c": 13, "d": 21}[k] for k, s in shards.items() if s == i) for i in range(2)]
    assert set(shards) == set("abcd") and max(load) - min(load) <= 5


def test_retained_counts_and_seeds():
    assert [sampling.retained(10, f) for f in (0, 0.01, 0.25, 0.5, 1, 2)] == [0, 1, 3, 5, 10, 10]
    assert sampling.dataset_seed(42, "a") == sampling.dataset_seed(42, "a") != sampling.dataset_seed(43, "a")


def test_camera_files(spark, tmp_path):
    import struct

    (tmp_path / "a.cam").write_bytes(struct.pack("<f", 202021.25) + np.arange(21.0).tobytes())
    (tmp_path / "b.cam").write_bytes(b"short")
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in files.camera_files(spark, str(tmp_path)).collect()}
    assert rows["a.cam"]["intrinsics"] == list(range(9)) and rows["a.cam"]["extrinsics"] == list(range(9, 21))
    assert rows["b.cam"]["error"] == "5 bytes"


def test_layouts_and_lists(spark, tmp_path):
    a = spark.createDataFrame([(1, 0, [1.0], [True])], "episode_index BIGINT, frame_index BIGINT, fov ARRAY<DOUBLE>, state_mask ARRAY<BOOLEAN>")
    assert files.frame_layout(a).first().asDict() == {"episode_index": 1, "frame_index": 0, "fov": [1.0], "valid": [True]}
    with pytest.raises(ValueError, match="missing"):
        files.frame_layout(a.drop("frame_index"))
    (tmp_path / "list.txt").write_text("# roots\n\n/b.mp4\n/a.mp4\n/b.mp4\n")
    assert [r["path"] for r in files.list_file(spark, str(tmp_path / "list.txt")).collect()] == ["/a.mp4", "/b.mp4"]


def test_missing_split_ids(spark):
    with pytest.raises(ValueError, match="without a row"):
        sampling.fixed_split(spark.range(3), "id", [1, 9])


def test_ranking_cases(spark):
    from frameloom.operators.reports import rank_models

    rows = [("balanced", "ate", 0.3), ("balanced", "rte", 5.0), ("balanced", "FAcc", 0.6), ("bad", "ate", 0.1), ("bad", "rte", 9.0), ("bad", "FAcc", 0.3), ("best", "ate", 0.2), ("best", "rte", 1.0), ("best", "FAcc", 0.9)]
    out = rank_models(spark.createDataFrame(rows, "model STRING, metric STRING, value DOUBLE"), "model").orderBy("rank").collect()
    assert out[0]["model"] == "best" and out[0]["metrics"] == 3
    one = rank_models(spark.createDataFrame(rows[:3], "model STRING, metric STRING, value DOUBLE"), "model").first()
    assert one["score"] == 0.0 and one["metrics"] == 0


def test_nearest_join_ties_go_to_the_earlier(spark):
    from frameloom.operators.sequences import nearest_join

    left = spark.createDataFrame([("k", 10), ("k", 5), ("z", 1)], "key STRING, t BIGINT")
    right = spark.createDataFrame([("k", 8, "a"), ("k", 12, "b"), ("k", 5, "c")], "key STRING, t BIGINT, v STRING")
    got = {(r["key"], r["t"]): (r["v"], r["gap"]) for r in nearest_join(left, right, ["key"], "t", ["v"]).collect()}
    assert got == {("k", 10): ("a", 2), ("k", 5): ("c", 0), ("z", 1): (None, None)}


def test_library_does_not_import_llm():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "frameloom"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("frameloom.llm") for n in names), path
