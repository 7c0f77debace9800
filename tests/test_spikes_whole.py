"""Long excursions, all numbers of a hand, and independence of how blocks are worked on."""

import numpy as np
import pytest
from test_dealt import GT, PRED, pose

from frameloom.operators import spikes

SIX = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def moving(n=600, seed=1, burst=(), off=1.0, turn=()):
    """A camera in smooth motion and a left hand whose pose turns; what is planted is off by ``off`` metres or radians."""
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(n):
        t = f / 30
        cam = np.array([np.sin(t), np.cos(0.7 * t), 0.1 * t]) + rng.normal(0, 1e-4, 3) + (off if f in burst else 0.0)
        six = []
        for j in range(15):
            a = 0.3 * np.sin(t + j) + ((off if j % 2 else -off) if f in turn and j in (3, 4) else 0.0)
            six += [np.cos(a), np.sin(a), 0.0, -np.sin(a), np.cos(a), 0.0]
        hand = [0.1 * np.sin(2 * t), 0.1, 0.9, *SIX, *six, *([0.1] * 10)]
        rows.append((f"s{seed}", f, "rig", t, pose(cam), [float(v) for v in hand] + [float("nan")] * 109, [2.0, -1.0], None, 1, "x"))
    return rows


def found(spark, rows, **more):
    got = spikes.implausible(spark.createDataFrame(rows, PRED), spark.createDataFrame([], GT), **more)
    return {tuple(r) for r in got.select("seq_id", "frame", "field").distinct().collect()}


@pytest.mark.parametrize("length", [1, 11, 12, 13, 20, 60])
def test_excursions_of_any_length_in_the_halo(spark, length):
    burst = set(range(250, 250 + length))
    assert found(spark, moving(burst=burst)) == {("s1", f, "extrinsic_c2w") for f in burst}


def test_a_lasting_change_is_no_excursion(spark):
    assert found(spark, moving(burst=set(range(300, 600)))) == set()


def test_opposite_turns_of_two_joints_are_seen(spark):
    assert found(spark, moving(turn={200, 201}, off=0.5)) == {("s1", f, "hand") for f in (200, 201)}


def test_result_is_independent_of_chunks_and_partitions(spark):
    rows = [r for seed in range(1, 5) for r in moving(seed=seed, burst={50 * seed, 50 * seed + 1}, turn={20 * seed})]
    want = {(f"s{k}", f, "extrinsic_c2w") for k in range(1, 5) for f in (50 * k, 50 * k + 1)} | {(f"s{k}", 20 * k, "hand") for k in range(1, 5)}
    assert found(spark, rows) == want
    assert found(spark, rows, chunk=500) == want
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert found(spark, rows[::-1], chunk=1000) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_long_frozen_stretches_of_a_source_with_long_repeats(spark):
    """Every pose stands for ten frames; a stretch of forty is frozen, parts that never move aren't tested."""
    rows = []
    for f in range(1200):
        k = 600 if 600 <= f < 640 else f - f % 10
        rows.append(("s", f, "slow", f / 30, pose([np.sin(k / 90), 0.0, 0.0]), None, None, None, 1, "x"))
    assert found(spark, rows) == {("s", f, "extrinsic_c2w") for f in range(601, 640)}
