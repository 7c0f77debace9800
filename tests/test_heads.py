"""Fits from moments against numpy on whole sequences, and the metric kernels on made-up paths."""

import numpy as np
from compare import DATA

from frameloom.operators import alignment, metrics
from frameloom.plans import heads


def test_fit_from_moments_is_the_direct_fit(spark):
    rng = np.random.default_rng(4)
    r = metrics.axis_angle_to_matrix(np.array([0.3, -1.1, 0.7]))
    rows, want = [], {}
    for k, mirror in enumerate((1, 1, -1)):
        g = rng.normal(size=(60, 3)) * [3, 1, 0.2] + 5
        p = (g - 2) @ r * 0.5 * [1, 1, mirror] + rng.normal(0, 0.05, (60, 3))
        rows += [(f"s{k}", i, *map(float, p[i]), *map(float, g[i])) for i in range(60)]
        want[f"s{k}"] = [(s, np.linalg.norm(s * p @ q.T + t - g, axis=1)) for s, q, t in (metrics.umeyama(p, g), metrics.umeyama(p, g, with_scale=False))]
    df = spark.createDataFrame(rows, "seq_id STRING, frame BIGINT, px DOUBLE, py DOUBLE, pz DOUBLE, gx DOUBLE, gy DOUBLE, gz DOUBLE")
    for which, scaled in enumerate((True, False)):
        fit = alignment.fits(alignment.moments(df, ["seq_id"]), with_scale=scaled)
        got = {x["seq_id"]: x for x in fit.withColumn("rmse", alignment.rmse(scaled)).collect()}
        moved = alignment.apply_fit(df, fit, ["seq_id"], ["frame"]).toPandas()
        for name, cases in want.items():
            s, e = cases[which]
            assert abs(got[name]["scale"] - s) < 1e-9
            assert abs(got[name]["rmse"] - np.sqrt((e**2).mean())) < 1e-9
            assert np.allclose(moved[moved["seq_id"] == name].sort_values("frame")["error"], e)


def test_degenerate_groups(spark):
    df = spark.createDataFrame([("still", i, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0) for i in range(5)] + [("two", i, float(i), 0.0, 0.0, float(i), 0.0, 0.0) for i in range(2)], "seq_id STRING, frame BIGINT, px DOUBLE, py DOUBLE, pz DOUBLE, gx DOUBLE, gy DOUBLE, gz DOUBLE")
    assert [(r["scale"], r["trace"]) for r in alignment.fits(alignment.moments(df, ["seq_id"])).collect()] == [(1.0, 0.0)] * 2
    assert alignment.fits(alignment.moments(df.limit(0), ["seq_id"])).count() == 0


def test_world_chunks_of_prediction_and_truth(spark):
    p = heads.pairs(spark, DATA).toPandas()
    assert len(p)
    got = heads.R.queries["m07_world_hands"](spark, DATA).toPandas().set_index(["seq_id", "chunk"])
    p["chunk"] = p["frame"] // 100
    for key, df in p.groupby(["seq_id", "chunk"]):
        if len(df) < 5:
            assert key not in got.index
            continue
        df = df.sort_values("frame")
        a, b = df[["px", "py", "pz"]].to_numpy(), df[["gx", "gy", "gz"]].to_numpy()
        s, r, t = metrics.umeyama(a, b)
        assert np.isclose(got.loc[key, "wa_mpjpe_mm"], np.linalg.norm(s * a @ r.T + t - b, axis=1).mean() * 1000)
        assert got.loc[key, "frames"] == len(df)
    same = heads.world_chunk(np.cumsum(np.ones((9, 3)), 0), np.cumsum(np.ones((9, 3)), 0))
    assert max(same.values()) < 1e-6


def test_hands_that_only_turned_fit(spark):
    import pandas as pd

    rng = np.random.default_rng(1)
    g = rng.normal(size=(4, 21, 3))
    r = metrics.axis_angle_to_matrix(np.array([0.2, 0.4, -0.3]))
    out = heads.fit_hands(pd.Series(list((2 * g @ r.T + 1).reshape(4, 63))), pd.Series(list(g.reshape(4, 63))))
    assert out["aligned"].max() < 1e-9 and out["rel"].min() > 0.1 and np.allclose(out["scale"], 0.5) and out["rigid"].min() > 0.1
    e = heads.R.queries["m10_alignments"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(e) and (e["whole"] <= e["none"] + 1e-6).mean() > 0.99


def test_block_spikes_by_columns_are_those_of_the_kernel(spark):
    from frameloom.operators import sequences

    rng = np.random.default_rng(9)
    rows, want = [], set()
    for k in range(6):
        n = 3 if k == 5 else 300
        frame = np.cumsum(rng.integers(1, 4, n))
        p = np.cumsum(rng.normal(0, 0.01, (n, 3)), 0)
        v = np.cumsum(rng.normal(0, 0.02, (n, 3)), 0)
        for _ in range(0 if n < 4 else 12):
            i, size = int(rng.integers(1, n - 30)), int(rng.integers(1, 20))
            (p if rng.random() < 0.6 else v)[i : i + size] += 2.0
        r = metrics.axis_angle_to_matrix(v)
        bad = metrics.block_spikes(p, frame, rotation=r)
        want |= {(f"s{k}", int(f)) for f in frame[bad]}
        m = np.tile(np.eye(4), (n, 1, 1))
        m[:, :3, :3], m[:, :3, 3] = r, p
        rows += [(f"s{k}", int(f), e.ravel().tolist()) for f, e in zip(frame, m, strict=True)]
    df = spark.createDataFrame(rows, "seq_id STRING, frame BIGINT, e ARRAY<DOUBLE>")
    got = {tuple(x) for x in sequences.block_spikes(df, "seq_id", "frame", "e").collect()}
    assert len(want) > 50 and got == want
