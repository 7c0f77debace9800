"""Metric kernels: alignment, trajectory errors, smoothing. Rotation maths is numpy on whole sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(df: DataFrame, key: str):
    """Groups for a Python kernel, dealt over as many tasks as the session shuffles to: adaptive execution would merge
    them by their few bytes, although their cost is in the kernel."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).groupBy(key)


def depth_errors(p: Column, g: Column, digits: dict[str, int] | None = None) -> list[Column]:
    """Aggregates AbsRel, SqRel, RMSE, RMSE of logs and the shares within 1.25, 1.25^2, 1.25^3 of positive depths."""
    d = digits or {}
    worst = F.greatest(p / g, g / p)
    out = {"abs_rel": F.avg(F.abs(p - g) / g), "sq_rel": F.avg(F.pow(p - g, 2) / g), "rmse": F.sqrt(F.avg(F.pow(p - g, 2))), "rmse_log": F.sqrt(F.avg(F.pow(F.log(p) - F.log(g), 2)))}
    out |= {f"delta{i}": F.avg((worst < 1.25**i).cast("int")) for i in (1, 2, 3)}
    return [F.round(c, d.get(n, 6)).alias(n) for n, c in out.items()]


def umeyama(source: np.ndarray, target: np.ndarray, with_scale: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and translation that map ``source`` onto ``target`` with the least squared error."""
    ms, mt = source.mean(0), target.mean(0)
    s, t = source - ms, target - mt
    u, d, vt = np.linalg.svd(t.T @ s / len(s))
    sign = np.ones(3)
    if np.linalg.det(u) * np.linalg.det(vt) < 0:
        sign[2] = -1
    r = (u * sign) @ vt
    var = (s**2).sum() / len(s)
    scale = float((d * sign).sum() / var) if with_scale and var > 0 else 1.0
    return scale, r, mt - scale * r @ ms


def project_rotation(m: np.ndarray) -> np.ndarray:
    """Nearest proper rotations of a stack of 3x3 matrices."""
    u, _, vt = np.linalg.svd(m)
    flip = np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)
    u[..., :, 2] *= flip[..., None]
    return u @ vt


def six_to_matrix(six: np.ndarray) -> np.ndarray:
    """Rotations from their first two rows, made orthonormal."""
    a, b = six[..., :3], six[..., 3:]
    x = a / np.linalg.norm(a, axis=-1, keepdims=True)
    y = b - (x * b).sum(-1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=-1, keepdims=True)
    return np.stack([x, y, np.cross(x, y)], -2)


def matrix_to_six(m: np.ndarray) -> np.ndarray:
    return m[..., :2, :].reshape(*m.shape[:-2], 6)


def axis_angle_to_matrix(v: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(v, axis=-1)[..., None, None]
    k = np.zeros((*v.shape[:-1], 3, 3))
    k[..., 0, 1], k[..., 0, 2], k[..., 1, 0] = -v[..., 2], v[..., 1], v[..., 2]
    k[..., 1, 2], k[..., 2, 0], k[..., 2, 1] = -v[..., 0], -v[..., 1], v[..., 0]
    with np.errstate(all="ignore"):
        a = np.where(angle > 1e-8, np.sin(angle) / angle, 1.0)
        b = np.where(angle > 1e-8, (1 - np.cos(angle)) / angle**2, 0.5)
    return np.eye(3) + a * k + b * (k @ k)


def matrix_to_axis_angle(m: np.ndarray) -> np.ndarray:
    q = matrix_to_quaternion(m)
    w, v = np.clip(q[..., 3:], -1, 1), q[..., :3]
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    angle = 2 * np.arctan2(n, w)
    with np.errstate(all="ignore"):
        return np.where(n > 1e-9, v / n * angle, 2 * v)


def matrix_to_quaternion(m: np.ndarray) -> np.ndarray:
    """Quaternions x, y, z, w with w >= 0: the eigenvector of the largest eigenvalue of the symmetric form."""
    xx, yy, zz = m[..., 0, 0], m[..., 1, 1], m[..., 2, 2]
    k = np.zeros((*m.shape[:-2], 4, 4))
    k[..., 0, 0], k[..., 1, 1], k[..., 2, 2], k[..., 3, 3] = xx - yy - zz, yy - xx - zz, zz - xx - yy, xx + yy + zz
    for i, j, v in ((0, 1, m[..., 0, 1] + m[..., 1, 0]), (0, 2, m[..., 0, 2] + m[..., 2, 0]), (1, 2, m[..., 1, 2] + m[..., 2, 1]), (0, 3, m[..., 2, 1] - m[..., 1, 2]), (1, 3, m[..., 0, 2] - m[..., 2, 0]), (2, 3, m[..., 1, 0] - m[..., 0, 1])):
        k[..., i, j] = k[..., j, i] = v
    q = np.linalg.eigh(k)[1][..., -1]
    return np.where(q[..., 3:] < 0, -q, q)


def quaternion_to_matrix(q: np.ndarray) -> np.ndarray:
    x, y, z, w = np.moveaxis(q / np.linalg.norm(q, axis=-1, keepdims=True), -1, 0)
    rows = [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]
    return np.stack(rows, -1).reshape(*q.shape[:-1], 3, 3)


def slerp(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Spherical interpolation between quaternions the short way."""
    dot = float((a * b).sum())
    if dot < 0:
        b, dot = -b, -dot
    if dot > 0.9995:
        q = a + (b - a) * t[:, None]
    else:
        angle = np.arccos(min(1.0, dot))
        q = (np.sin((1 - t) * angle)[:, None] * a + np.sin(t * angle)[:, None] * b) / np.sin(angle)
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def geodesic_deg(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    trace = np.einsum("...ij,...ij->...", a, b)
    return np.degrees(np.arccos(np.clip((trace - 1) / 2, -1, 1)))


def proper(m: np.ndarray) -> np.ndarray:
    """Which 4x4 poses are finite rigid motions."""
    with np.errstate(all="ignore"):
        r = m[:, :3, :3]
        error = np.abs(np.einsum("nij,nkj->nik", r, r) - np.eye(3)).max((1, 2))
        return np.isfinite(m).all((1, 2)) & (error < 0.02) & (np.abs(m[:, 3] - [0, 0, 0, 1]).max(1) < 1e-3)


def trajectory_metrics(pred: np.ndarray, gt: np.ndarray, with_scale: bool = True) -> dict[str, float]:
    """ATE in mm and percent of the path, RPE of translation and rotation, and the scale; a still track is degenerate."""
    p, g = pred[:, :3, 3], gt[:, :3, 3]
    path = float(np.linalg.norm(np.diff(g, axis=0), axis=1).sum())
    out = {"n_frames": float(len(p)), "path_m": path, "scale": np.nan, "ate_mm": np.nan, "ate_pct": np.nan, "rpe_t_mm": np.nan, "rpe_r_deg": np.nan, "degenerate": 1.0}
    if len(p) < 3 or path < 1e-6 or np.linalg.norm(p - p[0], axis=1).max() < 1e-9:
        return out
    s, r, t = umeyama(p, g, with_scale)
    moved = s * p @ r.T + t
    ate = float(np.sqrt(((moved - g) ** 2).sum(1).mean()))
    rel = lambda m: np.linalg.inv(m[:-1]) @ m[1:]
    a, b = rel(pred), rel(gt)
    step = np.linalg.norm(s * a[:, :3, 3] - b[:, :3, 3], axis=1)
    return out | {"scale": s, "ate_mm": ate * 1000, "ate_pct": ate / path * 100, "rpe_t_mm": float(step.mean()) * 1000, "rpe_r_deg": float(geodesic_deg(a[:, :3, :3], b[:, :3, :3]).mean()), "degenerate": 0.0}


def trajectory_table(pairs: DataFrame, with_scale: bool = True) -> DataFrame:
    """Metrics of each sequence of ``seq_id, frame, pred, gt`` (row-major 4x4 poses of both on common frames)."""
    names = ["n_frames", "path_m", "scale", "ate_mm", "ate_pct", "rpe_t_mm", "rpe_r_deg", "degenerate"]

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("frame")
        pred, gt = (np.stack(df[c].to_numpy()).astype(float).reshape(-1, 4, 4) for c in ("pred", "gt"))
        fine = proper(pred) & proper(gt)
        return pd.DataFrame([{"seq_id": df["seq_id"].iloc[0], **trajectory_metrics(pred[fine], gt[fine], with_scale)}])[["seq_id", *names]]

    return by_key(pairs, "seq_id").applyInPandas(one, "seq_id STRING, " + ", ".join(f"{n} DOUBLE" for n in names))


def joint_errors(pred: np.ndarray, gt: np.ndarray, root: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Root-relative and Procrustes-aligned mean joint errors of each frame, in the joints' unit."""
    rel = np.linalg.norm((pred - pred[:, root : root + 1]) - (gt - gt[:, root : root + 1]), axis=2).mean(1)
    aligned = np.empty(len(pred))
    for i, (p, g) in enumerate(zip(pred, gt, strict=True)):
        s, r, t = umeyama(p, g)
        aligned[i] = np.linalg.norm(s * p @ r.T + t - g, axis=1).mean()
    return rel, aligned


def block_spikes(p: np.ndarray, frame: np.ndarray, jump: float = 0.15, max_block: int = 15, recovery: float = 0.15, rotation: np.ndarray | None = None, turn: float = 45.0) -> np.ndarray:
    """Readings between two neighbouring leaps, at most ``max_block`` of them, where the second leads back to within
    ``recovery`` of where the first left. A leap is a step of more than ``jump``, or a turn of more than ``turn`` degrees,
    for each frame between. Greedy scans from every leap to the next one come to the same."""
    bad = np.zeros(len(p), bool)
    if len(p) < 4:
        return bad
    gap = np.diff(frame)
    leap = np.linalg.norm(np.diff(p, axis=0), axis=1) / gap > jump
    if rotation is not None:
        leap |= geodesic_deg(rotation[:-1], rotation[1:]) / gap > turn
    at = np.flatnonzero(leap)
    for out, back in zip(at[:-1], at[1:], strict=True):
        if back - out <= max_block and np.linalg.norm(p[back + 1] - p[out]) < recovery:
            bad[out + 1 : back + 1] = True
    return bad


def kalman_smooth(t: np.ndarray, z: np.ndarray, q: float = 0.6, r: float = 0.6) -> np.ndarray:
    """Constant-velocity Kalman filter with a backward (RTS) pass over one channel at uneven times.

    The measurement noise is the channel's own (1.4826 MAD of its second differences / sqrt 6, at least 1e-6) scaled by
    ``r``; fewer than four values come back as they are.
    """
    n = len(z)
    if n < 4:
        return z.copy()
    second = np.diff(z, 2)
    noise = max(1e-6, 1.4826 * float(np.median(np.abs(second - np.median(second)))) / np.sqrt(6))
    # Position, velocity and the three entries of the covariance as plain numbers: a step is a few dozen operations.
    times, values = t.tolist(), z.tolist()
    x, v, a, b, c = values[0], 0.0, noise**2, 0.0, noise**2 * 100
    rr, qq = (r * noise) ** 2, (q * noise) ** 2
    kept = []
    for i in range(n):
        dt = times[i] - times[i - 1] if i else 0.0
        px, pa, pb, pc = x + dt * v, a + 2 * dt * b + dt * dt * c + qq * dt**3 / 3, b + dt * c + qq * dt * dt / 2, c + qq * dt
        total = pa + rr
        k1, k2, miss = pa / total, pb / total, values[i] - px
        x, v, a, b, c = px + k1 * miss, v + k2 * miss, pa - k1 * pa, pb - k1 * pb, pc - k2 * pb
        kept.append((x, v, a, b, c, dt, px, v - k2 * miss, pa, pb, pc))
    out = [0.0] * n
    sx, sv = x, v
    out[-1] = sx
    for i in range(n - 2, -1, -1):
        x, v, a, b, c, *_ = kept[i]
        dt, px, pv, pa, pb, pc = kept[i + 1][5:]
        det = pa * pc - pb * pb
        if det > 0:
            # gain = P F' (predicted P)^-1
            m1, m2, m3, m4 = a + dt * b, b, b + dt * c, c
            g1, g2, g3, g4 = (m1 * pc - m2 * pb) / det, (m2 * pa - m1 * pb) / det, (m3 * pc - m4 * pb) / det, (m4 * pa - m3 * pb) / det
            dx, dv = sx - px, sv - pv
            x, v = x + g1 * dx + g2 * dv, v + g3 * dx + g4 * dv
        sx, sv = x, v
        out[i] = sx
    return np.array(out)


def chain_windows(starts: np.ndarray, poses: list[np.ndarray]) -> np.ndarray:
    """Global poses of overlapping windows whose first pose is the identity: each is hung on the one before it."""
    out = list(poses[0])
    for s, w in zip(starts[1:], poses[1:], strict=True):
        base = out[s]
        out[s:] = [base @ m for m in w]
    return np.stack(out)
