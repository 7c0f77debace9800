"""Alignment of point pairs from moments: what a least-squares fit needs of a group is summed in SQL, whatever its size,
and only the 3x3 decomposition of each group's covariance runs in Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
FIT = "scale DOUBLE, rotation ARRAY<DOUBLE>, shift ARRAY<DOUBLE>, trace DOUBLE"


def moments(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, vp, vg, cov, mp, mg`` of the points ``px, py, pz`` and ``gx, gy, gz``: spreads, covariance (truth by
    prediction, row-major) and means; partial sums are combined before the shuffle."""
    spread = lambda s: sum((F.var_pop(f"{s}{a}") for a in AXES), F.lit(0.0))
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), spread("p").alias("vp"), spread("g").alias("vg"), F.array(*[F.covar_pop(f"g{a}", f"p{b}") for a in AXES for b in AXES]).alias("cov"),
        F.array(*[F.avg(f"p{a}") for a in AXES]).alias("mp"), F.array(*[F.avg(f"g{a}") for a in AXES]).alias("mg"),
    )


def fits(m: DataFrame, with_scale: bool = True) -> DataFrame:
    """Adds ``scale, rotation, shift`` of the least-squares fit of prediction onto truth, and ``trace``, the sum of the
    signed singular values; groups of fewer than three points or without any spread have scale 1 and no rotation."""

    @F.pandas_udf(FIT)
    def solve(cov: pd.Series, vp: pd.Series, mp: pd.Series, mg: pd.Series, n: pd.Series) -> pd.DataFrame:
        c = np.stack(cov.to_numpy()).astype(float).reshape(-1, 3, 3)
        p, g = (np.stack(v.to_numpy()).astype(float) for v in (mp, mg))
        u, d, vt = np.linalg.svd(c)
        sign = np.ones((len(c), 3))
        sign[:, 2] = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)
        r = (u * sign[:, None, :]) @ vt
        trace = (d * sign).sum(1)
        flat = (vp.to_numpy() < 1e-18) | (n.to_numpy() < 3)
        r[flat], trace[flat] = np.eye(3), 0.0
        scale = np.where(flat | (not with_scale), 1.0, trace / np.where(flat, 1.0, vp.to_numpy()))
        shift = g - scale[:, None] * np.einsum("nij,nj->ni", r, p)
        return pd.DataFrame({"scale": scale, "rotation": list(r.reshape(-1, 9)), "shift": list(shift), "trace": trace})

    return m.withColumn("fit", solve("cov", "vp", "mp", "mg", "n")).select("*", "fit.*").drop("fit")


def apply_fit(pairs: DataFrame, fit: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """Pairs with their group's fit and ``error``, the distance of the moved prediction from the truth."""
    from frameloom.operators.skew import salted_lookup

    j = salted_lookup(pairs, fit.select(*keys, "scale", "rotation", "shift"), keys, spread)
    at = lambda c, i: F.get(c, F.lit(i))
    moved = lambda i: F.col("scale") * sum((at("rotation", 3 * i + k) * F.col(f"p{a}") for k, a in enumerate(AXES)), F.lit(0.0)) + at("shift", i)
    return j.withColumn("error", F.sqrt(sum((F.pow(moved(i) - F.col(f"g{a}"), 2) for i, a in enumerate(AXES)), F.lit(0.0))))


def rmse(with_scale: bool):
    """Root mean squared error after the fit, from spreads and trace alone."""
    left = F.col("vg") - F.col("trace") * F.col("trace") / F.col("vp") if with_scale else F.col("vp") + F.col("vg") - 2 * F.col("trace")
    return F.sqrt(F.greatest(left, F.lit(0.0)))
