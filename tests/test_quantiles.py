"""Exact quantiles by narrowing ranks against one aggregation."""

import numpy as np
import pytest
from compare import DATA, spark_rows, sql_rows
from pyspark.sql import functions as F

from frameloom.operators import profile
from frameloom.plans import catalogue

QS = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]


def test_against_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {"ties": [1.0] * 400 + [2.0], "wide": (rng.normal(size=900) * 10.0 ** rng.integers(-6, 6, 900)).tolist(), "near": (20 + rng.random(700) * 1e-9).tolist(), "one": [-3.5], "zero": [0.0, -0.0, 0.0, 5.0], None: rng.integers(-5, 5, 300).astype(float).tolist()}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("ties", None), ("empty", None)]
    got = {r["k"]: r["q"] for r in profile.exact_quantiles(spark.createDataFrame(rows, "k STRING, v DOUBLE"), "v", QS, ["k"]).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert np.allclose(got[k], np.quantile(vs, QS), rtol=1e-12, atol=1e-15), k


def test_empty_and_ungrouped(spark):
    assert profile.exact_quantiles(spark.createDataFrame([], "v DOUBLE"), "v", [0.5], []).filter(F.size("q") > 0).count() == 0
    assert profile.exact_quantiles(spark.range(101).select(F.col("id").alias("v")), "v", [0.5, 0.25], []).first()["q"] == [50.0, 25.0]


@pytest.mark.parametrize("name", ["a01_numeric_profile", "a02_quantiles"])
def test_profiles_are_the_same_by_ranks(spark, monkeypatch, name):
    core = catalogue.core()
    monkeypatch.setattr(profile, "ONE_PASS_ROWS", 0)
    df = core.queries[name](spark, DATA)
    assert spark_rows(df) == sql_rows(core.sql[name], df.columns)
