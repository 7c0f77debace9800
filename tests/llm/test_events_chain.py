"""Stretches without any certain run, over many blocks."""

import random

import numpy as np
import pytest

from frameloom.llm import events


def least_cost(states, d, penalty):
    cost = np.zeros(len(d))
    for s in states:
        cost = np.minimum(cost, cost.min() + penalty) + d[s]
    return cost.min()


@pytest.mark.parametrize("penalty", [2.5, 40.0])
def test_open_chains_are_solved_exactly_block_by_block(spark, penalty):
    rng = random.Random(3)
    d = np.array([[0, 1, 2], [1, 0, 1.5], [2, 1.5, 0]])
    states = [rng.randrange(3) for _ in range(200)]
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(states)] + [("b", i, i % 2) for i in range(100)], "e STRING, p INT, s INT")
    got = events.collapse_runs(df, "e", "p", ["s"], penalty=penalty, dissimilarity=d, block=8).toPandas().sort_values(["entity", "first"])
    for entity, truth in (("a", states), ("b", [i % 2 for i in range(100)])):
        one = got[got["entity"] == entity]
        assert one["first"].iloc[0] == 0 and one["last"].iloc[-1] == len(truth) - 1
        assert (one["first"].to_numpy()[1:] == one["last"].to_numpy()[:-1] + 1).all()
        assert (one["state"].to_numpy()[1:] != one["state"].to_numpy()[:-1]).all()
        paid = sum(d[truth[i], r.state] for r in one.itertuples() for i in range(r.first, r.last + 1)) + penalty * (len(one) - 1)
        assert abs(paid - least_cost(truth, d, penalty)) < 1e-9
        assert abs(one["cost"].sum() + penalty * (len(one) - 1) - paid) < 1e-9
