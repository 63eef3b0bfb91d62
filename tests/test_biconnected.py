"""Biconnected components by a forest against depth-first search in one task."""

import random

import pytest

from roadloom.operators import hierarchy as h


@pytest.mark.parametrize("seed", [2, 7])
def test_by_forest(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(55 + 5 * seed)]
    edges += [(100 + k, 101 + k) for k in range(6)] + [(106, 103), (103, 103), (200, 201), (201, 200)]  # a tail on a circle, a loop, one pair apart
    df = spark.createDataFrame(edges, "tail long, head long")
    want = sorted(map(tuple, h.biconnected(df).collect()))
    assert len({c for _, _, c in want}) > 5 and sorted(map(tuple, h.biconnected(df, 0).collect())) == want
