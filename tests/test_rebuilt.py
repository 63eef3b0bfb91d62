"""Functions from speed profiles in batches of edges against one edge at a time."""

import random

from roadloom.operators import coop as c
from roadloom.operators.ttf import speed_profile_times


def test_no_group_for_each_edge(spark, monkeypatch):
    monkeypatch.setattr(c, "POINTS", 20)
    rng = random.Random(5)
    length = {e: rng.choice([3, 400, 90_000, 900_000]) for e in range(60)}
    speeds = {e: [(0, rng.randrange(1, 130)), *((900_000 * k, rng.randrange(0, 130)) for k in sorted(rng.sample(range(1, 96), rng.choice([0, 1, 7, 95]))))] for e in range(0, 60, 2)}
    profiles = spark.createDataFrame([(e, s, v) for e, p in speeds.items() for s, v in rng.sample(p, len(p))], "edge_id long, start long, kmh long")
    made = c.rebuild_functions(profiles, spark.createDataFrame(list(length.items()), "edge_id long, dist_m long"))
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, made.collect())) == sorted((e, t, d) for e, p in speeds.items() for t, d in speed_profile_times(p, length[e]))
