"""Paths and trips within a band come out of the tasks that search; no table of all nodes for all sources is made."""

import heapq
import random

import pytest

from roadloom.operators import search as s
from roadloom.operators import workload as w


def network(seed=5, n=60):
    draw = random.Random(seed)
    return [(draw.randrange(n), draw.randrange(n), draw.randrange(1, 6)) for _ in range(4 * n)] + [(200, 201, 3)]


def distances(edges, src):
    dist, heap = {}, [(0, src)]
    while heap:
        d, u = heapq.heappop(heap)
        if u not in dist:
            dist[u] = d
            for a, b, x in edges:
                if a == u:
                    heapq.heappush(heap, (d + x, b))
    return dist


def way(edges, src, dst):
    dist = distances(edges, src)
    if dst not in dist:
        return []
    out = [dst]
    while before := [a for a, b, x in edges if b == out[-1] and dist.get(a) == dist[out[-1]] - x]:
        out.append(min(before))
    return [(k, v, dist[v]) for k, v in enumerate(out[::-1])]


@pytest.mark.parametrize("most", [5_000_000, 0])
def test_paths(spark, monkeypatch, most):
    monkeypatch.setattr(s, "LOCAL_EDGES", most)
    edges, kept, cut = network(), [], s.cut

    def counted(df):
        out = cut(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(s, "cut", counted)
    od = [(1, 0, 7), (2, 0, 31), (3, 5, 5), (4, 9, 200), (5, 300, 300), (6, 301, 0), (7, 200, 201), (8, 3, 44), (8, 3, 44)]
    got = s.paths(spark.createDataFrame(edges, "tail long, head long, weight long"), spark.createDataFrame(od, "query_id long, src long, dst long")).collect()
    assert sorted(map(tuple, got)) == sorted((q, *x) for q, a, b in set(od) for x in way(edges, a, b))
    assert not most or max(kept, default=0) <= len(got)


@pytest.mark.parametrize("most", [5_000_000, 0])
def test_within(spark, monkeypatch, most):
    monkeypatch.setattr(s, "LOCAL_EDGES", most)
    edges = network(6)
    starts = [(1, 0, 3, 6), (2, 0, 0, 2), (3, 8, 5, 5), (4, 300, 0, 4), (5, 300, 1, 4), (6, 200, 2, 9), (7, 4, 90, 99)]
    got = s.within(spark.createDataFrame(edges, "tail long, head long, weight long"), spark.createDataFrame(starts, "query_id long, src long, low long, high long")).collect()
    assert sorted(map(tuple, got)) == sorted((q, a, v) for q, a, low, high in starts for v, d in distances(edges, a).items() if low <= d <= high)


def test_band_makes_no_table_of_all_nodes(spark, monkeypatch):
    monkeypatch.setattr(s, "one_to_all", None)
    edges = spark.createDataFrame(network(), "tail long, head long, weight long")
    starts, nodes = spark.createDataFrame([(k, k % 50) for k in range(40)], "query_id long, src long"), spark.range(60).selectExpr("id as node_id", "id div 8 as cell")
    trips = w.population_band_trips(edges, starts, nodes.groupBy("cell").count().withColumnRenamed("count", "population"), nodes, 8, 20)
    assert trips.columns == ["query_id", "src", "dst"] and 0 < trips.count() <= 40


def test_violations_search_no_farther_than_asked(spark):
    import numpy as np

    from roadloom.operators import alternatives as alt

    n = 400  # a line with a detour at its begin
    line = [(k, k + 1, 1) for k in range(n)] + [(0, n + 5, 9), (n + 5, 1, 9)]
    g = s.Csr(*(np.array(x) for x in zip(*line)))
    asked = []
    g.first = type("Counted", (), {"__getitem__": lambda self, k, first=g.first: asked.append(k) or first[k]})()
    path = [0, g.at(n + 5), *range(1, n + 1)]
    assert alt._violations(g, path[:3], 0.1) == [(0, 2)]
    assert len(asked) < 40


def test_paths_are_dealt_to_many_tasks(spark):
    from roadloom.operators import alternatives as alt

    edges = spark.createDataFrame([(k, k + 1, 1) for k in range(30)], "tail long, head long, weight long")
    paths = spark.createDataFrame([(p, k, k) for p in range(200) for k in range(5)], "path_id long, idx long, node long")
    for found in (alt.fix_paths(paths, edges, 0.1), alt.local_optimality(paths, edges, 0.1)):
        assert found.rdd.getNumPartitions() > 8
    assert alt.ubs_violations(paths, edges, 0.1).rdd.getNumPartitions() > 8


@pytest.mark.parametrize("eps", [0.0, 0.1, 0.5])
def test_violations_equal_all_pairs(eps):
    import numpy as np

    from roadloom.operators import alternatives as alt

    edges = network(7, 40)[:-1]
    g, draw, seen = s.Csr(*(np.array(x) for x in zip(*edges))), random.Random(8), 0
    dist = {v: distances(edges, v) for v in g.ids.tolist()}
    for _ in range(60):
        walk = [draw.choice(g.ids.tolist())]
        while len(walk) < 12 and (on := [b for a, b, _ in edges if a == walk[-1]]):
            walk.append(draw.choice(on))
        prefix = [0]
        for a, b in zip(walk, walk[1:]):
            prefix.append(prefix[-1] + min(x for u, v, x in edges if (u, v) == (a, b)))
        bad = [(i, j) for i in range(len(walk)) for j in range(i + 1, len(walk)) if prefix[j] - prefix[i] - dist[walk[i]][walk[j]] > int(dist[walk[i]][walk[j]] * eps)]
        want = [(i, j) for i, j in bad if not any((a, b) != (i, j) and i <= a and b <= j for a, b in bad)]
        assert alt._violations(g, [g.at(v) for v in walk], eps) == want
        seen += len(want)
    assert seen
