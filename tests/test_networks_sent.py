"""What goes to the tasks of a network, and searches that end early."""

import pickle
import tracemalloc

import numpy as np

from conftest import SMALL
from roadloom.fixtures import view
from roadloom.operators import search as s
from roadloom.operators import workload as w


def random_network(n, m, seed=3):
    r = np.random.default_rng(seed)
    return r.integers(0, n, m), r.integers(0, n, m), r.integers(0, 40, m)


def test_a_network_is_held_and_sent_as_arrays():
    net = random_network(20_000, 100_000)
    tracemalloc.start()
    g = s.Csr(*net)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 20 * 100_000  # bytes an edge
    sent = pickle.dumps(g)
    assert len(sent) < 20 * 100_000
    assert pickle.loads(sent).dijkstra([(0, 0)]) == g.dijkstra([(0, 0)])


def test_rows_of_a_network_do_not_become_objects_of_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def rows(self):
        raise AssertionError("a network's rows are collected")

    edges = view(spark, SMALL, "g_grid")
    monkeypatch.setattr(DataFrame, "collect", rows)
    assert len(s.csr(edges).head) > 0


def test_nearest_node_beyond_a_length(spark, monkeypatch):
    net = random_network(60, 180)
    g = s.Csr(*net)
    edges = spark.createDataFrame([tuple(map(int, r)) for r in zip(*net)], "tail long, head long, weight long")
    asked = [(q, int(g.ids[q % len(g.ids)]), (q * 13) % 150) for q in range(120)] + [(500, 999, 0)]
    want = set()
    for q, src, least in asked[:-1]:
        dist = g.dijkstra([(g.at(src), 0)])[0]
        far = min(((d, int(g.ids[v])) for v, d in dist.items() if d > least), default=None)
        if far:
            want.add((q, src, far[1], far[0]))
    starts = spark.createDataFrame(asked, "query_id long, src long, least long")
    assert {tuple(r) for r in s.nearest_beyond(edges, starts).collect()} == want
    monkeypatch.setattr(s, "LOCAL_EDGES", 0)
    assert {tuple(r) for r in s.nearest_beyond(edges, starts).collect()} == want


def test_geometric_trips_do_not_search_the_whole_network(spark, monkeypatch):
    monkeypatch.setattr(s, "one_to_all", None)
    starts = view(spark, SMALL, "od").select("query_id", "src")
    assert w.geometric_trips(view(spark, SMALL, "g_grid"), starts, 100_000, 20).count() > 0
