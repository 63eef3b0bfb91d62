"""Steps that go by cells, ranges or distinct rows where they went by whole tables, against plain versions."""

import random

from pyspark.sql import functions as F

from roadloom.operators import approximation as a
from roadloom.operators import graph as g
from roadloom.operators import hierarchy as h
from roadloom.operators import search as s
from roadloom.operators import sweep as sw
from roadloom.session import cut


def network(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.randrange(1, 20)) for _ in range(m)]


def plain(edges, n):
    """Distances of all pairs."""
    d = [[0 if a == b else None for b in range(n)] for a in range(n)]
    for a, b, w in edges:
        if d[a][b] is None or w < d[a][b]:
            d[a][b] = w
    for k in range(n):
        for a in range(n):
            for b in range(n):
                if d[a][k] is not None and d[k][b] is not None and (d[a][b] is None or d[a][k] + d[k][b] < d[a][b]):
                    d[a][b] = d[a][k] + d[k][b]
    return d


def test_exact_potentials_are_made_where_they_are_used(spark):
    edges = network(40, 70, 1)
    dist = plain(edges, 40)
    od = [(k, k % 40, (k * 7) % 43) for k in range(90)]  # targets from 40 on have no edges
    got = s.astar_exact(spark.createDataFrame(edges, "tail long, head long, weight long"), spark.createDataFrame(od, "query_id long, src long, dst long")).collect()
    assert {(r["query_id"], r["src"], r["dst"], r["dist"]) for r in got} == {(q, a, b, dist[a][b] if b < 40 else None) for q, a, b in od}


def test_hierarchies_larger_than_a_task(spark, monkeypatch):
    """Labels, elimination tree queries and potentials send no hierarchy to tasks, and split what passes a cell."""
    monkeypatch.setattr(h, "MOST_SHARED", 5)
    monkeypatch.setattr(sw, "BLOCK", 3)
    edges = network(40, 90, 2)
    dist = plain(edges, 40)
    net = spark.createDataFrame(edges, "tail long, head long, weight long")
    hier = cut(h.customized_cells(h.respecting(cut(h.contract(net)), net)))
    assert hier.count() > 5
    od = spark.createDataFrame([(a * 40 + b, a, b) for a in range(40) for b in range(40) if a != b], "query_id long, src long, dst long")
    want = {(a * 40 + b, dist[a][b]) for a in range(40) for b in range(40) if a != b}
    assert {tuple(r) for r in h.etree_query(hier, od).select("query_id", "dist").collect()} == want
    ranks = spark.createDataFrame([(v,) for v in range(40)], "rank long")
    assert {tuple(r) for r in h.label_query(cut(h.labels(hier, ranks)), od).collect()} == want
    pi = {(t, v, dist[v][t]) for t in range(40) for v in range(40) if dist[v][t] is not None}
    assert {(r["dst"], r["node"], r["pi"]) for r in h.cch_potentials(hier, ranks, ranks).collect()} >= pi - {(v, v, 0) for v in range(40)}
    found, dealt = sw.potentials(hier, ranks)
    assert {(r["query_id"], r["dist"]) for r in s.astar_batched(net, od, found, dealt, sw.FAR).collect()} == want


def test_bounds_of_functions_go_to_all_tasks(spark):
    """Only the asked sides are made, in more tasks than the few that so few bytes would get."""
    point = lambda x, y: F.struct(F.lit(x).alias("dep"), F.lit(y).alias("tt"))
    points = F.array(point(0, 5000), point(21_600_000, 5100), point(43_200_000, 9000), point(86_400_000, 5000))
    some = spark.range(300).select(F.col("id").alias("key"), F.when(F.col("id") != 7, points).alias("p"))
    found = a.reduced(some, 300.0, ("lower",))
    assert found.columns == ["key", "p", "lower"] and found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    rows = {r["key"]: r for r in found.collect()}
    assert len(rows) == 300 and rows[7]["lower"] is None
    whole = {r["key"]: r for r in a.reduced(some, 300.0).collect()}
    assert all(rows[k]["lower"] == whole[k]["lower"] and rows[k]["p"] == whole[k]["p"] for k in rows)


def test_nearest_looks_once_for_each_place(spark):
    """Many points of few places take no more rows through the rings than there are places."""
    points = [(k, k % 7 * 13, k % 5 * 11) for k in range(200)] + [(999, None, 3)]
    nodes = [(v, v % 9 * 10, v // 9 * 10) for v in range(60)]
    got = g.nearest(spark.createDataFrame(points, "point_id long, x long, y long"), spark.createDataFrame(nodes, "node_id long, x long, y long"), 16).collect()
    want = set()
    for k, x, y in points[:-1]:
        d2, v = min(((x - a) ** 2 + (y - b) ** 2, v) for v, a, b in nodes)
        want.add((k, v, d2))
    assert {tuple(r) for r in got} == want | {(999, None, None)}


def test_completion_comes_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(h, "STREAMED", 3)
    edges = network(60, 110, 4)
    near = {v: set() for v in range(60)}
    for a_, b_, _ in edges:
        if a_ != b_:
            near[min(a_, b_)].add(max(a_, b_))
    for v in range(60):
        if near[v]:
            first = min(near[v])
            near[first] |= near[v] - {first}
    got = [tuple(r) for r in h.contract(spark.createDataFrame(edges, "tail long, head long, weight long")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(v, w) for v in near for w in near[v]}


def test_cells_are_put_in_order_by_levels(spark, monkeypatch):
    """More cells than MOST_SHARED, in the order of a plain walk."""
    monkeypatch.setattr(h, "MOST_SHARED", 5)
    rng = random.Random(5)
    parent = {v: rng.randrange(v + 1, min(v + 9, 60)) for v in range(59)} | {59: None, 60: None, 61: 63, 62: 63, 63: None}
    tree = spark.createDataFrame(list(parent.items()), "rank long, parent long")
    children = {}
    for v, p in parent.items():
        children.setdefault(p, []).append(v)
    cell = {}
    for v in sorted(parent, reverse=True):
        p = parent[v]
        cell[v] = cell[p] if p is not None and len(children[p]) == 1 else v
    up = {c: cell[parent[c]] if parent[c] is not None else None for c in set(cell.values())}
    size = {c: sum(x == c for x in cell.values()) for c in up}
    below = {c: sorted(x for x in up if up[x] == c) for c in up}

    def total(c):
        return size[c] + sum(total(x) for x in below[c])

    def walk(c):
        return [c, *(y for x in sorted(below[c], key=lambda x: (-total(x), x)) for y in walk(x))]

    roots = sorted(c for c in up if up[c] is None)
    breadth, level = [], roots
    while level:
        breadth, level = breadth + level, [x for c in level for x in below[c]]
    for by, order in (("breadth", breadth), ("size", [y for c in roots for y in walk(c)])):
        ranks = [v for c in reversed(order) for v in sorted(cell) if cell[v] == c]
        assert {tuple(r) for r in h.reordered(tree, by).collect()} == {(v, k) for k, v in enumerate(ranks)}
