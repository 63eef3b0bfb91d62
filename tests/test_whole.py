"""Queries over the whole of their tables, against brute force on a small fixture."""

import heapq
from pathlib import Path

import duckdb
import pytest

from conftest import SMALL
from roadloom import catalog
from roadloom.fixtures import view


@pytest.fixture(scope="module")
def later(tmp_path_factory):
    """sf0.001 with order keys from 6,000 on, so that all of the workload's ids are above 3,000."""
    d = tmp_path_factory.mktemp("later")
    for f in Path(SMALL).glob("*.parquet"):
        if f.name != "orders.parquet":
            (d / f.name).symlink_to(f)
    duckdb.sql(f"copy (select * replace (o_orderkey + 6000 as o_orderkey) from '{SMALL}/orders.parquet') to '{d}/orders.parquet' (format parquet)")
    return str(d)


def tables(spark, d, *names):
    return [view(spark, d, n).collect() for n in names]


def dijkstra(edges, src):
    near = {}
    for e in edges:
        near.setdefault(e["tail"], []).append((e["head"], e["weight"]))
    dist, heap = {}, [(0, src)]
    while heap:
        d, u = heapq.heappop(heap)
        if u not in dist:
            dist[u] = d
            for v, w in near.get(u, ()):
                heapq.heappush(heap, (d + w, v))
    return dist


@pytest.mark.parametrize("name", ["p2p_distance", "bidirectional", "cch_query", "hub_label_query", "astar_zero", "astar_exact_potential"])
def test_whole_distances(spark, later, name):
    od, edges = tables(spark, later, "od", "g_trans" if name.startswith("astar") else "g_grid")
    want = {r["query_id"]: dijkstra(edges, r["src"]).get(r["dst"]) for r in od if r["src"] != r["dst"]}
    got = catalog.queries()[f"{name}"](spark, later).collect()
    assert want and {r["query_id"]: r["dist"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("name", ["many_to_many", "rphast"])
def test_whole_tables(spark, later, name):
    od, edges = tables(spark, later, "od", "g_grid")
    od = [r for r in od if name == "many_to_many" or r["src"] != r["dst"]]
    ends = {r["dst"] for r in od}
    want = {(s, t, d) for s in {r["src"] for r in od} for t, d in dijkstra(edges, s).items() if t in ends}
    assert want and {(r["src"], r["dst"], r["dist"]) for r in catalog.queries()[f"{name}"](spark, later).collect()} == want


@pytest.mark.parametrize("name", ["shortest_path_nodes", "path_prefix_dist"])
def test_whole_paths(spark, later, name):
    od, edges = tables(spark, later, "od", "g_grid")
    step = {(e["tail"], e["head"]): e["weight"] for e in edges}
    ways = {}
    for r in sorted(catalog.queries()[f"{name}"](spark, later).collect(), key=lambda r: r["idx"]):
        ways.setdefault(r[0] if name == "shortest_path_nodes" else r["path_id"], []).append((r["node"], r["dist"]))
    assert set(ways) == {r["query_id"] for r in od if r["src"] != r["dst"]}
    for r in od:
        if r["src"] != r["dst"]:
            way = ways[r["query_id"]]
            assert way[0] == (r["src"], 0) and way[-1] == (r["dst"], dijkstra(edges, r["src"])[r["dst"]])
            assert all(b - a == step[u, v] for (u, a), (v, b) in zip(way, way[1:]))


def test_whole_bounds(spark, later):
    od, edges = tables(spark, later, "od", "g_grid")
    dist = {r["query_id"]: dijkstra(edges, r["src"])[r["dst"]] for r in od if r["src"] != r["dst"]}
    assert sorted(map(tuple, catalog.queries()["penalty_metrics_base"](spark, later).collect())) == sorted((q, x * 125 // 100, x // 100) for q, x in dist.items())
    far = {s: min(((x, v) for v, x in dijkstra(edges, s).items() if x >= 100_000), default=None) for s in {r["src"] for r in od}}
    got = {r["q"]: (r["dist"], r["node"]) for r in catalog.queries()["od_geometric"](spark, later).collect()}
    assert got == {s: x for s, x in far.items() if x}


def test_whole_time_dependent(spark, later):
    od, edges, ttf = tables(spark, later, "od", "g_grid", "ttf")
    points = {}
    for r in sorted(ttf, key=lambda r: r["dep"]):
        points.setdefault(r["edge_id"], []).append((r["dep"], r["tt"]))

    def cost(e, t):
        x = t % 86_400_000
        (a, ta), (b, tb) = next(s for s in zip(points[e], points[e][1:]) if s[0][0] <= x < s[1][0])
        return a + ta + (x - a) * (b + tb - a - ta) // (b - a) - x

    want = {}
    for r in od:
        if r["src"] != r["dst"]:
            best, heap = {}, [(r["departure"], r["src"])]
            while heap:
                t, u = heapq.heappop(heap)
                if u not in best:
                    best[u] = t
                    for e in edges:
                        if e["tail"] == u:
                            heapq.heappush(heap, (t + cost(e["edge_id"], t), e["head"]))
            want[r["query_id"]] = best[r["dst"]] - r["departure"]
    run = catalog.queries()
    assert {r["query_id"]: r["duration"] for r in run["td_earliest_arrival"](spark, later).collect()} == want
    corridor = {r["query_id"]: r["duration"] for r in run["td_sampled_corridor"](spark, later).collect()}
    assert set(corridor) == set(want) and all(corridor[q] >= want[q] for q in want)
    way = {}
    for r in run["td_path"](spark, later).collect():
        way.setdefault(r["query_id"], {})[r["idx"]] = r["node"]
    step = {(e["tail"], e["head"]): e["edge_id"] for e in edges}
    assert set(way) == set(want)
    for r in od:
        if r["query_id"] in want:
            nodes, t = [way[r["query_id"]][k] for k in range(len(way[r["query_id"]]))], r["departure"]
            for u, v in zip(nodes, nodes[1:]):
                t += cost(step[u, v], t)
            assert (nodes[0], nodes[-1], t - r["departure"]) == (r["src"], r["dst"], want[r["query_id"]])


def test_whole_alternatives(spark, later):
    od, edges, trans = tables(spark, later, "od", "g_grid", "g_trans")
    od = {r["query_id"]: r for r in od if r["src"] != r["dst"]}
    run = catalog.queries()
    base = {r["query_id"]: r["length"] for r in run["penalty_alternatives"](spark, later).where("alternative = 0").collect()}
    assert base == {q: dijkstra(edges, r["src"])[r["dst"]] for q, r in od.items()}
    first = {r["query_id"]: r["first"] for r in run["pareto_routes"](spark, later).groupBy("query_id").agg({"first": "min"}).toDF("query_id", "first").collect()}
    assert first == {q: x for q, r in od.items() if (x := dijkstra(trans, r["src"]).get(r["dst"])) is not None}
    assert {r["path_id"] for r in run["ubs_ranges"](spark, later).collect()} <= set(od) and run["ubs_ranges"](spark, later).count()


def test_whole_nearest(spark):
    orders, nodes = tables(spark, SMALL, "orders", "grid_nodes")
    want = set()
    for r in orders:
        k = r["o_orderkey"]
        x, y = k * 7919 % 200, k * 104729 % 260
        want.add((k, *min(((n["x"] * 3 - x) ** 2 + (n["y"] * 5 - y) ** 2, n["node_id"]) for n in nodes)[::-1]))
    assert {(r["point_id"], r["node_id"], r["d2"]) for r in catalog.queries()["nearest_node"](spark, SMALL).collect()} == want


def test_whole_links(spark):
    links = sorted(view(spark, SMALL, "links").collect(), key=lambda r: r["seq"])
    ranges = {(r["seq"], r["seq"] + 1 + r["link_id"] % 7) for r in links}
    want = {r for r in ranges if not any(q != r and q[0] >= r[0] and q[1] <= r[1] for q in ranges)}
    assert {tuple(r) for r in catalog.queries()["filter_covered"](spark, SMALL).collect()} == want
    paths = {}
    for r in links:
        paths.setdefault(r["trip"], []).append(r["link_id"] % 3)
    assert catalog.queries()["distinct_paths"](spark, SMALL).first()["variants"] == len(set(map(tuple, paths.values())))


def test_whole_perfect_distances(spark):
    edges, order = tables(spark, SMALL, "g_grid", "grid_order")
    node = {r["rank"]: r["node_id"] for r in order}
    rank = {v: k for k, v in node.items()}
    pairs = {tuple(sorted((rank[e["tail"]], rank[e["head"]]))) for e in edges}
    # an edge from t to h, t < h by id, counts where its ranks rise as well, as in the query's SQL
    pairs = {(a, b) for a, b in pairs if node[a] < node[b]}
    dist = {a: dijkstra(edges, node[a]) for a in {a for a, _ in pairs}}
    got = {tuple(r) for r in catalog.queries()["cch_perfect_distances"](spark, SMALL).select("lo", "hi", "up").collect()}
    assert got == {(a, b, dist[a][node[b]]) for a, b in pairs}


def joined(pairs, without=None):
    """Whether the pairs' nodes, without one of them, hang together."""
    near = {}
    for a, b in pairs:
        if without not in (a, b):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    left = {v for p in pairs for v in p} - {without}
    todo = [min(left)]
    while todo:
        u = todo.pop()
        if u in left:
            left.discard(u)
            todo += near.get(u, ())
    return not left


def test_whole_structure(spark):
    pairs = {tuple(sorted((e["tail"], e["head"]))) for e in view(spark, SMALL, "g_trans").collect() if e["tail"] != e["head"]}
    parts = {}
    for r in catalog.queries()["biconnected_components"](spark, SMALL).collect():
        parts.setdefault(r["component"], set()).add((r["lo"], r["hi"]))
    assert set().union(*parts.values()) == pairs and sum(map(len, parts.values())) == len(pairs)
    ends = {c: {v for p in part for v in p} for c, part in parts.items()}
    assert all(joined(part) and (len(part) == 1 or all(joined(part, v) for v in ends[c])) for c, part in parts.items())
    assert all(len(ends[a] & ends[b]) <= 1 for a in ends for b in ends if a < b)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    while single := [v for v in near if len(near[v]) == 1]:
        for v in single:
            for u in near.pop(v, ()):
                near[u].discard(v)
    assert {r["node_id"] for r in catalog.queries()["degree_one_core"](spark, SMALL).collect()} == {v for v in near if near[v]}


def test_whole_profiles(spark):
    """Against earliest arrivals every ten minutes; whole milliseconds are lost at each of up to 40 edges."""
    from pyspark.sql import functions as F

    from roadloom.operators import ttf as t

    od = view(spark, SMALL, "od").where("src <> dst")
    every = od.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(143)))).select((F.col("query_id") * 1000 + F.col("k")).alias("query_id"), "src", "dst", (F.col("k") * 600_000).cast("long").alias("departure"))
    took = {}
    for r in t.earliest_arrival(view(spark, SMALL, "g_grid"), view(spark, SMALL, "ttf"), every).collect():
        took.setdefault(r["query_id"] // 1000, []).append(r["duration"])
    got = {r["query_id"]: r for r in catalog.queries()["td_profile_minimum"](spark, SMALL).collect()}
    assert set(got) == set(took)
    for q, times in took.items():
        assert min(times) - 6_000 <= got[q]["fastest"] <= min(times) + 50 and max(times) - 50 <= got[q]["slowest"] <= max(times) + 6_000
