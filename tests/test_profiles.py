"""Hierarchies by cells, functions on them, profiles with paths, all against plain searches on a network of 200 nodes."""

import heapq
from bisect import bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from roadloom.fixtures import view
from roadloom.operators import cells, hierarchy, profiles
from roadloom.operators.ttf import DAY
from roadloom.plans.structure import ranked
from roadloom.session import cut


@pytest.fixture(scope="module")
def net(spark):
    """Edges between ranks with their functions, in memory."""
    edges = ranked(spark, SMALL).collect()
    points = {}
    for r in view(spark, SMALL, "ttf").orderBy("edge_id", "dep").collect():
        points.setdefault(r["edge_id"], []).append((r["dep"], r["tt"]))
    out = {}
    for e in edges:
        dep, tt = zip(*points[e["edge_id"]])
        out.setdefault(e["tail"], []).append((e["head"], e["edge_id"], dep, tt))
    return out


@pytest.fixture(scope="module")
def built(spark):
    """completion, its cells and tree, functions of edges; cells are small, so that there are several rounds."""
    kept, cells.CELL = cells.CELL, 60
    edges = ranked(spark, SMALL)
    cch = cut(hierarchy.contract(edges))
    bounds = view(spark, SMALL, "ttf").groupBy("edge_id").agg(F.max("tt").alias("weight"))
    upper = cut(hierarchy.customized_cells(hierarchy.respecting(cch, edges.drop("weight").join(bounds, "edge_id"))))
    out = {"cch": cch, "cells": cut(hierarchy.cells_of(upper)), "limits": cut(hierarchy.perfected(upper)), "tree": cut(hierarchy.full_tree(cch, view(spark, SMALL, "grid_order"))), "edges": cut(profiles.edge_functions(edges, view(spark, SMALL, "ttf")))}
    out["needed"] = cut(profiles.customize(out["edges"], out["cells"], out["limits"]))
    yield out
    cells.CELL = kept


def arrivals(net, start, at, inner=10**9):
    """Earliest arrivals over inner nodes below a rank."""
    best, heap = {start: at}, [(at, start)]
    while heap:
        t, u = heapq.heappop(heap)
        if t > best[u] or (u != start and u >= inner):
            continue
        x = t % DAY
        for v, _, dep, tt in net.get(u, ()):
            k = bisect_right(dep, x) - 1
            new = t + tt[k] + (tt[k + 1] - tt[k]) * (x - dep[k]) / (dep[k + 1] - dep[k])
            if new < best.get(v, np.inf):
                best[v] = new
                heapq.heappush(heap, (new, v))
    return best


def test_cells_give_the_same_completion(spark, built):
    above = {}
    for r in ranked(spark, SMALL).collect():
        above.setdefault(min(r["tail"], r["head"]), set()).add(max(r["tail"], r["head"]))
    for v in range(200):
        own = sorted(above.get(v, ()))
        if own:
            above.setdefault(own[0], set()).update(own[1:])
    assert {tuple(r) for r in built["cch"].select("lo", "hi").collect()} == {(v, w) for v in above for w in above[v]}
    sizes = built["cells"].groupBy("round", "cell").count().collect()
    assert max(r["count"] for r in sizes) <= 60 and len({r["round"] for r in sizes}) > 1


def test_components_loop_equals_local(spark, monkeypatch):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(60) if k % 7] + [(70, 90), (80, 90)], "lo long, hi long")
    nodes = spark.range(100).select(F.col("id").alias("rank"))
    local = sorted(map(tuple, cells.components(pairs, nodes).collect()))
    monkeypatch.setattr(cells, "LOCAL_PAIRS", 0)
    assert sorted(map(tuple, cells.components(pairs, nodes).select("rank", "cell").collect())) == local
    assert dict(local)[70] == 90 and dict(local)[99] == 99


def test_every_shortcut_has_the_function_of_a_search(built, net):
    rows = profiles.customize(built["edges"], built["cells"]).collect()
    assert len(rows) == 2 * built["cch"].count()
    known = {}
    for r in rows:
        a, b = (r["lo"], r["hi"]) if r["dir"] == "up" else (r["hi"], r["lo"])
        for x in (0.0, 20_000_000.0, 43_210_987.0, 86_399_000.0):
            key = (a, x, r["lo"])
            if key not in known:
                known[key] = arrivals(net, a, x, r["lo"])
            assert abs(np.interp(x, r["dep"], r["tt"]) - (known[key][b] - x)) < 0.01
        assert r["dep"][0] == 0 and r["dep"][-1] == DAY and r["starts"][0] == 0 and len(r["starts"]) == len(r["vias"])
        assert all(v < r["lo"] for v in r["vias"])


def asked(spark, first=0, last=DAY, n=4):
    od = [(k, (k * 67 + 3) % 200, (k * 131 + 90) % 200, first + k * 1000, last) for k in range(n)]
    return od, spark.createDataFrame([*od, (99, 5, 5, first, last)], "query_id long, src long, dst long, first long, last long")


def test_profiles_equal_searches(spark, built, net):
    """Over the whole day, and over a part of it that crosses midnight."""
    for first, last in ((0, DAY), (80_000_000, 90_000_000)):
        od, df = asked(spark, first, last)
        found = {}
        for r in profiles.profile(built["needed"], built["tree"], df).orderBy("query_id", "dep").collect():
            found.setdefault(r["query_id"], []).append((r["dep"], r["tt"]))
        assert set(found) == {q for q, *_ in od} | {99}
        for q, s, t, a, b in od:
            dep, tt = zip(*found[q])
            assert (dep[0], dep[-1]) == (a, b)
            for x in np.linspace(a, b, 40):
                assert abs(np.interp(x, dep, tt) - (arrivals(net, s, x)[t] - x)) < 0.01


def test_paths_of_all_ranges(spark, built, net):
    """Ranges lie end to end; their paths, driven at a thousand departures, arrive when a search does."""
    od, df = asked(spark)
    edges = {e: (u, v, dep, tt) for u, ways in net.items() for v, e, dep, tt in ways}
    ranges = {}
    for r in profiles.profile_paths(built["needed"], built["tree"], df).orderBy("query_id", "first").collect():
        ranges.setdefault(r["query_id"], []).append(r)
    for q, s, t, a, b in od:
        rows = ranges[q]
        assert rows[0]["first"] == a and rows[-1]["last"] == b and all(abs(x["last"] - y["first"]) < 1e-3 for x, y in zip(rows, rows[1:]))
        assert all(x["edges"] != y["edges"] for x, y in zip(rows, rows[1:]))
        for x in np.linspace(a, b - 1, 250):
            row = next(r for r in rows if r["first"] - 1e-3 <= x <= r["last"] + 1e-3)
            now, at = x, s
            for e in row["edges"]:
                u, v, dep, tt = edges[e]
                assert u == at
                now, at = now + np.interp(now % DAY, dep, tt), v
            assert at == t and abs(now - arrivals(net, s, x)[t]) < 0.05
    assert any(len(rows) > 1 for rows in ranges.values())


def test_paths_at_departures(spark, built, net):
    od = [(k, (k * 67 + 3) % 200, (k * 131 + 90) % 200, 7_919_000 * k) for k in range(12)]
    rows = profiles.paths_at(built["needed"], built["tree"], spark.createDataFrame(od, "query_id long, src long, dst long, departure long")).orderBy("query_id", "idx").collect()
    edges = {e: (u, v, dep, tt) for u, ways in net.items() for v, e, dep, tt in ways}
    for q, s, t, x in od:
        now, at = float(x), s
        for r in (r for r in rows if r["query_id"] == q):
            u, v, dep, tt = edges[r["edge_id"]]
            assert u == at and abs(now - r["entered"]) < 0.01
            now, at = now + np.interp(now % DAY, dep, tt), v
        assert at == t and abs(now - arrivals(net, s, x)[t]) < 0.01


def test_no_way(spark, built):
    lone = built["needed"].where("lo > 150")
    _, df = asked(spark, n=1)
    assert profiles.profile(lone, built["tree"], df.where("query_id = 0")).count() == 0
    assert profiles.profile_paths(lone, built["tree"], df.where("query_id = 0")).count() == 0


def test_merge_says_which_is_better():
    day = float(DAY)
    f = profiles.function(np.array([0.0, day]), np.array([10.0, 10.0]), [0.0], [1])
    g = profiles.function(np.array([0.0, day / 2, day]), np.array([20.0, 0.0, 20.0]), [0.0, day / 2], [2, 3])
    h = profiles.merge(f, g)
    assert h.starts == [0.0, day / 4, day / 2, 3 * day / 4] and h.vias == [1, 2, 3, 1]
    assert h.tt.tolist() == [10.0, 10.0, 0.0, 10.0, 10.0]
    assert profiles.merge(f, f) is f


def test_sources_and_unique_paths(built):
    """Against a plain descent through all sources; all shortcuts are there, so both legs of each are."""
    every = cut(profiles.customize(built["edges"], built["cells"]))
    rows = {(r["lo"], r["hi"], r["dir"]): r["vias"] for r in every.collect()}
    known = {}

    def unique(lo, hi, way):
        if (lo, hi, way) not in known:
            vias = rows[lo, hi, way]
            a, b = (lo, hi) if way == "up" else (hi, lo)
            known[lo, hi, way] = len(vias) == 1 and (vias[0] < 0 or unique(vias[0], a, "down") and unique(vias[0], b, "up"))
        return known[lo, hi, way]

    expected = {k for k in rows if unique(*k)}
    found = [tuple(r) for r in profiles.unique_paths(every).collect()]
    assert set(found) == expected and len(found) == len(expected)
    single = {k for k in rows if len(rows[k]) == 1}
    assert expected < single < set(rows)
    s = profiles.source_statistics(every).first()
    assert tuple(s) == (len(rows), sum(map(len, rows.values())), max(map(len, rows.values())), len(single))
    assert tuple(profiles.source_statistics(every.limit(0)).first()) == (0, None, None, 0)
    assert profiles.unique_paths(every.limit(0)).count() == 0
