"""Hierarchies, corridors and robust routes against plain definitions."""

import itertools
import random

import pytest

from conftest import SMALL
from roadloom import catalog
from roadloom.fixtures import view
from roadloom.operators import alternatives as alt
from roadloom.operators import ch
from roadloom.operators import hierarchy as h
from roadloom.operators import ordered
from roadloom.operators import search as s
from roadloom.operators import ttf as t
from roadloom.operators import workload as w
from roadloom.session import cut
from roadloom.sources import files


def random_network(seed, n=14, m=40):
    rng = random.Random(seed)
    return [(u, v, rng.randint(1, 9)) for u, v in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if u != v]


def distances(edges, n=14):
    d = {(u, v): 0 if u == v else float("inf") for u in range(n) for v in range(n)}
    for u, v, x in edges:
        d[u, v] = min(d[u, v], x)
    for k, i, j in itertools.product(range(n), repeat=3):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    return d


def frame(spark, edges):
    return spark.createDataFrame(edges, "tail long, head long, weight long")


def all_pairs(spark, n=14):
    return spark.createDataFrame([(i * n + j, i, j) for i in range(n) for j in range(n)], "query_id long, src long, dst long")


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchies(spark, seed):
    """Distances and paths of both hierarchies, and of partial contraction, on all pairs."""
    edges = random_network(seed)
    want, cheapest = distances(edges), {}
    for u, v, x in edges:
        cheapest[u, v] = min(x, cheapest.get((u, v), x))
    net, od = frame(spark, edges), all_pairs(spark)
    walked = lambda p: sum(cheapest[a, b] for a, b in zip(p, p[1:]))
    cch = cut(h.contract(net))
    weights = cut(h.customize(h.respecting(cch, net)))
    for found in (ch.query(cut(ch.contract(net)), od), h.etree_query(weights, od, with_path=True)):
        for r in found.collect():
            i, j = divmod(r["query_id"], 14)
            assert r["dist"] == (None if want[i, j] == float("inf") else want[i, j])
            assert (walked(r["path"]) == r["dist"] and (r["path"][0], r["path"][-1]) == (i, j)) if r["dist"] is not None else not r["path"]
    left = distances([(r["tail"], r["head"], r["weight"]) for r in ch.overlay(net, 7).collect()])
    assert all(left[i, j] == want[i, j] for i in range(7, 14) for j in range(7, 14))
    arcs = {(r["lo"], r["hi"]): r for r in weights.collect()}
    for r in h.unpack_arcs(weights).collect():
        own, mids = arcs[r["lo"], r["hi"]], [v for v in range(r["lo"]) if (v, r["lo"]) in arcs and (v, r["hi"]) in arcs]
        ok = lambda v: arcs[v, r["lo"]]["down"] is not None and arcs[v, r["hi"]]["up"] is not None and arcs[v, r["lo"]]["down"] + arcs[v, r["hi"]]["up"] == own["up"]
        assert r["up_mid"] == min(filter(ok, mids), default=None)
    useful = {(r["dir"], r["lo"], r["hi"]) for r in h.directed(cch, net).collect()}
    assert useful == {(c, *k) for k, r in arcs.items() for c in ("up", "down") if r[c] is not None}


@pytest.mark.parametrize("policy", ["min_key", "alternating"])
def test_search_family(spark, policy):
    edges = random_network(3)
    want, od = distances(edges), all_pairs(spark)
    exact = spark.createDataFrame([(j, i, int(x)) for (i, j), x in want.items() if x < float("inf")], "dst long, node long, pi long")
    null = lambda x: None if x == float("inf") else x
    plain = s.astar(frame(spark, edges), od).collect()
    led = s.astar(frame(spark, edges), od, exact).collect()
    for found in (plain, led, s.pairs(frame(spark, edges), od).collect(), s.bidirectional(frame(spark, edges), od, policy).collect()):
        assert {(r["src"], r["dst"]): r["dist"] for r in found} == {k: null(x) for k, x in want.items()}
    assert sum(r["settled"] for r in led) < sum(r["settled"] for r in plain)
    gone = {r["query_id"] for r in s.unreachable(frame(spark, edges), od, look=2).collect()}
    assert gone == {i * 14 + j for (i, j), x in want.items() if x == float("inf")}


def test_rounds_of_large_networks(spark, monkeypatch):
    """The frontier back-ends give the same."""
    monkeypatch.setattr(s, "LOCAL_EDGES", 3)
    edges = random_network(5, 8, 16)
    want, od = distances(edges, 8), all_pairs(spark, 8).where("src < 3")
    got = {(r["src"], r["dst"]): r["dist"] for r in s.astar(frame(spark, edges), od).collect()}
    assert got == {k: None if x == float("inf") else x for k, x in want.items() if k[0] < 3}


def test_separators(spark):
    cch = cut(h.contract(catalog_ranked(spark)))
    nodes = view(spark, SMALL, "grid_order").select("rank")
    tree = {r["rank"]: r["parent"] for r in h.full_tree(cch, nodes).collect()}
    children = {}
    for v, p in tree.items():
        children.setdefault(p, []).append(v)

    def cell(v):
        while tree[v] is not None and len(children[tree[v]]) == 1:
            v = tree[v]
        return v

    frame_ = cut(h.full_tree(cch, nodes))
    got = {r["rank"]: r["cell"] for r in h.separator_tree(frame_).collect()}
    assert got == {v: cell(v) for v in tree}
    depth = lambda v: 0 if tree[v] is None else depth(tree[v]) + (got[v] != got[tree[v]])
    levels = {}
    for v in tree:
        levels.setdefault(depth(v), []).append(v)
    assert {(r["level"], r["cells"], r["nodes"]) for r in h.separator_levels(frame_).collect()} == {(k, len({got[v] for v in x}), len(x)) for k, x in levels.items()}
    for by in ("breadth", "size"):
        place = {r["rank"]: r["position"] for r in h.reordered(frame_, by).collect()}
        assert sorted(place.values()) == list(range(len(tree)))
        assert all(place[v] < place[p] for v, p in tree.items() if p is not None)


def catalog_ranked(spark):
    from roadloom.plans.structure import ranked

    return ranked(spark, SMALL)


def test_robust_routes(spark):
    rng = random.Random(2)
    cells = [(x, y) for x in range(4) for y in range(4)]
    edges = [(4 * x + y, 4 * a + b, rng.randint(3, 9)) for x, y in cells for a, b in ((x + 1, y), (x, y + 1), (x - 1, y), (x, y - 1)) if (a, b) in cells]
    live = [(u, v, rng.randint(1, 30)) for u, v, _ in edges]
    want, usual, now = distances(edges, 16), {(u, v): x for u, v, x in edges}, {(u, v): x for u, v, x in live}
    eps = 0.3

    def bad(p):
        length = lambda i, j: sum(usual[a, b] for a, b in zip(p[i:j], p[i + 1 : j + 1]))
        return any(length(i, j) - want[p[i], p[j]] > int(want[p[i], p[j]] * eps) for i in range(len(p)) for j in range(i + 1, len(p)))

    def simple(p):
        if p[-1] == 15:
            yield p
            return
        for u, v, _ in edges:
            if u == p[-1] and v not in p and not bad([*p, v]):
                yield from simple([*p, v])

    best = min(sum(now[a, b] for a, b in zip(p, p[1:])) for p in simple([0]))
    od = spark.createDataFrame([(1, 0, 15)], "query_id long, src long, dst long")
    r = alt.traffic_aware(frame(spark, edges), frame(spark, live), od, eps).first()
    assert r["live_length"] == best and not bad(r["path"])
    around = [0, 4, 8, 12, 13, 9, 5, 1, 2, 6, 10, 14, 15]
    paths = spark.createDataFrame([(7, k, v) for k, v in enumerate(around)], "path_id long, idx long, node long")
    fixed = [x["node"] for x in sorted(alt.fix_paths(paths, frame(spark, edges), eps).collect(), key=lambda x: x["idx"])]
    assert (fixed[0], fixed[-1]) == (0, 15) and not bad(fixed) and all((a, b) in usual for a, b in zip(fixed, fixed[1:]))
    one = alt.local_optimality(paths, frame(spark, edges), eps).first()
    parts = [around[i : j + 1] for i in range(len(around)) for j in range(i + 1, len(around))]
    length = lambda p: sum(usual[a, b] for a, b in zip(p, p[1:]))
    assert one["length"] == length(around)
    assert one["shortest_detour"] == min(length(p) for p in parts if length(p) - want[p[0], p[-1]] > int(want[p[0], p[-1]] * eps))


def test_order(spark, monkeypatch):
    rows = [(i * 37 % 101, i % 5 or None) for i in range(101)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    ordered_rows = sorted(rows)
    assert [(r["k"], r["n"]) for r in ordered.number_rows(df, ["k"], "n").orderBy("k").collect()] == [(k, n) for n, (k, _) in enumerate(ordered_rows)]
    total, want, last, carried = 0, [], None, []
    for k, v in ordered_rows:
        want.append((k, total))
        total += v or 0
        last = last if v is None else v
        carried.append((k, last))
    from pyspark.sql import functions as F

    assert [(r["k"], r["s"]) for r in ordered.running_sum(df, ["k"], F.coalesce("v", F.lit(0)), "s").orderBy("k").collect()] == want
    assert [(r["k"], r["c"]) for r in ordered.carry_last(df, ["k"], "v", "c").orderBy("k").collect()] == carried
    assert ordered.number_rows(df.limit(0), ["k"], "n").count() == 0


def test_stored_structures(spark, tmp_path):
    tables = {"edges": spark.createDataFrame([(0, 1), (0, 2)], "lo long, hi long"), "tree": spark.createDataFrame([(0, 1), (1, None)], "rank long, parent long")}
    files.store(tables, str(tmp_path))
    back = files.load(spark, str(tmp_path), files.CCH_TABLES)
    assert all(sorted(back[n].collect()) == sorted(tables[n].collect()) for n in ("edges",)) and back["tree"].count() == 2
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path), {"edges": "lo long, weight long"})


def test_workloads(spark):
    q = spark.range(20_000).withColumnRenamed("id", "query_id")
    hours = {r["h"]: r["n"] for r in w.departures(q, "rush_hour", 1).selectExpr("departure div 3600000 as h").groupBy("h").count().withColumnRenamed("count", "n").collect()}
    assert set(hours) == set(range(24)) and all(abs(hours[x] / 20_000 - n / 245) < 0.01 for x, n in enumerate(w.RUSH_HOUR))
    normal = [r["departure"] / 1000 for r in w.departures(q, "normal", 1).collect()]
    assert abs(sum(normal) / len(normal) - 43_200) < 300
    mean = q.select(w.geometric(q.query_id, 1, 1000).alias("g")).agg({"g": "avg"}).first()[0]
    assert abs(mean - 1000) < 40
    with pytest.raises(ValueError):
        w.departures(q, "never", 1)
    with pytest.raises(KeyError):
        w.generate("unknown", 1, q, q, q)


def test_function_parts(spark):
    ttf = view(spark, SMALL, "ttf")
    whole = t.append(ttf, ttf, 30_000_000)
    at = ttf.select("edge_id").distinct().selectExpr("edge_id as key", "edge_id", "explode(sequence(0L, 86000000L, 9555555L)) as t")
    a = {(r["edge_id"], r["t"]): r["tt"] for r in t.evaluate(ttf, at).collect()}
    b = {(r["edge_id"], r["t"]): r["tt"] for r in t.evaluate(whole, at).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= 1 for k in a)  # the new point is rounded down
