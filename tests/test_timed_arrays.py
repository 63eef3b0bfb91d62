"""Earliest arrivals by arrays and by joins against a plain search."""

import heapq
import random
from bisect import bisect_right

import pytest

from roadloom.operators import ttf as t


def network(seed):
    """Functions of two to six points on parallel and one-way edges; a part that can't be reached."""
    rng, edges, points = random.Random(seed), [], []
    for k in range(110):
        a, b = (rng.randrange(30), rng.randrange(30)) if k < 100 else (40 + k % 3, 40 + k % 2)
        edges.append((k, a, b))
        base = rng.choice([5, 10, 10, 20]) * 100_000
        deps = [0, *sorted(rng.sample(range(1, 24), rng.randrange(5))), 24]
        first = base + rng.choice([0, 1000])
        points += [(k, j, h * 3_600_000, first if h in (0, 24) else base + rng.randrange(0, 900_000)) for j, h in enumerate(deps)]
    return edges, points


def plain(edges, points, src, dst, start):
    by, out = {}, {}
    for k, _, dep, tt in points:
        by.setdefault(k, []).append((dep, tt))
    for k, a, b in edges:
        out.setdefault(a, []).append((b, by[k]))
    best, pred, heap = {src: start}, {}, [(start, src)]
    while heap:
        now, u = heapq.heappop(heap)
        if now > best[u]:
            continue
        for v, p in out.get(u, ()):
            x = now % t.DAY
            if len(p) == 2:
                d = p[0][1]
            else:
                k = bisect_right([a for a, _ in p], x) - 1
                (a, ta), (b, tb) = p[k], p[k + 1]
                d = a + ta + (x - a) * (b + tb - a - ta) // (b - a) - x
            if now + d < best.get(v, now + d + 1):
                best[v], pred[v] = now + d, u
                heapq.heappush(heap, (now + d, v))
    if dst not in best:
        return None, None
    path = [dst]
    while path[-1] != src:
        path.append(pred[path[-1]])
    return best[dst] - start, path[::-1]


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_arrivals_at_any_size(spark, most, monkeypatch):
    monkeypatch.setattr(t, "CELLS", 100)  # three queries at a time
    edges, points = network(3)
    rng = random.Random(1)
    od = [(q, rng.randrange(30), rng.randrange(30) if q % 5 else 41, rng.randrange(t.DAY)) for q in range(40)] + [(50, 3, 3, 7), (51, 777, 4, 7), (52, 777, 777, 7)]
    net, ttf = spark.createDataFrame(edges, "edge_id long, tail long, head long"), spark.createDataFrame(points, "edge_id long, idx long, dep long, tt long")
    got = {r["query_id"]: (r["duration"], r["path"]) for r in t.earliest_arrival(net, ttf, spark.createDataFrame(od, "query_id long, src long, dst long, departure long"), most=most).collect()}
    assert got == {q: plain(edges, points, a, b, start) for q, a, b, start in od}
