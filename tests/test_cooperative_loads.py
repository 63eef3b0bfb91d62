"""Cooperative routing against a plain version with one table of loads."""

import heapq
import random

from roadloom.operators import coop

DAY, SIZE = 86_400_000, 900_000


def plain(edges, od, batch, used):
    def cost(e, ff, cap, t):
        load = used.get((e, t % DAY // SIZE), 0) / cap
        return max(1, int(ff * (1 + load * load) + 0.5))

    trips, pending = [], []
    for n, (q, s, t, start) in enumerate(sorted(od, key=lambda r: (r[3], r[0]))):
        best, by, heap = {s: start}, {}, [(start, s)]
        while heap:
            now, u = heapq.heappop(heap)
            if now > best[u]:
                continue
            if u == t:
                break
            for e, a, b, ff, cap in edges:
                if a == u and (new := now + cost(e, ff, cap, now)) < best.get(b, new + 1):
                    best[b], by[b] = new, (u, e, ff, cap, now)
                    heapq.heappush(heap, (new, b))
        way, v = [], t
        while t in best and v != s:
            way.insert(0, by[v])
            v = by[v][0]
        trips.append((q, start, best[t] - start if t in best else None, way))
        pending += [(e, at % DAY // SIZE) for _, e, _, _, at in way]
        if (n + 1) % batch == 0 or n + 1 == len(od):
            for k in pending:
                used[k] = used.get(k, 0) + 1
            pending = []
    out = []
    for q, start, took, way in trips:
        now = start
        for _, e, ff, cap, _ in way:
            now += cost(e, ff, cap, now)
        out.append((q, took, None if took is None else now - start, [(e, at % DAY // SIZE * SIZE) for _, e, _, _, at in way]))
    return out


def test_cooperative(spark):
    draw = random.Random(9)
    edges = [(k, draw.randrange(15), draw.randrange(15), draw.randrange(1, 600_000), draw.randrange(1, 4)) for k in range(60)]
    od = [(k, draw.randrange(15), draw.randrange(16), draw.randrange(DAY - 2_000_000, DAY)) for k in range(40)]
    net, trips = spark.createDataFrame(edges, "edge_id long, tail long, head long, ff_time long, capacity long"), spark.createDataFrame(od, "query_id long, src long, dst long, departure long")
    earlier = [(k, b * SIZE, 2) for k in range(0, 60, 4) for b in (0, 94, 95)]
    state = spark.createDataFrame(earlier, "edge_id long, bucket long, used long")
    for batch, used in ((1, None), (10, state)):
        want = plain(edges, od, batch, {} if used is None else {(e, b // SIZE): n for e, b, n in earlier})
        got = [(r["query_id"], r["duration"], r["realised"], [tuple(x) for x in r["uses"]]) for r in coop.cooperative(net, trips, SIZE, batch, used).collect()]
        assert sorted(got) == sorted(want)
