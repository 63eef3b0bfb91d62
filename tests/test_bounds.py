"""Functions with fewer points against a grid search and the exact ones; bounds by the time of day against plain searches."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from roadloom.operators import approximation as a
from roadloom.operators import buckets as b
from roadloom.operators.profiles import function, link
from roadloom.operators.ttf import DAY
from test_profiles import arrivals, built, net  # noqa: F401

PAIR = "key long, p array<struct<dep:double,tt:double>>"


def random_function(rng, n, end=40.0, scale=40):
    """A function on which nobody overtakes."""
    x = np.concatenate([[0], np.sort(rng.choice(np.arange(1, int(end)), n - 2, replace=False)), [end]]).astype(float)
    tt = rng.integers(scale // 2, 3 * scale // 2, n).astype(float)
    return x, np.maximum.accumulate(x + tt) - x


def grid_links(x, low, high, nx=24, ny=9):
    """Fewest lines between points of a grid in the tunnel."""
    gx = np.union1d(np.linspace(x[0], x[-1], nx), x)
    lo, hi = np.interp(gx, x, low), np.interp(gx, x, high)
    points = [(i, y) for i in range(len(gx)) for y in (np.linspace(lo[i], hi[i], ny) if hi[i] > lo[i] else lo[i : i + 1])]
    done, front, links = {0}, {0}, 0
    while not any(points[k][0] == len(gx) - 1 for k in front):
        new = set()
        for j in front:
            i, y = points[j]
            for k, (e, z) in enumerate(points):
                if e > i and k not in done and k not in new:
                    at = y + (z - y) * (gx[i : e + 1] - gx[i]) / (gx[e] - gx[i])
                    if (at >= lo[i : e + 1] - 1e-9).all() and (at <= hi[i : e + 1] + 1e-9).all():
                        new.add(k)
        done, front, links = done | new, new, links + 1
    return links


@pytest.mark.parametrize("side", ["both", "lower", "upper"])
def test_fewest_points_within_the_tunnel(side):
    rng = np.random.default_rng(7)
    below, above = a.SIDES[side]
    for k in range(120):
        x, tt = random_function(rng, int(rng.integers(3, 9)))
        eps = float(rng.choice([0.5, 2, 5, 10]))
        dep, near = a.fewest(x, tt, eps, side)
        every = np.union1d(x, dep)
        off = np.interp(every, dep, near) - np.interp(every, x, tt)
        assert off.min() >= -below * eps - 1e-6 and off.max() <= above * eps + 1e-6
        assert abs(off[0]) < 1e-6 and abs(off[-1]) < 1e-6 and (np.diff(dep) > 0).all()
        assert (np.diff(near) >= -np.diff(dep) - 1e-6).all()
        if k < 15:
            low, high = tt - below * eps, tt + above * eps
            low[[0, -1]] = high[[0, -1]] = tt[[0, -1]]
            assert len(dep) - 1 <= grid_links(x, low, high)


def test_long_functions_and_odd_ones():
    x = np.linspace(0, DAY, 2001)
    tt = 600_000 + 200_000 * np.sin(x / DAY * 2 * np.pi)
    sizes = [len(a.fewest(x, tt, eps)[0]) for eps in (1.0, 100.0, 10_000.0, 1e9)]
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < 100 and sizes[-1] == 2
    one = np.array([0.0]), np.array([5.0])
    assert a.fewest(*one, 1.0) == one
    dep, near = a.fewest(np.array([0.0, 1, 2, 3]), np.array([5.0, 6, 7, 5]), 0.0)
    assert dep.tolist() == [0, 2, 3] and near.tolist() == [5, 7, 5]


def whole_days(rng, n):
    out = []
    for k in range(n):
        x, tt = random_function(rng, int(rng.integers(3, 30)))
        x, tt = x * (DAY / 40), tt * 60_000 + 10_000_000 * (k % 5 == 0)
        tt = np.maximum.accumulate(x + tt) - x
        tt[-1] = tt[0] = max(tt[0], tt[-1])
        tt = np.maximum.accumulate(x + tt) - x
        tt[0] = tt[-1]
        out.append((x, np.maximum.accumulate(x + tt) - x))
    return [(x, tt) for x, tt in out if tt[0] == tt[-1]]


def test_links_and_merges_by_bounds(spark):
    fs = whole_days(np.random.default_rng(3), 60)
    rows = [(k, [(float(p), float(q)) for p, q in zip(*f)]) for k, f in enumerate(fs)]
    few = a.reduced(spark.createDataFrame(rows, PAIR), 100_000.0)
    assert {r["key"] for r in few.where("size(near) <= size(p) and size(lower) <= size(p) and size(upper) <= size(p)").collect()} == {k for k, _ in rows}
    n = len(fs) // 2
    first = few.where(F.col("key") < n).select("key", F.col("p").alias("f"), F.col("lower").alias("f_lower"), F.col("upper").alias("f_upper"))
    second = few.where(F.col("key") >= n).select((F.col("key") - n).alias("key"), F.col("p").alias("g"), F.col("lower").alias("g_lower"), F.col("upper").alias("g_upper"))
    pairs = first.join(second, "key")
    times = np.linspace(0, DAY, 997)
    linked = a.bounded_links(pairs).collect()
    assert sorted(r["key"] for r in linked) == list(range(min(n, len(fs) - n)))
    for r in linked:
        f, g = (function(*fs[k], [0.0], [0]) for k in (r["key"], r["key"] + n))
        exact = np.interp(times, *link(f, g, 0)[:2])
        low, high = (np.interp(times, *zip(*((p["dep"], p["tt"]) for p in r[c]))) for c in ("lower", "upper"))
        assert (low <= exact + 1e-3).all() and (high >= exact - 1e-3).all()
    shares = []
    for r in a.bounded_merges(pairs).collect():
        f, g = (np.interp(times, *fs[k]) for k in (r["key"], r["key"] + n))
        who = np.array(r["firsts"])[np.searchsorted(r["starts"], times, side="right") - 1]
        clear = np.abs(f - g) > 1e-3
        assert (who == (f <= g))[clear].all()
        assert r["starts"][0] == 0 and all(x != y for x, y in zip(r["firsts"], r["firsts"][1:]))
        shares.append(r["refined"] / DAY)
    assert min(shares) == 0 and max(shares) > 0 and max(shares) < 1


def test_no_rows_and_nulls(spark):
    assert a.reduced(spark.createDataFrame([], PAIR), 1.0).count() == 0
    rows = {r["key"]: r for r in a.reduced(spark.createDataFrame([(1, None), (2, []), (3, [(0.0, 4.0)])], PAIR), 1.0).collect()}
    assert rows[1]["near"] is None and rows[2]["lower"] == [] and rows[3]["upper"][0]["tt"] == 4.0


def test_minima_of_parts(built):  # noqa: F811
    for r in b.bucketed(built["needed"].where("lo > 150"), 10).collect():
        for k, low in enumerate(r["lows"]):
            x0, x1 = k * DAY / 10, (k + 1) * DAY / 10
            inner = [t for d, t in zip(r["dep"], r["tt"]) if x0 <= d <= x1]
            assert abs(low - min([*inner, np.interp(x0, r["dep"], r["tt"]), np.interp(x1, r["dep"], r["tt"])])) < 1e-6
        assert r["high"] == max(r["tt"])


def test_least_across_midnight():
    lows = np.array([5.0, 9, 8, 7])
    q = DAY / 4
    assert b.least(lows, 1.5 * q, 2.5 * q) == 8 and b.least(lows, 3.5 * q, 4.5 * q) == 5 and b.least(lows, 5.2 * q, 5.8 * q) == 9
    assert b.least(lows, 0, 4 * q) == 5 and b.least(lows, 5.5 * q, 7.5 * q) == 7


def trips(spark, n=12):
    od = [(k, (k * 67 + 3) % 200, (k * 131 + 90) % 200, 7_919_000 * k) for k in range(n)]
    return od, spark.createDataFrame(od, "query_id long, src long, dst long, departure long")


def settled_by(net, s, t, x, left):  # noqa: F811
    """Nodes that a search on the network settles, led by `left`."""
    best, heap, n = {s: x}, [(x + left.get(s, np.inf), x, s)], 0
    while heap:
        _, now, u = heapq.heappop(heap)
        if now > best[u]:
            continue
        if u == t:
            return now - x, n
        n += 1
        for v, _, dep, tt in net.get(u, ()):
            at = now + np.interp(now % DAY, dep, tt)
            if v in left and at < best.get(v, np.inf):
                best[v] = at
                heapq.heappush(heap, (at + left[v], at, v))


def test_bounds_hold_and_lead_better(spark, built, net):  # noqa: F811
    """All nodes' bounds against searches at times within the trip; the search on the network that they lead."""
    od, df = trips(spark, 8)
    edges = b.bucketed(built["needed"], 96)
    nodes = df.select("query_id").crossJoin(spark.range(200).select(F.col("id").alias("rank")))
    left, day = {}, {}
    for r in b.potentials(edges, built["tree"], df, nodes).collect():
        day.setdefault(r["query_id"], {})[r["rank"]] = r["day_bound"]
        if r["bound"] is not None:
            assert r["bound"] >= r["day_bound"] - 1e-6
            left.setdefault(r["query_id"], {})[r["rank"]] = r["bound"]
    upper = {r["query_id"]: r for r in b.earliest_arrival(edges, built["tree"], df).collect()}
    total, better = [0, 0], 0
    for q, s, t, x in od:
        reach, most = arrivals(net, s, float(x)), x + upper[q]["upper"]
        for v, bound in left[q].items():
            for at in (reach[v], (reach[v] + most) / 2):
                arrival = arrivals(net, v, at)[t]
                assert arrival > most or bound <= arrival - at + 0.01
            better += bound > day[q][v] + 1
        lost = set(range(200)) - set(left[q])
        assert all(arrivals(net, v, reach[v])[t] > reach[t] - 0.01 for v in lost)
        for k, own in enumerate((left[q], day[q])):
            duration, n = settled_by(net, s, t, float(x), own)
            assert abs(duration - (reach[t] - x)) < 0.01
            total[k] += n
    assert better > 100 and total[0] < total[1]


def test_arrivals_led_by_buckets(spark, built, net):  # noqa: F811
    od, df = trips(spark)
    counts = []
    for buckets in (1, 96):
        rows = {r["query_id"]: r for r in b.earliest_arrival(b.bucketed(built["needed"], buckets), built["tree"], df).collect()}
        assert len(rows) == len(od)
        for q, s, t, x in od:
            exact = arrivals(net, s, float(x))[t] - x
            assert abs(rows[q]["duration"] - exact) < 0.01 and rows[q]["bound"] <= exact + 0.01 <= rows[q]["upper"] + 0.02
        counts.append(sum(r["settled"] for r in rows.values()))
    assert counts[1] <= counts[0]


def test_no_way_and_no_trip(spark, built):  # noqa: F811
    edges = b.bucketed(built["needed"].where("lo > 150"), 4)
    rows = spark.createDataFrame([(1, 3, 90, 0), (2, 7, 7, 5)], "query_id long, src long, dst long, departure long")
    found = {r["query_id"]: (r["duration"], r["settled"]) for r in b.earliest_arrival(edges, built["tree"], rows).collect()}
    assert found[1] == (None, 0) and found[2][0] == 0
    assert b.earliest_arrival(edges, built["tree"], rows.limit(0)).count() == 0
    assert b.potentials(edges, built["tree"], rows.where("query_id = 1"), rows.select("query_id", F.col("dst").alias("rank"))).count() == 0
