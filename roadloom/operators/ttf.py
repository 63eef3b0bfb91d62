"""Travel-time functions: periodic piecewise linear functions as rows (edge_id, idx, dep, tt).

Times are milliseconds in a period of a day; travel times between breakpoints are interpolated on the
line of arrival with integer division, as one whole expression, so results are exact integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import cut

DAY = 86_400_000
#: No way.
FAR_AWAY = 1 << 61
#: Labels (queries x nodes) that a task keeps at a time, most queries among them, and tasks that queries are dealt to.
CELLS, TOGETHER, TASKS = 1 << 24, 64, 32


def _along() -> WindowSpec:
    return Window.partitionBy("edge_id").orderBy("dep")


def normalise(ttf: DataFrame) -> DataFrame:
    """Points at 0 and at the period with equal value for functions that aren't constant; a constant one
    has one point at 0. The value at 0 of an open function is that of its last point."""
    shape = ttf.groupBy("edge_id").agg(F.min("tt").alias("lo"), F.max("tt").alias("hi"), F.min("dep").alias("first"), F.max("dep").alias("last"), F.max_by("tt", "dep").alias("end"), F.min_by("tt", "dep").alias("begin"))
    constant = shape.where("lo = hi").select("edge_id", F.lit(0).cast("long").alias("dep"), F.col("lo").alias("tt"))
    open_ = shape.where("lo <> hi")
    edge = F.when(F.col("first") == 0, F.col("begin")).otherwise(F.col("end"))
    start = open_.where("first > 0").select("edge_id", F.lit(0).cast("long").alias("dep"), edge.alias("tt"))
    end = open_.where(F.col("last") < DAY).select("edge_id", F.lit(DAY).cast("long").alias("dep"), edge.alias("tt"))
    inner = ttf.join(open_.select("edge_id"), "edge_id", "left_semi").select("edge_id", "dep", "tt")
    return inner.union(start).union(end).union(constant).select("edge_id", (F.row_number().over(_along()) - 1).cast("long").alias("idx"), "dep", "tt")


def segments(ttf: DataFrame) -> DataFrame:
    """edge_id, dep, tt, dep1, tt1: neighbouring points."""
    return ttf.select("edge_id", "dep", "tt", F.lead("dep").over(_along()).alias("dep1"), F.lead("tt").over(_along()).alias("tt1")).where("dep1 is not null")


def at_line(x: str = "t") -> Column:
    """The travel time at x on the segment (dep, tt, dep1, tt1)."""
    return F.expr(f"(dep + tt) + ({x} - dep) * ((dep1 + tt1) - (dep + tt)) div (dep1 - dep) - {x}")


def evaluate(ttf: DataFrame, at: DataFrame) -> DataFrame:
    """key, edge_id, t, tt: the travel time of each (key, edge_id, t). A function with one or two points
    is constant. Segments of an edge are few, so the join is on the edge with a range filter."""
    few = ttf.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("tt", "dep").alias("const"))
    seg = segments(ttf)
    q = at.withColumn("x", F.pmod("t", F.lit(DAY))).join(few, "edge_id")
    flat = q.where("n <= 2").select("key", "edge_id", "t", F.col("const").alias("tt"))
    line = q.where("n > 2").join(seg, "edge_id").where("dep <= x and x < dep1").select("key", "edge_id", "t", at_line("x").alias("tt"))
    return flat.union(line)


def inverse(ttf: DataFrame, at: DataFrame) -> DataFrame:
    """key, edge_id, arrival, departure: the latest breakpoint-exact departure not arriving later, within a day."""
    seg = segments(ttf).withColumn("a0", F.col("dep") + F.col("tt")).withColumn("a1", F.col("dep1") + F.col("tt1"))
    hit = at.join(seg, "edge_id").where("a0 <= arrival and arrival < a1")
    return hit.select("key", "edge_id", "arrival", F.expr("dep + (arrival - a0) * (dep1 - dep) div (a1 - a0)").alias("departure"))


def bounds(ttf: DataFrame) -> DataFrame:
    """edge_id, lower, upper, points, constant."""
    return ttf.groupBy("edge_id").agg(F.min("tt").alias("lower"), F.max("tt").alias("upper"), F.count(F.lit(1)).alias("points"), (F.min("tt") == F.max("tt")).alias("constant"))


def slopes(ttf: DataFrame) -> DataFrame:
    """edge_id, lowest, highest slope of a function's segments, to six places."""
    slope = (F.col("tt1") - F.col("tt")) / (F.col("dep1") - F.col("dep"))
    return segments(ttf).groupBy("edge_id").agg(F.round(F.min(slope), 6).alias("lowest"), F.round(F.max(slope), 6).alias("highest"))


def fifo_violations(ttf: DataFrame) -> DataFrame:
    """Segments on which a later departure arrives earlier."""
    return segments(ttf).where("dep + tt > dep1 + tt1").select("edge_id", "dep")


def window_average(ttf: DataFrame, start: int, end: int) -> DataFrame:
    """edge_id, mean over [start, end), which may wrap: segments' end values weighted by clipped length."""
    spans = [(start, end)] if start < end else [(start, DAY), (0, end)]
    total = sum(b - a for a, b in spans)
    seg = segments(ttf)
    parts = [seg.select("edge_id", "tt", "tt1", (F.least("dep1", F.lit(b)) - F.greatest("dep", F.lit(a))).alias("len")).where("len > 0") for a, b in spans]
    both = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return both.groupBy("edge_id").agg(F.expr(f"sum((tt + tt1) * len) div 2 div {total}").alias("mean"))


def live_at(ttf: DataFrame, live: DataFrame, at: DataFrame, soon: int) -> DataFrame:
    """key, edge_id, t, tt: up to `soon` the live time where there is one; after it the predicted time
    reached with slope one from the live one."""
    base = evaluate(ttf, at).join(live, "edge_id", "left")
    ramp = F.col("t") - soon
    later = F.when(F.col("live_tt") > F.col("tt"), F.greatest(F.col("live_tt") - ramp, F.col("tt"))).otherwise(F.least(F.col("live_tt") + ramp, F.col("tt")))
    return base.select("key", "edge_id", "t", F.when(F.col("live_tt").isNull(), F.col("tt")).when(F.col("t") <= soon, F.col("live_tt")).otherwise(later).cast("long").alias("tt"))


def small(df: DataFrame, most: int) -> DataFrame:
    """The whole table; with a hint to broadcast it if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def interval_minima(ttf: DataFrame, intervals: DataFrame) -> DataFrame:
    """edge_id, interval_id, lowest: over [start, end], breakpoints and the values at both borders."""
    few = small(intervals, 100_000)
    inside = ttf.join(few, F.col("dep").between(F.col("start"), F.col("end"))).select("edge_id", "interval_id", "tt")
    seg = segments(ttf)
    border = few.select("interval_id", F.explode(F.array("start", "end")).alias("x"))
    edge = seg.join(border, (F.col("dep") <= F.col("x")) & (F.col("x") < F.col("dep1"))).select("edge_id", "interval_id", at_line("x").alias("tt"))
    return inside.union(edge).groupBy("edge_id", "interval_id").agg(F.min("tt").alias("lowest"))


def merge_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """edge_id, dep, tt: both functions' points, the smaller value where both have one."""
    x, y = a.select("edge_id", "dep", F.col("tt").alias("ta")), b.select("edge_id", "dep", F.col("tt").alias("tb"))
    return x.join(y, ["edge_id", "dep"], "full").select("edge_id", "dep", F.least("ta", "tb").alias("tt"))


def _value(dep: np.ndarray, tt: np.ndarray, t: np.ndarray) -> np.ndarray:
    x = np.mod(t, DAY)
    k = np.clip(np.searchsorted(dep, x, side="right") - 1, 0, max(len(dep) - 2, 0))
    if len(dep) == 1:
        return np.full(len(x), tt[0])
    return tt[k] + (tt[k + 1] - tt[k]) * (x - dep[k]) / (dep[k + 1] - dep[k])


def link(f: tuple[np.ndarray, np.ndarray], g: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """h(t) = f(t) + g(t + f(t)): f's points, and those that g's points have under f's inverse."""
    fd, ft = f
    arrival = fd + ft
    wanted = np.concatenate([g[0] + k * DAY for k in range(-1, int(arrival.max() // DAY) + 2)])
    wanted = wanted[(wanted >= arrival[0]) & (wanted <= arrival[-1])]
    extra = np.interp(wanted, arrival, fd) if len(fd) > 1 else np.mod(wanted - ft[0], DAY)
    if len(fd) == 1:
        extra = np.concatenate([[0.0], np.mod(g[0] - ft[0], DAY), [float(DAY)]])
    dep = np.unique(np.concatenate([fd, extra, [0.0, float(DAY)]]))
    first = _value(fd, ft, np.minimum(dep, DAY - 1e-9)) if len(fd) > 1 else np.full(len(dep), ft[0])
    if len(fd) > 1:
        first[dep == DAY] = ft[-1]
    return simplify(dep, first + _value(*g, dep + first))


def merge(f: tuple[np.ndarray, np.ndarray], g: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pointwise minimum with the crossing points."""
    dep = np.unique(np.concatenate([f[0], g[0], [0.0, float(DAY)]]))
    at = lambda h: np.full(len(dep), h[1][0]) if len(h[0]) == 1 else np.interp(dep, *h)
    a, b = at(f), at(g)
    d = a - b
    cross = np.flatnonzero(d[:-1] * d[1:] < 0)
    x = dep[cross] + (dep[cross + 1] - dep[cross]) * d[cross] / (d[cross] - d[cross + 1])
    every = np.unique(np.concatenate([dep, x]))
    return simplify(every, np.minimum(np.interp(every, dep, a), np.interp(every, dep, b)))


def simplify(dep: np.ndarray, tt: np.ndarray, eps: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Without points that lie on the line between their neighbours."""
    keep = [0]
    for k in range(1, len(dep) - 1):
        a, c = keep[-1], k + 1
        if abs(tt[a] + (tt[c] - tt[a]) * (dep[k] - dep[a]) / (dep[c] - dep[a]) - tt[k]) > eps:
            keep.append(k)
    keep.append(len(dep) - 1)
    return dep[keep], tt[keep]


def approximate(dep: np.ndarray, tt: np.ndarray, eps: float, side: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Fewer points, within eps (Douglas-Peucker). side -1 or 1: a lower or upper bound within 2 eps."""
    keep, work = {0, len(dep) - 1}, [(0, len(dep) - 1)]
    while work:
        a, c = work.pop()
        if c - a < 2:
            continue
        line = tt[a] + (tt[c] - tt[a]) * (dep[a + 1 : c] - dep[a]) / (dep[c] - dep[a])
        off = np.abs(line - tt[a + 1 : c])
        k = int(off.argmax())
        if off[k] > eps:
            keep.add(a + 1 + k)
            work += [(a, a + 1 + k), (a + 1 + k, c)]
    at = sorted(keep)
    return dep[at], tt[at] + side * eps


def repair_fifo(dep: np.ndarray, tt: np.ndarray, up: bool = True) -> np.ndarray:
    """Travel times with no overtaking: arrivals raised to the largest so far, or lowered to the least to come."""
    arrival = dep + tt
    arrival = np.maximum.accumulate(arrival) if up else np.minimum.accumulate(arrival[::-1])[::-1]
    return arrival - dep


def speed_profile_times(points: list[tuple[int, int]], length_m: int) -> list[tuple[int, int]]:
    """Travel-time points (ms) of an edge from speeds (start ms, km/h) over a day by driving through the
    speed changes; departures are the speed changes and those that arrive at one."""
    starts = [t for t, _ in points] + [DAY]
    speeds = [max(1, v) for _, v in points]
    whole = float(length_m)

    def drive(t: float) -> float:
        left, now, k = whole, t % DAY, 0
        while k + 1 < len(speeds) and starts[k + 1] <= now:
            k += 1
        spent = 0.0
        while True:
            metres_per_ms = speeds[k % len(speeds)] / 3600
            span = starts[k % len(speeds) + 1] - now
            if metres_per_ms * span >= left:
                return spent + left / metres_per_ms
            left -= metres_per_ms * span
            spent += span
            k, now = k + 1, starts[(k + 1) % len(speeds)] if (k + 1) % len(speeds) else 0

    # departures from which the end is reached just at a change: those drive the edge backwards in time
    back = []
    for k, s in enumerate(starts[1:], 1):
        left, j, at = whole, k - 1, float(s)
        while True:
            metres_per_ms = speeds[j] / 3600
            if metres_per_ms * (at - starts[j]) >= left:
                back.append(at - left / metres_per_ms)
                break
            left -= metres_per_ms * (at - starts[j])
            at, j = starts[j], j - 1
            if j < 0:
                break
    deps = sorted({0, DAY, *starts[:-1], *(int(b) for b in back)})
    return [(t, int(drive(t))) for t in deps]


def linked_functions(pairs: DataFrame) -> DataFrame:
    """key, dep, tt of h = f then g for rows (key, f, g) of points [(dep, tt)], in whole milliseconds."""
    return _combined(pairs, link)


def merged_functions(pairs: DataFrame) -> DataFrame:
    return _combined(pairs, merge)


def _combined(pairs: DataFrame, how) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for key, f, g in zip(part["key"], part["f"], part["g"]):
                a, b = (tuple(np.array([p[k] for p in h], float) for k in ("dep", "tt")) for h in (f, g))
                dep, tt = how(a, b)
                yield pd.DataFrame({"key": key, "dep": dep, "tt": tt})

    return pairs.mapInPandas(run, "key long, dep double, tt double")


class TimedNet:
    """A network of functions in a task: edges by tail and head, their points by departure, as arrays. Searches go for many queries at once, so that a
    step is a few array operations for all of them."""

    def __init__(self, tail: np.ndarray, head: np.ndarray, count: np.ndarray, dep: np.ndarray, tt: np.ndarray):
        self.ids = np.unique(np.concatenate([tail, head]))
        at = np.searchsorted(self.ids, tail)
        self.first, self.tail = np.searchsorted(at, np.arange(len(self.ids) + 1)), at.astype(np.int32)
        self.head = np.searchsorted(self.ids, head).astype(np.int32)
        self.points = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        self.dep, self.tt = dep, tt
        self.halvings = int(count.max(initial=0)).bit_length()
        self.into = np.argsort(self.head, kind="stable").astype(np.int32)
        self.into_first = np.searchsorted(self.head[self.into], np.arange(len(self.ids) + 1))
        self.width = max(1, int(np.median(tt))) // 4 if len(tt) else 1

    def took(self, edge: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Travel times of edges at times of the day."""
        low, high = self.points[edge].astype(np.int64), self.points[edge + 1] - 2  # the last segment starts at high
        lone = high <= low
        k, top = low.copy(), np.maximum(high, low)
        for _ in range(self.halvings):
            mid = (k + top + 1) >> 1
            here = self.dep[mid] <= x
            k, top = np.where(here, mid, k), np.where(here, top, np.maximum(mid - 1, k))
        start, tt = self.dep[k].astype(np.int64), self.tt[k].astype(np.int64)
        then = np.minimum(k + 1, len(self.dep) - 1)
        span, rise = self.dep[then] - start, self.dep[then] + self.tt[then].astype(np.int64) - start - tt
        return np.where(lone, self.tt[low], start + tt + (x - start) * rise // np.where(lone, 1, span) - x)

    def _edges(self, first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all edges of nodes, and the place in `nodes` of each."""
        n = first[nodes + 1] - first[nodes]
        of = np.repeat(np.arange(len(nodes)), n)
        return first[nodes][of] + np.arange(len(of)) - (np.cumsum(n) - n)[of], of

    def search(self, src: np.ndarray, dst: np.ndarray, departure: np.ndarray) -> np.ndarray:
        """Durations to all nodes that are reached before the end (FAR_AWAY: not reached), a row for each query; src, dst by position."""
        n, many = len(self.ids), len(src)
        took, rows = np.full(many * n, FAR_AWAY), np.arange(many)
        waits, owner = np.zeros(many * n, bool), np.zeros(many * n, np.int32)
        ends, open_ = rows * n + dst, rows * n + src
        took[open_], waits[open_], level = 0, True, 0
        while len(open_):
            so_far = took[open_]
            alive = so_far < took[ends][open_ // n]
            waits[open_[~alive]] = False
            open_, so_far = open_[alive], so_far[alive]
            now = so_far < level
            if not now.any():
                if len(open_):
                    level = so_far.min() + self.width
                continue
            keys, d0, open_ = open_[now], so_far[now], open_[~now]
            waits[keys] = False
            query, node = np.divmod(keys, n)
            edge, of = self._edges(self.first, node)
            query, d0 = query[of], d0[of]
            new = d0 + self.took(edge, (departure[query] + d0) % DAY)
            to = query * n + self.head[edge]
            better = new < np.minimum(took[to], took[ends][query])
            to, new = to[better], new[better]
            np.minimum.at(took, to, new)
            to = to[~waits[to]]
            owner[to] = np.arange(len(to))
            to = to[owner[to] == np.arange(len(to))]
            waits[to] = True
            open_ = np.concatenate([open_, to])
        return took.reshape(many, n)

    def path(self, took: np.ndarray, src: int, dst: int, departure: int) -> list[int]:
        """Positions of a fastest path, backwards by the earliest node (ties: the smaller one) from which the next is reached in time."""
        out, v = [dst], dst
        while v != src:
            edge = self.into[self.into_first[v] : self.into_first[v + 1]]
            u = self.tail[edge]
            edge, u = edge[took[u] < FAR_AWAY], u[took[u] < FAR_AWAY]
            u = u[took[u] + self.took(edge, (departure + took[u]) % DAY) == took[v]]
            v = int(u[np.lexsort((u, took[u]))[0]])
            out.append(v)
        return out[::-1]


def _timed_net(points: DataFrame) -> TimedNet:
    """Of edges with their points (tail, head, edge_id, p); the arrays come as Arrow's columns, points as 32-bit numbers."""
    x = points.orderBy("tail", "head", "edge_id").select("tail", "head", F.transform("p", lambda a: a["dep"].cast("int")).alias("dep"), F.transform("p", lambda a: a["tt"].cast("int")).alias("tt")).toArrow()
    flat = lambda c: x[c].combine_chunks().flatten().to_numpy().astype(np.int32)
    count = pc.list_value_length(x["dep"]).to_numpy().astype(np.int64)
    return TimedNet(x["tail"].to_numpy(), x["head"].to_numpy(), count, flat("dep"), flat("tt"))


def earliest_arrival(edges: DataFrame, ttf: DataFrame, od: DataFrame, only: DataFrame | None = None, most: int = 40_000_000) -> DataFrame:
    """query_id, duration (null if unreachable), path of each (query_id, src, dst, departure).

    Functions have positive times and no overtaking. A network of up to `most` points goes to the tasks as arrays (8 bytes
    a point), queries on a larger one are answered by joins. Ties: smaller node first."""
    keep = edges if only is None else edges.join(only, "edge_id", "left_semi")
    points = keep.select("edge_id", "tail", "head").join(ttf, "edge_id").groupBy("edge_id", "tail", "head").agg(F.array_sort(F.collect_list(F.struct("dep", "tt"))).alias("p"))
    if ttf.count() > most:
        return _arrival_loop(points, od)
    shared = edges.sparkSession.sparkContext.broadcast(_timed_net(points))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        n = len(net.ids)
        size = max(1, min(TOGETHER, CELLS // max(1, n)))
        for part in parts:
            for k in range(0, len(part), size):
                some, out = part.iloc[k : k + size], []
                q, src, dst, start = (some[c].to_numpy(np.int64) for c in ("query_id", "src", "dst", "departure"))
                a, b = np.searchsorted(net.ids, src), np.searchsorted(net.ids, dst)
                there = (a < n) & (b < n)
                there[there] = (net.ids[a[there]] == src[there]) & (net.ids[b[there]] == dst[there])
                row = np.cumsum(there) - 1
                took = net.search(a[there], b[there], start[there]) if there.any() else None
                for i in range(len(q)):
                    if not there[i] or took[row[i], b[i]] == FAR_AWAY:
                        out.append((q[i], 0, [src[i]]) if src[i] == dst[i] else (q[i], None, None))
                    else:
                        out.append((q[i], int(took[row[i], b[i]]), net.ids[net.path(took[row[i]], int(a[i]), int(b[i]), int(start[i]))].tolist()))
                yield pd.DataFrame(out, columns=["query_id", "duration", "path"]).astype({"duration": "Int64"})

    return od.select("query_id", "src", "dst", "departure").repartition(TASKS).mapInPandas(run, "query_id long, duration long, path array<long>")


def _arrival_loop(points: DataFrame, od: DataFrame) -> DataFrame:
    """`earliest_arrival` by joins, all queries in one loop: labels that come no later than a query's end go over all edges, until none is earlier."""
    ways, od = cut(points.select(F.col("tail").alias("pred"), F.col("head").alias("to"), "p")), cut(od.select("query_id", "src", "dst", "departure"))
    at = F.expr("greatest(least(size(filter(p, x -> x.dep <= now)), size(p) - 1), 1)")
    line = F.expr("a.dep + a.tt + (now - a.dep) * (b.dep + b.tt - a.dep - a.tt) div (b.dep - a.dep) - now")  # no overtaking: the product isn't negative
    took = F.when(F.size("p") <= 2, F.col("a.tt")).otherwise(line)
    state = cut(od.select("query_id", F.col("src").alias("node"), F.lit(0).cast("long").alias("took"), F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("pred"), F.lit(True).alias("fresh")))
    while state.where("fresh").head(1):
        ends = od.join(state.select("query_id", F.col("node").alias("dst"), F.col("took").alias("most")), ["query_id", "dst"], "left").select("query_id", "departure", "most")
        new = state.where("fresh").join(ends, "query_id").where("most is null or took < most").select("query_id", F.col("node").alias("pred"), F.col("took").alias("before"), "departure", "most").join(ways, "pred")
        new = new.withColumn("now", F.expr(f"(departure + before) % {DAY}")).withColumn("k", at).withColumn("a", F.expr("p[k - 1]")).withColumn("b", F.expr("p[k]"))
        new = new.withColumn("took", F.col("before") + took).where("most is null or took <= most").select("query_id", F.col("to").alias("node"), "took", "before", "pred", F.lit(None).cast("long").alias("old"))
        both = state.select("query_id", "node", "took", "before", "pred", F.col("took").alias("old")).union(new)
        best = both.groupBy("query_id", "node").agg(F.min(F.struct("took", "before", "pred")).alias("b"), F.min("old").alias("old"))
        state = cut(best.select("query_id", "node", "b.took", "b.before", "b.pred", (F.col("old").isNull() | (F.col("b.took") < F.col("old"))).alias("fresh")))
    now = cut(od.select("query_id", F.col("dst").alias("node")).join(state, ["query_id", "node"]).select("query_id", "node", "took", "pred", F.lit(0).cast("long").alias("k")))
    found, steps = now.select("query_id", F.col("took").alias("duration")), now.select("query_id", "node", "k")
    while now.where("pred is not null").head(1):
        last = now.where("pred is not null").select("query_id", F.col("pred").alias("node"), (F.col("k") + 1).alias("k"))
        now = cut(last.join(state, ["query_id", "node"]).select("query_id", "node", "took", "pred", "k"))
        steps = cut(steps.union(now.select("query_id", "node", "k")))
    paths = steps.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "node")), asc=False), lambda x: x["node"]).alias("path"))
    return od.select("query_id").join(found, "query_id", "left").join(paths, "query_id", "left").select("query_id", "duration", "path")


def profile(edges: DataFrame, ttf: DataFrame, od: DataFrame, most: int = 5_000_000) -> DataFrame:
    """query_id, dep, tt: the travel-time function of a whole day for each (query_id, src, dst), by label
    correction with function-valued labels."""
    if ttf.count() > most:
        raise ValueError("the network is too large to send to tasks")
    rows = edges.join(ttf, "edge_id").groupBy("edge_id", "tail", "head").agg(F.array_sort(F.collect_list(F.struct("dep", "tt"))).alias("p"))
    net: dict[int, list] = {}
    for r in rows.toLocalIterator():
        net.setdefault(r["tail"], []).append((r["head"], np.array([x["dep"] for x in r["p"]], float), np.array([x["tt"] for x in r["p"]], float)))
    shared = edges.sparkSession.sparkContext.broadcast(net)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = shared.value
        for part in parts:
            for q, src, dst in zip(part["query_id"], part["src"], part["dst"]):
                zero = (np.array([0.0, float(DAY)]), np.zeros(2))
                label, heap, upper = {src: zero}, [(0.0, src)], np.inf
                queued = {src}
                while heap:
                    low, u = heapq.heappop(heap)
                    if u not in queued:
                        continue
                    queued.discard(u)
                    if low > upper:
                        break
                    for v, dep, tt in graph.get(u, ()):
                        new = link(label[u], (dep, tt))
                        old = label.get(v)
                        both = new if old is None else merge(old, new)
                        if old is None or len(both[0]) != len(old[0]) or np.abs(both[1] - old[1]).max() > 1e-3 or np.abs(both[0] - old[0]).max() > 1e-3:
                            label[v] = both
                            if v == dst:
                                upper = both[1].max()
                            queued.add(v)
                            heapq.heappush(heap, (both[1].min(), v))
                if dst in label:
                    yield pd.DataFrame({"query_id": q, "dep": label[dst][0], "tt": label[dst][1]})

    return od.select("query_id", "src", "dst").repartition(8).mapInPandas(run, "query_id long, dep double, tt double")


def crop(ttf: DataFrame, start: int, end: int) -> DataFrame:
    """edge_id, dep, tt: the part of each function over [start, end] of the day, with its values at both borders."""
    inside = ttf.where((F.col("dep") > start) & (F.col("dep") < end)).select("edge_id", "dep", "tt")
    border = segments(ttf).select("*", F.explode(F.array(F.lit(start).cast("long"), F.lit(end).cast("long"))).alias("x"))
    # the end of the day belongs to the last segment
    at = border.where("(dep <= x and x < dep1) or (x = dep1 and dep1 = " + str(DAY) + ")")
    return inside.union(at.select("edge_id", F.col("x").alias("dep"), F.when(F.col("x") == F.col("dep1"), F.col("tt1")).otherwise(at_line("x")).alias("tt")))


def append(first: DataFrame, second: DataFrame, at: int) -> DataFrame:
    """edge_id, dep, tt: the first function before `at` and the second from there on; both end and begin at it."""
    return crop(first, 0, at).where(F.col("dep") < at).union(crop(second, at, DAY))


def turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """1 if a, b, c turn left (counter-clockwise), -1 if right, 0 if they lie on a line."""
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)).cast("long")


def crossing(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Where in a common interval, in whole millionths of it (halves up), two lines of whole numbers cross that go from a0
    to a1 and from b0 to b1; null if they don't."""
    d0, d1 = a0 - b0, a1 - b1
    whole = F.abs(d0 - d1)
    return F.when((d0 != d1) & (F.signum(d0) * F.signum(d1) <= 0), F.call_function("div", 2_000_000 * F.abs(d0) + whole, 2 * whole))


def switch_points(ttf: DataFrame, live: DataFrame, soon: int) -> DataFrame:
    """edge_id, switch: when the live value (edge_id, live_tt), held until `soon` and then falling or rising by as much as
    time passes, meets the function again; null: not on this day. Whole milliseconds, rounded down."""
    seg = segments(ttf).join(live, "edge_id").where(F.col("dep1") > soon)
    at_soon = evaluate(ttf, live.select("edge_id", F.col("edge_id").alias("key"), F.lit(soon).cast("long").alias("t"))).select("edge_id", F.col("tt").alias("now"))
    both = seg.join(at_soon, "edge_id").withColumn("way", F.when(F.col("live_tt") > F.col("now"), -1).otherwise(1))
    # function: tt + slope (t - dep); ramp: live_tt + way (t - soon)
    slope = (F.col("tt1") - F.col("tt")) / (F.col("dep1") - F.col("dep"))
    t = (F.col("live_tt") - F.col("way") * soon - F.col("tt") + slope * F.col("dep")) / (slope - F.col("way"))
    hit = both.withColumn("t", F.floor(t).cast("long")).where((F.col("t") >= soon) & (F.col("t") >= F.col("dep")) & (F.col("t") < F.col("dep1")))
    return live.select("edge_id").join(hit.groupBy("edge_id").agg(F.min("t").alias("switch")), "edge_id", "left")


def delay_statistics(ttf: DataFrame) -> DataFrame:
    """One row: mean of (highest - lowest) / lowest over all functions and over those that aren't constant, and the same
    ratio of the sums."""
    low, high, n = F.col("low"), F.col("high"), F.count(F.lit(1))
    per = ttf.groupBy("edge_id").agg(F.min("tt").alias("low"), F.max("tt").alias("high"))
    rel = F.when(low > 0, (high - low) / low).otherwise(0.0)
    varies = low < high
    return per.agg(
        (F.sum(F.when(varies, rel)) / F.count_if(varies)).alias("nonconst_mean"),
        (F.sum(rel) / n).alias("mean"),
        (F.sum(F.when(varies, high - low)) / F.sum(F.when(varies, low))).alias("nonconst_total"),
        (F.sum(high - low) / F.sum(low)).alias("total"),
    )


def along_paths(edges: DataFrame, ttf: DataFrame, trips: DataFrame) -> DataFrame:
    """query_id, idx, node, t of trips (query_id, departure, path): when each node of a given path is reached; the fastest
    parallel edge counts. A step without an edge ends the trip there."""
    steps = trips.select("query_id", "departure", F.posexplode("path").alias("idx", "node")).withColumn("next", F.lead("node").over(Window.partitionBy("query_id").orderBy("idx")))
    points = edges.join(ttf, "edge_id").groupBy("edge_id", "tail", "head").agg(F.array_sort(F.collect_list(F.struct("dep", "tt"))).alias("p"))
    ways = points.groupBy("tail", "head").agg(F.collect_list("p").alias("ways"))
    both = steps.join(ways, (F.col("node") == F.col("tail")) & (F.col("next") == F.col("head")), "left").select("query_id", "departure", "idx", "node", "ways")

    def run(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        from bisect import bisect_right

        part, rows = part.sort_values("idx"), []
        t = int(part["departure"].iloc[0])
        for k, node, ways in zip(part["idx"], part["node"], part["ways"]):
            rows.append((keys[0], k, node, t))
            if ways is None:
                break
            best = None
            for p in ways:
                dep, tt, x = [a["dep"] for a in p], [a["tt"] for a in p], t % DAY
                j = min(bisect_right(dep, x) - 1, len(dep) - 2)
                d = tt[0] if len(dep) <= 2 else dep[j] + tt[j] + (x - dep[j]) * (dep[j + 1] + tt[j + 1] - dep[j] - tt[j]) // (dep[j + 1] - dep[j]) - x
                best = d if best is None else min(best, d)
            t += best
        return pd.DataFrame(rows, columns=["query_id", "idx", "node", "t"])

    return both.groupBy("query_id").applyInPandas(run, "query_id long, idx long, node long, t long")
