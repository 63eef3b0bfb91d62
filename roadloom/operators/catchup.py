"""Time-dependent queries on a customized hierarchy: bounds per edge, corridors, potentials from bounds.

Lower and upper bounds of the functions are customized like any metric. A query first walks the hierarchy with both:
the upper bound of the best way tells which hierarchy edges can matter at all, and these are unpacked to edges of the
network. The search itself evaluates functions on those edges only, in order of arrival plus the lower bound of what
is left. Answers are the same as those of a search over the whole network.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .hierarchy import INFINITE, Cch, SharedCch, customize, respecting
from .ttf import DAY, interval_minima


def bound_weights(cch: DataFrame, ranked: DataFrame, ttf: DataFrame, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The customized completion under lower and under upper bounds of the functions; ranked (edge_id, tail, head)
    between ranks."""
    bounds = ttf.groupBy("edge_id").agg(F.min("tt").alias("lower"), F.max("tt").alias("upper"))
    edges = ranked.select("edge_id", "tail", "head").join(bounds, "edge_id")
    return tuple(cut(customize(respecting(cch, edges.select("tail", "head", F.col(c).alias("weight"))), cells=cells)) for c in ("lower", "upper"))


def interval_query(lower: DataFrame, upper: DataFrame, od: DataFrame) -> DataFrame:
    """query_id, lower, upper: bounds of the travel time at any departure, for od (query_id, src, dst) between ranks."""
    low, high = SharedCch(lower), SharedCch(upper)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            a, b = ([c.meet(s, t)[0] for s, t in zip(part["src"], part["dst"])] for c in (_own(low, "low"), _own(high, "high")))
            yield pd.DataFrame({"query_id": part["query_id"], "lower": pd.array([None if x == INFINITE else int(x) for x in a], "Int64"), "upper": pd.array([None if x == INFINITE else int(x) for x in b], "Int64")})

    return od.select("query_id", "src", "dst").repartition(16, "query_id").mapInPandas(run, "query_id long, lower long, upper long")


_kept: dict[str, tuple[str, Cch]] = {}


def _own(shared: SharedCch, role: str) -> Cch:
    """A worker's copy; one for each role is kept."""
    if role not in _kept or _kept[role][0] != shared.key:
        _kept[role] = shared.key, Cch(*shared.arrays.value)
    return _kept[role][1]


def corridor(low: Cch, high: Cch, s: int, t: int) -> tuple[float, set[tuple[int, int]]]:
    """Upper bound of the best way, and the edges (tail, head) between ranks that a way within it can use."""
    most = high.meet(s, t)[0]
    used: set[tuple[int, int]] = set()
    if most == INFINITE:
        return most, used
    (a, _), (b, _) = low.climb(s, 1), low.climb(t, 2)
    # what is at least left above each ancestor: to the other end over any common ancestor
    left = [{}, {}]
    for k, (own, other) in enumerate(((a, b), (b, a))):
        for v in sorted(own, reverse=True):
            rest = [other.get(v, INFINITE)] + [e[1 + k] + left[k].get(e[0], INFINITE) for e in low.above.get(v, ())]
            left[k][v] = min(rest)
    todo = [(v, e[0]) for v in a for e in low.above.get(v, ()) if a[v] + e[1] + left[0].get(e[0], INFINITE) <= most]
    todo += [(e[0], v) for v in b for e in low.above.get(v, ()) if b[v] + e[2] + left[1].get(e[0], INFINITE) <= most]
    while todo:
        x, y = todo.pop()
        if (x, y) in used:
            continue
        used.add((x, y))
        bound = high.weight(x, y)
        small, large = (x, y) if len(low.below.get(x, ())) < len(low.below.get(y, ())) else (y, x)
        for v in low.below.get(small, ()):
            if v in low.below.get(large, ()) and low.below[x][v][1] + low.below[y][v][0] <= bound:
                todo += [(x, v), (v, y)]
    return most, used


def _value(dep: list[int], tt: list[int], t: int) -> int:
    x = t % DAY
    if len(dep) <= 2:
        return tt[0]
    k = bisect_right(dep, x) - 1
    a = dep[k] + tt[k]
    return a + (x - dep[k]) * (dep[k + 1] + tt[k + 1] - a) // (dep[k + 1] - dep[k]) - x


def earliest_arrival(lower: DataFrame, upper: DataFrame, ranked: DataFrame, ttf: DataFrame, od: DataFrame, metrics: dict[int, DataFrame] | None = None, chosen: DataFrame | None = None, most: int = 5_000_000) -> DataFrame:
    """query_id, duration (null: no way), settled of od (query_id, src, dst, departure) between ranks, on the corridor that
    the bounds leave.

    metrics, chosen: weights (like `lower`) by metric, each a lower bound at the departures that it is chosen for
    (query_id, metric_id); then the search is led by the query's metric instead of the bound over the whole day."""
    if ttf.count() > most:
        raise ValueError("the network is too large to send to tasks")
    net: dict[int, list] = {}
    points = ranked.select("edge_id", "tail", "head").join(ttf, "edge_id").groupBy("edge_id", "tail", "head").agg(F.array_sort(F.collect_list(F.struct("dep", "tt"))).alias("p"))
    for r in points.orderBy("tail", "head").toLocalIterator():
        net.setdefault(r["tail"], []).append((r["head"], [x["dep"] for x in r["p"]], [x["tt"] for x in r["p"]]))
    low, high = SharedCch(lower), SharedCch(upper)
    led = {k: SharedCch(w) for k, w in (metrics or {}).items()}
    shared = ttf.sparkSession.sparkContext.broadcast(net)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for q, s, t, start, metric in zip(*(part[c].tolist() for c in ("query_id", "src", "dst", "departure", "metric_id"))):
                bound, used = corridor(_own(low, "low"), _own(high, "high"), s, t)
                pi = (_own(led[metric], f"metric {metric}") if metric in led else _own(low, "low")).potential(t)
                best, heap, done, settled = {s: start}, [(start + pi(s), start, s)], None, 0
                while heap and bound < INFINITE:
                    _, now, u = heapq.heappop(heap)
                    if now > best[u]:
                        continue
                    settled += 1
                    if u == t:
                        done = now - start
                        break
                    for v, dep, tt in shared.value.get(u, ()):
                        if (u, v) in used:
                            new = now + _value(dep, tt, now)
                            if new < best.get(v, new + 1) and new + pi(v) <= start + bound:
                                best[v] = new
                                heapq.heappush(heap, (new + pi(v), new, v))
                rows.append((q, done, settled))
            yield pd.DataFrame(rows, columns=["query_id", "duration", "settled"]).astype({"duration": "Int64"})

    asked = od.select("query_id", "src", "dst", "departure")
    asked = asked.join(chosen, "query_id", "left") if chosen is not None else asked.withColumn("metric_id", F.lit(-1))
    return asked.fillna({"metric_id": -1}).repartition(8, "query_id").mapInPandas(run, "query_id long, duration long, settled long")


def metric_weights(cch: DataFrame, ranked: DataFrame, ttf: DataFrame, metrics: DataFrame, cells: DataFrame | None = None) -> dict[int, DataFrame]:
    """For each metric (metric_id, start, end; a few dozen) the customized completion under the functions' minima in it."""
    minima = cut(interval_minima(ttf, metrics.select(F.col("metric_id").alias("interval_id"), "start", "end")))
    out = {}
    for r in metrics.select("metric_id").collect():
        k = r["metric_id"]
        own = ranked.select("edge_id", "tail", "head").join(minima.where(F.col("interval_id") == k), "edge_id").select("tail", "head", F.col("lowest").alias("weight"))
        out[k] = cut(customize(respecting(cch, own), cells=cells))
    return out
