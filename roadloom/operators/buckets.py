"""Lower bounds of what is left of a trip that know the time of day: a hierarchy's functions as their minima in equal parts of the day, looked up
between the first and the last time at which a node can be passed, and earliest arrivals led by them.

A trip that departs at x passes a node at x plus the least travel time from the source at the earliest, and at the latest when the least
travel time to the target is left of the trip's upper bound. On any way within that bound, an edge out of the node costs at least the least
of its minima in the parts of the day between the two, across midnight too. Summed up over ways to the target, this is at most what any fastest
way still takes, and at least the bound of the whole day. A query is one group with the edges above its ends; nothing is collected or sent to all tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hierarchy import ancestors
from .ttf import DAY

#: Times are widened by so much (ms) before a part of the day is looked up, for rounding.
SLACK = 1.0
NEVER = float("inf")


def bucketed(functions: DataFrame, buckets: int) -> DataFrame:
    """lo, hi, dir, dep, tt, lows (the function's minimum in each of so many equal parts of the day, borders included), high (its maximum)."""
    borders = np.linspace(0, DAY, buckets + 1)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            lows, high = [], []
            for dep, tt in zip(part["dep"], part["tt"]):
                at = np.interp(borders, dep, tt)
                low = np.minimum(at[:-1], at[1:])
                np.minimum.at(low, np.minimum((np.asarray(dep) * buckets // DAY).astype(int), buckets - 1), tt)
                lows.append(low)
                high.append(float(np.max(tt)))
            yield part.assign(lows=lows, high=high)

    return functions.select("lo", "hi", "dir", "dep", "tt").mapInPandas(run, "lo long, hi long, dir string, dep array<double>, tt array<double>, lows array<double>, high double")


def least(lows: np.ndarray, first: float, last: float) -> float:
    """The least of a day's minima between two times, on whatever days they are."""
    n = len(lows)
    a, b = int((first - SLACK) * n // DAY), int((last + SLACK) * n // DAY)
    if b - a + 1 >= n:
        return float(lows.min())
    a, b = a % n, b % n
    return float(lows[a : b + 1].min()) if a <= b else float(min(lows[a:].min(), lows[: b + 1].min()))


class Corridor:
    """A trip's bounds on the edges above its ends."""

    def __init__(self, src: int, dst: int, departure: float, edges: pd.DataFrame) -> None:
        self.src, self.dst, self.departure = src, dst, float(departure)
        self.up: dict[int, list] = {}
        self.down: dict[int, list] = {}
        for e in edges.itertuples(index=False):
            lows = np.asarray(e.lows, float)
            (self.up if e.dir == "up" else self.down).setdefault(e.lo, []).append((e.hi, lows, float(lows.min()), e.high, e))
        low, high = lambda e: e[2], lambda e: e[3]
        there, back = self._climb(self.up, src, high), self._climb(self.down, dst, high)
        self.upper = min((d + back[v] for v, d in there.items() if v in back), default=NEVER)
        if self.upper == NEVER:
            return
        self.left_day = self._left(self._climb(self.down, dst, low), lambda v, e: e[2])
        self.gone = self._gone(self._climb(self.up, src, low))
        self.target = self._climb(self.down, dst, None)
        self.left = self._left(self.target, self._within)

    def _climb(self, ways: dict[int, list], start: int, cost) -> dict[int, float]:
        """Costs of the ways between `start` and all ranks above it."""
        out = {start: 0.0}
        for v in sorted(ways):
            if v in out:
                for e in ways[v]:
                    new = out[v] + (cost(e) if cost else self._within(e[0], e))
                    if new < out.get(e[0], NEVER):
                        out[e[0]] = new
        return out

    def _gone(self, there: dict[int, float]) -> dict[int, float]:
        """Least travel times from the source to all ranks above the target; other ranks have none that holds for ways down to them."""
        out: dict[int, float] = {}
        for v in sorted(self.down, reverse=True):
            out[v] = min([there.get(v, NEVER)] + [out.get(e[0], there.get(e[0], NEVER)) + e[2] for e in self.down[v]])
        for v in {e[0] for es in self.down.values() for e in es} - set(out):
            out[v] = there.get(v, NEVER)
        return out

    def _left(self, target: dict[int, float], cost) -> dict[int, float]:
        """What is left to the target from all ranks whose edges up are known."""
        out = dict(target)
        for v in sorted(self.up, reverse=True):
            out[v] = min([target.get(v, NEVER)] + [cost(v, e) + out.get(e[0], NEVER) for e in self.up[v]])
        return out

    def _within(self, v: int, e: tuple) -> float:
        """The least that edge e takes at v on this trip; infinite if v can't be passed in time."""
        first, last = self.gone.get(v, 0.0), self.upper - self.left_day.get(v, NEVER)
        return least(e[1], self.departure + first, self.departure + last) if first <= last + SLACK else NEVER

    def arrive(self) -> tuple[float | None, int]:
        """Duration of the fastest way, and how many ranks were settled: up from the source and then down to the target, in the
        order of arrival plus the bound of what is left."""
        below: dict[int, list] = {}
        for lo, ways in self.down.items():
            for e in ways:
                below.setdefault(e[0], []).append((lo, e[4]))
        most = self.departure + self.upper + SLACK
        best = {(self.src, 0): self.departure}
        heap, settled = [(self.departure + self.left.get(self.src, NEVER), self.departure, self.src, 0)], 0
        while heap:
            key, now, v, phase = heapq.heappop(heap)
            if now > best[v, phase]:
                continue
            if v == self.dst and phase:
                return now - self.departure, settled
            settled += 1
            ways = [(e[0], 0, now + float(np.interp(now % DAY, e[4].dep, e[4].tt))) for e in self.up.get(v, ())] if not phase else []
            if phase or v in self.target:
                ways += [(lo, 1, now + float(np.interp(now % DAY, e.dep, e.tt))) for lo, e in below.get(v, ())]
            if v == self.dst:
                ways.append((v, 1, now))
            for w, next_phase, at in ways:
                key = at + (self.target if next_phase else self.left).get(w, NEVER)
                if key <= most and at < best.get((w, next_phase), NEVER):
                    best[w, next_phase] = at
                    heapq.heappush(heap, (key, at, w, next_phase))
        return None, settled


def _grouped(od: DataFrame, edges: DataFrame, tree: DataFrame, starts: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    """`run` on each query with the edges up from the ranks above its starts (query_id, rank) and those down to its target's."""
    ends = starts.select("query_id", F.lit("up").alias("dir"), F.col("rank").alias("start")).union(od.select("query_id", F.lit("down"), "dst")).distinct()
    above = ends.join(ancestors(tree, ends.select(F.col("start").alias("rank"))), "start").select("query_id", "dir", F.col("rank").alias("lo")).distinct()
    own = above.join(edges, ["lo", "dir"]).select(F.col("query_id").alias("q"), "lo", "hi", "dir", *columns)
    asked = od.select("query_id", "src", "dst", F.col("departure").cast("double").alias("departure"))
    nodes = starts.groupBy("query_id").agg(F.collect_set("rank").alias("ranks"))
    return asked.join(nodes, "query_id").groupBy("query_id").cogroup(own.groupBy("q")).applyInPandas(run, schema)


def potentials(edges: DataFrame, tree: DataFrame, od: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, rank, bound, day_bound of the ranks asked for (query_id, rank): what a trip (query_id, src, dst, departure) still takes from there
    at least, if it passes there within its upper bound, by `edges` (`bucketed`) and by the whole day's minima. Null bound: no way over there is within
    the upper bound; no row: no way to the target at all. Query ids are unique; repeated ranks count once."""

    def run(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q in asked.itertuples(index=False):
            c = Corridor(q.src, q.dst, q.departure, own)
            if c.upper < NEVER:
                for v in q.ranks:
                    day = c.left_day.get(v, NEVER)
                    if day < NEVER:
                        bound = c.left.get(v, NEVER)
                        inside = bound < NEVER and c.gone.get(v, 0.0) + bound <= c.upper + SLACK
                        out.append((q.query_id, int(v), bound if inside else None, day))
        return pd.DataFrame(out, columns=["query_id", "rank", "bound", "day_bound"])

    starts = od.select("query_id", F.col("src").alias("rank")).union(nodes.select("query_id", "rank"))
    found = _grouped(od, edges, tree, starts, ["lows", "high"], run, "query_id long, rank long, bound double, day_bound double")
    return found.join(nodes.select("query_id", "rank").distinct(), ["query_id", "rank"], "left_semi")


def earliest_arrival(edges: DataFrame, tree: DataFrame, od: DataFrame) -> DataFrame:
    """query_id, duration (null: no way), bound, upper, settled of each trip (query_id, src, dst, departure) between ranks, led by the bounds
    of `edges` (`bucketed`). Trips without any edge above their ends have no way, but from a node to itself."""

    def run(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q in asked.itertuples(index=False):
            c = Corridor(q.src, q.dst, q.departure, own)
            if c.upper == NEVER:
                out.append((q.query_id, None, None, None, 0))
            else:
                duration, settled = c.arrive()
                out.append((q.query_id, duration, c.left[q.src], c.upper, settled))
        return pd.DataFrame(out, columns=["query_id", "duration", "bound", "upper", "settled"])

    starts = od.select("query_id", F.col("src").alias("rank"))
    return _grouped(od, edges, tree, starts, ["dep", "tt", "lows", "high"], run, "query_id long, duration double, bound double, upper double, settled long")
